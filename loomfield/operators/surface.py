"""Surfaces from the field: cubes, quads, block-owned meshes and their change logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import keys as K

from .cut import cut

CORNER_STEPS = {(i, j, k): i * K.STEP["x"] + j * K.STEP["y"] + k for i in (0, 1) for j in (0, 1) for k in (0, 1)}
#: the twelve edges of a cube: pairs of corners that differ along one axis
EDGES = [(a, b) for a in CORNER_STEPS for b in CORNER_STEPS if a < b and sum(x != y for x, y in zip(a, b)) == 1]


def sign_edges(nodes: DataFrame) -> DataFrame:
    """Lattice edges whose ends lie on different sides: (k, axis, va, vb). Zero counts as outside."""
    axes = F.array(*[F.struct(F.lit(i).alias("axis"), F.lit(K.STEP[a]).cast("bigint").alias("step")) for i, a in enumerate("xyz")])
    asked = nodes.select("k", F.col("s").alias("va"), F.explode(axes).alias("e")).select("k", "va", "e.axis", (F.col("k") + F.col("e.step")).alias("other"))
    return asked.join(nodes.select(F.col("k").alias("other"), F.col("s").alias("vb")), "other").where("(va < 0) <> (vb < 0)").select("k", "axis", "va", "vb")


def cube_vertices(nodes: DataFrame, least_corners: int = 3, least_chance: float | None = None, spread: float = 0.38) -> DataFrame:
    """One vertex for each cube that the surface crosses: the mean of its edge crossings, in cube units.

    Candidate cubes are those with a corner on the inner side, so the eight corners are looked up
    only there; corners that were not observed count as +1. With ``least_chance`` cubes need a mean chance of
    their observed corners of that much: near the surface and seen with some weight w.
    """
    inner = nodes.where("s < 0").select("k", F.explode(K.offsets([-s for s in CORNER_STEPS.values()])).alias("step"))
    cubes = inner.select((F.col("k") + F.col("step")).alias("cube")).distinct()
    corners = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(s).cast("bigint").alias("step")) for i, s in enumerate(CORNER_STEPS.values())])
    asked = cubes.select("cube", F.explode(corners).alias("c")).select("cube", "c.i", (F.col("cube") + F.col("c.step")).alias("k"))
    chance = F.lit(1.0) if least_chance is None else F.exp(-0.5 * F.pow(F.col("s") / spread, 2)) * (1 - F.exp(-F.col("w") / 2))
    seen = asked.join(nodes.select("k", "s", chance.alias("chance")), "k")
    wide = seen.groupBy("cube").agg(F.count(F.lit(1)).alias("observed"), F.avg("chance").alias("chance"), *[F.coalesce(F.max(F.when(F.col("i") == i, F.col("s"))), F.lit(1.0)).alias(f"v{i}") for i in range(8)]).where((F.col("observed") >= least_corners) & (F.col("chance") >= (least_chance or 0.0)))
    index = {c: i for i, c in enumerate(CORNER_STEPS)}
    crossings = []
    for a, b in EDGES:
        va, vb = F.col(f"v{index[a]}"), F.col(f"v{index[b]}")
        # only ends on different sides are used, and those differ
        t = va / F.when(va != vb, va - vb)
        crossings.append(((va < 0) != (vb < 0), [F.lit(float(x)) + (y - x) * t for x, y in zip(a, b)]))
    n = sum((F.when(on, 1).otherwise(0) for on, _ in crossings), F.lit(0))
    mean = [sum((F.when(on, p[i]).otherwise(0.0) for on, p in crossings), F.lit(0.0)) / n for i in range(3)]
    return wide.withColumn("n", n).where("n > 0").select("cube", "observed", "n", *[m.alias(a) for m, a in zip(mean, "xyz")])


#: the two axes across each axis
ACROSS = {0: ("y", "z"), 1: ("x", "z"), 2: ("x", "y")}


def _around(nodes: DataFrame, vertices: DataFrame) -> DataFrame:
    """For each crossing edge with a vertex in all four cubes around it: c0 .. c3 and their vertices p0 .. p3.

    The four cubes of an edge are four rows that meet the vertices in one join.
    """
    corner = lambda axis, i: -[0, K.STEP[ACROSS[axis][0]], K.STEP[ACROSS[axis][0]] + K.STEP[ACROSS[axis][1]], K.STEP[ACROSS[axis][1]]][i]
    steps = F.array(*[K.offsets([corner(axis, i) for i in range(4)]) for axis in range(3)])
    asked = sign_edges(nodes).select("k", "axis", F.posexplode(steps[F.col("axis")]).alias("i", "step")).withColumn("cube", F.col("k") + F.col("step"))
    place = F.struct(*[(c + F.col(a)).alias(a) for a, c in zip("xyz", K.unpack(F.col("cube")))])
    met = asked.join(vertices.select("cube", "x", "y", "z"), "cube")
    pick = lambda c, i: F.max(F.when(F.col("i") == i, c))
    made = [pick(F.col("cube"), i).alias(f"c{i}") for i in range(4)] + [pick(place, i).alias(f"p{i}") for i in range(4)]
    return met.groupBy("k", "axis").agg(F.count(F.lit(1)).alias("n"), *made).where("n = 4").drop("n")


def quads(nodes: DataFrame, vertices: DataFrame) -> DataFrame:
    """For each crossing edge the four cubes around it, if all have a vertex; owned by the edge's start."""
    return _around(nodes, vertices).select("k", "axis", "c0", "c1", "c2", "c3")


def _length(a: Column, b: Column) -> Column:
    return F.sqrt(sum(((a[c] - b[c]) * (a[c] - b[c]) for c in "xyz"), F.lit(0.0)))


def _doubled_area(a: Column, b: Column, c: Column) -> Column:
    u, v = [b[i] - a[i] for i in "xyz"], [c[i] - a[i] for i in "xyz"]
    cross = (u[1] * v[2] - u[2] * v[1], u[2] * v[0] - u[0] * v[2], u[0] * v[1] - u[1] * v[0])
    return F.sqrt(sum((x * x for x in cross), F.lit(0.0)))


def triangles(nodes: DataFrame, vertices: DataFrame, longest: float = 3.0, shortest: float = 1e-5, ratio: float = 8.0, area2: float = 1e-8) -> DataFrame:
    """Two triangles of each quad, without those that are too long, too short, too thin or too small (in voxels).

    Rows of k, axis, half, cubes a, b, c and their vertices pa, pb, pc; the owner is the edge's start k.
    """
    halves = F.array(*[F.struct(F.lit(h).alias("half"), *[F.col(f"c{i}").alias(n) for n, i in zip("abc", s)], *[F.col(f"p{i}").alias(f"p{n}") for n, i in zip("abc", s)]) for h, s in enumerate(((0, 1, 2), (0, 2, 3)))])
    rows = _around(nodes, vertices).select("k", "axis", F.explode(halves).alias("t")).select("k", "axis", "t.*")
    p = [F.col(f"p{n}") for n in "abc"]
    edges = [_length(p[0], p[1]), _length(p[1], p[2]), _length(p[2], p[0])]
    rows = rows.withColumns({"e1": F.greatest(*edges), "e0": F.least(*edges), "area2": _doubled_area(*p)})
    return rows.where((F.col("e1") <= longest) & (F.col("e0") > shortest) & (F.col("e1") <= ratio * F.col("e0")) & (F.col("area2") > area2)).drop("e0", "e1")


def extract_blocks(nodes: DataFrame, blocks: DataFrame, cells: int = K.BLOCK_CELLS, least_weight: float = 0.1) -> DataFrame:
    """The triangles that given spatial blocks (block) own, from their nodes and those of the blocks around."""
    near = dilate_blocks(blocks)
    gated = nodes.where(F.col("w") >= least_weight).withColumn("home", K.block_of(F.col("k"), cells)).join(near, "home", "left_semi").drop("home")
    faces = triangles(gated, cube_vertices(gated)).withColumn("block", K.block_of(F.col("k"), cells))
    return faces.join(blocks.select("block").distinct(), "block", "left_semi")


def dilate_blocks(blocks: DataFrame) -> DataFrame:
    """(home) the blocks and all that touch them."""
    return blocks.select(F.explode(K.offsets(K.AROUND)).alias("s"), "block").select((F.col("block") + F.col("s")).alias("home")).distinct()


def halo(nodes: DataFrame, blocks: DataFrame, cells: int = K.BLOCK_CELLS) -> DataFrame:
    """Nodes of the given blocks and those one voxel beyond their borders: all that their cubes can touch."""
    rows = nodes.withColumn("home", K.block_of(F.col("k"), cells))
    inner = rows.join(blocks.select(F.col("block").alias("home")).distinct(), "home", "left_semi")
    x, y, z = K.unpack(F.col("k"))
    edge = F.lit(False)
    for c in (x, y, z):
        edge = edge | F.pmod(c, F.lit(cells)).isin(0, cells - 1)
    ring = inner.where(edge).select(F.explode(K.offsets(K.AROUND)).alias("s"), "k").select((F.col("k") + F.col("s")).alias("k")).distinct()
    return rows.join(inner.select("k").unionByName(ring).distinct(), "k", "left_semi").drop("home")


def components(faces: DataFrame) -> DataFrame:
    """(v, label) of each vertex of ``faces`` (a, b, c): the least vertex it hangs together with.

    Labels go to neighbours and then to the label's own label, so paths halve; a step is two joins on
    shuffled keys and the last one is written before the next.
    """
    sides = faces.select(F.explode(F.array(F.struct(F.col("a").alias("u"), F.col("b").alias("v")), F.struct(F.col("b").alias("u"), F.col("c").alias("v")))).alias("e")).select("e.*")
    both = cut(sides.unionByName(sides.select(F.col("v").alias("u"), F.col("u").alias("v"))).distinct())
    labels = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("v"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(labels, "v").groupBy("u").agg(F.min("label").alias("m"))
        lower = labels.join(near.withColumnRenamed("u", "v"), "v").select("v", F.least("label", "m").alias("low"), "label")
        up = labels.select(F.col("v").alias("low"), F.col("label").alias("root"))
        step = cut(lower.join(up, "low").select("v", F.least("low", "root").alias("label"), (F.least("low", "root") < F.col("label")).alias("moved")))
        labels = step.drop("moved")
        if step.where("moved").isEmpty():
            return labels


def mesh_summary(faces: DataFrame, few: int = 100) -> DataFrame:
    """One row: faces, area, components, the largest one's share of faces and the share in those of fewer than ``few``."""
    of = faces.join(components(faces).withColumnRenamed("v", "a"), "a").groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    n = F.sum("n")
    parts = of.agg(F.count(F.lit(1)).alias("components"), (F.max("n") / n).alias("largest"), (F.coalesce(F.sum(F.when(F.col("n") < few, F.col("n"))), F.lit(0)) / n).alias("small"))
    return faces.agg(F.count(F.lit(1)).alias("faces"), (F.sum("area2") / 2).alias("area")).crossJoin(parts)  # one row each


def local_ids(faces: DataFrame, block: str, vertex: str) -> DataFrame:
    """Dense vertex numbers within each block."""
    return faces.withColumn("local_id", F.dense_rank().over(Window.partitionBy(block).orderBy(vertex)) - 1)


def block_offsets(sizes: DataFrame) -> DataFrame:
    """Where each block's vertices begin when blocks are laid end to end by key (one row per block)."""
    w = Window.partitionBy(F.lit(1)).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("start", F.sum("nv").over(w) - F.col("nv"))


def tiles(sizes: DataFrame, most: int) -> DataFrame:
    """Blocks grouped into tiles of about a third of ``most`` nodes, in key order."""
    w = Window.partitionBy(F.lit(1)).orderBy("block").rowsBetween(Window.unboundedPreceding, 0)
    return sizes.withColumn("tile", F.floor((F.sum("nv").over(w) - 1) / max(most / 3, 1)).cast("bigint"))


def replay(deltas: DataFrame, upto: int) -> DataFrame:
    """State after a change log: the last entry of each block, unless it removes the block."""
    last = deltas.where(F.col("chunk") <= upto).groupBy("block").agg(F.max(F.struct("chunk", "removed", "payload")).alias("d"))
    return last.where("NOT d.removed").select("block", "d.chunk", "d.payload")


def dirty_nodes(before: DataFrame, now: DataFrame, tolerance: float, gate: float, surety: float = 0.05) -> DataFrame:
    """Nodes that changed enough to be extracted again: presence, sign, value, weight gate or surety 1 - exp(-w / 2)."""
    b = before.select("k", F.col("s").alias("s_old"), F.col("w").alias("w_old"))
    both = now.join(b, "k", "full_outer")
    flag = F.col("s").isNull() | F.col("s_old").isNull() | ((F.col("s") < 0) != (F.col("s_old") < 0)) | (F.abs(F.col("s") - F.col("s_old")) > tolerance) | ((F.col("w") >= gate) != (F.col("w_old") >= gate)) | (F.abs(F.exp(-F.col("w") / 2) - F.exp(-F.col("w_old") / 2)) > surety)
    return both.where(flag).select("k")


def blocks_of_corners(nodes: DataFrame, cells: int = K.BLOCK_CELLS) -> DataFrame:
    """Blocks of all cubes that have one of these nodes as a corner."""
    return nodes.select(F.explode(K.offsets([-s for s in CORNER_STEPS.values()])).alias("s"), "k").select(K.block_of(F.col("k") + F.col("s"), cells).alias("block")).distinct()
