"""The sparse field: weighted samples on a lattice, fused by temporal block."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import keys as K

from .cut import cut


def splat(samples: DataFrame, by: list[str], voxel: float = 1.0, least: float = 1e-5, copies: str | None = None) -> DataFrame:
    """Trilinear weights of each sample at the eight lattice points around it, summed by key.

    Eight rows per sample are made inside the stage that reads them and summed before the shuffle.
    ``copies`` names a column that tells how many equal samples a row stands for.
    """
    n = [copies] if copies else []
    times = lambda c: c * F.col(copies) if copies else c
    base = [K.cell(F.col(c), voxel) for c in "xyz"]
    low = samples.select(*by, *n, "value", "weight", K.pack(*base).alias("k0"), *[(F.col(c) / voxel - b).alias(f"f{c}") for c, b in zip("xyz", base)])
    # a corner is a number from 0 to 7, its step and weight are arithmetic on its bits
    bit = {"x": F.floor(F.col("c") / 4), "y": F.floor(F.col("c") / 2) % 2, "z": F.col("c") % 2}
    side = lambda a: F.when(bit[a] == 1, F.col(f"f{a}")).otherwise(1 - F.col(f"f{a}"))
    at = low.withColumn("c", F.explode(F.array(*[F.lit(i) for i in range(8)])))
    at = at.select(*by, *n, "value", (F.col("k0") + bit["x"] * K.STEP["x"] + bit["y"] * K.STEP["y"] + bit["z"]).alias("k"), (F.col("weight") * side("x") * side("y") * side("z")).alias("w")).where(F.col("w") > least)
    return at.groupBy(*by, "k").agg(F.sum(times(F.col("value") * F.col("w"))).alias("value_sum"), F.sum(times(F.col("w"))).alias("weight_sum"), F.max("w").alias("weight_max"))


def bound_weights(field: DataFrame, mode: str = "max") -> DataFrame:
    """A node's weight in one temporal block is at most its largest sample weight; the mean value stays.

    ``mode`` sum leaves weights as they are.
    """
    if mode == "sum":
        return field
    if mode != "max":
        raise ValueError("weights of a block are bounded by max or not at all (sum)")
    w = F.least("weight_max", "weight_sum")
    return field.withColumns({"value_sum": F.col("value_sum") * w / F.col("weight_sum"), "weight_sum": w})


def merge_blocks(field: DataFrame) -> DataFrame:
    """All temporal blocks of a node together; every block that touches a node is a hit.

    ``field`` has one row for each block and node, so blocks are counted as rows.
    """
    return field.groupBy("k").agg(F.sum("value_sum").alias("value_sum"), F.sum("weight_sum").alias("weight_sum"), F.count(F.lit(1)).alias("hit_count"), F.bit_or(K.mask_bit(F.col("block"))).alias("mask"))


def prefixes(field: DataFrame, last: int) -> DataFrame:
    """(c, k): the merged field as it stands after each temporal block c up to ``last``, with ``touched`` if c reached the node.

    Sums run along a node's own blocks and are repeated until its next one; no block waits for another.
    """
    w = Window.partitionBy("k").orderBy("block")
    so_far = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = field.select("k", "block", F.sum("value_sum").over(so_far).alias("value_sum"), F.sum("weight_sum").over(so_far).alias("weight_sum"), F.count(F.lit(1)).over(so_far).alias("hit_count"), F.coalesce(F.lead("block").over(w) - 1, F.lit(last)).alias("until"))
    rows = rows.withColumn("c", F.explode(F.sequence(F.col("block"), F.col("until"))))
    return rows.select("c", "k", "value_sum", "weight_sum", "hit_count", (F.col("c") == F.col("block")).alias("touched"))


def current_value() -> Column:
    """The solved value where there is one, else the fused one."""
    return F.coalesce(F.col("solved"), F.col("s"))


def fused_value() -> Column:
    return F.coalesce(F.try_divide("value_sum", "weight_sum"), F.lit(0.0))


def dilate(keys: DataFrame, steps: list[int] = K.AROUND) -> DataFrame:
    """Keys and those around them, once each."""
    return keys.select(F.explode(K.offsets(steps)).alias("s"), "k").select((F.col("k") + F.col("s")).alias("k")).distinct()


def neighbours(nodes: DataFrame, value: str, steps: list[int] = K.FACES, by: list[str] | None = None) -> DataFrame:
    """(by, k, step, value of the node at k + step): a stencil as an equi-join."""
    by = by or []
    asked = nodes.select(*by, "k", F.explode(K.offsets(steps)).alias("step")).withColumn("other", F.col("k") + F.col("step"))
    return asked.join(nodes.select(*by, F.col("k").alias("other"), F.col(value).alias("v")), [*by, "other"]).select(*by, "k", "step", "v")


def normals(nodes: DataFrame, value: str = "s", by: list[str] | None = None) -> DataFrame:
    """Unit gradients by central differences, one-sided where a neighbour is missing, null without any."""
    by = by or []
    around = neighbours(nodes, value, by=by)
    pick = lambda step: F.max(F.when(F.col("step") == step, F.col("v")))
    sides = around.groupBy(*by, "k").agg(*[pick(s * K.STEP[a]).alias(f"{a}{n}") for a in "xyz" for s, n in ((1, "p"), (-1, "m"))])
    rows = nodes.join(sides, [*by, "k"])
    d = {a: F.coalesce((F.col(f"{a}p") - F.col(f"{a}m")) / 2, F.col(f"{a}p") - F.col(value), F.col(value) - F.col(f"{a}m"), F.lit(0.0)) for a in "xyz"}
    rows = rows.select(*by, "k", *[c.alias(f"g{a}") for a, c in d.items()])
    n = F.sqrt(F.col("gx") * F.col("gx") + F.col("gy") * F.col("gy") + F.col("gz") * F.col("gz"))
    return rows.select(*by, "k", *[F.when(n > 1e-9, F.col(f"g{a}") / n).alias(f"n{a}") for a in "xyz"])


def conflict_target(kind: str, hits: float = 3.0, beta: float = 1.0, f: float = 0.12, kappa: float = 0.5) -> tuple[Column, Column]:
    """Target value and confidence from votes h (hits) and p (passes) at fused value s0 with weight w."""
    h, p = F.when(F.col("w") > 0, F.col("h") / hits).otherwise(0.0), beta * F.col("p") / hits
    c, s0 = h + p, F.col("s0")
    if kind == "mirror":
        target = F.when((c > 0) & (s0 <= 0), -F.greatest(F.abs(s0), F.lit(0.1 * f)) * (h - p) / c).otherwise(s0)
    else:
        target = F.when(c > 0, (h * s0 + p * (f if kind == "truncation" else kappa)) / c).otherwise(s0)
    return target, c


def solve_region(nodes: DataFrame, moved: Column, cells: int, rings: int = 1) -> DataFrame:
    """Nodes in the spatial blocks of those that ``moved`` and in ``rings`` of blocks around; inside are the former."""
    rows = nodes.withColumn("home", K.block_of(F.col("k"), cells))
    inner = rows.where(moved).select("home").distinct()
    region = inner
    for _ in range(rings):
        region = dilate(region.withColumnRenamed("home", "k")).withColumnRenamed("k", "home")
    near = rows.join(region, "home", "left_semi").join(inner.withColumn("in_", F.lit(True)), "home", "left")
    return near.select(*nodes.columns, F.coalesce("in_", F.lit(False)).alias("inside"))


def jacobi(nodes: DataFrame, steps: int, damping: float = 0.8, smooth: float = 1.0, tolerance: float = 0.0, every: int = 3) -> DataFrame:
    """Damped Jacobi steps of ``c (s - target) + smooth * (s - mean of neighbours) = 0`` on interior nodes.

    ``nodes``: k, s, target, c, inside. The adjacency is an equi-join on shifted keys, made once. Lineage
    is cut ``every`` few steps, so the plan does not grow with ``steps``; with a ``tolerance`` it is
    cut at each, and steps end when no undamped change reaches it.
    """
    pairs = nodes.select("k", F.explode(K.offsets(K.FACES)).alias("step")).select("k", (F.col("k") + F.col("step")).alias("other"))
    if steps > every or tolerance:
        pairs = cut(pairs.join(nodes.select(F.col("k").alias("other")), "other"))
    for step in range(1, steps + 1):
        mean = pairs.join(nodes.select(F.col("k").alias("other"), F.col("s").alias("v")), "other").groupBy("k").agg(F.sum("v").alias("nv"), F.count(F.lit(1)).alias("deg"))
        rows = nodes.join(mean, "k", "left")
        has = F.when(F.coalesce("deg", F.lit(0)) > 0, smooth).otherwise(0.0)
        full = (F.col("c") * F.col("target") + has * F.coalesce(F.col("nv") / F.col("deg"), F.lit(0.0))) / (F.col("c") + has)
        change = F.when(F.col("inside") & (F.col("c") + has > 0), full - F.col("s")).otherwise(F.lit(0.0))
        nodes = rows.select("k", (F.col("s") + damping * change).alias("s"), "target", "c", "inside", F.abs(change).alias("change"))
        if tolerance:
            nodes = cut(nodes)
            if (nodes.agg(F.max("change")).first()[0] or 0.0) < tolerance:
                break
        elif step % every == 0 and step < steps:
            nodes = cut(nodes)
    return nodes.select("k", "s", "target", "c", "inside")


def changed(before: DataFrame, solved: DataFrame, least: float = 1e-4) -> DataFrame:
    """Interior nodes that the solve moved by more than ``least``, with their new value."""
    old = before.select("k", F.col("s").alias("s_old"))
    return solved.where("inside").join(old, "k").where(F.abs(F.col("s") - F.col("s_old")) > least).select("k", "s")


def unit_counts(units: DataFrame, hits: str, passes: str, newly: str) -> DataFrame:
    """h and p in units of scans or rays, rescaled so that on average they weigh as much as block counts.

    ``units`` has a row for each block and node it touched or voted on: block hits are 1 where ``hits`` is
    not null, block passes 1 where ``newly``.
    """
    totals = units.agg(F.count(hits).alias("bh"), F.sum(hits).alias("uh"), F.count_if(F.col(newly)).alias("bp"), F.sum(F.when(F.col(newly), F.col(passes))).alias("up"))
    scale = totals.select(F.coalesce(F.try_divide("bh", "uh"), F.lit(1.0)).alias("sh"), F.coalesce(F.try_divide("bp", "up"), F.lit(1.0)).alias("sp"))
    per = units.groupBy("k").agg(F.coalesce(F.sum(hits), F.lit(0.0)).alias("h"), F.coalesce(F.sum(F.when(F.col(newly), F.col(passes))), F.lit(0.0)).alias("p"))
    return per.crossJoin(scale).select("k", (F.col("h") * F.col("sh")).alias("h"), (F.col("p") * F.col("sp")).alias("p"))  # one row


def far_blocks(nodes: DataFrame, x: float, y: float, z: float, reach: float, voxel: float, cells: int = K.BLOCK_CELLS) -> DataFrame:
    """Spatial blocks whose centre is farther than ``reach`` from a place: what a bounded memory would let go."""
    blocks = nodes.select(K.block_of(F.col("k"), cells).alias("block")).distinct()
    centre = [(c + 0.5) * cells * voxel for c in K.unpack(F.col("block"))]
    d2 = sum(((c - o) * (c - o) for c, o in zip(centre, (x, y, z))), F.lit(0.0))
    return blocks.where(d2 > reach * reach)


def moments(points: DataFrame, sizes: list[float], by: list[str]) -> DataFrame:
    """Counts, sums and products of offsets from the cell centre, per level of cell size."""
    levels = F.array(*[F.struct(F.lit(i).alias("level"), F.lit(s).alias("size")) for i, s in enumerate(sizes)])
    rows = points.select(*by, "x", "y", "z", F.explode(levels).alias("l")).select(*by, "x", "y", "z", "l.*")
    cells = {a: F.floor(F.col(a) / F.col("size")).cast("bigint") for a in "xyz"}
    rows = rows.select(*by, "level", K.pack(*cells.values()).alias("k"), *[(F.col(a) - (c + 0.5) * F.col("size")).alias(f"d{a}") for a, c in cells.items()])
    products = [(a, b) for i, a in enumerate("xyz") for b in "xyz"[i:]]
    return rows.groupBy(*by, "level", "k").agg(F.count(F.lit(1)).alias("n"), *[F.sum(f"d{a}").alias(f"s{a}") for a in "xyz"], *[F.sum(F.col(f"d{a}") * F.col(f"d{b}")).alias(f"m{a}{b}") for a, b in products])


def covariance(m: DataFrame) -> dict[str, Column]:
    """Entries of the covariance from moments."""
    return {f"{a}{b}": F.col(f"m{a}{b}") / F.col("n") - F.col(f"s{a}") * F.col(f"s{b}") / (F.col("n") * F.col("n")) for i, a in enumerate("xyz") for b in "xyz"[i:]}


def running(m: DataFrame, order: str, by: list[str]) -> DataFrame:
    """Moments up to and including each step of ``order``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    sums = [c for c in m.columns if c not in (*by, order)]
    return m.select(*by, order, *[F.sum(c).over(w).alias(c) for c in sums])
