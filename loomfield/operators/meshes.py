"""Joins of rays and points with triangles, samples of a surface, differences of meshes.

Triangles go to the cells around their box and rays step through cells of the same size, so what can meet
has a cell in common; the exact tests are residuals and the nearest answer a minimum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomfield.functions import geometry as G
from loomfield.functions import keys as K


def _vec(c: Column) -> G.Vec:
    return c["x"], c["y"], c["z"]


def _less(a: G.Vec, b: G.Vec) -> G.Vec:
    return a[0] - b[0], a[1] - b[1], a[2] - b[2]


def in_cells(triangles: DataFrame, size: float, margin: int = 1) -> DataFrame:
    """Each triangle (pa, pb, pc) in all cells of its box and ``margin`` around, as ``cell``."""
    rows = triangles
    for a in "xyz":
        ends = [F.col(f"p{n}")[a] for n in "abc"]
        span = F.sequence(K.cell(F.least(*ends), size) - margin, K.cell(F.greatest(*ends), size) + margin)
        rows = rows.withColumn(f"c{a}", F.explode(span))
    return rows.withColumn("cell", K.pack(*[F.col(f"c{a}") for a in "xyz"])).drop("cx", "cy", "cz")


def ray_hits(rays: DataFrame, triangles: DataFrame, size: float, reach: float = 0.0) -> DataFrame:
    """(id, t): distance along each ray (id, ox..oz, ex..ez) to the first triangle before its end and ``reach`` more."""
    d = tuple(F.col(f"e{a}") - F.col(f"o{a}") for a in "xyz")
    r = rays.withColumn("len", G.norm(d)).where("len > 0").withColumns({f"d{a}": c / F.col("len") for a, c in zip("xyz", d)})
    r = r.withColumn("i", F.explode(F.sequence(F.lit(0), F.ceil((F.col("len") + reach) / size).cast("int"))))
    at = [K.cell(F.col(f"o{a}") + F.col(f"d{a}") * F.col("i") * size, size) for a in "xyz"]
    r = r.select("id", "ox", "oy", "oz", "dx", "dy", "dz", "len", K.pack(*at).alias("cell")).distinct()
    met = r.join(in_cells(triangles.select("pa", "pb", "pc"), size), "cell")
    a, u, v = _vec(F.col("pa")), _less(_vec(F.col("pb")), _vec(F.col("pa"))), _less(_vec(F.col("pc")), _vec(F.col("pa")))
    way, off = G.vec("dx", "dy", "dz"), _less(G.vec("ox", "oy", "oz"), a)
    # o + t d = a + p u + q v, by Cramer's rule
    normal = G.cross(u, v)
    det = -G.dot(way, normal)
    turn = G.cross(off, way)
    det = F.when(F.abs(det) > 1e-12, det)
    t, p, q = G.dot(off, normal) / det, G.dot(v, turn) / det, -G.dot(u, turn) / det
    hit = (p >= 0) & (q >= 0) & (p + q <= 1) & (t > 0) & (t <= F.col("len") + reach)
    return met.select("id", F.when(hit, t).alias("t")).where("t IS NOT NULL").groupBy("id").agg(F.min("t").alias("t"))


def _to_segment(p: G.Vec, a: G.Vec, b: G.Vec) -> Column:
    """Squared distance of a point from a segment."""
    u, w = _less(b, a), _less(p, a)
    t = F.greatest(F.least(F.coalesce(F.try_divide(G.dot(w, u), G.dot(u, u)), F.lit(0.0)), F.lit(1.0)), F.lit(0.0))
    off = tuple(w[i] - t * u[i] for i in range(3))
    return G.dot(off, off)


def surface_distance(points: DataFrame, triangles: DataFrame, radius: float) -> DataFrame:
    """(pid, d): distance of each point from the nearest triangle, of those within ``radius``."""
    cells = K.pack(*[K.cell(F.col(a), radius) for a in "xyz"])
    met = points.withColumn("cell", cells).join(in_cells(triangles.select("pa", "pb", "pc"), radius), "cell")
    p, a, b, c = G.vec("x", "y", "z"), *[_vec(F.col(f"p{n}")) for n in "abc"]
    u, v, w = _less(b, a), _less(c, a), _less(p, a)
    normal = G.cross(u, v)
    n2 = G.dot(normal, normal)
    s, t = G.dot(G.cross(w, v), normal) / n2, G.dot(G.cross(u, w), normal) / n2
    over = (n2 > 0) & (s >= 0) & (t >= 0) & (s + t <= 1)
    height = G.dot(w, normal)
    edge = F.least(_to_segment(p, a, b), _to_segment(p, b, c), _to_segment(p, c, a))
    d2 = F.when(over, height * height / n2).otherwise(edge)
    return met.select("pid", d2.alias("d2")).groupBy("pid").agg(F.sqrt(F.min("d2")).alias("d")).where(F.col("d") <= radius)


def _part(seed: int, what: str, *cols: str) -> Column:
    digest = F.md5(F.concat_ws(":", F.lit(f"{seed}{what}"), *cols).cast("binary"))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / float(1 << 32)


def surface_samples(triangles: DataFrame, n: int, seed: int) -> DataFrame:
    """About ``n`` points spread evenly over the surface: j counts a triangle's own points.

    A triangle gets its share of ``n`` by area, the fraction by a hash; places are hashes too, so a rerun agrees.
    ``triangles``: k, axis, half, pa, pb, pc, area2.
    """
    total = triangles.agg(F.sum("area2").alias("total"))
    rows = triangles.crossJoin(total).withColumn("share", F.col("area2") / F.col("total") * n)  # one row
    own = F.floor(F.col("share") + _part(seed, "n", "k", "axis", "half")).cast("int")
    rows = rows.withColumn("own", own).where("own > 0").withColumn("j", F.explode(F.sequence(F.lit(1), F.col("own"))))
    r, s = F.sqrt(_part(seed, "r", "k", "axis", "half", "j")), _part(seed, "s", "k", "axis", "half", "j")
    place = {a: F.col("pa")[a] * (1 - r) + F.col("pb")[a] * r * (1 - s) + F.col("pc")[a] * r * s for a in "xyz"}
    return rows.select("k", "axis", "half", "j", *[c.alias(a) for a, c in place.items()])


def mesh_difference(a: DataFrame, b: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """One row: vertices (cube, x, y, z) that only one mesh has, and those of both that are more than ``tolerance`` apart."""
    there = b.select("cube", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    both = a.join(there, "cube", "full_outer")
    off = F.sqrt(reduce(lambda s, c: s + c, [(F.col(c) - F.col(f"b{c}")) * (F.col(c) - F.col(f"b{c}")) for c in "xyz"]))
    return both.agg(F.count_if(F.col("bx").isNull()).alias("only_a"), F.count_if(F.col("x").isNull()).alias("only_b"), F.count_if(off > tolerance).alias("moved"), F.max(off).alias("most"))
