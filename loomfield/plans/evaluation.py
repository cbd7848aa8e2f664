"""Registered queries of meshes, scores and pacing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomfield.functions import geometry as G
from loomfield.functions import keys as K
from loomfield.operators import field, meshes, scans, scores, surface
from loomfield.streaming import pace

from . import registry as R
from . import surrogates as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CELLS = 8


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


# meshes


def gated(spark: SparkSession, d: str) -> DataFrame:
    return R.nodes(spark, d).where("w >= 0.1")


def faces(spark: SparkSession, d: str) -> DataFrame:
    n = gated(spark, d)
    return surface.triangles(n, surface.cube_vertices(n))


@query
def cube_chance(spark, d):
    """Cubes that are likely enough to hold the surface."""
    return surface.cube_vertices(gated(spark, d), least_chance=0.1).select("cube", F.col("n").cast("int").alias("n"))


@query
def triangles(spark, d):
    return faces(spark, d).select("k", F.col("axis").cast("int").alias("axis"), F.col("half").cast("int").alias("half"), "a", "b", "c", F.round("area2", 4).alias("area2"))


@query
def extract_region(spark, d):
    """Faces of the blocks that the last temporal block changed."""
    blocks = surface.blocks_of_corners(surface.dirty_nodes(R.before(spark, d), R.nodes(spark, d), 0.0125, 0.1), CELLS)
    return surface.extract_blocks(R.nodes(spark, d), blocks, CELLS).groupBy("block").agg(F.count(F.lit(1)).alias("faces"), F.round(F.sum("area2"), 3).alias("area2"))


@query
def halo_nodes(spark, d):
    blocks = R.nodes(spark, d).select(K.block_of(F.col("k"), CELLS).alias("block")).distinct().where("block % 3 = 0")
    return surface.halo(R.nodes(spark, d), blocks, CELLS).select("k")


@query
def mesh_difference(spark, d):
    a, b = R.before(spark, d).where("w >= 0.1"), gated(spark, d)
    return meshes.mesh_difference(surface.cube_vertices(a), surface.cube_vertices(b)).select("only_a", "only_b", "moved", F.round("most", 4).alias("most"))


@query
def surface_samples(spark, d):
    rows = meshes.surface_samples(faces(spark, d), 2000, 5)
    return rows.select("k", F.col("axis").cast("int").alias("axis"), F.col("half").cast("int").alias("half"), F.col("j").cast("int").alias("j"), *[F.round(a, 4).alias(a) for a in "xyz"])


def cell_rays(spark: SparkSession, d: str) -> DataFrame:
    """One ray to the middle of the held-out returns of a cell."""
    rows = S.returns_plain(spark, d).where("frame % 10 = 5")
    cell = K.pack(*[K.cell(F.col(a), 8.0) for a in "xyz"])
    return rows.groupBy(cell.alias("id")).agg(*[F.round(F.avg(a), 4).alias(f"e{a}") for a in "xyz"]).select("id", *[F.lit(0.0).alias(f"o{a}") for a in "xyz"], "ex", "ey", "ez")


@query
def ray_hits(spark, d):
    """How far rays go before they meet the mesh."""
    return meshes.ray_hits(cell_rays(spark, d), faces(spark, d), 2.0, 3.0).select("id", F.round("t", 4).alias("t"))


@query
def surface_distance(spark, d):
    p = cell_rays(spark, d).select(F.col("id").alias("pid"), *[F.col(f"e{a}").alias(a) for a in "xyz"])
    return meshes.surface_distance(p, faces(spark, d), 4.0).select("pid", F.round("d", 4).alias("d"))


# scores


def distances(spark: SparkSession, d: str, every: int = 1) -> tuple[DataFrame, DataFrame]:
    """Distances of odd and even points from the nearest of the other side, at any distance."""
    a, b = S.cloud(spark, d, True), S.cloud(spark, d, False).where(F.floor(F.col("pid") / 2) % every == 0)
    near = lambda p, q: p.join(scores.nearest(p, q.select(F.col("pid").alias("oid"), "x", "y", "z"), 1, 1.0), "pid").select("pid", "x", "y", F.sqrt("d2").alias("d"))
    return near(a, b), near(b, a)


@query
def gt_metrics(spark, d):
    return R.rounded(scores.distance_metrics(*distances(spark, d), 0.5, 1.0))


@query
def block_stats(spark, d):
    return R.rounded(scores.block_statistics(distances(spark, d)[0], 2.0, 0.5))


@query
def bootstrap(spark, d):
    return R.rounded(scores.bootstrap(scores.block_statistics(distances(spark, d)[0], 2.0, 0.5), 50, 11))


@query
def bootstrap_interval(spark, d):
    stats = scores.block_statistics(distances(spark, d)[0], 2.0, 0.5)
    return R.rounded(scores.spread(scores.bootstrap(stats, 50, 11), ["mean_d", "close"]))


@query
def paired_bootstrap(spark, d):
    """A run against one that lacks half of its points."""
    one, two = (field.cut(scores.block_statistics(distances(spark, d, n)[0], 2.0, 0.5)) for n in (1, 2))
    return R.rounded(scores.paired(one, two, 50, 11))


# pacing


def arrivals(spark: SparkSession, d: str) -> DataFrame:
    """Days of events as blocks: when the last event came and how long its work takes."""
    e = S.table(spark, d, "events").select(F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), (F.col("value") * 1000).cast("bigint").alias("work"))
    first = e.agg(F.min("us").alias("first"))
    rows = e.crossJoin(first).groupBy(F.floor((F.col("us") - F.col("first")) / 86_400_000_000).cast("bigint").alias("i"))  # one row
    return rows.agg((F.max("us") - F.first("first")).alias("arrived"), (F.sum("work") * 20_000).alias("work"))


@query
def paced_replay(spark, d):
    return pace.served(arrivals(spark, d))


@query
def latency(spark, d):
    return R.rounded(pace.latency_summary(pace.served(arrivals(spark, d))))


@query
def ray_reach(spark, d):
    """Blocks that the rays of each temporal block can reach."""
    r = R.rays(S.returns_plain(spark, d))
    way = G.vec("ex", "ey", "ez")
    length = G.norm(way)
    steps = r.withColumn("i", F.explode(F.sequence(F.lit(0), F.floor((length + 3.5) / 8.0).cast("int"))))
    at = K.pack(*[F.floor(F.col(f"e{a}") / length * F.col("i") * 8.0 / 8.0).cast("bigint") for a in "xyz"])
    ends = r.select("c", K.pack(*[K.cell(F.col(f"e{a}"), 8.0) for a in "xyz"]).alias("b"))
    blocks = steps.select("c", at.alias("b")).unionByName(ends).distinct()
    return blocks.select("c", F.explode(K.offsets(K.AROUND)).alias("s"), "b").select("c", (F.col("b") + F.col("s")).alias("block")).distinct()


@query
def frame_spec(spark, d):
    """Frames named by a selection."""
    rows = scans.frames_of(spark, "train:0-19,25,30-44:skip5mod10")
    return rows.join(S.returns_plain(spark, d).groupBy("frame").agg(F.count(F.lit(1)).alias("n")), "frame").select("frame", "n")
