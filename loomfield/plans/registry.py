"""The registered queries of the spatial operators, over surrogate tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomfield.functions import geometry as G
from loomfield.functions import keys as K
from loomfield.operators import field, scans, scores, support, surface, votes

from . import surrogates as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
TURN = G.yaw(0.3)
SHIFT = (1.0, -2.0, 0.5)
LEVELS = [2.0, 4.0, 8.0]
#: added before rounding what is itself made of rounded values, which would often end in an exact half
OFF_TIES = 3e-8
HALF_DAY = 43_200_000_000_000
#: rays of a scan that are asked first, the budget of the reference's configurations; all others vote as well
MAX_RAYS_PER_SCAN = 12_000


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def rounded(df: DataFrame) -> DataFrame:
    """Sums of doubles depend on their order; six digits do not."""
    return df.select(*[r6(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


def cell_key() -> Column:
    return K.pack(*[K.cell(F.col(a)) for a in "xyz"])


# keys and scalar maths


@query
def key_roundtrip(spark, d):
    k = S.returns(spark, d).select("frame", "pt", cell_key().alias("k"))
    x, y, z = K.unpack(F.col("k"))
    return k.select("frame", "pt", "k", x.alias("kx"), y.alias("ky"), z.alias("kz"))


@query
def block_key(spark, d):
    rows = S.returns_plain(spark, d).select(K.block_of(K.pack(*[K.cell(F.col(a), 0.25) for a in "xyz"])).alias("block_key"))
    return rows.groupBy("block_key").agg(F.count(F.lit(1)).alias("n"))


@query
def mask_bits(spark, d):
    m = S.returns_plain(spark, d).groupBy("block").agg(F.bit_or(K.mask_bit(F.col("frame"))).alias("mask"))
    return m.select("block", "mask", F.bit_count("mask").cast("int").alias("n_frames"))


@query
def rigid_transform(spark, d):
    rows = S.returns(spark, d)
    p = G.transform(TURN, SHIFT, G.vec("x", "y", "z"))
    back = G.inverse_transform(TURN, SHIFT, p)
    return rounded(rows.select("frame", "pt", *[c.alias(f"t{a}") for a, c in zip("xyz", p)], *[c.alias(f"b{a}") for a, c in zip("xyz", back)]))


@query
def quat_matrix(spark, d):
    m = G.quaternion_matrix(*[F.col(c) for c in scans.TURN])
    return rounded(S.trajectory(spark, d).select("event_id", *[m[i][j].cast("double").alias(f"m{i}{j}") for i in range(3) for j in range(3)]))


@query
def default_basis(spark, d):
    u, v = G.ray_basis(G.unit(G.vec("x", "y", "z")))
    return rounded(S.returns(spark, d).select("frame", "pt", *[c.alias(f"u{a}") for a, c in zip("xyz", u)], *[c.alias(f"v{a}") for a, c in zip("xyz", v)]))


@query
def eig3(spark, d):
    m = field.moments(S.returns_plain(spark, d), [16.0], ["frame"]).where("n >= 3")
    e = G.symmetric_eigenvalues(*field.covariance(m).values())
    return m.select("frame", "k", *[F.round(c, 4).alias(f"e{i}") for i, c in enumerate(e)])


@query
def angle_wrap(spark, d):
    return rounded(S.trajectory(spark, d).select("event_id", G.wrap_angle(F.col("px")).alias("a")))


@query
def projection(spark, d):
    depth = F.col("z") + 5.0
    return rounded(S.returns(spark, d).where(depth > 6.0).select("frame", "pt", (400.0 * F.col("x") / depth + 320.0).alias("u"), (400.0 * F.col("y") / depth + 240.0).alias("v"), depth.alias("depth")))


@query
def confidence_colour(spark, d):
    c = F.greatest(F.least(F.col("weight") / 1.5, F.lit(1.0)), F.lit(0.0))
    return S.returns(spark, d).select("frame", "pt", scans.round_half_even(255 * c).alias("r"), scans.round_half_even(255 * (1 - c)).alias("g"))


# sources and scans


@query
def range_filter(spark, d):
    return scans.within_range(S.returns(spark, d), 10.0, 45.0).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query
def frame_select(spark, d):
    return S.returns_plain(spark, d).join(scans.select_frames(spark, 0, 40, True), "frame", "left_semi").groupBy("frame").agg(F.count(F.lit(1)).alias("n"))


@query
def even_subsample(spark, d):
    return scans.even_subsample(S.returns(spark, d), 37).select("frame", "pt")


@query
def dedup_dual(spark, d):
    rows = S.table(spark, d, "events").select("event_id", "user_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    return scans.drop_dual_returns(rows, ["user_id", "event_type"], "us", 3_600_000_000, "event_id").select("event_id")


@query
def dedup_xyz(spark, d):
    rows = S.returns(spark, d).select("frame", "pt", *[K.cell(F.col(a), 2.0).alias(a) for a in "xyz"])
    return scans.first_of(rows, ["frame", "x", "y", "z"], "pt").select("frame", "pt")


@query
def pose_asof(spark, d):
    t = S.trajectory(spark, d)
    asked = t.select("user_id", F.col("event_id").alias("query_id"), (F.col("t_ns") + 1_800_000_000_000).alias("t_ns"))
    return rounded(scans.pose_at(asked, t, "user_id", HALF_DAY))


@query
def pose_nearest(spark, d):
    t = S.trajectory(spark, d)
    asked = t.where("event_id % 3 = 0").select("user_id", F.col("event_id").alias("query_id"), "t_ns")
    return scans.nearest_sample(asked, t.where("event_id % 3 <> 0"), "user_id")


@query
def match_tolerance(spark, d):
    near = pose_nearest(spark, d).where(F.col("distance_ns") <= HALF_DAY)
    return near.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("nearest_ns").alias("n_distinct"))


@query
def deskew_bins(spark, d):
    return scans.deskew_bins(S.returns_plain(spark, d), 2_000_000)


@query
def travel_fit(spark, d):
    t = S.trajectory(spark, d).select("user_id", "event_id", "t_ns", F.col("px").alias("v"))
    return rounded(scans.trailing_slope(t, "user_id", "t_ns", "v", 2 * HALF_DAY).select("event_id", "n", "slope"))


# the field


@query
def splat(spark, d):
    return rounded(field.splat(S.samples(spark, d), []))


@query
def block_weight_max(spark, d):
    return rounded(field.bound_weights(field.splat(S.samples(spark, d), ["block"])).select("block", "k", "value_sum", "weight_sum"))


def fused(spark: SparkSession, d: str) -> DataFrame:
    return field.merge_blocks(field.bound_weights(field.splat(S.samples(spark, d), ["block"])))


@query
def fused_nodes(spark, d):
    """The flagship: fused value, weight and number of temporal blocks of each lattice node."""
    return rounded(fused(spark, d).select("k", field.fused_value().alias("value"), F.col("weight_sum").alias("weight"), F.col("hit_count").alias("hits")))


@query
def merge_hits(spark, d):
    return fused(spark, d).select("k", "hit_count", "mask")


def nodes(spark: SparkSession, d: str) -> DataFrame:
    """k, s, w, h of the fused field; values to six digits, so that signs and gates do not hang on sums' order."""
    return fused(spark, d).select("k", r6(field.fused_value()).alias("s"), r6("weight_sum").alias("w"), F.col("hit_count").alias("h"))


@query
def current_value(spark, d):
    rows = nodes(spark, d).withColumn("solved", F.when(F.col("k") % 3 == 0, F.col("s") / 2))
    return rows.select("k", F.round(field.current_value() + OFF_TIES, 5).alias("current"))


@query
def field_normals(spark, d):
    return field.normals(nodes(spark, d)).select("k", *[F.round(f"n{a}", 5).alias(f"n{a}") for a in "xyz"])


@query
def dilate_blocks(spark, d):
    blocks = S.returns_plain(spark, d).select(K.pack(*[K.cell(F.col(a), 8.0) for a in "xyz"]).alias("k")).distinct()
    return field.dilate(blocks)


@query
def semi_region(spark, d):
    some = S.returns_plain(spark, d).where("frame = 7").select(K.block_of(cell_key(), 8).alias("b")).distinct()
    return nodes(spark, d).withColumn("b", K.block_of(F.col("k"), 8)).join(some, "b", "left_semi").groupBy("b").agg(F.count(F.lit(1)).alias("n"))


def voted(spark: SparkSession, d: str) -> DataFrame:
    p = F.when((F.col("w") > 0) & (F.col("s") <= 0), F.col("k") % 3).otherwise(0)
    return nodes(spark, d).select("k", "w", "h", F.col("s").alias("s0"), p.alias("p"))


def _target(kind: str):
    def run(spark, d):
        target, c = field.conflict_target(kind)
        return voted(spark, d).select("k", F.round(target + OFF_TIES, 5).alias("target"), r6(c).alias("c"))

    return run


for _kind in ("mirror", "truncation", "constant"):
    QUERIES[f"target_{_kind}"] = _target(_kind)


def solvable(spark: SparkSession, d: str) -> DataFrame:
    target, c = field.conflict_target("mirror")
    inside = K.block_of(F.col("k"), 8) % 2 == 0
    return voted(spark, d).select("k", F.col("s0").alias("s"), target.alias("target"), c.alias("c"), inside.alias("inside"))


@query
def jacobi3(spark, d):
    return field.jacobi(solvable(spark, d), 3).select("k", F.round(F.col("s") + OFF_TIES, 4).alias("s"))


@query
def running_moments(spark, d):
    per_frame = field.moments(S.returns_plain(spark, d), LEVELS, ["frame"])
    m = field.running(per_frame, "frame", ["level", "k"])
    return m.select("level", "k", "frame", "n", *[F.round(F.col(c) + 3e-9, 4).alias(c) for c in ("sx", "sy", "sz", "mxx", "mxy", "mzz")])  # off exact ties


@query
def local_frame(spark, d):
    """Finest level with enough returns, from moments up to and including the return's frame."""
    rows = S.returns(spark, d)
    m = field.running(field.moments(rows, LEVELS, ["frame"]), "frame", ["level", "k"]).where("n >= 5").select("level", "k", "frame", "n")
    levels = F.array(*[F.struct(F.lit(i).alias("level"), K.pack(*[K.cell(F.col(a), s) for a in "xyz"]).alias("k")) for i, s in enumerate(LEVELS)])
    asked = rows.select("frame", "pt", F.explode(levels).alias("l")).select("frame", "pt", "l.*")
    found = asked.join(m, ["level", "k", "frame"], "left").groupBy("frame", "pt").agg(F.min(F.when(F.col("n").isNotNull(), F.struct("level", "n"))).alias("b"))
    return found.select("frame", "pt", F.col("b.level").alias("level"), F.col("b.n").alias("n"), (F.coalesce(F.col("b.n") / (F.col("b.n") + 5), F.lit(0.0))).alias("conf")).withColumn("conf", r6("conf"))


def rays(spark: SparkSession, d: str) -> DataFrame:
    u = G.unit(G.vec("x", "y", "z"))
    return S.returns(spark, d).select((F.col("frame") * 10_000_000 + F.col("pt")).alias("id"), "x", "y", "z", *[c.alias(f"d{a}") for a, c in zip("xyz", u)], G.norm(G.vec("x", "y", "z")).alias("range"), u[2].alias("cosine"), (0.5 + F.col("frame") % 3).alias("trunc"), ((0.5 + F.col("frame") % 3) / 3.0).alias("tau"), F.col("weight").alias("conf"))


@query
def ray_samples(spark, d):
    return rounded(votes.along_ray(rays(spark, d), 0.4))


@query
def lateral_counts(spark, d):
    """Odd number of samples across a ray from the area of an ellipse, at most 25."""
    n = support.lateral_count(F.col("weight") * 0.5 + 0.1, F.col("z") * 0.1 + 0.1, 0.4, limited=False)
    return S.returns(spark, d).select("frame", "pt", n.alias("n"))


# neighbours and votes


@query
def knn(spark, d):
    c = S.cloud(spark, d)
    near = scores.nearest_within(c, c.select(F.col("pid").alias("oid"), "x", "y", "z"), 0.8, 8)
    return rounded(near.withColumnRenamed("d2", "dist2"))


def rays(returns: DataFrame) -> DataFrame:
    """Rays from the origin to the returns of the frames that are not held out: c, scan, ox..oz, ex..ez."""
    kept = returns.where("frame % 10 <> 5")
    return kept.select(F.col("block").alias("c"), F.col("frame").alias("scan"), *[F.lit(0.0).alias(f"o{a}") for a in "xyz"], *[F.col(a).alias(f"e{a}") for a in "xyz"])


def first_rays(spark: SparkSession, d: str) -> DataFrame | None:
    """Evenly spaced rays of each scan, ``MAX_RAYS_PER_SCAN`` at most; None if that is all of them."""
    first = rays(scans.even_subsample(S.returns(spark, d).where("frame % 10 <> 5"), MAX_RAYS_PER_SCAN))
    longer = rays(S.returns_plain(spark, d)).groupBy("scan").count().where(F.col("count") > MAX_RAYS_PER_SCAN)
    return None if longer.isEmpty() else first


@query
def pass_votes(spark, d):
    """Votes of all rays on every node by its tangent plane."""
    n = nodes(spark, d)
    first = first_rays(spark, d)
    return votes.pass_votes(n.select("k").join(field.normals(n), "k", "left"), rays(S.returns_plain(spark, d)), 1.0, 2.5, 1.5, first=first)


@query
def evidence_units(spark, d):
    """Hits counted as frames per block."""
    at = field.splat(S.samples(spark, d), ["block", "frame"])
    return at.groupBy("block", "k").agg(F.count(F.lit(1)).alias("n_frames"), r6(F.sum("weight_sum")).alias("weight"))


# surfaces


@query
def cube_vertices(spark, d):
    v = surface.cube_vertices(nodes(spark, d).where("w >= 0.1"))
    return v.select("cube", F.col("observed").cast("int").alias("observed"), F.col("n").cast("int").alias("n"), *[F.round(a, 4).alias(a) for a in "xyz"])


@query
def quads(spark, d):
    gated = nodes(spark, d).where("w >= 0.1")
    return surface.quads(gated, surface.cube_vertices(gated))


@query
def local_reindex(spark, d):
    v = nodes(spark, d).select(K.block_of(F.col("k"), 8).alias("block"), F.col("k").alias("vid"))
    return surface.local_ids(v, "block", "vid")


def block_sizes(spark: SparkSession, d: str) -> DataFrame:
    return nodes(spark, d).groupBy(K.block_of(F.col("k"), 8).alias("block")).agg(F.count(F.lit(1)).alias("nv"))


@query
def assemble_offsets(spark, d):
    return surface.block_offsets(block_sizes(spark, d)).select("block", "nv", F.col("start").cast("bigint").alias("start"))


@query
def tile_ids(spark, d):
    return surface.tiles(block_sizes(spark, d), 3000).select("block", "tile")


def before(spark: SparkSession, d: str) -> DataFrame:
    """The field without its last temporal block."""
    f = field.merge_blocks(field.bound_weights(field.splat(S.samples(spark, d).where("block < 5"), ["block"])))
    return f.select("k", r6(field.fused_value()).alias("s"), r6("weight_sum").alias("w"))


@query
def dirty_nodes(spark, d):
    return surface.dirty_nodes(before(spark, d), nodes(spark, d), 0.0125, 0.1)


@query
def dirty_blocks(spark, d):
    return surface.blocks_of_corners(dirty_nodes(spark, d), 8)


@query
def delta_replay(spark, d):
    e = S.table(spark, d, "events")
    log = e.select(F.col("event_id").alias("chunk"), F.col("user_id").alias("block"), (F.col("event_type") == "error").alias("removed"), F.col("value").alias("payload"))
    return surface.replay(log, 900)


# scores


@query
def ground_bands(spark, d):
    h = scores.above_ground(S.returns_plain(spark, d), 10.0)
    band = F.when(F.col("height") < 2, "low").when(F.col("height") < 5, "middle").otherwise("high")
    return h.groupBy(band.alias("band")).agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean_value"))


def held_out(spark: SparkSession, d: str) -> DataFrame:
    r = S.returns_plain(spark, d)
    expected = G.norm(G.vec("x", "y", "z"))
    hit = F.when(F.col("off_ns") % 7 != 0, expected + (F.col("off_ns") % 31 - 15) / 100.0)
    return r.where("frame % 10 = 5").select("frame", scores.range_band(expected).alias("band"), expected.alias("expected"), hit.alias("hit"))


@query
def ray_metrics(spark, d):
    return rounded(scores.ray_metrics(held_out(spark, d), []))


@query
def ray_rollup(spark, d):
    return rounded(scores.ray_metrics(held_out(spark, d), ["frame", "band"]))


@query
def roi_metrics(spark, d):
    """Points within a distance of any of a few sensor positions."""
    sensors = S.returns_plain(spark, d).groupBy("frame").agg(F.avg("x").alias("sx"), F.avg("y").alias("sy")).where("frame % 20 = 0")
    p = S.returns_plain(spark, d).where("frame % 10 = 5").select("frame", "x", "y", "value")
    # each position goes to the nine cells around it, so a point asks only its own
    cx, cy = K.cell(F.col("sx"), 10.0), K.cell(F.col("sy"), 10.0)
    around = F.explode(F.array(*[F.struct((cx + i).alias("cx"), (cy + j).alias("cy")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    there = sensors.select("sx", "sy", around.alias("c")).select("sx", "sy", "c.*")
    p = p.withColumns({"px": K.cell(F.col("x"), 10.0), "py": K.cell(F.col("y"), 10.0)})
    near = p.join(there, (F.col("px") == F.col("cx")) & (F.col("py") == F.col("cy")) & ((F.col("x") - F.col("sx")) ** 2 + (F.col("y") - F.col("sy")) ** 2 <= 100.0), "left_semi")
    return near.groupBy("frame").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("value")).alias("mean_value"))


@query
def zbuffer(spark, d):
    p = S.returns(spark, d).select("frame", "pt", K.cell(F.col("x"), 2.0).alias("px"), K.cell(F.col("y"), 2.0).alias("py"), F.col("z").alias("depth"))
    return scores.depth_buffer(p, 0.2).select("frame", "pt")


@query
def outlier_mean(spark, d):
    return rounded(scores.without_outliers(S.returns_plain(spark, d), "frame", "y", 3.0))


@query
def observed_mask(spark, d):
    """Voxels seen by any return after its transform, dilated by one."""
    p = G.transform(TURN, SHIFT, G.vec("x", "y", "z"))
    return field.dilate(S.returns_plain(spark, d).select(K.pack(*[K.cell(c, 4.0) for c in p]).alias("k")).distinct())


@query
def counter_diff(spark, d):
    """Blocks whose counters differ between two runs, null-safe."""
    n = F.count(F.lit(1)).alias("n")
    a = S.returns_plain(spark, d).groupBy("block").agg(n)
    b = S.returns_plain(spark, d).where("frame <> 7").groupBy("block").agg(n)
    return a.alias("a").join(b.alias("b"), "block", "full_outer").where("NOT (a.n <=> b.n)").select("block", F.col("a.n").alias("n_a"), F.col("b.n").alias("n_b"))


@query
def smoothed(spark, d):
    """Exponential smoothing with clipped change along each track, as a fold over its ordered samples."""
    t = S.trajectory(spark, d).groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("t_ns", "px"))).alias("a"))
    step = lambda s, x: s + F.greatest(F.least(0.3 * (x["px"] - s), F.lit(20.0)), F.lit(-20.0))
    return rounded(t.select("user_id", F.aggregate("a", F.element_at("a", 1)["px"], step).alias("last")))


@query
def frame_windows(spark, d):
    """Tumbling one-day blocks anchored at the first event, with running totals."""
    e = S.table(spark, d, "events").select("value", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    b = e.crossJoin(e.agg(F.min("us").alias("first"))).groupBy(F.floor((F.col("us") - F.col("first")) / 86_400_000_000).cast("bigint").alias("block")).agg(F.count(F.lit(1)).alias("n"))
    return b.withColumn("n_so_far", F.sum("n").over(Window.orderBy("block")))
