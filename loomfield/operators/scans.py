"""Filters, selections and poses of scans."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomfield.functions import geometry as G

POSE = ["px", "py", "pz"]
TURN = ["qx", "qy", "qz", "qw"]


def within_range(points: DataFrame, least: float, most: float) -> DataFrame:
    """Finite returns whose distance lies between two bounds."""
    p = G.vec("x", "y", "z")
    finite = ~(F.isnan(p[0]) | F.isnan(p[1]) | F.isnan(p[2]))
    return points.where(finite & G.norm(p).between(least, most))


def select_frames(spark, first: int, last: int, training: bool) -> DataFrame:
    """Frame indices from first to last - 1; ``training`` leaves out every index that ends in 5."""
    frames = spark.range(first, last).withColumnRenamed("id", "frame")
    return frames.where("frame % 10 <> 5") if training else frames


def parse_frames(spec: str) -> list[tuple[int, int, bool]]:
    """Ranges (first, last + 1, training) of a frame selection.

    ``train:a-b``, ``all:a-b``, ``a-b``, ``a-b:skip5mod10`` or a comma list of numbers and ranges; frames must increase.
    """
    out: list[tuple[int, int, bool]] = []
    for part in spec.split(","):
        m = re.fullmatch(r"\s*(?:(train|all):)?(\d+)(?:-(\d+))?(:skip5mod10)?\s*", part)
        if not m:
            raise ValueError(f"not a frame selection: {part!r}")
        first = int(m.group(2))
        last = int(m.group(3) or first)
        if last < first or (out and first < out[-1][1]):
            raise ValueError(f"frames must increase: {spec!r}")
        out.append((first, last + 1, m.group(1) == "train" or bool(m.group(4))))
    return out


def frames_of(spark, spec: str) -> DataFrame:
    """The frames of a selection; one that selects nothing is an error."""
    parts = [select_frames(spark, *p) for p in parse_frames(spec)]
    if all(last - first == 1 and training and first % 10 == 5 for first, last, training in parse_frames(spec)):
        raise ValueError(f"no frame left by {spec!r}")
    return reduce(DataFrame.unionByName, parts)


def even_subsample(points: DataFrame, most: int, group: str = "frame", order: str = "pt") -> DataFrame:
    """All of a group if it has at most ``most`` rows, else ``most`` evenly spaced ones with both ends."""
    n = F.count(F.lit(1)).over(Window.partitionBy(group))
    place = F.row_number().over(Window.partitionBy(group).orderBy(order)).cast("bigint") - 1  # its products leave 32 bits
    ranked = points.withColumns({"_n": n, "_i": place})
    # i is picked if some j has floor(j (n - 1) / (most - 1)) = i
    j = F.ceil(F.col("_i") * (most - 1) / (F.col("_n") - 1))
    picked = (j < most) & (F.floor(j * (F.col("_n") - 1) / (most - 1)) == F.col("_i"))
    return ranked.where((F.col("_n") <= most) | (F.col("_i") == F.col("_n") - 1) | picked).drop("_n", "_i")


def subsample_first(points: DataFrame, most: int, group: str = "frame", order: str = "pt") -> DataFrame:
    """``even_subsample`` with ``order`` renumbered from 0 in each group."""
    kept = even_subsample(points, most, group, order)
    return kept.withColumn(order, F.row_number().over(Window.partitionBy(group).orderBy(order)) - 1)


def keep_masked(points: DataFrame, mask: DataFrame, group: str = "frame", order: str = "pt") -> DataFrame:
    """Returns that a mask (group, order, keep) keeps; groups whose mask has another number of rows than the group are an error.

    The error is raised by the job that reads the result.
    """
    n = points.groupBy(group).agg(F.count(F.lit(1)).alias("n")).join(mask.groupBy(group).agg(F.count(F.lit(1)).alias("m")), group, "left")
    checked = n.select(group, F.when(F.coalesce(F.col("m"), F.lit(-1)) == F.col("n"), True).otherwise(F.raise_error(F.concat(F.lit("mask and returns differ in "), F.col(group).cast("string")))).alias("fits"))
    return points.join(checked.where("fits").drop("fits"), group).join(mask.where("keep").select(group, order), [group, order], "left_semi")


def drop_dual_returns(points: DataFrame, same: list[str], time: str, most: int, tie: str) -> DataFrame:
    """Of rows equal in ``same`` and at most ``most`` apart in time the later goes."""
    before = F.lag(time).over(Window.partitionBy(*same).orderBy(time, tie))
    return points.withColumn("_before", before).where(F.col("_before").isNull() | (F.col(time) - F.col("_before") > most)).drop("_before")


def first_of(points: DataFrame, same: list[str], order: str) -> DataFrame:
    """The first row in order of those equal in ``same``."""
    return points.withColumn("_r", F.row_number().over(Window.partitionBy(*same).orderBy(order))).where("_r = 1").drop("_r")


def pose_segments(trajectory: DataFrame, track: str) -> DataFrame:
    """Consecutive poses side by side; the columns of the later one end in 1."""
    w = Window.partitionBy(track).orderBy("t_ns")
    return trajectory.withColumns({f"{c}1": F.lead(c).over(w) for c in ["t_ns", *POSE, *TURN]})


def pose_at(queries: DataFrame, trajectory: DataFrame, track: str, most_gap: int, clamp: bool = False) -> DataFrame:
    """Poses at the query times between two samples; gaps over ``most_gap`` give none, and nothing is extrapolated.

    With ``clamp`` times before the first sample or after the last get that sample's pose.

    Queries and samples are merged by time within a track and the last sample before each query is
    carried on, so there is neither a range join nor a collected trajectory.
    """
    seg = pose_segments(trajectory, track)
    cols = ["t_ns", *POSE, *TURN]
    carried = F.struct(*[F.col(c) for c in cols], *[F.col(f"{c}1") for c in cols])
    samples = seg.select(track, F.col("t_ns").alias("_t"), F.lit(0).alias("_query"), F.lit(None).cast("bigint").alias("query_id"), carried.alias("_s"))
    asked = queries.select(track, F.col("t_ns").alias("_t"), F.lit(1).alias("_query"), "query_id", F.lit(None).cast(samples.schema["_s"].dataType).alias("_s"))
    w = Window.partitionBy(track).orderBy("_t", "_query").rowsBetween(Window.unboundedPreceding, 0)
    last = F.last("_s", ignorenulls=True).over(w)
    if clamp:
        last = F.coalesce(last, F.first("_s", ignorenulls=True).over(Window.partitionBy(track).orderBy("_t", "_query").rowsBetween(0, Window.unboundedFollowing)))
    both = samples.unionByName(asked).withColumn("_s", last).where("_query = 1 AND _s IS NOT NULL")
    flat = both.select(track, "query_id", F.col("_t").alias("t"), "_s.*")
    exact = F.col("t") == F.col("t_ns")
    if clamp:
        exact = exact | (F.col("t") < F.col("t_ns")) | F.col("t_ns1").isNull()
    flat = flat.where(exact | (F.col("t_ns1").isNotNull() & (F.col("t_ns1") - F.col("t_ns") <= most_gap)))
    f = F.when(exact, F.lit(0.0)).otherwise((F.col("t") - F.col("t_ns")) / (F.col("t_ns1") - F.col("t_ns")))
    at = lambda c: F.when(exact, F.col(c)).otherwise(F.col(c) + (F.col(f"{c}1") - F.col(c)) * f)
    turned = G.slerp([F.col(c) for c in TURN], [F.when(exact, F.col(c)).otherwise(F.col(f"{c}1")) for c in TURN], f)
    return flat.select(track, "query_id", F.col("t").alias("t_ns"), *[at(c).alias(c) for c in POSE], *[q.alias(c) for q, c in zip(turned, TURN)])


def nearest_sample(queries: DataFrame, samples: DataFrame, track: str) -> DataFrame:
    """Time of the nearest sample and how far it is; of two equally near the earlier counts."""
    a = samples.select(track, F.col("t_ns").alias("_t"), F.lit(0).alias("_query"), F.lit(None).cast("bigint").alias("query_id"), F.col("t_ns").alias("_s"))
    b = queries.select(track, F.col("t_ns").alias("_t"), F.lit(1).alias("_query"), "query_id", F.lit(None).cast("bigint").alias("_s"))
    both = a.unionByName(b)
    w = Window.partitionBy(track).orderBy("_t", "_query")
    before = F.last("_s", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    after = F.first("_s", ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing))
    both = both.withColumns({"_b": before, "_a": after}).where("_query = 1 AND coalesce(_a, _b) IS NOT NULL")
    earlier = F.col("_b").isNotNull() & (F.col("_a").isNull() | (F.col("_t") - F.col("_b") <= F.col("_a") - F.col("_t")))
    near = F.when(earlier, F.col("_b")).otherwise(F.col("_a"))
    return both.select(track, "query_id", near.alias("nearest_ns"), F.abs(F.col("_t") - near).alias("distance_ns"))


def deskew_bins(points: DataFrame, width: int) -> DataFrame:
    """Per frame and bin of time offsets: how many returns, and the offset at which the bin's pose is taken."""
    return points.groupBy("frame", F.floor(F.col("off_ns") / width).cast("bigint").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.expr("CAST(percentile(off_ns, 0.5) AS BIGINT)").alias("median_ns"))


def deskew(points: DataFrame, stamps: DataFrame, trajectory: DataFrame, track: str, width: int, mount: tuple = (), most_gap: int = 1 << 62) -> DataFrame:
    """Returns moved into their scan's frame at its stamp, with the sensor's place sx, sy, sz when each was measured.

    ``points``: frame, pt, x, y, z, off_ns; ``stamps``: frame, ``track``, t_ns. All returns of a bin of
    ``width`` ns share the pose at the bin's median offset, clamped to the trajectory; ``mount`` is the
    rotation and shift from sensor to body.
    """
    turn, shift = mount or ([[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], (0.0, 0.0, 0.0))
    bins = deskew_bins(points, width).join(stamps, "frame")
    asked = bins.select(track, F.struct("frame", "bin").alias("key"), (F.col("t_ns") + F.col("median_ns")).alias("t_ns"))
    asked = asked.unionByName(stamps.select(track, F.struct("frame", F.lit(None).cast("bigint").alias("bin")).alias("key"), "t_ns"))
    ids = asked.withColumn("query_id", F.xxhash64("key"))  # joined back by time, so that an id is only carried
    poses = pose_at(ids.select(track, "query_id", "t_ns"), trajectory, track, most_gap, clamp=True).select(track, "t_ns", *POSE, *TURN).distinct()
    at = lambda rows, t, mark: rows.join(poses.select(track, F.col("t_ns").alias(t), *[F.col(c).alias(f"{mark}{c}") for c in POSE + TURN]), [track, t])
    both = at(bins.withColumnRenamed("t_ns", "t0").withColumn("tb", F.col("t0") + F.col("median_ns")), "t0", "a")
    both = at(both, "tb", "b").select("frame", "bin", *[f"{m}{c}" for m in "ab" for c in POSE + TURN])
    rows = points.withColumn("bin", F.floor(F.col("off_ns") / width).cast("bigint")).join(both, ["frame", "bin"])
    pose = lambda m: (G.quaternion_matrix(*[F.col(f"{m}{c}") for c in TURN]), G.vec(*[f"{m}{c}" for c in POSE]))

    def in_scan(p: G.Vec) -> G.Vec:
        world = G.transform(*pose("b"), G.transform(turn, shift, p))
        return G.inverse_transform(turn, shift, G.inverse_transform(*pose("a"), world))

    moved, sensor = in_scan(G.vec("x", "y", "z")), in_scan((F.lit(0.0), F.lit(0.0), F.lit(0.0)))
    rest = [c for c in points.columns if c not in ("x", "y", "z")]
    return rows.select(*rest, *[c.alias(a) for a, c in zip("xyz", moved)], *[c.alias(f"s{a}") for a, c in zip("xyz", sensor)])


def trailing_slope(samples: DataFrame, track: str, time: str, value: str, width: int) -> DataFrame:
    """Least-squares slope over the trailing window that ends at each sample."""
    w = Window.partitionBy(track).orderBy(time).rangeBetween(-width, 0)
    t = (F.col(time) - F.min(time).over(Window.partitionBy(track))) / float(width)
    d = samples.withColumn("_t", t)
    n, st, sv = F.count(F.lit(1)).over(w), F.sum("_t").over(w), F.sum(value).over(w)
    stt, stv = F.sum(F.col("_t") * F.col("_t")).over(w), F.sum(F.col("_t") * F.col(value)).over(w)
    spread = n * stt - st * st
    return d.select("*", n.alias("n"), F.when((n > 1) & (spread > 1e-9), (n * stv - st * sv) / spread).alias("slope")).drop("_t")


def round_half_even(c: Column) -> Column:
    return F.rint(c).cast("bigint")
