"""Readers of scans, trajectories, manifests and calibrations as DataFrames.

Files are listed and read by Spark, so any store that Spark reaches will do; decoding is Arrow
batches of one file each.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# Fixed values of the point cloud format: type letter and size to a little-endian dtype.
PCD_TYPES = {"F4": "<f4", "F8": "<f8", "I1": "<i1", "I2": "<i2", "I4": "<i4", "I8": "<i8", "U1": "<u1", "U2": "<u2", "U4": "<u4", "U8": "<u8"}
# Nanoseconds in a unit of time.
UNITS = {"s": 1_000_000_000, "ms": 1_000_000, "us": 1_000, "ns": 1, "seconds": 1_000_000_000, "milliseconds": 1_000_000, "microseconds": 1_000, "nanoseconds": 1}
MANIFEST = "frame_id string, lidar_path string, lidar_timestamp_ns bigint, image_path string, image_timestamp_ns bigint, point_time_field string, point_time_unit string, metadata map<string,string>"


def pcd_header(raw: bytes) -> tuple[dict[str, list[str]], int]:
    """Header entries and where the data begins; blank lines and comments are skipped."""
    out: dict[str, list[str]] = {}
    at = 0
    while "DATA" not in out:
        end = raw.find(b"\n", at)
        if end < 0:
            raise ValueError("the header has no DATA line")
        line = raw[at:end].decode("ascii", "replace").strip()
        at = end + 1
        if line and not line.startswith("#"):
            name, *rest = line.split()
            out[name.upper()] = rest
    return out, at


def pcd_columns(raw: bytes) -> dict[str, np.ndarray]:
    """Columns of a binary or ascii point cloud; a field with a count above one is two-dimensional."""
    head, at = pcd_header(raw)
    fields, n = head["FIELDS"], int(head["POINTS"][0])
    counts = [int(c) for c in head.get("COUNT", ["1"] * len(fields))]
    kinds = [PCD_TYPES[t.upper() + s] for t, s in zip(head["TYPE"], head["SIZE"], strict=True)]
    dtype = np.dtype([(f, k) if c == 1 else (f, k, (c,)) for f, k, c in zip(fields, kinds, counts, strict=True)])
    how = head["DATA"][0].lower()
    if how == "binary":
        if len(raw) - at < n * dtype.itemsize:
            raise ValueError(f"{n} points announced, {(len(raw) - at) // dtype.itemsize} found")
        rows = np.frombuffer(raw, dtype, n, at)
        return {f: rows[f] for f in fields}
    if how != "ascii":
        raise ValueError(f"unsupported data: {how}")
    cells = np.array(raw[at:].split(), dtype="U").reshape(-1, sum(counts)) if n else np.zeros((0, sum(counts)))
    if len(cells) != n:
        raise ValueError(f"{n} points announced, {len(cells)} found")
    out, c = {}, 0
    for f, k, width in zip(fields, kinds, counts):
        part = cells[:, c : c + width].astype("f8").astype(k)
        out[f] = part[:, 0] if width == 1 else part
        c += width
    return out


def read_clouds(spark: SparkSession, paths: str | list[str], least: float = 0.0, most: float = float("inf"), time_field: str | None = None, unit: str = "ns") -> DataFrame:
    """path, pt, x, y, z, intensity, off_ns of the finite returns within a range of distances."""
    scale = UNITS[unit]

    def decode(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, raw in zip(b["path"], b["content"]):
                c = pcd_columns(bytes(raw))
                xyz = [c[a].astype("f8") for a in "xyz"]
                distance = np.sqrt(sum(a * a for a in xyz))
                keep = np.isfinite(distance) & (distance >= least) & (distance <= most)
                if not keep.any():
                    raise ValueError(f"{path}: no return within range")
                light = next((c[f] for f in ("intensity", "reflectivity") if f in c), None)
                out = pd.DataFrame({"path": path, "pt": np.arange(int(keep.sum()), dtype="int32"), **{a: v[keep] for a, v in zip("xyz", xyz)}})
                out["intensity"] = np.nan if light is None else light[keep].astype("f4")
                out["off_ns"] = pd.array([pd.NA] * len(out), dtype="Int64") if time_field is None else np.rint(c[time_field][keep].astype("f8") * scale).astype("int64")
                yield out

    files = spark.read.format("binaryFile").load(paths).select("path", "content")
    return files.mapInPandas(decode, "path string, pt int, x double, y double, z double, intensity float, off_ns bigint")


def read_trajectory(spark: SparkSession, path: str, unit: str = "s") -> DataFrame:
    """Eight-column text; stamps go through DECIMAL, never through DOUBLE. A stamp given twice is an error when it is read."""
    lines = spark.read.text(path).select(F.trim("value").alias("v")).where("v <> '' AND NOT startswith(v, '#')")
    c = F.split("v", r"\s+")
    names = ["px", "py", "pz", "qx", "qy", "qz", "qw"]
    rows = lines.select((c[0].cast("decimal(38,9)") * UNITS[unit]).cast("bigint").alias("t_ns"), *[c[i + 1].cast("double").alias(n) for i, n in enumerate(names)])
    n = F.sqrt(sum((F.col(q) * F.col(q) for q in names[3:]), F.lit(0.0)))
    rows = rows.select("t_ns", *names[:3], *[(F.col(q) / n).alias(q) for q in names[3:]])
    again = F.count(F.lit(1)).over(Window.partitionBy("t_ns")) > 1
    return rows.withColumn("t_ns", F.when(again, F.raise_error(F.concat(F.lit("stamp given twice: "), F.col("t_ns").cast("string")))).otherwise(F.col("t_ns")))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per line, numbered by ``frame`` in the order of stamps; a malformed line is an error when it is read.

    An unknown field is an error too, and so are two lines of one stamp (``checked_manifest``).
    """
    known = [f.split(" ")[0] for f in MANIFEST.split(", ")]
    lines = spark.read.text(path).where(F.trim("value") != "")
    row = F.from_json("value", MANIFEST, {"mode": "FAILFAST"})
    extra = F.array_except(F.json_object_keys("value"), F.array(*map(F.lit, known)))
    checked = F.when(F.size(extra) > 0, F.raise_error(F.concat(F.lit("unknown field "), F.array_join(extra, ", ")))).otherwise(row)
    rows = lines.select(checked.alias("r")).select("r.*").withColumn("point_time_unit", F.coalesce("point_time_unit", F.lit("nanoseconds")))
    return rows.withColumn("frame", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("lidar_timestamp_ns")) - 1)  # one small row per scan


def checked_manifest(rows: DataFrame) -> DataFrame:
    """The manifest, if it has lines and no stamp twice."""
    n, distinct = rows.agg(F.count(F.lit(1)), F.count_distinct("lidar_timestamp_ns")).first()
    if not n or n != distinct:
        raise ValueError("a manifest needs scans with stamps that increase")
    return rows


def not_increasing(rows: DataFrame, time: str, by: list[str], order: str) -> DataFrame:
    """Rows whose stamp is not after the one before in ``order``; an ordered sequence has none."""
    before = F.lag(time).over(Window.partitionBy(*(by or [F.lit(1)])).orderBy(order))
    return rows.withColumn("before", before).where(F.col(time) <= F.col("before")).drop("before")


def load_sequence(manifest: DataFrame, trajectory: DataFrame, calibration: dict[str, list], most_gap: int = 200_000_000, image_gap: int = 30_000_000) -> DataFrame:
    """The manifest's scans with the sensor's pose in the world at their stamp: px..pz and the rotation r00..r22.

    Scans between samples more than ``most_gap`` apart have no pose and go; nothing is extrapolated. Paths
    that leave the sequence's folder and images too far from their scan are errors when they are read.
    """
    from loomfield.functions import geometry as G
    from loomfield.operators import scans as S

    escapes = F.col("lidar_path").startswith("/") | F.array_contains(F.split("lidar_path", "/"), "..")
    late = F.abs(F.col("image_timestamp_ns") - F.col("lidar_timestamp_ns")) > image_gap
    problem = F.when(escapes, F.lit("path leaves the sequence: ")).when(F.coalesce(late, F.lit(False)), F.lit("image too far from its scan: "))
    path = F.when(problem.isNotNull(), F.raise_error(F.concat(problem, F.col("lidar_path")))).otherwise(F.col("lidar_path"))
    rows = manifest.withColumn("lidar_path", path)
    one = lambda df: df.withColumn("track", F.lit(0))
    asked = one(rows.select(F.col("frame").cast("bigint").alias("query_id"), F.col("lidar_timestamp_ns").alias("t_ns")))
    poses = S.pose_at(asked, one(trajectory), "track", most_gap)
    turn = G.quaternion_matrix(*[F.col(c) for c in S.TURN])
    r, t = calibration["rotation"], calibration["translation"]
    product = [[sum((turn[i][k] * r[k][j] for k in range(3)), F.lit(0.0)) for j in range(3)] for i in range(3)]
    place = G.transform(turn, G.vec(*S.POSE), tuple(F.lit(float(c)) for c in t))
    placed = poses.select(F.col("query_id").alias("frame"), *[c.alias(n) for c, n in zip(place, S.POSE)], *[product[i][j].alias(f"r{i}{j}") for i in range(3) for j in range(3)])
    return rows.join(placed, "frame")


def content_hashes(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """path and sha256 of files."""
    return spark.read.format("binaryFile").load(paths).select("path", F.sha2("content", 256).alias("sha256"))


def _matrix(entry: object) -> tuple[np.ndarray, np.ndarray]:
    """Rotation and translation of a 4 x 4 matrix, or of an entry that names them."""
    if isinstance(entry, dict):
        return np.array(entry["rotation"], float).reshape(3, 3), np.array(entry["translation"], float).reshape(3)
    m = np.array(entry, float).reshape(4, 4)
    if not np.allclose(m[3], [0, 0, 0, 1]):
        raise ValueError("not a rigid transform")
    return m[:3, :3], m[:3, 3]


def parse_calibration(text: str) -> dict[str, list]:
    """Rotation and translation from sensor to body, checked to be rigid, and if given the camera's fx, fy, cx, cy.

    JSON, or YAML where its module is there. Accepted are ``imu_from_lidar`` (an entry with rotation and
    translation, or 16 numbers) and, by their usual other names, ``extrinsic_R`` and ``extrinsic_T``, by
    themselves or in ``extrin_calib``; ``camera`` with a matrix ``K`` or the four numbers.
    """
    try:
        c = json.loads(text)
    except ValueError:
        import yaml

        c = yaml.safe_load(text)
    if "imu_from_lidar" in c:
        r, t = _matrix(c["imu_from_lidar"])
    else:
        e = c.get("extrin_calib", c)
        r, t = np.array(e["extrinsic_R"], float).reshape(3, 3), np.array(e["extrinsic_T"], float).reshape(3)
    if not np.isfinite(r).all() or not np.isfinite(t).all() or not np.allclose(r @ r.T, np.eye(3), atol=1e-6) or np.linalg.det(r) < 0:
        raise ValueError("not a rigid transform")
    out = {"rotation": r.tolist(), "translation": t.tolist()}
    camera = c.get("camera")
    if camera:
        k = np.array(camera["K"], float).reshape(3, 3) if "K" in camera else None
        out["camera"] = [float(x) for x in ((k[0, 0], k[1, 1], k[0, 2], k[1, 2]) if k is not None else (camera[n] for n in ("fx", "fy", "cx", "cy")))]
    return out
