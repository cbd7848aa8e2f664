from __future__ import annotations

import hashlib
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomfield.operators import field
from loomfield.plans import surrogates
from loomfield.sources import scans, sinks
from loomfield.streaming.blocks import FusedStream

TINY = "/root/testdata/sf0.001"


def test_cloud_roundtrip_and_range(spark, tmp_path):
    x = np.array([1.0, 50.0, np.nan, 3.0])
    (tmp_path / "a.pcd").write_bytes(sinks.pcd_bytes(x, x * 0, x * 0, x, np.arange(4)))
    rows = scans.read_clouds(spark, str(tmp_path / "a.pcd"), 0.5, 40.0, "offset_time").orderBy("pt").collect()
    assert [(r["x"], r["off_ns"]) for r in rows] == [(1.0, 0), (3.0, 3)]


def test_ascii_cloud_with_counts():
    raw = b"# c\n\nFIELDS x y z n\nSIZE 4 4 4 8\nTYPE F F F F\nCOUNT 1 1 1 2\nPOINTS 2\nDATA ascii\n1 2 3 4 5\n6 7 8 9 10\n"
    assert scans.pcd_columns(raw)["n"].tolist() == [[4, 5], [9, 10]]
    with pytest.raises(ValueError, match="3 points announced"):
        scans.pcd_columns(raw.replace(b"POINTS 2", b"POINTS 3"))
    with pytest.raises(ValueError, match="unsupported"):
        scans.pcd_columns(raw.replace(b"ascii", b"binary_compressed"))


def test_trajectory_text(spark, tmp_path):
    (tmp_path / "t.txt").write_text("# t x y z q\n1700000000.123456789 1 2 3 0 0 0 2\n")
    r = scans.read_trajectory(spark, str(tmp_path / "t.txt")).first()
    assert (r["t_ns"], r["qw"]) == (1700000000123456789, 1.0)


def test_calibration_must_be_rigid():
    with pytest.raises(ValueError):
        scans.parse_calibration('{"imu_from_lidar": {"rotation": [1,0,0,0,1,0,0,0,-1], "translation": [0,0,0]}}')


def test_calibration_names_and_camera():
    turn = [0, -1, 0, 1, 0, 0, 0, 0, 1]
    first = scans.parse_calibration(json.dumps({"imu_from_lidar": {"rotation": turn, "translation": [1, 2, 3]}, "camera": {"K": [400, 0, 320, 0, 410, 240, 0, 0, 1]}}))
    other = scans.parse_calibration(json.dumps({"extrin_calib": {"extrinsic_R": turn, "extrinsic_T": [1, 2, 3]}, "camera": {"fx": 400, "fy": 410, "cx": 320, "cy": 240}}))
    square = scans.parse_calibration(json.dumps({"imu_from_lidar": [0, -1, 0, 1, 1, 0, 0, 2, 0, 0, 1, 3, 0, 0, 0, 1]}))
    assert first == other and first["camera"] == [400.0, 410.0, 320.0, 240.0] and square["rotation"] == first["rotation"] and square["translation"] == [1, 2, 3]


def test_manifest_and_sequence(spark, tmp_path):
    line = lambda i, **more: json.dumps({"frame_id": str(i), "lidar_path": f"scans/{i}.pcd", "lidar_timestamp_ns": i * 100_000_000} | more)
    (tmp_path / "m.jsonl").write_text("\n".join([line(1), line(2), line(40)]) + "\n")
    rows = scans.checked_manifest(scans.read_manifest(spark, str(tmp_path / "m.jsonl")))
    assert [(r["frame"], r["point_time_unit"]) for r in rows.orderBy("frame").collect()] == [(0, "nanoseconds"), (1, "nanoseconds"), (2, "nanoseconds")]
    (tmp_path / "t.txt").write_text("".join(f"{i / 10:.1f} {i} 0 0 0 0 0 1\n" for i in range(5)))
    placed = scans.load_sequence(rows, scans.read_trajectory(spark, str(tmp_path / "t.txt")), {"rotation": np.eye(3).tolist(), "translation": [0.5, 0, 0]}).orderBy("frame").collect()
    assert [(r["frame"], r["px"], r["r11"]) for r in placed] == [(0, 1.5, 1.0), (1, 2.5, 1.0)]
    (tmp_path / "bad.jsonl").write_text(line(1, colour="red"))
    with pytest.raises(Exception, match="unknown field colour"):
        scans.read_manifest(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "twice.jsonl").write_text(line(1) + "\n" + line(1))
    with pytest.raises(ValueError, match="increase"):
        scans.checked_manifest(scans.read_manifest(spark, str(tmp_path / "twice.jsonl")))
    (tmp_path / "out.jsonl").write_text(line(1, lidar_path="../x.pcd"))
    with pytest.raises(Exception, match="leaves the sequence"):
        scans.load_sequence(scans.read_manifest(spark, str(tmp_path / "out.jsonl")), scans.read_trajectory(spark, str(tmp_path / "t.txt")), {"rotation": np.eye(3).tolist(), "translation": [0, 0, 0]}).collect()


def test_written_clouds_and_meshes_are_read_back(spark, tmp_path):
    points = spark.createDataFrame([(f, i, float(i + 1), 0.0, 0.0, 1.0, 5 * i) for f in (3, 4) for i in range(4)], "frame int, pt int, x double, y double, z double, intensity double, off_ns long")
    assert sinks.write_clouds(points, str(tmp_path)) == 2
    back = scans.read_clouds(spark, str(tmp_path / "000003.pcd"), time_field="offset_time", unit="nanoseconds").orderBy("pt").collect()
    assert [(r["x"], r["off_ns"]) for r in back] == [(1.0, 0), (2.0, 5), (3.0, 10), (4.0, 15)]
    v = spark.createDataFrame([(i * 10, float(i), 0.0, 0.0) for i in range(3)], "vid long, x double, y double, z double")
    f = spark.createDataFrame([(0, 10, 20)], "a long, b long, c long")
    assert sinks.write_mesh(v, f, str(tmp_path), "m.ply") == 1 and (tmp_path / "m.ply").read_bytes().startswith(b"ply\n")
    with pytest.raises(ValueError, match="cannot be written"):
        sinks.write_mesh(v, f.withColumn("c", F.lit(99).cast("long")), str(tmp_path), "m.ply")
    assert [r["sha256"] for r in scans.content_hashes(spark, str(tmp_path / "m.ply")).collect()] == [hashlib.sha256((tmp_path / "m.ply").read_bytes()).hexdigest()]


def test_mesh_bytes():
    raw = sinks.ply_bytes(np.zeros((3, 3)), np.array([[0, 1, 2]]))
    assert raw.startswith(b"ply\n") and len(raw.split(b"end_header\n")[1]) == 3 * 12 + 13


def test_stream_equals_batch(spark, tmp_path):
    samples = surrogates.samples(spark, TINY).select("block", "x", "y", "z", "value", "weight")
    for b in range(6):  # one file per temporal block, in order of arrival
        samples.where(F.col("block") == b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(samples.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    state = FusedStream(spark, str(tmp_path / "state"))
    state.run(stream, str(tmp_path / "checkpoint"))
    batch = field.merge_blocks(field.bound_weights(field.splat(samples, ["block"])))
    r = lambda df: {(x["k"], round(x["value_sum"], 6), round(x["weight_sum"], 6), x["hit_count"]) for x in df.collect()}
    assert r(state.field()) == r(batch)
