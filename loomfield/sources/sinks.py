"""Writers: point clouds and meshes as files of their formats, change logs as tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def pcd_bytes(x: np.ndarray, y: np.ndarray, z: np.ndarray, intensity: np.ndarray, off_ns: np.ndarray) -> bytes:
    """A binary point cloud with float coordinates and unsigned offsets."""
    n = len(x)
    # The format's header and the fields that readers of such files look for.
    head = f"# .PCD v0.7\nVERSION 0.7\nFIELDS x y z intensity offset_time\nSIZE 4 4 4 4 4\nTYPE F F F F U\nCOUNT 1 1 1 1 1\nWIDTH {n}\nHEIGHT 1\nVIEWPOINT 0 0 0 1 0 0 0\nPOINTS {n}\nDATA binary\n"
    rows = np.zeros(n, dtype=[("x", "<f4"), ("y", "<f4"), ("z", "<f4"), ("i", "<f4"), ("t", "<u4")])
    for name, v in zip(rows.dtype.names, (x, y, z, intensity, off_ns)):
        rows[name] = v
    return head.encode("ascii") + rows.tobytes()


def clouds_as_bytes(points: DataFrame, by: str = "frame") -> DataFrame:
    """(frame, content): each frame's returns as one file's bytes; a frame is one sweep, so bounded."""

    def encode(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("pt")
        return pd.DataFrame({by: [g[by].iloc[0]], "content": [pcd_bytes(*(g[c].to_numpy() for c in ("x", "y", "z", "intensity", "off_ns")))]})

    return points.groupBy(by).applyInPandas(encode, f"{by} int, content binary")


def ply_bytes(vertices: np.ndarray, faces: np.ndarray, colours: np.ndarray | None = None) -> bytes:
    """A binary little-endian mesh."""
    kinds = [("x", "<f4"), ("y", "<f4"), ("z", "<f4")] + ([("red", "u1"), ("green", "u1"), ("blue", "u1")] if colours is not None else [])
    v = np.zeros(len(vertices), dtype=kinds)
    for i, a in enumerate("xyz"):
        v[a] = vertices[:, i]
    if colours is not None:
        for i, a in enumerate(("red", "green", "blue")):
            v[a] = colours[:, i]
    f = np.zeros(len(faces), dtype=[("n", "u1"), ("v", "<i4", (3,))])
    f["n"], f["v"] = 3, faces
    names = {"<f4": "float", "u1": "uchar"}
    props = "".join(f"property {names[k]} {n}\n" for n, k in kinds)
    return f"ply\nformat binary_little_endian 1.0\nelement vertex {len(v)}\n{props}element face {len(f)}\nproperty list uchar int vertex_indices\nend_header\n".encode("ascii") + v.tobytes() + f.tobytes()


def append_deltas(changes: DataFrame, path: str, chunk: int) -> None:
    """Add a chunk to a change log; a chunk that is written again replaces itself."""
    changes.withColumn("chunk", F.lit(chunk).cast("bigint")).write.mode("overwrite").parquet(f"{path}/chunk={chunk:012d}")


def run_summary(rows: DataFrame, measures: list[str]) -> DataFrame:
    """Means and counts per run as one row, for a JSON sink."""
    return rows.agg(F.count(F.lit(1)).alias("n"), *[F.avg(m).alias(f"mean_{m}") for m in measures])


def write_summary(rows: DataFrame, measures: list[str], path: str) -> None:
    """``run_summary`` as one JSON file; what cannot be a JSON number (not finite) is left out of its line."""
    one = run_summary(rows, measures)
    clean = [F.when(~(F.isnan(c) | (F.abs(F.col(c)) == float("inf"))), F.col(c)).alias(c) if t == "double" else F.col(c) for c, t in one.dtypes]
    one.select(*clean).coalesce(1).write.mode("errorifexists").json(path)


def write_files(files: DataFrame, folder: str) -> int:
    """Write rows of name and content as files below ``folder``, in whatever store Spark reaches; how many were written.

    Each file is written beside its place and renamed. Rows come to the driver one partition at a time.
    """
    spark = files.sparkSession
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    n = 0
    for row in files.select("name", "content").toLocalIterator():
        if "/" in row["name"] or row["name"].startswith("."):
            raise ValueError(f"not a file name: {row['name']!r}")
        path, part = jvm.org.apache.hadoop.fs.Path(f"{folder}/{row['name']}"), jvm.org.apache.hadoop.fs.Path(f"{folder}/.{row['name']}.part")
        store = path.getFileSystem(conf)
        out = store.create(part, True)
        out.write(bytearray(row["content"]))
        out.close()
        store.delete(path, False)
        if not store.rename(part, path):
            raise OSError(f"could not write {folder}/{row['name']}")
        n += 1
    return n


def write_clouds(points: DataFrame, folder: str, by: str = "frame") -> int:
    """One point cloud file per group, named by its number."""
    files = clouds_as_bytes(points, by)
    return write_files(files.select(F.format_string("%06d.pcd", F.col(by).cast("bigint")).alias("name"), "content"), folder)


def write_mesh(vertices: DataFrame, faces: DataFrame, folder: str, name: str) -> int:
    """A mesh as one file: ``vertices`` (vid, x, y, z and if there red, green, blue) and ``faces`` (a, b, c by vid).

    A single file is a single writer's work; tables are the sink for meshes that no reader can hold.
    """
    checked = invalid_mesh(vertices, faces)
    if not checked.isEmpty():
        raise ValueError(f"faces or vertices that cannot be written: {checked.first()}")
    v = vertices.orderBy("vid").toPandas()
    place = pd.Series(np.arange(len(v)), index=v["vid"])
    f = faces.orderBy("a", "b", "c").toPandas()
    colours = v[["red", "green", "blue"]].to_numpy() if "red" in v else None
    raw = ply_bytes(v[["x", "y", "z"]].to_numpy(), np.stack([place[f[c]].to_numpy() for c in "abc"], axis=1).reshape(-1, 3), colours)
    return write_files(vertices.sparkSession.createDataFrame([(name, bytearray(raw))], "name string, content binary"), folder)


def invalid_mesh(vertices: DataFrame, faces: DataFrame) -> DataFrame:
    """What makes a mesh invalid: vertices that are not finite or doubled, corners without a vertex. Empty for a valid one."""
    finite = F.lit(True)
    for a in "xyz":
        finite = finite & F.col(a).isNotNull() & ~F.isnan(a) & (F.abs(F.col(a)) < float("inf"))
    bad = vertices.groupBy("vid").agg(F.count(F.lit(1)).alias("n"), F.min(finite).alias("finite")).where("n > 1 OR NOT finite").select(F.lit("vertex").alias("what"), "vid")
    corners = faces.select(F.explode(F.array("a", "b", "c")).alias("vid"))
    return bad.unionByName(corners.join(vertices.select("vid"), "vid", "left_anti").select(F.lit("corner").alias("what"), "vid"))
