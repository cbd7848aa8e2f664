"""Exact top-k search by inner product over an index of pivot distances.

Vectors become integers, floor(scale * x). Pivots are vectors drawn by hash (at most ``pivots``).
The index keys every vector by its nearest pivot and its distance to it and stores runs of
``block`` vectors in that order: annuli around a pivot, each with the range of its distances and
its largest norm. With d(q, v) >= |d(q, p) - d(v, p)|, an annulus cannot hold a score above
(|q|^2 + max|v|^2 - gap^2) / 2, where gap is the distance from d(q, p) to the annulus' range.

A query expands its annuli in the order of their bounds: ``first`` of them, then eight times as
many, then the rest; its k-th score so far rules out every annulus whose bound is lower, and most
queries stop before the last round. Bounds are checked against all annuli, so the result is exact
whatever the pivots.

Everything meets in blocks of bounded size. Queries are dealt to groups of about ``group`` by hash
and the annulus directory (one small row per ``block`` vectors) to parts of as many rows as a task
holds easily; each group meets each part once per round. An annulus is searched once by each group that
needs it, with one matrix product per 512 queries. A very common vector fills whole annuli and is
spread over them by row, not by value; a query keeps k rows per annulus at most.

Definitions: vectors that are null, empty, hold a null or non-finite component, differ in length
from the first pivot, or have a null id take no part; ties go to the smaller id; rows with the same
id are candidates one by one but one query (the least of their vectors), and a query never meets a
row of its own id; other columns are
ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .scratch import Scratch

_HITS = "query_id long, vec_id long, score long"
_PART = 16_384  # rows of the directory that a task holds


def _matrix(blobs: Iterable[bytes]) -> np.ndarray:
    return np.stack([np.frombuffer(b, dtype="<f8") for b in blobs])


def quantized(vectors: DataFrame, scale: int = 1024, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id and the integer vector as packed doubles (exact below 2 ** 53); unusable vectors are left out."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            ids, blobs = [], []
            for i, v in zip(b["vec_id"], b["v"]):
                if v is None or not len(v):
                    continue
                x = np.array(v, dtype=np.float64)
                if np.isfinite(x).all():
                    ids.append(int(i))
                    blobs.append(np.floor(scale * x).astype("<f8").tobytes())
            yield pd.DataFrame({"vec_id": pd.Series(ids, dtype="int64"), "v": pd.Series(blobs, dtype="object")})

    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    return rows.mapInPandas(run, "vec_id long, v binary")


def _nearest(points: DataFrame, pivots: np.ndarray) -> DataFrame:
    """Pivot and distance of every vector; vectors of another length are left out."""
    norms = (pivots**2).sum(1)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b = b[[len(x) == 8 * pivots.shape[1] for x in b["v"]]]
            if len(b):
                m = _matrix(b["v"])
                d2 = (m**2).sum(1)[:, None] - 2 * m @ pivots.T + norms
                p = d2.argmin(1)
                yield pd.DataFrame({"vec_id": b["vec_id"].to_numpy(), "v": list(b["v"]), "pivot": p.astype("int32"), "r": np.sqrt(np.maximum(d2[np.arange(len(p)), p], 0))})

    return points.mapInPandas(run, "vec_id long, v binary, pivot int, r double")


def _annuli(keyed: DataFrame, block: int, parts: int) -> DataFrame:
    """Runs of ``block`` vectors in (pivot, distance) order; the id breaks ties, so equal vectors spread."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        held: list[pd.DataFrame] = []
        n = seq = 0
        base = TaskContext.get().partitionId() << 32

        def out(rows: pd.DataFrame) -> Iterator[pd.DataFrame]:
            nonlocal seq
            for pivot, g in rows.groupby("pivot", sort=True):
                m = _matrix(g["v"])
                norm = (m**2).sum(1)
                yield pd.DataFrame({"annulus": [base + seq], "pivot": [int(pivot)], "lo": [g["r"].min()], "hi": [g["r"].max()], "norm": [norm.max()], "n": [len(g)], "ids": [g["vec_id"].to_numpy(dtype="<i8").tobytes()], "m": [m.tobytes()]})
                seq += 1

        for b in batches:
            held.append(b)
            n += len(b)
            while n >= block:
                rows = pd.concat(held)
                yield from out(rows[:block])
                held, n = [rows[block:]], n - block
        if n:
            yield from out(pd.concat(held))

    ordered = keyed.repartitionByRange(parts, "pivot", "r", "vec_id").sortWithinPartitions("pivot", "r", "vec_id")
    return ordered.mapInPandas(run, "annulus long, pivot int, lo double, hi double, norm double, n long, ids binary, m binary")


def _bounds(queries: DataFrame, directory: DataFrame, pivots: np.ndarray, groups: int, parts: int, most: int | None) -> DataFrame:
    """(g, query_id, annulus) whose bound reaches the query's floor: all of them, or its ``most`` best ones.

    ``queries``: g, vec_id, v, floor. A group of queries meets a part of the directory in one task,
    some hundred queries and some thousand annuli at a time.
    """
    own = (pivots**2).sum(1)

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for at in range(0, len(left) if len(right) else 0, 256):
            some = left.iloc[at : at + 256]
            q, floor, ids = _matrix(some["v"]), some["floor"].to_numpy(), some["vec_id"].to_numpy()
            qn = (q**2).sum(1)
            near = np.sqrt(np.maximum(qn[:, None] - 2 * q @ pivots.T + own, 0))
            for begin in range(0, len(right), 4096):
                ring = right.iloc[begin : begin + 4096]
                dist = near[:, ring["pivot"].to_numpy()]
                # distances carry rounding: widen by a relative 1e-9
                gap = np.maximum(np.maximum(ring["lo"].to_numpy() - dist, dist - ring["hi"].to_numpy()) - 1e-9 * (1 + dist), 0)
                bound = (qn[:, None] + ring["norm"].to_numpy() - gap**2) / 2
                keep = bound >= floor[:, None] - 1e-6
                if most is not None and most < len(ring):
                    best = np.argpartition(-bound, most - 1, axis=1)[:, :most]
                    chosen = np.zeros(bound.shape, bool)
                    np.put_along_axis(chosen, best, True, axis=1)
                    keep &= chosen
                i, j = np.nonzero(keep)
                found.append((ids[i], ring["annulus"].to_numpy()[j], bound[i, j]))
        columns = [np.concatenate(c) for c in zip(*found)] if found else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        return pd.DataFrame({"g": left["g"].iloc[0] if len(left) else 0, "query_id": columns[0], "annulus": columns[1], "bound": columns[2]})

    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    asked = queries.withColumn("part", every(parts))
    copies = directory.withColumn("share", F.pmod(F.xxhash64("annulus"), F.lit(parts)).cast("int")).withColumn("cell", every(groups))
    pairs = asked.groupBy("g", "part").cogroup(copies.groupBy("cell", "share")).applyInPandas(run, "g int, query_id long, annulus long, bound double")
    if most is not None:
        rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound"), "annulus"))
        pairs = pairs.withColumn("place", rank).where(F.col("place") <= most)
    return pairs.select("g", "query_id", "annulus")


def _search(pairs: DataFrame, queries: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """At most k hits of each (query, annulus) pair; an annulus meets one group of queries at a time."""

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: dict[str, list[np.ndarray]] = {"query_id": [], "vec_id": [], "score": []}
        if len(left) and len(right):
            ids = np.frombuffer(right["ids"].iloc[0], dtype="<i8")
            m = np.frombuffer(right["m"].iloc[0], dtype="<f8").reshape(len(ids), -1)
            for at in range(0, len(left), 512):
                part = left.iloc[at : at + 512]
                for q, s in zip(part["query_id"], _matrix(part["v"]) @ m.T):
                    ok = np.flatnonzero(ids != q)
                    best = ok[np.lexsort((ids[ok], -s[ok]))[:k]]
                    out["query_id"].append(np.full(len(best), q))
                    out["vec_id"].append(ids[best])
                    out["score"].append(s[best].astype("int64"))
        return pd.DataFrame({c: np.concatenate(v).astype("int64") if v else np.array([], dtype="int64") for c, v in out.items()})

    asked = pairs.join(queries.select(F.col("vec_id").alias("query_id"), "v"), "query_id")
    cells = pairs.select(F.col("annulus").alias("ring"), F.col("g").alias("cell")).distinct()
    cells = cells.join(index.select(F.col("annulus").alias("ring"), "ids", "m"), "ring")
    return asked.groupBy("annulus", "g").cogroup(cells.groupBy("ring", "cell")).applyInPandas(run, _HITS)


def _best(hits: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, vectors: DataFrame, k: int = 10, scale: int = 1024, pivots: int = 64, block: int = 2048, first: int = 3, group: int = 2048, scratch: Scratch | None = None) -> DataFrame:
    """query_id, rank, vec_id and score of each query's k best vectors; ``queries`` and ``vectors`` have vec_id and embedding."""
    spark = vectors.sparkSession
    scratch = scratch or Scratch(spark, "topk")
    points = scratch.table(quantized(vectors, scale), "points")
    chosen = [np.frombuffer(r["v"], dtype="<f8") for r in points.orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()]
    if not chosen:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    centre = np.stack([c for c in chosen if len(c) == len(chosen[0])])
    ranges = max(spark.sparkContext.defaultParallelism, points.count() // (16 * block) + 1)
    index = scratch.table(_annuli(_nearest(points, centre), block, ranges), "index")
    directory = index.select("annulus", "pivot", "lo", "hi", "norm")
    usable = quantized(queries, scale).where(F.length("v") == 8 * centre.shape[1])
    asked = scratch.table(usable.groupBy("vec_id").agg(F.min("v").alias("v")), "queries")
    groups, parts = asked.count() // group + 1, directory.count() // _PART + 1
    asked = asked.withColumn("g", F.pmod(F.xxhash64("vec_id"), F.lit(groups)).cast("int"))
    hits = spark.createDataFrame([], "query_id long, vec_id long, score long")
    searched = spark.createDataFrame([], "query_id long, annulus long")
    for step, most in enumerate((first, 8 * first, None)):
        floor = hits.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("least")).where(F.col("n") >= k).select("query_id", F.col("least").cast("double").alias("floor"))
        open_ = asked.join(floor, asked["vec_id"] == floor["query_id"], "left").select("g", "vec_id", "v", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
        found = _bounds(open_, directory, centre, groups, parts, most).join(searched, ["query_id", "annulus"], "left_anti")
        pairs = scratch.table(found.select("g", "query_id", "annulus"), f"pairs-{step}")
        if pairs.isEmpty():
            break
        best = _best(hits.unionByName(_search(pairs, asked, index, k)), k)
        hits = scratch.table(best.select("query_id", "vec_id", "score"), f"hits-{step}")
        searched = searched.unionByName(pairs.select("query_id", "annulus"))
    return _best(hits, k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
