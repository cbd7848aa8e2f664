"""Near-duplicate documents by circulant MinHash, banding and exact Jaccard verification.

A document is its set of word shingles. Two permutations make all coordinates of its signature: the
first scatters the shingles' hashes over 2 ** 32 places, the second, shifted circularly by k, gives
coordinate k (its least value over the set). Bands of coordinates put documents into buckets; pairs
from buckets are links if the full sets are similar enough, so banding decides only what is
compared. With 32 bands of 4 coordinates a pair at similarity 0.75 is missed with probability 5e-6.

Equal sets are one class and are compared once. A small bucket compares all its classes (a bounded
number of pairs). A larger one compares each class with its first class; as long as its classes
fall into more than one component so far, classes outside its largest component are compared with
all of it, 64 of them in the next round, 4096 in the one after, and so on. At the end any two
classes of a bucket are connected or one of them was compared with the whole bucket, so no link is
lost. These comparisons are made in blocks of some 256 members with some 64 leaders of their bucket,
so pairs are compared without being rows and a task holds one block whatever the bucket's size.

Buckets, links and components stay in DataFrames; a round's tables are in the shared folder.

Definitions: a null text, or one without words, has an empty set and is linked with nothing;
documents of fewer words than a shingle have one shingle of all their words; very long texts are
taken whole; rows with the same doc_id are one document, so what is linked with one of them is
linked with all, and each gets its row; a row without doc_id is linked with nothing, has no
component and is kept; other columns are ignored, and pass through ``without_near_duplicates``
whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .components import components
from .scratch import Scratch

SMALL = 8  # classes in a bucket of which all pairs are compared
LEADERS = 64  # classes of a bucket that are compared with all of it in the second round


def shingles(texts: list[str | None], width: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's shingles."""
    h, bounds = W.many(texts, lower=True)
    own = [h[a:z] for a, z in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
    return [np.unique(W.windows(x, min(width, len(x)))) if len(x) else x for x in own]


def signature(found: np.ndarray, size: int) -> np.ndarray:
    """Least values of a permutation and its circular shifts over the scattered set."""
    place = (W.mix(found ^ np.uint64(0xA0761D6478BD642F)) >> np.uint64(32)).astype(np.uint32)
    out = np.full(size, np.iinfo(np.uint32).max, np.uint32)
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    for at in range(0, len(place), 512):
        x = place[None, at : at + 512] + shifts
        x ^= x >> np.uint32(16)
        x *= np.uint32(0x7FEB352D)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0x846CA68B)
        x ^= x >> np.uint32(16)
        np.minimum(out, x.min(1), out=out)
    return out


def _bands(sig: np.ndarray, bands: int) -> np.ndarray:
    rows = sig.reshape(bands, -1).astype(np.uint64)
    acc = np.arange(1, bands + 1, dtype=np.uint64)
    for i in range(rows.shape[1]):
        acc = W.mix(acc * np.uint64(0x9E3779B97F4A7C15) + rows[:, i])
    return acc


def signed(docs: DataFrame, width: int, bands: int, rows: int) -> DataFrame:
    """doc_id, set size, 128-bit digest of the set and its band keys."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                n, d1, d2, keys = [], [], [], []
                for found in shingles(part.column("text").to_pylist(), width):
                    n.append(len(found))
                    one, two = digest(found)
                    d1.append(one)
                    d2.append(two)
                    keys.append(_bands(signature(found, bands * rows), bands).view(np.int64) if len(found) else None)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "n", "d1", "d2", "bands"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n long, d1 long, d2 long, bands array<long>")


def digest(found: np.ndarray) -> tuple[int, int]:
    """128 bits that equal sets share."""
    return int(W.mix(found).sum(dtype=np.uint64).view(np.int64)), int(W.mix(found * np.uint64(0xE7037ED1A0B428DB)).sum(dtype=np.uint64).view(np.int64))


def _sets(texts: DataFrame, width: int) -> DataFrame:
    """The full sets of classes (id, d1, d2) from texts of their documents; other texts of the same doc_id are left out."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = b.slice(at, 128)
                rows = zip(part.column("id").to_pylist(), zip(part.column("d1").to_pylist(), part.column("d2").to_pylist()), shingles(part.column("text").to_pylist(), width))
                found = [(i, s.view(np.int64)) for i, d, s in rows if digest(s) == d]
                yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in found], pa.int64()), pa.array([s for _, s in found], pa.list_(pa.int64()))], names=["id", "s"])

    return texts.mapInArrow(run, "id long, s array<long>")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose full sets are similar enough."""
    one = pairs.join(sets.select(F.col("id").alias("a"), F.col("s").alias("sa")), "a")
    two = one.join(sets.select(F.col("id").alias("b"), F.col("s").alias("sb")), "b")
    both = F.size(F.array_intersect("sa", "sb"))
    return two.where(100 * both >= percent * (F.size("sa") + F.size("sb") - both)).select("a", "b")


def _verified_blocks(chosen: DataFrame, members: DataFrame, sets: DataFrame, percent: int, chunk: int = 256) -> DataFrame:
    """Links between leaders and members of the same bucket; both come as band, id, m (bucket size) and shares.

    A bucket's members are dealt to parts of about ``chunk`` by hash and its leaders to ``shares`` of
    about ``LEADERS``; each part meets each share in a group of its own. Sets are joined once per
    class and then copied to its groups; pairs are never rows.
    """
    parts = F.ceil(F.col("w.m") / chunk)
    upto = lambda n: F.sequence(F.lit(0).cast("bigint"), n - 1)
    per_id = lambda rows: rows.groupBy("id").agg(F.collect_list(F.struct("band", "m", "shares")).alias("ws"))
    member = per_id(members).join(sets, "id").select("id", "s", F.explode("ws").alias("w")).select("id", "s", "w", F.explode(upto(F.col("w.shares"))).alias("share"))
    member = member.select(F.xxhash64("w.band", F.pmod(F.xxhash64("id"), parts), "share").alias("g"), "id", "s")
    leader = per_id(chosen).join(sets.select("id", F.col("s").alias("t")), "id").select(F.col("id").alias("leader"), "t", F.explode("ws").alias("w"))
    leader = leader.select("leader", "t", "w", F.explode(upto(parts)).alias("part"))
    leader = leader.select(F.xxhash64("w.band", "part", F.pmod(F.xxhash64("leader", "w.band"), F.col("w.shares"))).alias("h"), "leader", "t")

    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found: list[np.ndarray] = []
        for at in range(0, len(left) if len(right) else 0, chunk):
            part = left.iloc[at : at + chunk]
            ids, size = part["id"].to_numpy(), part["s"].map(len).to_numpy()
            flat, start = np.concatenate(part["s"].to_list()), np.r_[0, np.cumsum(size)[:-1]]
            for a, t in zip(right["leader"], right["t"]):
                own = np.sort(np.asarray(t))
                place = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                both = np.add.reduceat((own[place] == flat).astype(np.int64), start)
                similar = (100 * both >= percent * (len(own) + size - both)) & (ids != a)
                found.append(np.stack([np.full(int(similar.sum()), a), ids[similar]]))
        pairs = np.concatenate(found, axis=1) if found else np.zeros((2, 0), np.int64)
        return pd.DataFrame({"a": pairs.min(0), "b": pairs.max(0)})

    return member.groupBy("g").cogroup(leader.groupBy("h")).applyInPandas(run, "a long, b long").distinct()


def _repeats(sig: DataFrame) -> DataFrame:
    """doc_ids of more than one row, and whether their rows differ."""
    ends = [f(c).alias(f"{n}_{c}") for c in ("d1", "d2") for n, f in (("low", F.min), ("high", F.max))]
    rows = sig.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), *ends).where("rows > 1")
    return rows.select("doc_id", (F.expr("low_d1 <> high_d1 OR low_d2 <> high_d2")).alias("differ"))


def _same_document(linked: DataFrame, classes: DataFrame, repeats: DataFrame) -> DataFrame:
    """Links (a, b) between the classes of rows with one doc_id."""
    rows = linked.join(repeats.where("differ").select("doc_id"), "doc_id", "left_semi").select("doc_id", "d1", "d2").distinct()
    own = rows.join(classes.select("d1", "d2", "id"), ["d1", "d2"]).select("doc_id", "id")
    least = own.groupBy("doc_id").agg(F.min("id").alias("a"))
    return own.join(least, "doc_id").where("a <> id").select("a", F.col("id").alias("b"))


def _linked(docs: DataFrame, width: int, percent: int, bands: int, rows: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """``near_duplicates`` and ``_repeats``."""
    sig = scratch.table(signed(docs, width, bands, rows), "signed")
    repeats = scratch.table(_repeats(sig), "repeats")
    once = repeats.isEmpty()
    linked = sig.where("n > 0 AND doc_id IS NOT NULL")
    # a class is a set; its number is made when the table is written
    folded = linked.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    classes = scratch.table(folded.withColumn("id", F.monotonically_increasing_id()), "classes")
    keyed = classes.select("id", "n", F.explode("bands").alias("band"))
    # written, so that the join below has nothing but the two tables and a hot band can be split
    counts = scratch.table(keyed.groupBy("band").agg(F.count(F.lit(1)).alias("m"), F.min("id").alias("first")).where("m > 1"), "counts")
    buckets = scratch.table(keyed.join(counts, "band"), "buckets")
    # n compares as a ratio: a bucket splits into the sizes that can be similar only through verification
    sized = f"100 * least(na, nb) >= {percent} * greatest(na, nb)"
    small = buckets.where(F.col("m") <= SMALL)
    left, right = small.select("band", F.col("id").alias("a"), F.col("n").alias("na")), small.select("band", F.col("id").alias("b"), F.col("n").alias("nb"))
    within = left.join(right, "band").where(f"a < b AND {sized}").select("a", "b")
    large = buckets.where(F.col("m") > SMALL)
    star = large.where("id <> first").select(F.col("first").alias("a"), F.col("id").alias("b"))
    pairs = scratch.table(within.unionByName(star).distinct(), "pairs-1")
    wanted = classes.join(buckets.select("id").distinct(), "id", "left_semi").select("id", "d1", "d2", "doc")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(wanted, "doc").select("id", "d1", "d2", "text")
    found = _sets(texts, width)
    sets = scratch.table(found if once else found.dropDuplicates(["id"]), "sets")
    links = scratch.table(_verified(pairs, sets, percent), "links-1")
    if not once:
        links = links.unionByName(scratch.table(_same_document(linked, classes, repeats), "links-0"))

    roots = scratch.table(components(links, scratch, "cc-1"), "roots-1")
    active, step, most = large.select("band", "id", "m"), 1, LEADERS
    while True:
        placed = active.groupBy("id").agg(F.collect_list(F.struct("band", "m")).alias("ws")).join(roots.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("root", "id").alias("root"), F.explode("ws").alias("w")).select("id", "root", "w.*")
        per_root = placed.groupBy("band", "root").agg(F.count(F.lit(1)).alias("k"))
        main = per_root.groupBy("band").agg(F.max(F.struct("k", "root")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("k").alias("all")).where("parts > 1").select("band", F.col("top.root").alias("main"), (F.col("all") - F.col("top.k")).alias("out"))
        outside = scratch.table(placed.join(main, "band").where("root <> main").select("band", "id", "m", "out"), f"outside-{step}")
        if outside.isEmpty():
            break
        # the next leaders of a bucket: all that are outside if they are few, else a share of them by hash
        shares = F.ceil(F.least("out", F.lit(most)) / LEADERS).alias("shares")
        chosen = outside.where((F.col("out") <= most) | (F.pmod(F.xxhash64("band", "id", F.lit(step)), F.col("out")) < most)).select("band", "id", "m", shares)
        members = active.join(chosen.select("band", "shares").distinct(), "band")
        links = links.unionByName(scratch.table(_verified_blocks(chosen, members, sets, percent), f"links-{step + 1}"))
        roots = scratch.table(components(links, scratch, f"cc-{step + 1}"), f"roots-{step + 1}")
        # a bucket all of whose outside was compared is done
        more = outside.where(F.col("out") > most).select("band").distinct()
        if more.isEmpty():
            break
        active = scratch.table(active.join(more, "band", "left_semi"), f"active-{step + 1}")
        step, most = step + 1, most * LEADERS

    named = classes.select("id", "doc").join(roots.withColumnRenamed("node", "id"), "id")
    least = named.join(named.groupBy("root").agg(F.min("doc").alias("least")), "root").select("id", "least")
    per_class = classes.select("d1", "d2", "id", "doc").join(least, "id", "left").select("d1", "d2", F.coalesce("least", "doc").alias("root"))
    member = sig.select("doc_id", "n", "d1", "d2").join(per_class, ["d1", "d2"], "left")
    component = F.when((F.col("n") > 0) & F.col("doc_id").isNotNull(), F.col("root")).otherwise(F.col("doc_id"))
    if not once:  # an empty row follows the other rows of its doc_id
        by_id = member.where("n > 0 AND doc_id IS NOT NULL").join(repeats.select("doc_id"), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("root").alias("other"))
        member = member.join(by_id, "doc_id", "left")
        component = F.coalesce("other", component)
    return member.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")), repeats


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, bands: int = 32, rows: int = 4, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id reachable) and kept, a row for each row of ``docs``."""
    return _linked(docs, width, percent, bands, rows, scratch or Scratch(docs.sparkSession, "minhash"))[0]


def without_near_duplicates(docs: DataFrame, width: int = 5, percent: int = 75, scratch: Scratch | None = None) -> DataFrame:
    """The rows of ``docs`` that stay; of rows that repeat doc_id and text one stays."""
    result, repeats = _linked(docs, width, percent, 32, 4, scratch or Scratch(docs.sparkSession, "minhash"))
    gone = result.where(~F.col("kept")).select(F.col("doc_id").alias("gone")).distinct()
    rows = docs.select(F.struct(*[F.col(c) for c in docs.columns]).alias("doc"), F.col("doc_id").cast("long").alias("key"), F.col("text").alias("text"))
    left = rows.join(gone, F.col("key") == F.col("gone"), "left_anti")
    if repeats.isEmpty():
        return left.select("doc.*")
    again = repeats.select(F.col("doc_id").alias("again"))
    single = left.join(again, F.col("key") == F.col("again"), "left_anti").select("doc")
    folded = left.join(again, F.col("key") == F.col("again"), "left_semi").groupBy("key", "text").agg(F.min_by("doc", F.to_json("doc")).alias("doc"))
    return single.unionByName(folded.select("doc")).select("doc.*")
