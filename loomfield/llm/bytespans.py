"""Removal of byte strings that also start elsewhere, by sorting the suffixes that can repeat.

Every string of ``length`` bytes is represented by the smallest hash among the half as long strings
inside it, its anchor; equal strings have equal anchors at equal places. Strings next to each other
with one anchor form a segment, and anchors that occur once in the corpus are dropped with all their
strings. Equal segments are folded into one row with a count first, so a group of thousands of
copies sends one segment to the sort; what is left is where repeats begin and end.

Those segments are cut at their anchor into a suffix and a reversed prefix. Splitters sampled from
the data range-partition them by the anchor's leading bytes and its hash; equal anchors fall on one
side of a splitter, so a bucket's first and last anchors are compared with the neighbours' by
construction of the ranges and no repeat straddles two buckets. Each bucket sorts suffixes and
reversed prefixes by multikey quicksort and takes the common prefixes of neighbours; a string that
starts o bytes before the anchor repeats if another segment agrees on o bytes to the left and
length - o to the right, which the two sorted orders tell for all segments of the bucket at once.

An anchor that more than ``HEAVY`` different segments share is split before it is sorted: the
strings that start a .. b bytes before the anchor all hold the bytes from a before it to length - b
after it, so the range of starts is halved and segments go on with those bytes as their key, until
few enough share one. A single start left means that the key is the whole string and a count decides.

Definitions: a null text is empty; matches never cross documents but count within one; texts
shorter than ``length`` lose nothing, very long ones are taken whole; every row is a document, so
rows with the same doc_id and the same text remove each other's bytes; a null doc_id is a doc_id like
any other; other columns, whatever their names, are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch

_NO_ID = -(1 << 63)
_SMALL = 48  # suffixes that are sorted by comparison
HEAVY = 512  # segments with one key that are sorted together
_BUCKET = 8_000  # segments in a range, about


def encode(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def string_hashes(h: np.ndarray, length: int) -> np.ndarray:
    """A hash of each string of ``length`` byte values, from strings of half the length."""
    have, power = 1, 0x9E3779B97F4A7C15
    while have < length:
        step = min(have, length - have)
        # strings of have + step bytes: one at the start and one that ends with them
        h = h[: len(h) - step] * np.uint64(power) + h[step:]
        power = (power * power + 2 * step) % (1 << 64)
        have += step
    return W.mix(h)


def segments(raw: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of strings with one anchor: anchor hash, anchor place, first and last start, hash of the bytes."""
    half = length // 2
    if len(raw) < length:
        z = np.zeros(0, np.int64)
        return z.astype(np.uint64), z, z, z, z.astype(np.uint64)
    values = W.BYTE[raw]
    keys = string_hashes(values, half)
    place = W.sliding_min(keys, length - half + 1)
    start = np.flatnonzero(np.r_[True, place[1:] != place[:-1]])
    end = np.r_[start[1:], len(place)] - 1
    at = place[start]
    content = W.ranges(W.prefix(values), start, end + length, seed=length)
    return keys[at], at, start, end, W.mix(content + (at - start).astype(np.uint64))


def multikey_quicksort(rows: np.ndarray) -> np.ndarray:
    """Order of the rows of a matrix of big-endian 8-byte characters.

    A pivot character splits a range in less, equal and more; only the equal part moves on to the
    next character. Short ranges are sorted by comparison.
    """
    order = np.arange(len(rows))
    as_bytes = rows.astype(">u8")
    todo = [(0, len(rows), 0)]
    while todo:
        a, b, depth = todo.pop()
        if b - a < 2 or depth == rows.shape[1]:
            continue
        part = order[a:b]
        if b - a <= _SMALL:
            rest = as_bytes[part, depth:]
            raw = [r.tobytes() for r in rest]
            order[a:b] = part[sorted(range(b - a), key=raw.__getitem__)]
            continue
        c = rows[part, depth]
        some = np.sort(c[:: max(1, len(c) // 255)])
        pivot = some[len(some) // 2]
        less, equal = c < pivot, c == pivot
        n, m = int(less.sum()), int(equal.sum())
        order[a:b] = np.concatenate([part[less], part[equal], part[~(less | equal)]])
        todo += [(a, a + n, depth), (a + n, a + n + m, depth + 1), (a + n + m, b, depth)]
    return order


def _characters(strings: list[bytes], width: int) -> np.ndarray:
    """Strings padded with zeros to ``width`` bytes, as 8-byte characters that compare like the bytes.

    The length is the last character: a string comes before those it is the beginning of, zeros or not.
    """
    size = (width + 7) // 8 * 8
    padded = np.frombuffer(b"".join(s[:width].ljust(size, b"\0") for s in strings), dtype=">u8").reshape(len(strings), -1)
    return np.c_[padded.astype(np.uint64), np.array([min(len(s), width) for s in strings], np.uint64)]


def _sorted(strings: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of strings, and the common prefix of each with the one before it in that order."""
    order = multikey_quicksort(_characters(strings, width))
    common = np.zeros(len(strings), np.int64)
    for at in range(1, len(strings), 4096):
        ids = order[at - 1 : at + 4096]
        size = np.array([min(len(strings[i]), width) for i in ids])
        m = np.frombuffer(b"".join(strings[i][:width].ljust(width, b"\0") for i in ids), np.uint8).reshape(len(ids), width)
        differ = m[1:] != m[:-1]
        lcp = np.where(differ.any(1), differ.argmax(1), width)
        common[at : at + len(lcp)] = np.minimum(lcp, np.minimum(size[1:], size[:-1]))
    return order, common


def repeated(left: list[bytes], right: list[bytes], low: np.ndarray, high: np.ndarray, length: int) -> list[np.ndarray]:
    """For each segment the offsets o (bytes before the anchor) at which its string repeats.

    ``left`` holds the bytes before the anchor reversed, ``right`` those from it; a segment has the
    strings with low <= o <= high.
    """
    n = len(left)
    half = length // 2
    r_order, r_common = _sorted(right, length)
    l_order, l_common = _sorted(left, length - half) if max(map(len, left), default=0) else (np.arange(n), np.zeros(n, np.int64))
    found: list[list[int]] = [[] for _ in range(n)]
    # only segments with a neighbour of the same anchor can repeat
    near = np.zeros(n, bool)
    same = r_common >= half
    near[r_order[same]] = True
    near[r_order[np.flatnonzero(same) - 1]] = True
    r_class, l_class = np.empty(n, np.int64), np.empty(n, np.int64)
    for o in range(int(low.min()), int(high.max()) + 1) if n else ():
        rows = np.flatnonzero(near & (low <= o) & (o <= high))
        if len(rows) < 2:
            continue
        r_class[r_order] = np.cumsum(r_common < length - o)
        l_class[l_order] = np.cumsum(l_common < o) if o else 0
        both = r_class[rows] * (n + 1) + l_class[rows]
        _, inverse, counts = np.unique(both, return_inverse=True, return_counts=True)
        for i in rows[counts[inverse] > 1].tolist():
            found[i].append(o)
    return [np.array(f, np.int64) for f in found]


def _rows(docs: DataFrame, schema: str, make) -> DataFrame:
    """``make`` turns a document's bytes and other columns into arrays, one per column after doc_id."""
    names = [f.split(" ")[0] for f in schema.split(", ")]
    kinds = [{"long": pa.int64(), "binary": pa.binary()}[f.split(" ")[1]] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                ids, out = [], []
                for i in range(part.num_rows):
                    made = make(encode(part.column("text")[i].as_py()), {n: part.column(n)[i] for n in part.schema.names if n not in ("doc_id", "text")})
                    out.append(made)
                    ids += [part.column("doc_id")[i].as_py()] * len(made[0])
                join = lambda k: np.concatenate([o[k] for o in out]) if isinstance(out[0][k], np.ndarray) else [x for o in out for x in o[k]]
                if out:
                    columns = [ids, *map(join, range(len(names) - 1))]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return docs.mapInArrow(run, schema)


def _hashes(cell: pa.Scalar) -> np.ndarray:
    return cell.values.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) if cell.is_valid else np.zeros(0, np.uint64)


_SEGMENT = "doc_id long, key long, content long, lead binary, at long, low long, high long, bytes binary"


def _sort_buckets(candidates: DataFrame, length: int, buckets: int) -> DataFrame:
    """Segments whose strings repeat in part: owner, hash of the bytes, and the repeating offsets."""
    ranges = candidates.repartitionByRange(buckets, "lead", "key")

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held, ignore_index=True)
        at = rows["at"].to_numpy()
        left = [s[:a][::-1] for s, a in zip(rows["bytes"], at)]
        right = [s[a:] for s, a in zip(rows["bytes"], at)]
        offsets = repeated(left, right, rows["low"].to_numpy(), rows["high"].to_numpy(), length)
        on = [i for i, o in enumerate(offsets) if len(o)]
        yield pd.DataFrame({"doc_id": rows["doc_id"].to_numpy()[on], "content": rows["content"].to_numpy()[on], "offsets": pd.Series([offsets[i].tolist() for i in on], dtype=object)})

    return ranges.mapInPandas(run, "doc_id long, content long, offsets array<int>")


def _narrowed(heavy: DataFrame, length: int, step: int) -> DataFrame:
    """Segments once for each range of ``step`` starts that they have, keyed by the bytes that all strings of the range hold."""
    names = [c.split(" ")[0] for c in _SEGMENT.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out: list[tuple] = []
            for r in b.itertuples(index=False):
                for a in range(r.low // step * step, r.high + 1, step):
                    z = a + step - 1
                    low, high = max(r.low, a), min(r.high, z)
                    shared = r.bytes[r.at - a : r.at + length - z]
                    key = int.from_bytes(hashlib.blake2b(shared, digest_size=8, salt=b"%d" % a).digest(), "big", signed=True)
                    out.append((r.doc_id, key, r.content, shared[:16], high, low, high, r.bytes[r.at - high : r.at - low + length]))
            yield pd.DataFrame(out, columns=names)

    return heavy.mapInPandas(run, _SEGMENT)


def _partly_repeated(candidates: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """``_sort_buckets``, after anchors that very many segments share are split."""
    spark = candidates.sparkSession
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    step, found = length - length // 2 + 1, []
    rows = scratch.table(candidates, f"segments-{step}")
    while True:
        counts = scratch.table(rows.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1"), f"counts-{step}")
        if step == 1:  # the key is the string: who shares it repeats
            found.append(rows.join(counts.select("key"), "key", "left_semi").select("doc_id", "content", F.array(F.col("low").cast("int")).alias("offsets")))
            break
        light = rows.join(counts.where(F.col("m") <= HEAVY).select("key"), "key", "left_semi")
        found.append(scratch.table(_sort_buckets(light, length, max(least, rows.count() // _BUCKET)), f"sorted-{step}"))
        heavy = counts.where(F.col("m") > HEAVY).select("key")
        if heavy.isEmpty():
            break
        step = (step + 1) // 2
        rows = scratch.table(_narrowed(rows.join(heavy, "key", "left_semi"), length, step), f"segments-{step}")
    return reduce(DataFrame.unionByName, found)


def repeated_strings(docs: DataFrame, length: int = 400, scratch: Scratch | None = None) -> DataFrame:
    """doc_id and text of every row, with the segments that repeat as a whole or in part."""
    scratch = scratch or Scratch(docs.sparkSession, "bytespans")
    texts = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)).alias("doc_id"), "text")

    def fold(raw: bytes, _: dict) -> list:
        key, _, _, _, content = segments(np.frombuffer(raw, np.uint8), length)
        pair, n = np.unique(np.stack([key, content], 1), axis=0, return_counts=True) if len(key) else (np.zeros((0, 2), np.uint64), np.zeros(0, np.int64))
        return [pair[:, 0].copy().view(np.int64), pair[:, 1].copy().view(np.int64), n.astype(np.int64)]

    found = scratch.table(_rows(texts, "doc_id long, key long, content long, n long", fold), "found")
    distinct = found.groupBy("key", "content").agg(F.sum("n").alias("n"), F.min("doc_id").alias("owner"))
    anchors = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("parts")).where("parts > 1")
    state = scratch.table(distinct.join(anchors, "key", "left").where("n > 1 OR parts > 1").select("key", "content", F.col("n").alias("all_n"), "owner", "parts"), "state")
    judged = found.select("doc_id", "key", "content").join(state, ["key", "content"])
    judged = judged.where("all_n > 1 OR owner = doc_id").select("doc_id", "content", (F.col("all_n") > 1).alias("whole"), ((F.col("owner") == F.col("doc_id")) & F.col("parts").isNotNull()).alias("sort"))
    lists = [F.collect_list(F.when(F.col(c), F.col("content"))).alias(c) for c in ("whole", "sort")]
    per_doc = scratch.table(judged.groupBy("doc_id").agg(*lists), "segments")
    scratch.drop("found")
    scratch.drop("state")

    def cut(raw: bytes, more: dict) -> list:
        key, at, start, end, content = segments(np.frombuffer(raw, np.uint8), length)
        first = np.unique(content, return_index=True)[1] if len(content) else np.zeros(0, np.int64)
        on = first[np.isin(content[first], _hashes(more["sort"]))]
        data = [raw[a : b + length] for a, b in zip(start[on].tolist(), end[on].tolist())]
        lead = [raw[a : a + min(16, length // 2)] for a in at[on].tolist()]  # within the anchor: equal anchors keep together
        return [key[on].view(np.int64), content[on].view(np.int64), lead, at[on] - start[on], at[on] - end[on], at[on] - start[on], data]

    some = texts.join(per_doc.where(F.size("sort") > 0).select("doc_id", "sort"), "doc_id")
    part = _partly_repeated(_rows(some, _SEGMENT, cut), length, scratch).groupBy("doc_id").agg(F.collect_list(F.struct("content", "offsets")).alias("part"))
    return texts.join(per_doc.select("doc_id", "whole"), "doc_id", "left").join(part, "doc_id", "left")


def remove_strings(docs: DataFrame, length: int = 400, scratch: Scratch | None = None) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and the removed runs of bytes (start, end)."""
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:long,end:long>>"

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for begin in range(0, b.num_rows, 64):
                rows = b.slice(begin, 64)
                out: list[list] = [[], [], [], [], [], []]
                for i in range(rows.num_rows):
                    raw = encode(rows.column("text")[i].as_py())
                    whole, part = _hashes(rows.column("whole")[i]), rows.column("part")[i].as_py() or []
                    edge = np.zeros(len(raw) + 1, np.int64)
                    if len(whole) or part:
                        _, at, start, end, content = segments(np.frombuffer(raw, np.uint8), length)
                        on = np.isin(content, whole)
                        np.add.at(edge, start[on], 1)
                        np.add.at(edge, end[on] + length, -1)
                        offsets: dict[int, list[int]] = {}
                        for p in part:
                            offsets.setdefault(p["content"], []).extend(p["offsets"])
                        signed = content.view(np.int64)
                        for k in np.flatnonzero(np.isin(signed, np.array(list(offsets), np.int64))).tolist():
                            starts = at[k] - np.array(offsets[int(signed[k])])
                            np.add.at(edge, starts, 1)
                            np.add.at(edge, starts + length, -1)
                    gone = np.cumsum(edge[:-1]) > 0
                    runs = np.flatnonzero(np.diff(np.r_[0, gone.view(np.int8), 0])).reshape(-1, 2)
                    kept = np.frombuffer(raw, np.uint8)[~gone].tobytes() if len(runs) else raw
                    doc_id = rows.column("doc_id")[i].as_py()
                    row = (None if doc_id == _NO_ID else doc_id, len(raw), int(gone.sum()), len(runs), hashlib.sha256(kept).hexdigest(), [{"start": a, "end": z} for a, z in runs.tolist()])
                    for column, v in zip(out, row):
                        column.append(v)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), span]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    return repeated_strings(docs, length, scratch).select("doc_id", "text", "whole", "part").mapInArrow(run, schema)
