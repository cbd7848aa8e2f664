"""Removal of word windows that an earlier document has, by level-wise doubling.

A window of ``length`` words can only be shared if shorter windows inside it are. So windows are
looked up length by length, each twice the one before: the first length is ``length`` halved as
often as it stays at ``first`` or more. On a level each window of ``length`` words is represented by
the smallest hash among the shorter windows inside it (the same one wherever the long window
stands, so about two in every ``length - level + 1`` places are looked up); windows represented by
one that only one document has are dropped, and only the rest goes to the next level.

On the last level, long windows with the same representative next to each other form a segment.
Segments are compared as a whole first: equal segments need only their smallest doc_id, which also
folds thousands of copies into one row. Only where different segments share a representative are
their windows compared one by one, and only once per distinct segment.

Counts and smallest ids are partial aggregates; nothing about one window is gathered. What a level
leaves of each document is a narrow table in the shared folder; texts are shuffled by doc_id to meet
it, once for each level after the first.

Definitions: a null or empty text has no words and loses none; a text shorter than a window loses
none; windows shared within one document alone are kept; rows with the same doc_id are one document
and never remove from each other; a row without doc_id is left whole and removes nothing elsewhere;
extra columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .scratch import Scratch


def levels(length: int, first: int = 3) -> list[int]:
    """Window lengths before the last, each about half of the next."""
    out: list[int] = []
    n = length
    while (n + 1) // 2 >= first:
        n = (n + 1) // 2
        out.append(n)
    return out[::-1]


@dataclass
class Words:
    """Hashed words of a batch of texts in one array; windows that reach into the next text are left out."""

    h: np.ndarray
    bounds: np.ndarray
    length: int

    def __post_init__(self) -> None:
        self.text = np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))
        n = len(self.h) - self.length + 1
        self.at = np.flatnonzero(self.text[:n] == self.text[self.length - 1 :]) if n > 0 else np.zeros(0, np.int64)

    def representatives(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all ``level``-word windows, and for each long window in ``at`` the place of its representative."""
        keys = W.windows(self.h, level)
        if not len(self.at):
            return keys, self.at
        return keys, W.sliding_min(keys, self.length - level + 1)[self.at]

    def segments(self, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Runs of long windows with one representative: its hash, first and last window, a hash of the words."""
        keys, place = self.representatives(level)
        first = np.flatnonzero(np.diff(place, prepend=-1) != 0)
        start, end = self.at[first], self.at[np.r_[first[1:], len(place)] - 1] if len(place) else self.at
        where = place[first]
        # the representative's place in the segment is part of what must agree
        return keys[where], start, end, W.mix(W.ranges(W.prefix(self.h), start, end + self.length) + (where - start).astype(np.uint64))


def _once(text: np.ndarray, *columns: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct rows of text and hashes."""
    key = W.tagged(columns[0], text)
    for c in columns[1:]:
        key = W.mix(key + c)
    _, i = np.unique(key, return_index=True)
    return (text[i], *[c[i] for c in columns])


def _lists(column: pa.Array) -> np.ndarray:
    """Tags of the hashes in an array column: text and hash; null is empty."""
    values, offsets = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    text = np.repeat(np.arange(len(column)), np.diff(offsets))
    return W.tagged(values[offsets[0] : offsets[-1]].astype(np.int64).view(np.uint64), text)


def _each(docs: DataFrame, schema: str, length: int, make: Callable[[Words, pa.RecordBatch], tuple[np.ndarray, ...]]) -> DataFrame:
    """Rows of hashes: ``make`` returns the text's place in the batch and columns of hashes."""
    names = [f.split(" ")[0] for f in schema.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 128):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(at, 128)]) for c in b.columns], names=b.schema.names)
                text, *columns = make(Words(*W.many(part.column("text").to_pylist()), length), part)
                ids = part.column("doc_id").to_numpy(zero_copy_only=False)
                yield pa.RecordBatch.from_arrays([pa.array(ids[text]), *[pa.array(c.view(np.int64)) for c in columns]], names=names)

    return docs.mapInArrow(run, schema)


def repeated_spans(docs: DataFrame, length: int = 13, first: int = 3, scratch: Scratch | None = None) -> DataFrame:
    """doc_id and text of every row with the hashes to remove: ``whole`` segments and single ``windows``."""
    scratch = scratch or Scratch(docs.sparkSession, "wordspans")
    texts = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    last = levels(length, first)[-1]
    alive, below = texts, None
    for level in levels(length, first):

        def candidates(w: Words, part: pa.RecordBatch, level: int = level, below: int | None = below) -> tuple[np.ndarray, ...]:
            keys, place = w.representatives(level)
            text = w.text[w.at]
            if below is not None and len(place):
                lower, its = w.representatives(below)
                on = np.isin(W.tagged(lower[its], text), _lists(part.column("alive")))
                place, text = place[on], text[on]
            return _once(text, keys[place])

        found = _each(alive, "doc_id long, key long", length, candidates)
        if below is not None:  # it comes after a shuffle of texts, which its two readers shall not repeat
            found = scratch.table(found, f"found-{level}")
        shared = found.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key")
        kept = scratch.table(found.join(shared, "key").groupBy("doc_id").agg(F.collect_list("key").alias("alive")), f"level-{level}")
        alive, below = texts.join(kept, "doc_id"), level

    def whole(w: Words, part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        key, start, _, words = w.segments(last)
        on = np.isin(W.tagged(key, w.text[start]), _lists(part.column("alive")))
        return _once(w.text[start[on]], key[on], words[on])

    rows = scratch.table(_each(alive, "doc_id long, key long, words long", length, whole), "rows")
    distinct = rows.groupBy("key", "words").agg(F.min("doc_id").alias("owner"))
    several = distinct.groupBy("key").agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("key", F.lit(True).alias("several"))
    judged = rows.join(distinct.join(several, "key", "left"), ["key", "words"])
    judged = judged.where("owner < doc_id OR several").withColumn("gone", F.col("owner") < F.col("doc_id"))
    per_doc = judged.groupBy("doc_id").agg(F.collect_list(F.when(F.col("gone"), F.col("words"))).alias("whole"), F.collect_list(F.when(~F.col("gone"), F.col("words"))).alias("open"))
    per_doc = scratch.table(per_doc, "segments")

    def single(w: Words, part: pa.RecordBatch) -> tuple[np.ndarray, ...]:
        _, start, end, words = w.segments(last)
        on = np.isin(W.tagged(words, w.text[start]), _lists(part.column("open")))
        place = np.concatenate([np.arange(a, b + 1) for a, b in zip(start[on], end[on])] or [np.zeros(0, np.int64)])
        return _once(w.text[place], W.windows(w.h, length, 1)[place], W.windows(w.h, length, 2)[place])

    open_ = texts.join(per_doc.where(F.size("open") > 0).select("doc_id", "open"), "doc_id")
    windows = scratch.table(_each(open_, "doc_id long, one long, two long", length, single), "windows")
    owner = windows.groupBy("one", "two").agg(F.min("doc_id").alias("owner"), F.max("doc_id").alias("other")).where("owner < other").select("one", "two", "owner")
    gone = windows.join(owner, ["one", "two"]).where("owner < doc_id").groupBy("doc_id").agg(F.collect_list("one").alias("windows"))
    nothing = docs.where(F.col("doc_id").isNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.array().cast("array<long>").alias("whole"), F.array().cast("array<long>").alias("windows"))
    return texts.join(per_doc.select("doc_id", "whole"), "doc_id", "left").join(gone, "doc_id", "left").select("doc_id", "text", "whole", "windows").unionByName(nothing)


def remove_spans(docs: DataFrame, length: int = 13, first: int = 3) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 and the removed runs of words (start, end)."""
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>"
    last = levels(length, first)[-1]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for b in batches:
            for begin in range(0, b.num_rows, 128):
                part = pa.RecordBatch.from_arrays([pa.concat_arrays([c.slice(begin, 128)]) for c in b.columns], names=b.schema.names)
                texts = part.column("text").to_pylist()
                w = Words(*W.many(texts), length)
                gone = np.zeros(len(w.h) + 1, np.int64)
                whole, single = _lists(part.column("whole")), _lists(part.column("windows"))
                if len(whole):
                    _, start, end, content = w.segments(last)
                    on = np.isin(W.tagged(content, w.text[start]), whole)
                    np.add.at(gone, start[on], 1)
                    np.add.at(gone, end[on] + length, -1)
                if len(single):
                    place = w.at[np.isin(W.tagged(W.windows(w.h, length, 1)[w.at], w.text[w.at]), single)]
                    np.add.at(gone, place, 1)
                    np.add.at(gone, place + length, -1)
                mask = np.cumsum(gone[:-1]) > 0
                removed, digest, spans = [], [], []
                for text, a, z in zip(texts, w.bounds[:-1].tolist(), w.bounds[1:].tolist()):
                    own, words = mask[a:z], W.split(text)
                    n = int(own.sum())
                    removed.append(n)
                    digest.append(hashlib.sha256(b" ".join([x for x, m in zip(words, own.tolist()) if not m] if n else words)).hexdigest())
                    edge = np.flatnonzero(np.diff(np.r_[0, own.view(np.int8), 0])) if n else np.zeros(0, np.int64)
                    spans.append([{"start": s, "end": e} for s, e in edge.reshape(-1, 2).tolist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(w.bounds), pa.int64()), pa.array(removed, pa.int64()), pa.array(digest, pa.string()), pa.array(spans, span)], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    return repeated_spans(docs, length, first).mapInArrow(run, schema)
