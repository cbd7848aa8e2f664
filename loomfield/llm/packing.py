"""Packing of tokenized documents into sequences by best-fit decreasing.

A document longer than a sequence is first cut into full windows, which are sequences by
themselves; its tail and all shorter documents are packed longest first, each into the open
sequence with the least room that still holds it. A segment tree over remaining capacities finds
that sequence in log(capacity) steps.

Packing happens where documents are tokenized: each task packs groups of up to ``group_tokens``
tokens, so nothing is shuffled, memory is bounded, and a hot source is just more tasks. What stays
open at the end of a group is finished by cutting the emptiest sequences into the gaps of the
others and the very last one at powers of two, which need no padding.

Definitions: a null text is the empty text, which is the end token alone; rows with the same doc_id
are packed one by one; extra columns are ignored; an empty table gives no pieces.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
#: no run of word or of white space beyond this goes to the fast encoder, whose cost grows with its square
_RUN = 1000
_CHAR = "!-~¡-¿À-ÖØ-öø-ÿ"
#: texts of Latin letters, digits and marks take the fast encoder, others the tokenizer itself
_PLAIN = re.compile(rf"[\t\n\r ]{{0,{_RUN}}}+(?:[{_CHAR}]{{1,{_RUN}}}+(?:[\t\n\r ]{{1,{_RUN}}}+|\Z))*+")
# How byte-level tokenizers of this kind split texts into words, and their setting in the file.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def merge_ranks(spec: dict) -> dict[bytes, int] | None:
    """Tokens' bytes and ids of a byte-level BPE, if its merges are in the order of their ids."""
    model = spec["model"]
    plain = spec["normalizer"] is None and spec["pre_tokenizer"] == _BYTE_LEVEL and model["type"] == "BPE"
    if not plain or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges"):
        return None
    # printable bytes are written as themselves, the others as the code points from 256 on
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    vocab = model["vocab"]
    order = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if order != sorted(set(order)) or order[:1] == [-1]:
        return None
    special = {t["content"] for t in spec["added_tokens"]}
    tokens = [t for t in vocab if t not in special]
    if len(tokens) != 256 + len(order) or any(vocab[c] >= order[0] for c in byte if c in vocab):
        return None
    return {bytes(map(byte.__getitem__, t)): vocab[t] for t in tokens}


class Encoder:
    """Token ids of texts, as the tokenizer of a file gives them.

    The tokenizer keeps places and strings of tokens that nobody asks for here; where its file is a
    byte-level BPE, plain texts take an encoder that makes the same ids from the same merges.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.model, self.fast = Tokenizer.from_file(path), None
        spec = json.loads(self.model.to_str())
        self.special = [t["content"] for t in spec["added_tokens"]]
        ranks = merge_ranks(spec)
        if ranks is not None:
            import tiktoken

            self.fast = tiktoken.Encoding("file", pat_str=_PATTERN, mergeable_ranks=ranks, special_tokens={})

    def is_plain(self, text: str) -> bool:
        return self.fast is not None and _PLAIN.fullmatch(text) is not None and not any(s in text for s in self.special)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        plain = list(map(self.is_plain, texts))
        rest = self.model.encode_batch_fast([t for t, p in zip(texts, plain) if not p], add_special_tokens=False)
        other = iter(rest)
        ids = [self.fast.encode_ordinary(t) if p else next(other).ids for t, p in zip(texts, plain)]
        return [np.array(i, dtype="<u4").tobytes() for i in ids]


class Room:
    """Open sequences by remaining capacity: a segment tree of the capacities that have any."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.some = bytearray(2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        i = room + self.leaves
        while i and not self.some[i]:
            self.some[i] = 1
            i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """The sequence with the least room of at least ``least``, and that room."""
        i = least + self.leaves
        while not self.some[i]:
            while i & 1:  # up, until there is a right neighbour
                i >>= 1
            if not i:
                return None
            i += 1
        while i < self.leaves:
            i = 2 * i if self.some[2 * i] else 2 * i + 1
        room = i - self.leaves
        found = self.open[room].pop()
        if not self.open[room]:
            self.some[i] = 0
            i >>= 1
            while i and not (self.some[2 * i] or self.some[2 * i + 1]):
                self.some[i] = 0
                i >>= 1
        return found, room


def pack(lengths: list[int], capacity: int, least_cut: int = 64) -> list[list[tuple[int, int, int]]]:
    """Sequences of (item, start, length) for items of at most ``capacity`` tokens.

    Best fit decreasing, then the emptiest sequences are cut into gaps of ``least_cut`` or more as
    long as that saves a sequence, and the emptiest that is left is cut at powers of two.
    """
    room, sequences, fill = Room(capacity), [], []
    for item in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[item]
        found = room.take(n) if n else None
        if found is None:
            sequences.append([])
            fill.append(0)
            at, left = len(sequences) - 1, capacity
        else:
            at, left = found
        sequences[at].append((item, 0, n))
        fill[at] += n
        if left - n:
            room.put(left - n, at)
    order = sorted((i for i in range(len(sequences)) if fill[i] < capacity), key=lambda i: (fill[i], i))
    gaps = [i for i in reversed(order) if capacity - fill[i] >= least_cut]
    while gaps and order:
        donor = order.pop(0)
        gaps = [i for i in gaps if i != donor]
        if sum(capacity - fill[i] for i in gaps) < fill[donor]:
            order.insert(0, donor)
            break
        while sequences[donor]:
            item, start, n = sequences[donor].pop()
            while n:
                part = min(n, capacity - fill[gaps[0]])
                sequences[gaps[0]].append((item, start, part))
                fill[gaps[0]] += part
                start, n = start + part, n - part
                if fill[gaps[0]] == capacity:
                    gaps.pop(0)
        fill[donor] = 0
    if order and fill[order[0]] and capacity - fill[order[0]] >= least_cut:
        last, sequences[order[0]] = sequences[order[0]], []
        rest = sum(n for _, _, n in last)
        while rest:
            size = 1 << (rest.bit_length() - 1)
            part: list[tuple[int, int, int]] = []
            while size:
                item, start, n = last.pop(0)
                took = min(n, size)
                part.append((item, start, took))
                if took < n:
                    last.insert(0, (item, start + took, n - took))
                size, rest = size - took, rest - took
            sequences.append(part)
    return [s for s in sequences if s]


def _pack_group(group: list[tuple[int | None, bytes]], capacity: int, first: int) -> tuple[dict, int]:
    """Columns of the pieces of tokenized documents, and the next sequence id."""
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}

    def add(doc: int, start: int, n: int, sequence: int, offset: int) -> None:
        doc_id, ids = group[doc]
        for k, v in zip(out, (doc_id, start, n, zlib.crc32(ids[4 * start : 4 * (start + n)]), len(ids) // 4, sequence, offset)):
            out[k].append(v)

    tails = []
    for doc, (_, ids) in enumerate(group):
        n = len(ids) // 4
        full = n // capacity * capacity
        for start in range(0, full, capacity):
            add(doc, start, capacity, first, 0)
            first += 1
        if n > full:
            tails.append((doc, full, n - full))
    for sequence in pack([n for _, _, n in tails], capacity):
        offset = 0
        for item, start, n in sequence:
            add(tails[item][0], tails[item][1] + start, n, first, offset)
            offset += n
        first += 1
    return out, first


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1, group_tokens: int = 4_000_000, batch: int = 256) -> DataFrame:
    """One row per piece: where it comes from, its ids' checksum, its sequence and place there.

    ``sequence_id`` numbers the sequences of a task from task << 32, so it is unique without a
    second pass; ``group_tokens`` bounds what a task holds.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 32
        encoder = Encoder(tokenizer_path)
        group: list[tuple[int | None, bytes]] = []
        held = 0
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                texts = [t or "" for t in part.column("text").to_pylist()]
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), encoder.encode(texts)):
                    group.append((doc_id, ids + end))
                    held += len(ids) // 4 + 1
                    if held >= group_tokens:
                        out, first = _pack_group(group, capacity, first)
                        yield _batch(out)
                        group, held = [], 0
        if group:
            yield _batch(_pack_group(group, capacity, first)[0])

    return docs.select("doc_id", "text").mapInArrow(run, SCHEMA)


def _batch(out: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, pa.int64()) for v in out.values()], names=list(out))
