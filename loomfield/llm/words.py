"""Hashes of words and of word windows, computed with numpy in each task."""

from __future__ import annotations

import numpy as np

_P = np.uint64(0x9E3779B97F4A7C15)


def split(text: str | None, lower: bool = False) -> list[bytes]:
    """Words between the six ASCII white space characters; ``lower`` folds A-Z alone."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    return (raw.lower() if lower else raw).split()


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed permutation of 64-bit values."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def windows(h: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """One hash for each window of ``width`` hashes."""
    n = len(h) - width + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    acc = np.full(n, seed + width, np.uint64)
    for i in range(width):
        acc = acc * _P + h[i : i + n]
    return mix(acc)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Place of a smallest value in each window of ``width`` values, the leftmost among equals.

    Values are compared by their upper 40 bits, with the place below them; only texts of more than
    2 ** 24 places carry the place beside the value.
    """
    n, have = len(values), 1
    if n <= 1 << 24:
        low = np.uint64((1 << 24) - 1)
        best = (values & ~low) | np.arange(n, dtype=np.uint64)
        while have < width:  # windows of twice the width from two of the width, the last pair overlapping
            step = min(have, width - have)
            best = np.minimum(best[: len(best) - step], best[step:])
            have += step
        return (best & low).astype(np.int64)
    best, place = values >> np.uint64(24), np.arange(n)
    while have < width:
        step = min(have, width - have)
        left, right = best[: len(best) - step], best[step:]
        take = right < left
        best, place = np.where(take, right, left), np.where(take, place[step:], place[: len(place) - step])
        have += step
    return place


_TABLES: dict[int, np.ndarray] = {}


def _powers(base: np.uint64, n: int) -> np.ndarray:
    """Powers of ``base``, kept for the next text."""
    have = _TABLES.get(int(base))
    if have is None or len(have) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        have = np.multiply.accumulate(out)
        if n <= 1 << 22:
            _TABLES[int(base)] = have
    return have[:n]


def prefix(h: np.ndarray) -> np.ndarray:
    """Sums of hashes times powers, so that the hash of any range takes a few operations."""
    sums = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * _powers(_P, len(h)), out=sums[1:])
    return sums


#: inverse of the multiplier, to take ranges back to the same power
_INV = np.uint64(pow(int(_P), -1, 1 << 64))


def ranges(sums: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """One hash for each range [start, end) of ``prefix`` sums: equal contents give equal hashes wherever they stand."""
    back = _powers(_INV, len(sums))[start]
    return mix((sums[end] - sums[start]) * back + np.uint64(seed) + (end - start).astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F))


#: a random value for each byte, and which bytes are white space
BYTE = mix(np.arange(1, 257, dtype=np.uint64))
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True


def many(texts: list[str | None], lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of some texts in one array, and where each text's words begin (one more at the end).

    ``lower`` folds A-Z alone.
    """
    raws = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    if lower:
        raws = [r.lower() for r in raws]
    buffer = np.frombuffer(b" ".join(raws) + b" ", np.uint8)
    space = _SPACE[buffer]
    change = np.diff(space.view(np.int8), prepend=np.int8(1))
    start, end = np.flatnonzero(change == -1), np.flatnonzero(change == 1)
    h = ranges(prefix(BYTE[buffer]), start, end)
    at = np.cumsum([0] + [len(r) + 1 for r in raws])
    return h, np.searchsorted(start, at)


def tagged(h: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Hashes told apart by the text they belong to."""
    return mix(h + (text.astype(np.uint64) + np.uint64(1)) * _P)
