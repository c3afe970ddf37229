"""64-bit codes of the words of many texts at once, in numpy.

A word's code is a polynomial in its bytes modulo 2**64 with a random value for each byte, taken as the difference of two
running sums, then mixed with the word's length. Texts are cut between words into slices of about ``SLICE`` bytes, so
memory follows the slice (or the longest single word), not the batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .frames import ship

ship(__name__)

SLICE = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_powers: dict[str, np.ndarray] = {}


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    if "up" not in _powers or len(_powers["up"]) < n:
        for name, base in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
            steps = np.full(max(n, 1), base, np.uint64)
            steps[0] = 1
            _powers[name] = np.cumprod(steps, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def _slice_codes(raw: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the words in ``raw`` and where they start; no word crosses one of the ``breaks``."""
    if not len(raw):
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    up, down = _tables(len(raw))
    low = _LOWER[raw]
    space = _SPACE[raw]
    first = np.ones(len(raw), bool)
    first[1:] = space[:-1]
    last = np.ones(len(raw), bool)
    last[:-1] = space[1:]
    inner = breaks[(breaks > 0) & (breaks < len(raw))]
    first[inner] = True
    last[inner - 1] = True
    starts = np.flatnonzero(first & ~space)
    ends = np.flatnonzero(last & ~space) + 1
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_VALUES[low] * up[: len(raw)], out=sums[1:])
    codes = (sums[ends] - sums[starts]) * down[starts]
    codes += (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    codes ^= codes >> np.uint64(32)
    codes *= np.uint64(0xD6E8FEB86659FD93)
    return codes ^ (codes >> np.uint64(29)), starts


def word_codes(texts: pa.Array) -> Iterator[list[np.ndarray]]:
    """Lists of arrays: the codes of each text's words, A-Z read as a-z, for a few texts at a time and in their order.

    Words are runs of bytes other than the six ASCII spaces. Missing texts have no words.
    """
    wide = texts.cast(pa.large_string()).fill_null("")
    edges = np.frombuffer(wide.buffers()[1], np.int64)[wide.offset : wide.offset + len(wide) + 1]
    data = wide.buffers()[2]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    at = 0
    while at < len(wide):
        end = max(at + 1, int(np.searchsorted(edges, edges[at] + SLICE, "right")) - 1)
        if end == at + 1:
            yield [_long_codes(raw[edges[at] : edges[at + 1]])]
        else:
            cuts = edges[at : end + 1] - edges[at]
            codes, starts = _slice_codes(raw[edges[at] : edges[end]], cuts)
            yield np.split(codes, np.searchsorted(starts, cuts[1:-1]))
        at = end


def _long_codes(raw: np.ndarray) -> np.ndarray:
    none, parts, at = np.empty(0, np.int64), [], 0
    while at < len(raw):
        end = min(at + SLICE, len(raw))
        while end < len(raw):  # go on to the next space
            spaces = np.flatnonzero(_SPACE[raw[end : end + SLICE]])
            if len(spaces):
                end += int(spaces[0])
                break
            end = min(end + SLICE, len(raw))
        parts.append(_slice_codes(raw[at:end], none)[0])
        at = end
    return np.concatenate(parts) if parts else np.empty(0, np.uint64)


def shingles(codes: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct shingles of ``size`` words as 64-bit codes; fewer words make one shingle, no words none."""
    n = len(codes)
    if not n:
        return np.empty(0, np.uint64)
    span = min(size, n)
    mixed = np.full(n - span + 1, span, np.uint64)
    for i in range(span):
        mixed = (mixed ^ codes[i : n - span + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    mixed.sort()
    fresh = np.ones(len(mixed), bool)
    np.not_equal(mixed[1:], mixed[:-1], out=fresh[1:])
    return mixed[fresh]
