"""Hashes of words and windows, and windows dealt out by their least gram.

A window is W units (bytes or words) of one text. Each window belongs to the anchor in it: the gram of K units with the least hash, the first of
equals. Equal windows have equal anchors at equal offsets, so they meet when dealt out by the anchor's hash. Neighbouring windows mostly share
their anchor; such a run travels as one row."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = 0x9E3779B97F4A7C15 | 1
INVERSE = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.random.Generator(np.random.PCG64(977)).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SEPARATORS = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
LOW_BITS = 21
#: Units of one text that are handled at once; longer texts go in parts that overlap by a window less one.
PART = 1 << 20

_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    found = _powers.get(base)
    if found is None or len(found) < n:
        out = np.full(max(n, 1 << 16), base, np.uint64)
        out[0] = 1
        _powers[base] = found = np.cumprod(out, dtype=np.uint64)
    return found[:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(32))


class Sums:
    """Polynomial prefix hashes of a sequence of 64-bit units."""

    def __init__(self, units: np.ndarray):
        n = len(units)
        self.prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(units * powers(BASE, n), dtype=np.uint64, out=self.prefix[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.prefix[end] - self.prefix[start]) * powers(INVERSE, len(self.prefix))[start])

    def grams(self, size: int) -> np.ndarray:
        if len(self.prefix) <= size:
            return np.zeros(0, np.uint64)
        return mix((self.prefix[size:] - self.prefix[:-size]) * powers(INVERSE, len(self.prefix) - size))


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """Least of each w neighbours: the rest of one block of w and the beginning of the next."""
    n = len(x) - w + 1
    if n <= 0:
        return x[:0]
    blocks = -(-len(x) // w)
    full = np.full(blocks * w, np.iinfo(x.dtype).max, x.dtype)
    full[: len(x)] = x
    full = full.reshape(blocks, w)
    ahead = np.minimum.accumulate(full, 1).ravel()
    behind = np.minimum.accumulate(full[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def runs(units: np.ndarray, starts: np.ndarray, lengths: np.ndarray, w: int, k: int) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor, of texts that lie at these places among the units: text (its number), at (first window's place in the
    text), n (windows), off (from there to the anchor), anchor, content (hashes)."""
    from .words import ragged

    windows = np.maximum(lengths - w + 1, 0)
    if not windows.sum():
        return {x: np.zeros(0, t) for x, t in (("text", np.int64), ("at", np.int64), ("n", np.int64), ("off", np.int64), ("anchor", np.uint64), ("content", np.uint64))}
    sums = Sums(units)
    gram = sums.grams(k)
    low = np.uint64((1 << LOW_BITS) - 1)
    packed = (gram & ~low) | np.arange(len(gram), dtype=np.uint64)
    place = ragged(starts, windows)
    least = sliding_min(packed, w - k + 1)[place]
    text = np.repeat(np.arange(len(starts)), windows)
    first = np.flatnonzero(np.concatenate([[True], (least[1:] != least[:-1]) | (text[1:] != text[:-1])]))
    n = np.diff(np.concatenate([first, [len(least)]]))
    s = place[first]
    content = sums.of(s, s + n + w - 1) ^ (n.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
    spot = (least[first] & low).astype(np.int64)
    return {"text": text[first], "at": s - starts[text[first]], "n": n, "off": spot - s, "anchor": gram[spot], "content": content}


def parts(n: int, w: int, size: int = PART) -> list[tuple[int, int]]:
    """(start, end) of overlapping parts of a text of n units, which together hold each window once."""
    return [(a, min(n, a + size + w - 1)) for a in range(0, max(1, n - w + 1), size)]


def word_bounds(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, ends) of the words of UTF-8 bytes, between characters U+0020 and U+0009 to U+000D."""
    gap = np.concatenate([[True], SEPARATORS[raw], [True]])
    edge = np.flatnonzero(gap[1:] != gap[:-1])
    return edge[::2], edge[1::2]


def word_hashes(raw: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each word; long texts are hashed in slices that end at the end of a word."""
    starts, ends = word_bounds(raw)
    if len(raw) <= 4 * PART:
        return mix(Sums(BYTE_VALUES[raw]).of(starts, ends) + (ends - starts).astype(np.uint64))
    out, i = [], 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + 2 * PART, "right")))
        a = starts[i]
        out.append(mix(Sums(BYTE_VALUES[raw[a : ends[j - 1]]]).of(starts[i:j] - a, ends[i:j] - a) + (ends[i:j] - starts[i:j]).astype(np.uint64)))
        i = j
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(UTF-8 bytes of all texts, offsets); a null is empty."""
    column = pc.fill_null(column, "").cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def words_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(word hashes of all texts, where each text's begin)."""
    raw, offsets = text_bytes(column)
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    # a separator between the texts keeps their words apart
    apart = np.insert(raw, offsets[1:-1], 0x20) if len(column) > 1 else raw
    bounds = offsets + np.arange(len(offsets))
    starts, _ = word_bounds(apart)
    return word_hashes(apart), np.concatenate([np.searchsorted(starts, bounds[:-1]), [len(starts)]])
