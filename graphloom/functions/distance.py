"""Edit distances, common subsequences and n-grams of many pairs of texts at once: every step is one numpy operation over all pairs of a block."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Costs of inserting, deleting and substituting characters that text readers confuse; all others cost 1.
INSERT_COSTS = {"2": 0.6, "3": 0.8, "C": 0.8, "H": 0.8, "(": 0.8, ")": 0.8, "n": 0.8}
DELETE_COSTS = {".": 0.5, ",": 0.5, ";": 0.5, ":": 0.5, '"': 0.5, " ": 0.5}
SUBSTITUTE_COSTS = {
    "{": {"(": 0.4}, "}": {")": 0.4}, "j": {"i": 0.4}, "8": {"B": 0.4, "e": 0.5, "S": 0.5}, "I": {"l": 0.4}, "1": {"l": 0.4}, "O": {"2": 0.7, "C": 0.7},
    "0": {"O": 0.1}, "o": {"O": 0.4, "c": 0.5}, "D": {"O": 0.5, "C": 0.5}, "Q": {"O": 0.5}, "c": {"C": 0.4}, "d": {"c": 0.5}, "C": {"c": 0.8}, ".": {"c": 0.4},
    "n": {"N": 0.4}, "h": {"H": 0.4}, "K": {"H": 0.5}, "s": {"S": 0.4}, " ": {"2": 0.6}, ",": {"2": 0.4}, "z": {"2": 0.5, "5": 0.6}, "-": {"2": 0.4},
    "g": {"8": 0.5, "3": 0.6}, "3": {"5": 0.8}, "i": {"l": 0.5}, "f": {"l": 0.5}, "M": {"N": 0.5}, "H": {"N": 0.8}, "l": {"M": 0.5, "t": 0.5, "i": 0.5},
    "U": {"u": 0.5}, "B": {"e": 0.5}, "R": {"e": 0.5}, "5": {"S": 0.5}, "Z": {"z": 0.5},
}


#: Numbers in the widest array of a block.
AREA = 2_000_000


@dataclass(frozen=True)
class Costs:
    """What inserting, deleting and substituting a character costs: 1, where these don't say less."""

    insert: dict = field(default_factory=dict)
    delete: dict = field(default_factory=dict)
    substitute: dict = field(default_factory=dict)

    @property
    def least_insert(self) -> float:
        return min([1.0, *self.insert.values()])

    @property
    def least_delete(self) -> float:
        return min([1.0, *self.delete.values()])

    def classes(self) -> dict[str, str]:
        """For each character that can be swapped for less than 1, the least of all that such swaps lead to: between two classes a swap costs 1."""
        of: dict[str, str] = {}

        def find(c: str) -> str:
            while of.setdefault(c, c) != c:
                c = of[c]
            return c

        for x, swaps in self.substitute.items():
            for y in swaps:
                a, b = sorted((find(x), find(y)))
                of[b] = a
        return {c: find(c) for c in sorted(of)}


READER_COSTS = Costs(INSERT_COSTS, DELETE_COSTS, SUBSTITUTE_COSTS)
UNIT_COSTS = Costs()


def _coded(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(code points of all texts one after the other, where each begins and ends)."""
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), np.concatenate([[0], np.cumsum(lengths)])


def _grid(codes: np.ndarray, ends: np.ndarray, rows: np.ndarray, blank: int) -> tuple[np.ndarray, np.ndarray]:
    """(codes of these texts as rows of equal length, filled up with blank; lengths)."""
    start, size = ends[rows], ends[rows + 1] - ends[rows]
    at = np.arange(max(1, int(size.max(initial=0))))
    inside = at < size[:, None]
    out = np.full(inside.shape, blank, np.int64)
    out[inside] = codes[(start[:, None] + at)[inside]]
    return out, size


def pair_blocks(width: np.ndarray, area: int):
    """The pairs in blocks whose widths differ by a half at most, and the widest array of which has about `area` numbers."""
    order = np.argsort(width, kind="stable")
    sorted_width, at = width[order], 0
    while at < len(order):
        alike = int(np.searchsorted(sorted_width, sorted_width[at] * 3 // 2 + 4, "right"))
        room = max(1, area // max(1, int(sorted_width[alike - 1])))
        upto = min(alike, at + room)
        yield order[at:upto]
        at = upto


def edit_distances(a: list[str], b: list[str], costs: Costs = UNIT_COSTS) -> np.ndarray:
    """Least cost of turning each text of a into that of b beside it: a row of the table of all pairs in a block is one step."""
    out = np.zeros(len(a))
    if not len(a):
        return out
    (ca, ea), (cb, eb) = _coded(a), _coded(b)
    alphabet, code = np.unique(np.concatenate([ca, cb]), return_inverse=True)
    letters, blank = [chr(c) for c in alphabet], len(alphabet)
    price = lambda table: np.array([table.get(c, 1.0) for c in letters] + [1.0])
    added_for, gone_for = price(costs.insert), price(costs.delete)
    special = [c for c in letters if c in costs.substitute]
    row_of = np.zeros(blank + 1, np.int64)
    swap_for = np.ones((len(special) + 1, blank + 1))
    for k, c in enumerate(special, 1):
        row_of[letters.index(c)] = k
        swap_for[k] = [costs.substitute[c].get(y, 1.0) for y in letters] + [1.0]
    xs, ys = code[: len(ca)], code[len(ca) :]
    la, lb = np.diff(ea), np.diff(eb)
    for some in pair_blocks(np.maximum(la, lb) + 1, AREA):
        x, n = _grid(xs, ea, some, blank)
        y, m = _grid(ys, eb, some, blank)
        added = np.concatenate([np.zeros((len(some), 1)), np.cumsum(added_for[y], axis=1)], axis=1)
        row = added.copy()
        done = np.where(n == 0, row[np.arange(len(some)), m], 0.0)
        for i in range(int(n.max(initial=0))):
            c = x[:, i]
            swap = np.where(c[:, None] == y, 0.0, swap_for[row_of[c][:, None], y])
            new = row + gone_for[c][:, None]
            np.minimum(new[:, 1:], row[:, :-1] + swap, out=new[:, 1:])
            row = np.minimum.accumulate(new - added, axis=1) + added  # insertions: the cheapest place to the left, and what is added since
            last = n == i + 1
            if last.any():
                done[last] = row[last, m[last]]
        out[some] = done
    return np.round(out, 9)


def edit_distance(a: str, b: str, insert: dict, delete: dict, substitute: dict) -> float:
    """Least cost of turning a into b."""
    return float(edit_distances([a], [b], Costs(insert, delete, substitute))[0])


def weighted_levenshtein(a: Column, b: Column, weighted: bool = True) -> Column:
    """Rounded to 6 places; null for nulls."""
    costs = READER_COSTS if weighted else UNIT_COSTS

    @F.pandas_udf("double")
    def distance(x: pd.Series, y: pd.Series) -> pd.Series:
        known = (x.notna() & y.notna()).to_numpy()
        out = np.full(len(x), np.nan)
        out[known] = np.round(edit_distances(x[known].tolist(), y[known].tolist(), costs), 6)
        return pd.Series(out).where(known, None).astype("float64")

    return distance(a, b)


def common_subsequences(a: list[str], b: list[str]) -> np.ndarray:
    """Length of the longest common subsequence of each pair: a bit for each character of the shorter text, in words of 32 bits, for all pairs of a block
    at once; a step for each character of the longer. Carries of the additions go from word to word."""
    out = np.zeros(len(a), np.int64)
    if not len(a):
        return out
    (ca, ea), (cb, eb) = _coded(a), _coded(b)
    la, lb = np.diff(ea), np.diff(eb)
    codes = np.concatenate([ca, cb])
    starts = np.concatenate([ea[:-1], eb[:-1] + len(ca)])
    sizes = np.concatenate([la, lb])
    shorter = np.where(la <= lb, np.arange(len(a)), np.arange(len(a)) + len(a))
    longer = np.where(la <= lb, np.arange(len(a)) + len(a), np.arange(len(a)))
    for some in pair_blocks(sizes[longer] + 8 * sizes[shorter] + 1, AREA):
        n, m = sizes[shorter[some]], sizes[longer[some]]
        words = max(1, -(-int(n.max(initial=0)) // 32))
        # the alphabet of each pair: the distinct characters of its shorter text, numbered from 1; 0 stands for all others
        pair = np.repeat(np.arange(len(some)), n)
        at = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        value = (pair.astype(np.int64) << 21) | codes[starts[shorter[some]][pair] + at]
        known, number = np.unique(value, return_inverse=True)
        masks = np.zeros((len(known) + 1, words), np.uint64)
        np.bitwise_or.at(masks, (number + 1, at >> 5), np.uint64(1) << (at & 31).astype(np.uint64))
        full = np.zeros((len(some), words), np.uint64)
        bits = np.clip(n[:, None] - 32 * np.arange(words), 0, 32).astype(np.uint64)
        full[:] = (np.uint64(1) << bits) - np.uint64(1)
        open_bits = full.copy()
        low = np.uint64(0xFFFFFFFF)
        for i in range(int(m.max(initial=0))):
            going = np.flatnonzero(m > i)
            ask = (going.astype(np.int64) << 21) | codes[starts[longer[some[going]]] + i]
            spot = np.minimum(np.searchsorted(known, ask), max(0, len(known) - 1))
            hit_row = np.where(known[spot] == ask, spot + 1, 0) if len(known) else np.zeros(len(ask), np.int64)
            now = open_bits[going]
            hit = now & masks[hit_row]
            total = now + hit
            for w in range(1, words):  # carries
                total[:, w] += total[:, w - 1] >> np.uint64(32)
            open_bits[going] = ((total & low) | (now & ~hit)) & full[going]
        out[some] = n - np.bitwise_count(open_bits).sum(axis=1).astype(np.int64)
    return out


def common_subsequence(a: str, b: str) -> int:
    return int(common_subsequences([a], [b])[0])


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two texts; 0 for nulls."""

    @F.pandas_udf("long")
    def length(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(common_subsequences(x.fillna("").tolist(), y.fillna("").tolist()))

    return length(a, b)


def gram_matches(a: list[str], b: list[str], most: int) -> np.ndarray:
    """(pairs, most): size of the multiset intersection of the character n-grams of each pair, for n from 1 to most. The grams of all pairs of a block are
    named by one sort for each n: a gram is the gram a character shorter, and the character after it."""
    out = np.zeros((len(a), most), np.int64)
    if not len(a):
        return out
    (ca, ea), (cb, eb) = _coded(a), _coded(b)
    la, lb = np.diff(ea), np.diff(eb)
    for some in pair_blocks(la + lb + 1, AREA // 2):
        # the two texts of each pair one after the other; side tells them apart, rest how many characters follow in the text
        sizes = np.stack([la[some], lb[some]], axis=1).ravel()
        source = np.stack([ea[some], eb[some] + len(ca)], axis=1).ravel()
        owner = np.repeat(np.arange(len(sizes)), sizes)
        within = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        code = np.concatenate([ca, cb])[source[owner] + within].astype(np.int64)
        rest = sizes[owner] - within
        name = np.unique(code, return_inverse=True)[1] + 1 if len(code) else code
        letter = name
        for n in range(1, most + 1):
            if n > 1:
                rows = np.flatnonzero(rest >= n)
                name = name.copy()
                name[rows] = np.unique(name[rows] * np.int64(letter.max(initial=0) + 1) + letter[rows + n - 1], return_inverse=True)[1] + 1
            else:
                rows = np.arange(len(code))
            if not len(rows):
                break
            pair, side = owner[rows] >> 1, owner[rows] & 1
            key = np.sort(((pair * np.int64(name[rows].max() + 1) + name[rows]) << 1) | side)
            cut = np.flatnonzero(np.diff(key, prepend=key[0] - 1))
            gram, times = key[cut], np.diff(cut, append=len(key))
            both = np.flatnonzero((gram[1:] >> 1 == gram[:-1] >> 1)) if len(gram) > 1 else np.zeros(0, np.int64)
            shared = np.minimum(times[both], times[both + 1])
            np.add.at(out[:, n - 1], some[(gram[both] >> 1) // np.int64(name[rows].max() + 1)], shared)
    return out


def clipped_matches(a: Column, b: Column, most: int = 4) -> Column:
    """A list of gram_matches of two texts; nulls count as empty."""

    @F.pandas_udf("array<long>")
    def matches(x: pd.Series, y: pd.Series) -> pd.Series:
        return pd.Series(list(gram_matches(x.fillna("").tolist(), y.fillna("").tolist(), most)), dtype=object)

    return matches(a, b)
