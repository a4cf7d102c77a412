"""The closest entries of a dictionary, without comparing every text with every entry.

Costs below 1 join characters to classes; with each character replaced by its class, every operation that is left costs at least `unit`, so the number of
operations between the replaced texts, times unit, is never above the true distance.

1. Texts and entries that are one operation apart have a string in common once one character, or none, is left out of each. A join on these strings finds
   all such pairs: what it finds within `unit` settles a text, as anything it can't see is at least twice that far.
2. Texts that are open still are compared with the dictionary in a task: first by a bound from the counts of characters, for all entries at once, then
   exactly, in blocks of rising bounds, until no bound is below the best distance. The dictionary's size is checked before it goes to every task."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.distance import READER_COSTS, UNIT_COSTS, Costs, edit_distances, weighted_levenshtein
from ..scratch import saved, ship
from .small import MOST_ENTRIES

#: Longer texts have too many ways to lose a character; they go to step 2.
LONGEST = 64
#: Entries that step 2 compares exactly at first, and by how much more each time.
FIRST, MORE = 32, 8
#: Characters that the bound tells apart; the others share a place by their code.
PLACES = 48


def by_class(text: Column, costs: Costs) -> Column:
    """text with every character replaced by its class."""
    classes = {c: k for c, k in costs.classes().items() if c != k}
    return F.translate(text, "".join(classes), "".join(classes.values())) if classes else text


def shortened(text: Column) -> Column:
    """The distinct strings that are left when one character, or none, is taken out."""
    places = F.sequence(F.lit(1), F.length(text))
    less = F.transform(places, lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), F.when(F.length(text) > 0, less).otherwise(F.array().cast("array<string>"))))


def unit_cost(costs: Costs) -> float:
    return min(1.0, costs.least_insert, costs.least_delete)


def one_apart(texts: DataFrame, dictionary: DataFrame, costs: Costs) -> DataFrame:
    """(text, entry, ...) of texts (text) and entries (entry, ...) of at most LONGEST characters that are one operation apart, or none, and some more."""
    a = texts.where(F.length("text") <= LONGEST).select("text", F.explode(shortened(by_class(F.col("text"), costs))).alias("__key"))
    b = dictionary.where(F.length("entry") <= LONGEST + 1).select("*", F.explode(shortened(by_class(F.col("entry"), costs))).alias("__key"))
    return a.join(b, "__key").drop("__key").distinct()


@dataclass
class Entries:
    """A dictionary as it goes to every task: texts, and how often each has the characters of each place."""

    texts: list[str]
    counts: np.ndarray
    costs: Costs

    @classmethod
    def of(cls, texts: list[str], costs: Costs) -> Entries:
        """The most frequent classes have a place each, the others share the second half of the places."""
        out = cls(texts, np.zeros(0), costs)
        codes, times = np.unique(out.classes(texts)[0], return_counts=True)
        out.top = np.sort(codes[np.argsort(-times, kind="stable")][: PLACES // 2])
        out.counts = out.count(texts)
        return out

    def classes(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(class of each character of all texts, number of the text that it is in)."""
        table = str.maketrans(self.costs.classes())
        codes = np.frombuffer("".join(texts).translate(table).encode("utf-32-le", "surrogatepass"), np.uint32)
        return codes, np.repeat(np.arange(len(texts)), [len(t) for t in texts])

    def count(self, texts: list[str]) -> np.ndarray:
        codes, owner = self.classes(texts)
        half = PLACES - PLACES // 2
        place = PLACES // 2 + codes.astype(np.int64) % half
        if len(self.top):
            at = np.minimum(np.searchsorted(self.top, codes), len(self.top) - 1)
            place = np.where(self.top[at] == codes, at, place)
        return np.bincount(owner * PLACES + place, minlength=len(texts) * PLACES).reshape(-1, PLACES).astype(np.int32)

    def bounds(self, counts: np.ndarray) -> np.ndarray:
        """Least that each entry can be away from a text of these counts: what is too much must go, what is missing must come, or both in one swap."""
        less = self.counts - counts
        missing = np.maximum(less, 0).sum(axis=1)
        extra = missing - less.sum(axis=1)
        swap = min(1.0, self.costs.least_insert + self.costs.least_delete)
        return np.minimum(missing, extra) * swap + np.maximum(extra - missing, 0) * self.costs.least_delete + np.maximum(missing - extra, 0) * self.costs.least_insert

    def within(self, text: str, counts: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(entries closer than limit, their distances)."""
        some = np.flatnonzero(self.bounds(counts) < limit)
        dist = np.round(edit_distances([text] * len(some), [self.texts[k] for k in some], self.costs), 6)
        return some[dist < limit], dist[dist < limit]

    def closest(self, text: str, counts: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
        """(the closest entries, all with the same distance, and this), of those closer than limit."""
        bound = self.bounds(counts)
        order = np.argsort(bound, kind="stable")
        best, found, at, size = limit, [], 0, FIRST
        while at < len(order) and bound[order[at]] <= best:
            some = order[at : at + size]
            dist = np.round(edit_distances([text] * len(some), [self.texts[k] for k in some], self.costs), 6)
            least = dist.min()
            if least < best:
                best, found = least, []
            if best < limit:
                found.append(some[dist == best])
            at, size = at + size, size * MORE
        out = np.concatenate([*found, np.zeros(0, np.int64)]).astype(np.int64)
        return out, np.full(len(out), best)


def compared(texts: DataFrame, dictionary: DataFrame, limit: float, costs: Costs, closest: bool) -> DataFrame:
    """(text, entry, dist) of each of the texts with its closest entries, or with all that are closer than limit."""
    ship(texts.sparkSession)
    rows = dictionary.select("entry").limit(MOST_ENTRIES + 1).toArrow()["entry"].to_pylist()
    if len(rows) > MOST_ENTRIES:
        raise ValueError(f"over {MOST_ENTRIES} rows are too many for a dictionary")
    held = texts.sparkSession.sparkContext.broadcast(Entries.of(rows, costs))

    def work(batches):
        entries = held.value
        for batch in batches:
            some = batch.column(0).to_pylist()
            for k, counts in enumerate(entries.count(some)):
                found, dist = (entries.closest if closest else entries.within)(some[k], counts, limit)
                if len(found):
                    yield pa.RecordBatch.from_arrays([pa.array([some[k]] * len(found)), pa.array([entries.texts[i] for i in found]), pa.array(dist)], ["text", "entry", "dist"])

    return texts.select("text").repartition("text").mapInArrow(work, "text string, entry string, dist double")


def nearest_entries(texts: DataFrame, dictionary: DataFrame, limit: float, weighted: bool = True) -> DataFrame:
    """(text, entry, dist): for each of the distinct texts (text) the entries (entry, distinct) at the least distance, if that is below limit."""
    costs = READER_COSTS if weighted else UNIT_COSTS
    dist = weighted_levenshtein(F.col("text"), F.col("entry")) if weighted else F.levenshtein("text", "entry").cast("double")
    near = one_apart(texts.select("text"), dictionary.select("entry"), costs).withColumn("dist", dist)
    best = near.groupBy("text").agg(F.min("dist").alias("dist")).where((F.col("dist") <= unit_cost(costs)) & (F.col("dist") < limit))
    settled = saved(near.join(best, ["text", "dist"]).select("text", "entry", "dist"), "settled")
    rest = texts.select("text").join(settled.select("text").distinct(), "text", "left_anti")
    return settled.unionByName(compared(rest, dictionary, limit, costs, closest=True))
