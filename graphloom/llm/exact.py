"""Exact deduplication: binary-fuse filters of a snapshot screen incoming digests; only positives meet the snapshot's buckets.

A 3-wise binary-fuse filter keeps a 16-bit fingerprint for each key in an array a little longer than the number of keys: the fingerprint is
the xor of three slots in neighbouring segments. It is built once for each bucket of a snapshot, which never changes afterwards, and has no
false negatives; about one absent digest in 65 536 is a false positive, which the exact join then clears."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, ids_and_texts, look_up, lower_ascii, saved, shuffle_parts

#: Keys of one bucket, about, of the snapshot or of the batch, whichever is larger, where eight buckets for each shuffle partition would get more.
FILTER_KEYS = 100_000


def mixed(keys: np.ndarray, seed: int) -> np.ndarray:
    """64-bit finaliser of murmur3 over key + seed."""
    h = keys + np.uint64(seed)
    for shift, factor in ((33, 0xFF51AFD7ED558CCD), (33, 0xC4CEB9FE1A85EC53), (33, 1)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(factor)
    return h


class FuseFilter:
    def __init__(self, seed: int, length: int, count: int, slots: np.ndarray):
        """length: of a segment, a power of two; count: segments that a key can begin in; slots: fingerprints."""
        self.seed, self.length, self.count, self.slots = seed, length, count, slots

    def places(self, h: np.ndarray) -> list[np.ndarray]:
        first = (((h >> np.uint64(32)) * np.uint64(self.count * self.length)) >> np.uint64(32)).astype(np.int64)
        mask = self.length - 1
        second = (first + self.length) ^ ((h >> np.uint64(18)).astype(np.int64) & mask)
        third = (first + 2 * self.length) ^ (h.astype(np.int64) & mask)
        return [first, second, third]

    @staticmethod
    def prints(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(32))) & np.uint64(0xFFFF)).astype(np.uint16)

    @classmethod
    def build(cls, keys: np.ndarray) -> FuseFilter:
        """keys: distinct uint64."""
        n = len(keys)
        if not n:
            return cls(0, 4, 1, np.zeros(0, np.uint16))
        length = 1 << min(18, max(2, int(math.log(n) / math.log(3.33) + 2.25)))
        room = int(n * max(1.125, 0.875 + 0.25 * math.log(1e6) / math.log(max(n, 2)))) + length
        count = max(1, -(-room // length) - 2)
        for seed in range(1, 200):
            made = cls(seed, length, count, np.zeros((count + 2) * length, np.uint16))
            h = mixed(keys, seed)
            if made._fill(h):
                return made
            if seed % 20 == 0:
                count += max(1, count // 8)
        raise RuntimeError("no seed peels this filter")

    def _fill(self, h: np.ndarray) -> bool:
        """Peels in rounds all keys that are alone in a slot, then sets the slots in reverse."""
        n, place = len(h), np.stack(self.places(h))
        degree = np.bincount(place.ravel(), minlength=len(self.slots))
        total = np.bincount(place.ravel(), np.tile(np.arange(n, dtype=np.float64), 3), len(self.slots)).astype(np.int64)
        alone, rounds, left = np.flatnonzero(degree == 1), [], n
        while len(alone):
            key, at = np.unique(total[alone], return_index=True)
            slot = alone[at]
            rounds.append((key, slot))
            left -= len(key)
            touched = place[:, key].ravel()
            np.subtract.at(degree, touched, 1)
            np.subtract.at(total, touched, np.tile(key, 3))
            touched = np.unique(touched)
            alone = touched[degree[touched] == 1]
        if left:
            return False
        mark = self.prints(h)
        for key, slot in reversed(rounds):
            p = place[:, key]
            self.slots[slot] = mark[key] ^ self.slots[p[0]] ^ self.slots[p[1]] ^ self.slots[p[2]]
        return True

    def has(self, keys: np.ndarray) -> np.ndarray:
        if not len(self.slots):
            return np.zeros(len(keys), bool)
        h = mixed(keys, self.seed)
        a, b, c = self.places(h)
        return self.prints(h) == self.slots[a] ^ self.slots[b] ^ self.slots[c]


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, digest): SHA-256 of the text with A-Z in lower case; null counts as empty."""
    return ids_and_texts(docs).select("doc_id", F.unhex(F.sha2(lower_ascii(F.coalesce("text", F.lit(""))), 256)).alias("digest"))


def _keys(column: pa.Array) -> np.ndarray:
    """The first 8 bytes of each digest."""
    raw = np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)
    return np.ascontiguousarray(raw[:, :8]).view("<u8").ravel()


def bucketed(groups: DataFrame, buckets: int) -> DataFrame:
    return groups.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)).cast("int"))


def snapshot_filters(groups: DataFrame, buckets: int) -> DataFrame:
    """(bucket, seed, length, count, slots): a filter for each bucket of a snapshot's distinct digests."""

    def build(table: pa.Table) -> pa.Table:
        made = FuseFilter.build(np.unique(_keys(table["digest"])))
        row = {"bucket": table["bucket"][0].as_py(), "seed": made.seed, "length": made.length, "count": made.count, "slots": made.slots.tobytes()}
        return pa.Table.from_pylist([row], pa.schema([("bucket", pa.int32()), ("seed", pa.int64()), ("length", pa.int64()), ("count", pa.int64()), ("slots", pa.binary())]))

    return bucketed(groups.select("digest"), buckets).groupBy("bucket").applyInArrow(build, "bucket int, seed long, length long, count long, slots binary")


def screen(groups: DataFrame, filters: DataFrame, buckets: int) -> DataFrame:
    """groups with a column maybe: false if the digest is surely not in the snapshot. Each bucket meets its own filter only."""

    def check(incoming: pa.Table, found: pa.Table) -> pa.Table:
        if incoming.num_rows and found.num_rows:
            row = found.to_pylist()[0]
            maybe = FuseFilter(row["seed"], row["length"], row["count"], np.frombuffer(row["slots"], np.uint16)).has(_keys(incoming["digest"]))
        else:
            maybe = np.zeros(incoming.num_rows, bool)
        return incoming.drop_columns(["bucket"]).append_column("maybe", pa.array(maybe, pa.bool_()))

    return bucketed(groups, buckets).groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(check, "digest binary, n long, last long, maybe boolean")


def exact_groups(incoming: DataFrame, snapshot: DataFrame) -> DataFrame:
    """(digest, keep_id, group_size) of the equal texts of two sets of digests (doc_id, digest)."""
    spark = incoming.sparkSession
    by_digest = lambda d: d.groupBy("digest").agg(F.count("*").alias("n"), F.max("doc_id").alias("last"))  # noqa: E731  counted before the shuffle
    old, batch = saved(by_digest(snapshot), "snapshot"), saved(by_digest(incoming), "batch")
    buckets = max(8 * shuffle_parts(spark), max(old.count(), batch.count()) // FILTER_KEYS + 1)
    filters = saved(snapshot_filters(old, buckets), "filters")
    new = saved(screen(batch, filters, buckets), "screened")
    forget(batch, filters)
    seen = new.where("maybe").select("digest", F.col("n").alias("n2"), F.col("last").alias("last2"))
    both = saved(old.join(seen, "digest").select("digest", F.greatest("last", "last2").alias("keep_id"), (F.col("n") + F.col("n2")).alias("group_size")), "both")
    alone = lambda d: d.select("digest", F.col("last").alias("keep_id"), F.col("n").alias("group_size"))
    rest = new.where("maybe").join(both, "digest", "left_anti")
    return both.unionByName(alone(old.join(both, "digest", "left_anti"))).unionByName(alone(new.where("not maybe"))).unionByName(alone(rest))


def check_bytes(docs: DataFrame, members: DataFrame) -> None:
    """Raises if rows of one group differ in a byte. members: (doc_id, digest) of groups of more than one row; each group's least and greatest
    text are found before the shuffle, so that a large group is no burden."""
    texts = ids_and_texts(docs).select("doc_id", lower_ascii(F.coalesce("text", F.lit(""))).alias("norm")).withColumn("digest", F.unhex(F.sha2("norm", 256)))
    odd = members.distinct().join(texts, ["doc_id", "digest"]).groupBy("digest").agg(F.min("norm").alias("a"), F.max("norm").alias("b")).where("a != b")
    if odd.limit(1).count():
        raise ValueError("two different texts have the same SHA-256")


def exact_dedup(docs: DataFrame, snapshot_fold: int = 0, folds: int = 2) -> DataFrame:
    """(doc_id, keep_id, group_size, kept, text_sha256), a row for each row of docs that has an id.

    The documents of one fold of doc_id are taken as the snapshot, the others as the batch that arrives. Texts are equal when identical
    after lower-casing A-Z; null counts as empty. Of equal texts the greatest doc_id stays; rows that repeat that doc_id with the same text
    stay together. An empty table gives no rows."""
    rows = saved(digests(docs).withColumn("old", F.pmod(F.xxhash64("doc_id"), F.lit(folds)) == snapshot_fold), "digests")
    groups = saved(exact_groups(rows.where("not old").drop("old"), rows.where("old").drop("old")), "groups")
    found = saved(look_up(rows.drop("old"), "digest", groups, "group_size"), "found")
    check_bytes(docs, found.where("group_size > 1").select("doc_id", "digest"))
    return found.select("doc_id", "keep_id", "group_size", (F.col("doc_id") == F.col("keep_id")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))


def keep_distinct(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay. Rows without an id stay."""
    gone = exact_dedup(docs).where("not kept").select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__sha"))
    here = F.sha2(lower_ascii(F.coalesce(docs["text"].cast("string"), F.lit(""))), 256)
    return docs.join(gone, (F.col("doc_id").cast("long") == F.col("__id")) & (here == F.col("__sha")), "left_anti")


ORACLE_SQL = """
with d as (
  select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256
  from documents where doc_id is not null
), g as (select text_sha256, max(doc_id) as keep_id, count(*) as group_size from d group by text_sha256)
select doc_id, keep_id, group_size, doc_id = keep_id as kept, text_sha256 from d join g using (text_sha256)
"""
