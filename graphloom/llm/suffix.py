"""Removal of repeated byte strings with a Burrows-Wheeler transform and threshold-bounded interval expansion.

Runs of bytes that share an anchor (see repeats.py) are concatenated, with a symbol of its own between them, and sorted as suffixes. Rows of
the sorted matrix whose suffixes have a common prefix P form an interval. Breadth first, level by level, every interval is extended backward by
each character c that stands before its rows: the rows of cP are where the transform sends them, and a border between two intervals of level
d becomes a border of level d + 1. (The first seven levels are read off the sorting
keys.) So common prefix lengths come out in increasing order; the expansion stops at the threshold, and rows
that no border separates by then share at least that many bytes."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lean, shuffle_parts
from .repeats import Kind, covered, repeated_windows, with_bases, with_removals
from .windows import text_bytes

#: Bytes of runs that are sorted at once; the runs of one anchor stay together, of which there are MANY at most.
BLOCK = 250_000


def packed_symbols(symbols: np.ndarray) -> np.ndarray:
    """The first 7 symbols (0 to 256) of each suffix as one number."""
    n = len(symbols)
    padded = np.concatenate([symbols.astype(np.int64), np.zeros(7, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(7):
        key = key << 9 | padded[k : n + k]
    return key


def suffix_order(key: np.ndarray, depth: int) -> np.ndarray:
    """Places in the order of their suffixes' first `depth` symbols, at least: doubling from packed_symbols. Places whose order is settled keep
    their rank; only groups of equals are sorted again."""
    n = len(key)
    order = np.argsort(key, kind="stable")
    head = np.ones(n, bool)
    head[1:] = key[order[1:]] != key[order[:-1]]
    rank = np.empty(n, np.int64)
    rank[order] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    known = 7
    while known < depth:
        tied = np.flatnonzero(~(head & np.concatenate([head[1:], [True]])))  # rows of groups of more than one
        if not len(tied):
            break
        place = order[tied]
        ahead = np.where(place + known < n, rank[np.minimum(place + known, n - 1)] + 1, 0)
        by = rank[place] * np.int64(n + 1) + ahead
        again = np.argsort(by, kind="stable")
        order[tied] = place[again]
        by = by[again]
        first = np.ones(len(by), bool)
        first[1:] = by[1:] != by[:-1]
        head[tied] = first
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(first, np.arange(len(by)), 0))]
        known *= 2
    return order


def borders(symbols: np.ndarray, key: np.ndarray, order: np.ndarray, length: int) -> np.ndarray:
    """True for each row of the sorted matrix whose suffix shares fewer than `length` symbols with the row before."""
    n = len(symbols)
    transform = symbols[order - 1]  # the symbol before each suffix; before the whole text its last
    sent = np.argsort(transform, kind="stable").astype(np.int32)  # the row without its first symbol: the k-th c here is the k-th row that begins with c
    if length <= 7:
        short = key[order] >> (9 * (7 - length))
        return np.concatenate([[True], short[1:] != short[:-1]])
    packed = key[order]
    found = np.ones(n, bool)
    found[1:] = packed[1:] != packed[:-1]  # levels 0 to 6
    new = found.copy()
    new[1:] &= (packed[1:] >> 9) == (packed[:-1] >> 9)  # level 6 alone
    row = np.flatnonzero(~found).astype(np.int32)
    low, high = sent[row - 1], sent[row]
    settled = 0
    for _ in range(7, length):
        if not len(row) or not new.any():
            break
        count = np.cumsum(new, dtype=np.int32)
        hit = row[count[high] != count[low]]
        hit = hit[~found[hit]]
        new = np.zeros(n, bool)
        new[hit] = True
        found[hit] = True
        settled += len(hit)
        if settled * 8 > len(row):  # drop the rows that are settled
            left = ~found[row]
            row, low, high, settled = row[left], low[left], high[left], 0
    return found


def later_windows(data: list[bytes], doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, at, n): runs of windows of `length` bytes, within these strings, that aren't the first of their kind by (doc, at)."""
    sizes = np.fromiter(map(len, data), np.int64, len(data))
    symbols = np.frombuffer(b"\0".join(data) + b"\0", np.uint8).astype(np.uint16) + 1
    ends = np.cumsum(sizes + 1) - 1
    symbols[ends] = 0
    starts = ends - sizes
    key = packed_symbols(symbols)
    order = suffix_order(key, length + 12)
    group = np.cumsum(borders(symbols, key, order, length))
    owner = np.repeat(np.arange(len(data)), sizes + 1)[order]
    offset = order - starts[owner]
    real = offset + length <= sizes[owner]
    group, owner, offset = group[real], owner[real], offset[real]
    d, p = doc[owner], at[owner] + offset
    by = np.lexsort((p, d, group))
    group, d, p = group[by], d[by], p[by]
    head = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, bool)
    lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    later = (d > d[lead]) | (p > p[lead])
    d, p = d[later], p[later]
    by = np.lexsort((p, d))
    d, p = d[by], p[by]
    if not len(d):
        return d, p, d
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (p[1:] != p[:-1] + 1)]))
    return d[first], p[first], np.diff(np.concatenate([first, [len(d)]]))


def compare_runs(length: int):
    """rows (key, doc, at, n, off, data) -> (doc, at, n) of repeated windows, block by block of whole keys."""

    def of(rows: DataFrame) -> DataFrame:
        def work(batches):
            def done(cut):
                doc, at, n = later_windows(data[:cut], np.array(docs[:cut], np.int64), np.array(ats[:cut], np.int64), length)
                return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(n.astype(np.int32))], ["doc", "at", "n"])

            keys, docs, ats, data, size = [], [], [], [], 0
            for batch in batches:
                for a in range(0, batch.num_rows, 512):
                    part = batch.slice(a, 512)
                    keys += part.column(0).to_pylist()
                    docs += part.column(1).to_pylist()
                    ats += part.column(2).to_pylist()
                    data += part.column(5).to_pylist()
                    size += part.column(5).nbytes
                    if size > BLOCK:
                        cut = keys.index(keys[-1])
                        if cut:
                            yield done(cut)
                            keys, docs, ats, data = keys[cut:], docs[cut:], ats[cut:], data[cut:]
                            size = sum(map(len, data))
            if data:
                yield done(len(data))

        return rows.repartition(shuffle_parts(rows.sparkSession), "key").sortWithinPartitions("key", "doc", "at").mapInArrow(lean(work), "doc long, at long, n int")

    return of


def repeats(texts: DataFrame, length: int = 100, gram: int = 16) -> DataFrame:
    """(doc, at, n): runs of n strings of `length` bytes, the first at byte `at` of the document, that also start earlier. texts: with_bases()."""
    return repeated_windows(texts, Kind(length, gram, within=True, words=False), compare_runs(length))


def cut_bytes(docs: DataFrame, length: int, finish, schema: str) -> DataFrame:
    """finish(bytes, bytes kept, n_removed, n_spans) -> dict for each document."""
    names = [x.split()[0] for x in schema.split(", ")][1:]
    kinds = {"long": pa.int64(), "string": pa.string()}
    fields = [(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")]

    def cut(batches):
        for batch in batches:
            out = []
            for i in range(batch.num_rows):
                raw, _ = text_bytes(batch.column(1).slice(i, 1))
                lists, base = batch.column(3).slice(i, 1), batch.column(2)[i].as_py()
                if lists.null_count:
                    out.append(finish(raw.tobytes(), raw.tobytes(), 0, 0))
                    continue
                gone = covered(lists.flatten(), len(raw), length, base)
                spans = int(np.count_nonzero(np.diff(gone.astype(np.int8), prepend=0) == 1))
                out.append(finish(raw.tobytes(), raw[~gone].tobytes(), int(gone.sum()), spans))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array([o[k] for o in out], t) for k, t in fields[1:]]], ["doc_id", *names])

    texts = with_bases(docs)
    return with_removals(texts, repeats(texts, length)).mapInArrow(lean(cut), schema)


def byte_digests(docs: DataFrame, length: int = 100) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256): each byte that a repeated string of `length` bytes covers is removed; n_spans counts
    the maximal removed runs. A null text is empty; texts shorter than `length` lose nothing. Rows that repeat a doc_id with other texts are
    parts of one document, in the order of a hash; no string crosses them; rows that repeat both are alike. An empty table gives no rows."""
    finish = lambda raw, kept, m, s: {"n_bytes": len(raw), "n_removed": m, "n_spans": s, "kept_sha256": hashlib.sha256(kept).hexdigest()}
    return cut_bytes(docs, length, finish, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """docs, all columns, with the repeated bytes cut out of text (the rest of a character that is cut in two goes too) and n_chars, if there is
    such a column, counted anew. Rows without an id, and null texts, stay as they are. Each row gets its own text back, also where an id repeats."""
    from pyspark.sql import functions as F

    finish = lambda raw, kept, m, s: {"sha": hashlib.sha256(raw).hexdigest(), "text": kept.decode("utf-8", "ignore"), "removed": m}
    new = cut_bytes(docs, length, finish, "doc_id long, sha string, text string, removed long").select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"), F.col("text").alias("__text"), F.col("removed").alias("__gone")).where("__gone > 0").dropDuplicates(["__id", "__sha"])
    here = F.sha2(docs["text"].cast("string"), 256)
    joined = docs.join(new, (F.col("doc_id").cast("long") == F.col("__id")) & (here == F.col("__sha")), "left")
    text = F.coalesce("__text", "text")
    changes = {"text": text} | ({"n_chars": F.when(F.col("__id").isNull(), F.col("n_chars")).otherwise(F.length(text)).cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {})
    return joined.select(*[changes[c].alias(c) if c in changes else docs[c] for c in docs.columns])


ORACLE_SQL = r"""
with w as (
  select doc_id, hex(encode(coalesce(text, ''))) as h, octet_length(encode(coalesce(text, ''))) as n from documents where doc_id is not null
), win as (
  select doc_id, i, md5(substring(h, 2 * i + 1, 200)) as k from (select doc_id, h, unnest(range(0, n - 99)) as i from w)
), hit as (
  select doc_id, i from (select doc_id, i, row_number() over (partition by k order by doc_id, i) as r from win) where r > 1
), edge as (
  select doc_id, i, i > coalesce(lag(i) over (partition by doc_id order by i) + 100, -1) as opens from hit
), span as (
  select doc_id, min(i) as a, max(i) + 100 as b from (select *, sum(opens::int) over (partition by doc_id order by i) as s from edge) group by doc_id, s
), cut as (
  select w.doc_id, string_agg(substring(h, 2 * f + 1, 2 * (t - f)), '' order by f) as kept from w join (
    select doc_id, coalesce(lag(b) over (partition by doc_id order by a), 0) as f, a as t from span union all
    select doc_id, max(b), null from span group by 1
  ) s using (doc_id), (select 1) where t is not null group by 1
), tail as (select doc_id, max(b) as b from span group by 1)
select w.doc_id, cast(n as bigint) as n_bytes, cast(coalesce(m, 0) as bigint) as n_removed, coalesce(spans, 0) as n_spans,
  sha256(unhex(case when tail.b is null then h else coalesce(kept, '') || substring(h, 2 * tail.b + 1) end)) as kept_sha256
from w left join (select doc_id, sum(b - a) as m, count(*) as spans from span group by 1) using (doc_id) left join cut using (doc_id) left join tail using (doc_id)
"""
