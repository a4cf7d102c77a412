"""Removal of passages that an earlier document has too: seed and extend over words.

Seeds are winnowed anchors: of each window's 10-word grams the one with the least hash. Documents meet at their anchors (see repeats.py), each with
the run of words around it. All runs of a seed are extended at once, a word at a time, to the right and to the left: runs that have matched so far
stay in one class as long as their next words are equal, as words, not as hashes. That is the extension of every pair of runs without
listing the pairs. A run whose classes to both sides, window - k words to the right and k to the left, are those of a run in an earlier
document repeats a window of it; neighbouring windows make up the maximal repeat, at least `window` words long, which is cut out of every document
but the first that has it."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts
from .repeats import Kind, covered, repeated_windows, with_bases, with_removals
from .windows import text_bytes

#: Bytes of runs that are extended at once, about; the runs of one seed stay together, of which there are MANY at most.
BLOCK = 4_000_000


def classes(*keys: np.ndarray) -> np.ndarray:
    """A number for each row, the same for rows that are equal in all keys (each from 0 on)."""
    out = keys[0]
    for k in keys[1:]:
        out = np.unique(out * np.int64(k.max(initial=0) + 1) + k, return_inverse=True)[1]
    return out


def extend(key: np.ndarray, doc: np.ndarray, at: np.ndarray, n: np.ndarray, off: np.ndarray, data: pa.Array, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(doc, at, n): runs of windows, within these runs of words, that a run of the same key in an earlier document has too. off: words before
    the seed; a run has n windows."""
    order = np.lexsort((at, doc, key))
    key, doc, at, data = key[order], doc[order], at[order], data.take(pa.array(order))
    n, off = n[order].astype(np.int64), off[order].astype(np.int64)
    words = pc.split_pattern(data.cast(pa.large_string()), " ")
    start = words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
    word = words.flatten().dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
    end, seed = start + n + window - 1, start + off
    # windows hold the seed's first word in places 0 to most
    most = int(off.max(initial=0))
    step = lambda found, place, low, high: classes(found, np.where((place >= low) & (place < high), word[np.clip(place, 0, len(word) - 1)] + 1, 0))  # noqa: E731  0: no word there
    right, found = {}, np.unique(key, return_inverse=True)[1]
    for k in range(window):
        found = step(found, seed + k, start, end)
        right[k + 1] = found
    flags = np.zeros((len(key), most + 1), bool)
    left = np.zeros(len(key), np.int64)
    for k in range(most + 1):  # k words to the left
        if k:
            left = step(left, seed - k, start, end)
        here = np.flatnonzero((off >= k) & (off - k < n))
        if not len(here):
            continue
        _, first, same = np.unique(classes(right[window - k][here] if k < window else np.zeros(len(here), np.int64), left[here]), return_index=True, return_inverse=True)
        flags[here, most - k] = doc[here] > doc[here][first[same]]
    edge = np.diff(np.pad(flags, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, opens = np.nonzero(edge == 1)
    closes = np.nonzero(edge == -1)[1]
    return doc[row], at[row] + off[row] - (most - opens), closes - opens


def extend_runs(window: int):
    """rows (key, doc, at, n, off, data) -> (doc, at, n) of repeated windows, block by block of whole keys."""

    def of(rows: DataFrame) -> DataFrame:
        def work(batches):
            def done(table: pa.Table):
                cols = [table.column(k).to_numpy() for k in range(5)]
                doc, at, n = extend(*cols, table.column(5).combine_chunks() if table.column(5).num_chunks != 1 else table.column(5).chunk(0), window)
                return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(at), pa.array(n.astype(np.int32))], ["doc", "at", "n"])

            held, size = [], 0
            for batch in batches:
                held.append(batch)
                size += batch.nbytes
                if size > BLOCK:
                    table = pa.Table.from_batches(held)
                    key = table.column(0).to_numpy()
                    cut = int(np.searchsorted(key, key[-1]))
                    if cut:
                        yield done(table.slice(0, cut))
                        rest = table.slice(cut).combine_chunks()
                        held, size = rest.to_batches(), rest.nbytes
            if held and size:
                yield done(pa.Table.from_batches(held))

        return rows.repartition(shuffle_parts(rows.sparkSession), "key").sortWithinPartitions("key", "doc", "at").mapInArrow(work, "doc long, at long, n int")

    return of


def repeats(texts: DataFrame, window: int = 50, gram: int = 10) -> DataFrame:
    """(doc, at, n): runs of n windows, the first at word `at` of the document, whose words also start in a document with a smaller id. texts: with_bases()."""
    return repeated_windows(texts, Kind(window, gram, within=False, words=True), extend_runs(window))


def remove_passages(docs: DataFrame, window: int = 50, gram: int = 10) -> DataFrame:
    """(doc_id, n_words, n_removed, kept): the words `[^\\x20\\x09-\\x0D]+` that stay, joined by one space.

    A null text has no words; a text of fewer than `window` words loses none. Rows that repeat a doc_id with other texts are parts of one
    document: they don't remove each other's words, no window crosses them, and each gives a row of its own. An empty table gives no rows."""

    def cut(batches):
        for batch in batches:
            sizes, removed, kept = [], [], []
            for i in range(batch.num_rows):
                words = text_bytes(batch.column(1).slice(i, 1))[0].tobytes().split()
                lists = batch.column(3).slice(i, 1)
                gone = covered(lists.flatten(), len(words), window, batch.column(2)[i].as_py()) if lists.null_count == 0 else np.zeros(0, bool)
                sizes.append(len(words))
                removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g] if removed[-1] else words))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.int64()), pa.array([k.decode() for k in kept], pa.string())], ["doc_id", "n_words", "n_removed", "kept"])

    texts = with_bases(docs)
    return with_removals(texts, repeats(texts, window, gram)).mapInArrow(cut, "doc_id long, n_words long, n_removed long, kept string")


def passage_digests(docs: DataFrame, window: int = 50) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of remove_passages."""
    return remove_passages(docs, window).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


ORACLE_SQL = r"""
with w as (
  select doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x != '') as words from documents where doc_id is not null
), win as (
  select doc_id, i, md5(array_to_string(words[i:i + 49], ' ')) as h from (select doc_id, words, unnest(range(1, len(words) - 48)) as i from w)
), hit as (
  select doc_id, i from win join (select h, min(doc_id) as first_id from win group by h) using (h) where first_id < doc_id
), gone as (
  select distinct doc_id, i + k as i from hit, (select unnest(range(50)) as k)
), kept as (
  select p.doc_id, string_agg(p.word, ' ' order by p.i) as kept from (select doc_id, unnest(words) as word, unnest(range(1, len(words) + 1)) as i from w) p
  left join gone g on g.doc_id = p.doc_id and g.i = p.i where g.i is null group by 1
)
select w.doc_id, cast(len(words) as bigint) as n_words, coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join (select doc_id, count(*) as n from gone group by 1) g using (doc_id) left join kept using (doc_id)
"""
