"""Packing documents into training sequences without changing their order.

The stream of all ids, in doc_id order, is cut into windows of at most `size` ids. A window that ends at a document's end costs nothing, at a
sentence's end a little, elsewhere more; the ids it falls short of `size` cost one each, or none when its length is a power of two, which
needs no padding. Dynamic programming over the places where a cut may be finds the cheapest cuts. Padding is linear in the window's length, so
the best last cut is a sliding minimum, kept in a monotone queue; the few places at a power-of-two distance are looked at besides."""

from __future__ import annotations

import zlib
from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, lean, saved, shuffle_parts, text_blocks
from .words import tokenizers_coder

#: What a cut inside a document costs, in padded ids: at a sentence's end, elsewhere.
SENTENCE_COST, INNER_COST = 4.0, 32.0


def choose_cuts(places: np.ndarray, costs: np.ndarray, size: int) -> np.ndarray:
    """The cheapest cuts. places: ascending, from 0 to the stream's end, no two further apart than size; costs: of a cut at each place."""
    n = len(places)
    powers = [1 << k for k in range(size.bit_length()) if 1 << k <= size and 4 << k >= size]
    exact: list[list[int]] = [[] for _ in range(n)]
    for p in powers:
        i = np.searchsorted(places, places - p)
        for j in np.flatnonzero((places >= p) & (places[np.minimum(i, n - 1)] == places - p)):
            exact[j].append(int(i[j]))
    at, cost = places.tolist(), costs.tolist()
    best, back = [0.0] * n, [0] * n
    queue: deque[int] = deque([0])
    key = [0.0] * n
    for j in range(1, n):
        here = at[j]
        while at[queue[0]] < here - size:
            queue.popleft()
        i = queue[0]
        least = key[i] + size - here
        for x in exact[j]:
            if best[x] < least:
                least, i = best[x], x
        best[j], back[j] = least + cost[j], i
        key[j] = k = best[j] + here
        while queue and key[queue[-1]] >= k:
            queue.pop()
        queue.append(j)
    cuts, j = [], n - 1
    while j:
        cuts.append(j)
        j = back[j]
    return places[[0, *reversed(cuts)]]


def cut_places(ids: np.ndarray, doc_ends: np.ndarray, sentence_ends: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, costs): ends of documents and sentences, and every size/32 ids where these leave longer gaps."""
    step = max(1, size // 32)
    places = np.unique(np.concatenate([[0], sentence_ends, doc_ends]))
    gaps = np.diff(places)
    wide = np.flatnonzero(gaps > step)
    if len(wide):
        count = (gaps[wide] - 1) // step
        inner = np.repeat(places[wide], count) + step * (np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + 1)
        places = np.unique(np.concatenate([places, inner]))
    costs = np.full(len(places), INNER_COST)
    costs[np.searchsorted(places, sentence_ends)] = SENTENCE_COST
    costs[np.searchsorted(places, doc_ends)] = 0.0
    return places, costs


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, size: int = 2048, buffer_tokens: int = 1 << 20) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset): the pieces of all documents, each an unbroken part of one sequence.

    Documents go through in doc_id order; each task packs a range of doc_id, in buffers of about buffer_tokens ids, of which the last window
    is carried over to the next buffer. sequence_id counts from 0 without gaps. A null or empty text is end_id alone. Rows with the same
    doc_id are packed one after the other. An empty table gives no rows."""
    spark = docs.sparkSession
    ordered = ids_and_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(shuffle_parts(spark), "doc_id").sortWithinPartitions("doc_id")
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("shard", pa.int32()), ("in_shard", pa.int64()), ("offset", pa.int64())]

    def windows(batches):
        from pyspark import TaskContext

        coder, shard = tokenizers_coder(tokenizer, True), TaskContext.get().partitionId()
        signs = coder.encode([".", "!", "?"])[0]
        ends_sentence = np.zeros(1 << 17, bool)
        ends_sentence[signs] = True
        made = 0
        # the stream that isn't packed yet: ids, and for each document in it (doc_id, ids already packed, ids here, ids in all)
        rest, rest_docs = np.zeros(0, np.int64), np.zeros((0, 4), np.int64)

        def flush(ids, table, last):
            nonlocal made, rest, rest_docs
            ends = np.cumsum(table[:, 2])
            sentence = np.flatnonzero(ends_sentence[ids]) + 1
            cuts = choose_cuts(*cut_places(ids, ends, sentence, size), size)
            if not last and len(cuts) > 2:
                cuts = cuts[:-1]
            done = int(cuts[-1]) if last or len(cuts) > 1 else 0
            bounds = np.unique(np.concatenate([cuts, ends[ends < done]]))
            a, b = bounds[:-1], bounds[1:]
            doc = np.searchsorted(ends, a, "right")
            window = np.searchsorted(cuts, a, "right") - 1
            starts = ends - table[:, 2]
            raw = ids.astype("<u4")
            sums = [zlib.crc32(raw[x:y].data) for x, y in zip(a, b, strict=True)]
            out = [table[doc, 0], a - starts[doc] + table[doc, 1], b - a, np.array(sums, np.int64), table[doc, 3], np.full(len(a), shard, np.int32), window + made, a - cuts[window]]
            made += len(cuts) - 1
            left = ends > done
            rest, rest_docs = ids[done:], table[left].copy()
            if len(rest_docs):
                taken = max(0, done - int(starts[left][0]))
                rest_docs[0, 1] += taken
                rest_docs[0, 2] -= taken
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, (_, t) in zip(out, fields, strict=True)], [n for n, _ in fields])

        pending, tables, held = [], [], 0
        for batch in text_blocks(batches, limit=2_000_000):
            ids, cuts = coder.texts(batch.column(1))
            lengths = np.diff(cuts) + 1
            pending.append(np.insert(ids, cuts[1:], end_id).astype(np.int64))
            tables.append(np.stack([batch.column(0).to_numpy(), np.zeros_like(lengths), lengths, lengths], 1))
            held += len(pending[-1])
            if held >= buffer_tokens:
                yield flush(np.concatenate([rest, *pending]), np.concatenate([rest_docs, *tables]), False)
                pending, tables, held = [], [], 0
        if pending or len(rest):
            yield flush(np.concatenate([rest, *pending]), np.concatenate([rest_docs, *tables]), True)

    pieces = saved(ordered.mapInArrow(lean(windows, tokens=True), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, shard int, in_shard long, offset long"), "pieces")
    totals = {r[0]: r[1] for r in pieces.groupBy("shard").agg(F.max("in_shard") + 1).collect()}  # as many as tasks
    before, n = [], 0
    for shard in range(max(totals, default=-1) + 1):
        before.append(n)
        n += totals.get(shard, 0)
    first = F.element_at(F.array(*[F.lit(x).cast("long") for x in before or [0]]), F.col("shard") + 1)
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (first + F.col("in_shard")).alias("sequence_id"), "offset")
