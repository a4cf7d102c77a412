"""Token ids in succinct files: one wavelet matrix for each block of documents.

A wavelet matrix keeps a sequence of small integers as bit planes, from the highest bit to the lowest; before each lower plane the sequence is
dealt stably into those with bit 0 and those with bit 1. Rank and select on the planes give access, counts and occurrences without unpacking."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, shuffle_parts, text_blocks
from .words import tokenizers_coder

#: Bits between two entries of the rank directory.
STEP = 512
FILE_SCHEMA = "shard int, block int, first_start long, doc_ids binary, lengths binary, n long, width int, zeros binary, planes array<binary>, ranks array<binary>"


class WaveletMatrix:
    def __init__(self, n: int, zeros: np.ndarray, planes: list[np.ndarray], ranks: list[np.ndarray]):
        """planes: packed bits, highest first; zeros: number of 0 bits of each; ranks: 1 bits before every STEP-th place."""
        self.n, self.zeros, self.planes, self.ranks = n, zeros, planes, ranks

    @classmethod
    def build(cls, values: np.ndarray, width: int) -> WaveletMatrix:
        if len(values) and int(np.max(values)) >> width:
            raise ValueError(f"an id of {int(np.max(values))} does not fit into {width} bits")
        now = np.ascontiguousarray(values, np.uint16 if width <= 16 else np.uint32)
        zeros, planes, ranks = np.zeros(width, np.int64), [], []
        for level in range(width):
            bit = (now >> (width - 1 - level)) & 1 == 1
            planes.append(np.packbits(bit))
            counts = np.add.reduceat(bit, np.arange(0, len(bit), STEP), dtype=np.int64) if len(bit) else np.zeros(0, np.int64)
            ranks.append(np.concatenate([[0], np.cumsum(counts)]).astype(np.uint32))
            low = now[~bit]
            zeros[level] = len(low)
            now = np.concatenate([low, now[bit]])
        return cls(len(values), zeros, planes, ranks)

    def bits(self, level: int) -> np.ndarray:
        return np.unpackbits(self.planes[level], count=self.n).view(bool)

    def unpack(self) -> np.ndarray:
        """The whole sequence, from the lowest plane up."""
        width = len(self.planes)
        now = np.zeros(self.n, np.uint16 if width <= 16 else np.uint32)
        for level in range(width - 1, -1, -1):
            bit, z = self.bits(level), int(self.zeros[level])
            up = np.empty_like(now)
            up[~bit] = now[:z]
            up[bit] = now[z:] | now.dtype.type(1 << (width - 1 - level))
            now = up
        return now

    def rank1(self, level: int, at: int) -> int:
        """1 bits before this place."""
        block = at // STEP
        start = block * STEP // 8
        part = np.unpackbits(self.planes[level][start : start + STEP // 8], count=at - block * STEP) if at > block * STEP else ()
        return int(self.ranks[level][block]) + int(np.sum(part))

    def access(self, at: int) -> int:
        value = 0
        for level in range(len(self.planes)):
            ones = self.rank1(level, at)
            bit = self.rank1(level, at + 1) - ones
            value = value << 1 | bit
            at = int(self.zeros[level]) + ones if bit else at - ones
        return value

    def interval(self, value: int, start: int, end: int) -> tuple[int, int]:
        """Where the value's occurrences of [start, end) lie below the last plane."""
        width = len(self.planes)
        if value >> width:
            return 0, 0
        for level in range(width):
            a, b = self.rank1(level, start), self.rank1(level, end)
            if value >> (width - 1 - level) & 1:
                start, end = int(self.zeros[level]) + a, int(self.zeros[level]) + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        a, b = self.interval(value, start, self.n if end is None else end)
        return b - a

    def _select(self, level: int, bit: int, k: int) -> int:
        """Place of the k-th (from 0) such bit of a plane."""
        ones = self.ranks[level].astype(np.int64)
        before = ones if bit else np.minimum(np.arange(len(ones)) * STEP, self.n) - ones
        block = int(np.searchsorted(before, k, "right")) - 1
        start = block * STEP
        part = np.unpackbits(self.planes[level][start // 8 : (start + STEP) // 8], count=min(STEP, self.n - start))
        return start + int(np.flatnonzero(part == bit)[k - int(before[block])])

    def select(self, value: int, k: int) -> int:
        """Place of the k-th (from 0) occurrence."""
        a, b = self.interval(value, 0, self.n)
        if not 0 <= k < b - a:
            raise IndexError(k)
        at, width = a + k, len(self.planes)
        for level in range(width - 1, -1, -1):
            bit = value >> (width - 1 - level) & 1
            at = self._select(level, bit, at - int(self.zeros[level]) if bit else at)
        return at


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int, width: int = 16, block_tokens: int = 1 << 20) -> None:
    """Writes the ids of all texts, each document's followed by end_id, in ascending doc_id order: shards are ranges of doc_id, one Parquet
    file each; a row of it is a block of whole documents, with their doc_id and lengths and the wavelet matrix of their ids.

    A null text counts as empty (end_id alone). Rows with the same doc_id stay, one after the other. An empty table gives no blocks.
    A block has block_tokens ids at most, or one document."""
    spark = docs.sparkSession
    n = shuffle_parts(spark)
    ordered = ids_and_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id")

    def encode(batches):
        from pyspark import TaskContext

        coder, shard = tokenizers_coder(tokenizer, False), TaskContext.get().partitionId()
        parts, held, before, block = [], 0, 0, 0

        def row():
            nonlocal parts, held, before, block
            doc_ids, lengths, ids = (np.concatenate([p[k] for p in parts]) for k in range(3))
            m = WaveletMatrix.build(ids, width)
            out = {"shard": shard, "block": block, "first_start": before, "doc_ids": doc_ids.astype("<i8").tobytes(), "lengths": lengths.astype("<i8").tobytes(), "n": len(ids), "width": width}
            out |= {"zeros": m.zeros.astype("<i8").tobytes(), "planes": [p.tobytes() for p in m.planes], "ranks": [r.astype("<u4").tobytes() for r in m.ranks]}
            parts, held, before, block = [], 0, before + len(ids), block + 1
            return pa.RecordBatch.from_pylist([out], schema=arrow)

        for batch in text_blocks(batches, limit=2_000_000):
            ids, cuts = coder.texts(batch.column(1))
            lengths = np.diff(cuts)
            ids = np.insert(ids, cuts[1:], end_id)
            lengths = lengths + 1
            doc_ids = batch.column(0).to_numpy()
            if held and held + len(ids) > block_tokens:
                yield row()
            starts = np.cumsum(lengths) - lengths
            a = 0
            while a < len(doc_ids):  # a slice may itself be more than a block
                b = max(a + 1, int(np.searchsorted(starts + lengths, starts[a] + block_tokens, "right")))
                parts.append((doc_ids[a:b], lengths[a:b], ids[starts[a] : starts[b - 1] + lengths[b - 1]]))
                held += len(parts[-1][2])
                a = b
                if a < len(doc_ids):
                    yield row()
        if parts:
            yield row()

    kinds = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary(), "array<binary>": pa.list_(pa.binary())}
    arrow = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in FILE_SCHEMA.split(", ")])
    ordered.mapInArrow(encode, FILE_SCHEMA).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(path)


def open_block(row: dict) -> tuple[np.ndarray, np.ndarray, WaveletMatrix]:
    """(doc_ids, lengths, matrix) of one row of a file."""
    planes = [np.frombuffer(p, np.uint8) for p in row["planes"]]
    ranks = [np.frombuffer(r, "<u4") for r in row["ranks"]]
    return np.frombuffer(row["doc_ids"], "<i8"), np.frombuffer(row["lengths"], "<i8"), WaveletMatrix(row["n"], np.frombuffer(row["zeros"], "<i8"), planes, ranks)


def read_ids(blocks: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document of the files, by unpacking each block's matrix.

    start is the number of ids of all documents before: those before in the shard, which the block names, and those of earlier shards, of
    which there are as many as write tasks."""
    totals = {r[0]: r[1] for r in blocks.groupBy("shard").agg(F.sum("n")).collect()}
    before, start = {}, 0
    for shard in sorted(totals):
        before[shard] = start
        start += totals[shard]

    def decode(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                row = batch.slice(k, 1).to_pylist()[0]
                doc_ids, lengths, matrix = open_block(row)
                ids = matrix.unpack().astype("<u4")
                starts = np.cumsum(lengths) - lengths
                sums = [zlib.crc32(ids[s : s + n].data) for s, n in zip(starts, lengths, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids), pa.array(starts + before[row["shard"]] + row["first_start"]), pa.array(lengths), pa.array(sums, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return blocks.mapInArrow(decode, "doc_id long, start long, n_tokens long, ids_crc32 long")


def count_token(blocks: DataFrame, token: int) -> DataFrame:
    """(shard, block, n): occurrences of an id, by rank alone."""

    def counts(batches):
        for batch in batches:
            for row in batch.to_pylist():
                yield pa.RecordBatch.from_pylist([{"shard": row["shard"], "block": row["block"], "n": open_block(row)[2].count(token)}], schema=pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("n", pa.int64())]))

    return blocks.mapInArrow(counts, "shard int, block int, n long")


def occurrences(blocks: DataFrame, token: int) -> DataFrame:
    """(doc_id, at): every place of an id within its document, by select."""

    def places(batches):
        for batch in batches:
            for row in batch.to_pylist():
                doc_ids, lengths, matrix = open_block(row)
                at = np.array([matrix.select(token, k) for k in range(matrix.count(token))], np.int64)
                ends = np.cumsum(lengths)
                doc = np.searchsorted(ends, at, "right")
                yield pa.RecordBatch.from_arrays([pa.array(doc_ids[doc]), pa.array(at - (ends - lengths)[doc])], ["doc_id", "at"])

    return blocks.mapInArrow(places, "doc_id long, at long")
