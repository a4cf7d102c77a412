"""Quality scores by nearest-neighbour voting in a latent-semantic space.

A text's terms are the shapes of its surface: trigrams of character classes (letter case, digit, white space, each sign), how often a word
repeats the word before it or one shortly before, and its size. Term counts, weighted by log and inverse document frequency, are projected on
the leading singular directions of the labelled sample. Every document is compared with all labelled vectors, in blocks; its nearest labels
vote with their cosine as weight."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, ids_and_texts, lean, remainder, text_blocks

#: Classes of characters: lower case, upper case, digit, space, line end, other letter, other; then each ASCII sign by itself.
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
CLASSES = 7 + len(SIGNS)
#: Trigrams share this many columns by hashing; then come columns of repetition and of size.
SHAPES, REPEATS, SIZES = 1009, 12, 16
TERMS = SHAPES + REPEATS + SIZES
LOOK_BACK = (1, 2, 4, 8, 16, 32)


def _classes() -> np.ndarray:
    table = np.full(0x110000, 6, np.uint8)
    for i in range(0x3000):
        c = chr(i)
        table[i] = 0 if c.islower() else 1 if c.isupper() else 2 if c.isdigit() else 4 if c in "\r\n" else 3 if c.isspace() else 5 if c.isalpha() else 6
    for k, c in enumerate(SIGNS):
        table[ord(c)] = 7 + k
    return table


_table: np.ndarray | None = None


def terms(texts: list[str]) -> np.ndarray:
    """Counts (texts x TERMS)."""
    global _table
    if _table is None:
        _table = _classes()
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        kind = _table[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)].astype(np.int64)
        if len(kind):
            keep = np.concatenate([[True], (kind[1:] != kind[:-1]) | (kind[1:] > 1)])  # a run of one case is one symbol
            kind = kind[keep]
        if len(kind) > 2:
            shape = (kind[:-2] * CLASSES + kind[1:-1]) * CLASSES + kind[2:]
            out[i, :SHAPES] = np.bincount(shape % SHAPES, minlength=SHAPES)
        words = text.split()
        n = len(words)
        if n:
            number: dict[str, int] = {}
            w = np.fromiter((number.setdefault(x, len(number)) for x in words), np.int64, n)
            same = [int((w[b:] == w[:-b]).sum()) for b in LOOK_BACK]
            tenths = [int(10 * s / n) for s in same]
            for k, s in enumerate(tenths):
                out[i, SHAPES + k] = s * n / 10  # counts in tenths of the words: a chance repetition is none
            kinds = len(number) / n
            for k in range(REPEATS - len(LOOK_BACK)):
                out[i, SHAPES + len(LOOK_BACK) + k] = n if n > 30 and kinds < 0.5 / 2**k else 0
        out[i, SHAPES + REPEATS + min(SIZES - 1, n.bit_length())] = 1
    return out


@dataclass
class Space:
    """weights: of each term; basis: TERMS x dims; vectors: unit vectors of the labelled rows; labels: 0 or 1."""

    weights: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray

    def project(self, counts: np.ndarray) -> np.ndarray:
        v = self._weighted(counts, self.weights) @ self.basis
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return (v / np.where(norm > 0, norm, 1)).astype(np.float32)

    @staticmethod
    def _weighted(counts: np.ndarray, weights: np.ndarray) -> np.ndarray:
        v = np.log1p(counts) * weights
        norm = np.linalg.norm(v, axis=1, keepdims=True)
        return v / np.where(norm > 0, norm, 1)

    @classmethod
    def fit(cls, counts: np.ndarray, labels: np.ndarray, dims: int) -> Space:
        if not len(counts):
            return cls(np.zeros(TERMS, np.float32), np.zeros((TERMS, dims), np.float32), np.zeros((0, dims), np.float32), labels)
        weights = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 0.5).astype(np.float32)
        v = cls._weighted(counts, weights)
        value, direction = np.linalg.eigh((v.T @ v).astype(np.float64))
        space = cls(weights, direction[:, ::-1][:, :dims].astype(np.float32), np.zeros((0, dims), np.float32), labels)
        space.vectors = space.project(counts)
        return space

    def vote(self, counts: np.ndarray, neighbours: int) -> np.ndarray:
        """Share of label 1 among the nearest labelled rows, weighted by cosine; 0.5 where nothing was learnt. Of rows that tie
        for the last place any may be taken, but always the same."""
        if not len(self.labels):
            return np.full(len(counts), 0.5)
        cosine = self.project(counts) @ self.vectors.T
        k = min(neighbours, len(self.labels))
        near = np.argpartition(-cosine, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(cosine, near, 1), 1e-6).astype(np.float64) ** 8
        return (weight * self.labels[near]).sum(1) / weight.sum(1)


def train(docs: DataFrame, labels: DataFrame, sample: int = 6000, dims: int = 48) -> Space:
    """labels: (doc_id, quality). Learns from at most `sample` labelled rows, those with the least hash of doc_id; rows whose quality is
    neither 0 nor 1 teach nothing; equal labels of a doc_id count once, different ones both; a null text counts as empty."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("quality in (0, 1) and doc_id is not null").distinct()
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = ids_and_texts(docs).join(F.broadcast(chosen), "doc_id")  # at most sample rows

    def count(batches):
        for batch in text_blocks(batches, limit=1_500_000):
            got = terms([t or "" for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([g.astype(np.float32).tobytes() for g in got], pa.binary())], ["doc_id", "quality", "terms"])

    try:
        return _learnt(rows.mapInArrow(lean(count), "doc_id long, quality int, terms binary").toArrow(), dims)
    finally:
        give_back()  # the driver, too, goes on to other stages


def _learnt(got: pa.Table, dims: int) -> Space:
    got = got.sort_by([("doc_id", "ascending")])
    counts = np.frombuffer(b"".join(got["terms"].to_pylist()), np.float32).reshape(-1, TERMS)
    return Space.fit(counts, got["quality"].to_numpy().astype(np.float64), dims)


def _scored(rows: DataFrame, space: Space, neighbours: int, columns: str) -> DataFrame:
    """rows (doc_id, text, ...) with score in place of text; columns is the schema of all others."""
    shared = rows.sparkSession.sparkContext.broadcast(space)  # sample x dims floats

    def vote(batches):
        model = shared.value
        for batch in text_blocks(batches, limit=1_000_000):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            got = np.concatenate([model.vote(terms(texts[a : a + 256]), neighbours) for a in range(0, len(texts), 256)])
            yield batch.drop_columns(["text"]).append_column("score", pa.array(got.clip(0, 1)))

    return rows.mapInArrow(lean(vote), f"{columns}, score double")


def score(docs: DataFrame, space: Space, neighbours: int = 15) -> DataFrame:
    """(doc_id, score) of every row with an id; an empty or null text is scored by its size alone."""
    return _scored(ids_and_texts(docs), space, neighbours, "doc_id long")


def quality(docs: DataFrame, labels: DataFrame, folds: int = 3, held_out: int = 1, sample: int = 6000) -> DataFrame:
    """(doc_id, held_out, score, predicted): learns from labels outside the held-out fold (crc32 of doc_id as text, modulo folds) and scores
    every document. predicted is 1 from a score of 0.5 on. A null text counts as empty; rows that repeat a doc_id have each a row of their own; an empty
    table gives no rows."""
    space = train(docs, labels.where(remainder("doc_id", folds) != held_out), sample)
    return score(docs, space).select("doc_id", (remainder("doc_id", folds) == held_out).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, sample: int = 6000, neighbours: int = 15, known: DataFrame | None = None) -> DataFrame:
    """The rows of docs, with all their columns, whose score reaches the threshold. known: the texts that labels belong to, if not docs. Rows without an id stay. A null text counts as empty; rows that repeat a
    doc_id are judged each by its own text; an empty table stays empty."""
    digest = lambda text: F.sha2(F.coalesce(text.cast("string"), F.lit("")), 256)
    rows = ids_and_texts(docs).select("doc_id", "text", digest(F.col("text")).alias("sha"))
    bad = _scored(rows, train(docs if known is None else known, labels, sample), neighbours, "doc_id long, sha string").where(F.col("score") < threshold).select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"))
    return docs.join(bad, (F.col("doc_id").cast("long") == F.col("__id")) & (digest(docs["text"]) == F.col("__sha")), "left_anti")
