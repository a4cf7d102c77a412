"""Language identification with hyperdimensional profiles.

Each letter has a random vector of +1 and -1, drawn from its code point. An n-gram's vector is the product of its letters' vectors, each
rotated by its place; a document's vector is the sum over its n-grams; a language's prototype is the sum of its documents' unit vectors.
The language with the greatest cosine wins. Letters are lower-cased; every run of other characters is one boundary symbol."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, remainder, ship, text_blocks

DIM, SEED, GROUP = 1024, 20_011, 192


class Letters:
    """Tables over code points, made once for each worker: lower-case form, 0 for what is no letter."""

    found: Letters | None = None

    def __init__(self):
        self.fold = np.zeros(0x110000, np.uint32)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = c.lower()
                self.fold[i] = ord(low[0]) if low[0].isalpha() else i
        self.vectors: dict[int, np.ndarray] = {}

    @classmethod
    def get(cls) -> Letters:
        cls.found = cls.found or cls()
        return cls.found

    def rows(self, codes: np.ndarray, dim: int) -> np.ndarray:
        for c in map(int, codes):
            if (c, dim) not in self.vectors:
                self.vectors[c, dim] = (np.random.Generator(np.random.PCG64([SEED, c])).integers(0, 2, dim) * 2 - 1).astype(np.int8)
        return np.stack([self.vectors[int(c), dim] for c in codes])


def grams(texts: list[str], n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, gram, count, alphabet): how often each n-gram is in each text, sorted by document; a gram is a number in base len(alphabet)."""
    table = Letters.get()
    raw = np.frombuffer(("\0" + "\0".join(texts) + "\0").encode("utf-32-le", "replace"), np.uint32)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    ends = np.concatenate([[0], np.cumsum(sizes + 1)])  # places of the marks between texts
    code = table.fold[raw]
    keep = (code > 0) | np.concatenate([[True], code[:-1] > 0])
    place = np.flatnonzero(keep)
    code = code[place]
    last = np.concatenate([place[1:], [len(raw)]]) - 1
    mark = np.zeros(len(raw) + 1, np.int64)
    mark[1:][ends] = 1
    mark = np.cumsum(mark)
    doc = mark[place + 1] - 1
    across = mark[last + 1] > mark[place]  # a run of other characters with the end of a text in it
    alphabet, index = np.unique(code, return_inverse=True)
    size = len(alphabet)
    if len(code) < n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), alphabet
    gram = np.zeros(len(code) - n + 1, np.int64)
    for k in range(n):
        gram = gram * size + index[k : len(code) - n + 1 + k]
    good = np.ones(len(gram), bool)
    for k in range(1, n - 1):  # only the outer symbols may be the ends of a text
        good &= ~across[k : len(gram) + k]
    owner = np.where(across[: len(gram)], doc[1 : len(gram) + 1], doc[: len(gram)])
    key, count = np.unique(owner[good] * size**n + gram[good], return_counts=True)
    return key // size**n, key % size**n, count, alphabet


def vectors(texts: list[str], dim: int = DIM, n: int = 3) -> np.ndarray:
    """The unit vector of each text, zeros where it has no letter."""
    out = np.zeros((len(texts), dim), np.float32)
    doc, gram, count, alphabet = grams(texts, n)
    letters = Letters.get().rows(alphabet, dim)
    turned = [np.roll(letters, n - 1 - k, 1) for k in range(n)]
    size = len(alphabet)
    cuts = np.searchsorted(doc, np.arange(0, len(texts) + GROUP, GROUP))
    for g in range(len(cuts) - 1):
        a, b = cuts[g], cuts[g + 1]
        if a == b:
            continue
        used, at = np.unique(gram[a:b], return_inverse=True)
        bound = np.ones((len(used), dim), np.int8)
        rest = used
        for k in range(n - 1, -1, -1):
            bound *= turned[k][rest % size]
            rest = rest // size
        first = g * GROUP
        counts = np.zeros((min(GROUP, len(texts) - first), len(used)), np.float32)
        counts[doc[a:b] - first, at] = count[a:b]
        out[first : first + len(counts)] = counts @ bound.astype(np.float32)
    has_letter = np.zeros(len(texts), bool)
    own = Letters.get().fold
    for i, t in enumerate(texts):
        has_letter[i] = t.isalpha() or any(own[ord(c)] for c in t)
    out[~has_letter] = 0
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norm > 0, norm, 1)


def train(docs: DataFrame, per_lang: int = 4000, dim: int = DIM, n: int = 3) -> tuple[list[str], np.ndarray]:
    """(languages, unit prototypes) of the rows with text and lang. per_lang: about so many rows of each language are used, chosen by a hash
    of doc_id; the others only count."""
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null and doc_id is not null")
    sizes = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}  # a row for each language
    if not sizes:
        return [], np.zeros((0, dim), np.float32)
    draw = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 20)) / float(1 << 20)
    share = F.create_map(*[F.lit(x) for k, v in sizes.items() for x in (k, min(1.0, per_lang / v))])
    chosen = rows.where(draw < share[F.col("lang")])

    def sums(batches):
        total: dict[str, np.ndarray] = {}
        for batch in text_blocks(batches):
            got, langs = vectors(batch.column(1).to_pylist(), dim, n), np.array(batch.column(2).to_pylist(), object)
            for lang in set(langs):
                total[lang] = total.get(lang, 0) + got[langs == lang].sum(0, dtype=np.float64)
        for lang, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * dim), pa.array(np.arange(dim, dtype=np.int32)), pa.array(v)], ["lang", "at", "value"])

    added = chosen.mapInArrow(sums, "lang string, at int, value double").groupBy("lang", "at").agg(F.sum("value")).collect()  # languages x dim
    langs = sorted({r[0] for r in added})
    out = np.zeros((len(langs), dim))
    for lang, at, value in added:
        out[langs.index(lang), at] = value
    norm = np.linalg.norm(out, axis=1, keepdims=True)
    return langs, (out / np.where(norm > 0, norm, 1)).round(6).astype(np.float32)


def identify(docs: DataFrame, langs: list[str], prototypes: np.ndarray, n: int = 3) -> DataFrame:
    """(doc_id, lang_pred, score): the language with the greatest cosine, and that cosine, 0 at least. `und` and 0 where the text is null or
    has no letter, or where nothing was learnt. Ties go to the first language by name. Only the text is looked at."""
    rows = ids_and_texts(docs)
    dim = prototypes.shape[1]
    shared = docs.sparkSession.sparkContext.broadcast((langs, prototypes))  # languages x dim floats

    def predict(batches):
        names, table = shared.value
        for batch in text_blocks(batches):
            got = vectors([t or "" for t in batch.column(1).to_pylist()], dim, n)
            cosine = got @ table.T if names else np.zeros((len(got), 1), np.float32)
            best = cosine.argmax(1)
            known = got.any(1) & bool(names)
            lang = [names[b] if k else "und" for b, k in zip(best, known, strict=True)]
            score = np.where(known, cosine[np.arange(len(got)), best].clip(0, 1), 0).astype(np.float64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return rows.mapInArrow(predict, "doc_id long, lang_pred string, score double")


def language_id(docs: DataFrame, folds: int = 5, held_out: int = 0, per_lang: int = 4000) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learns from the documents outside the held-out fold (crc32 of doc_id as text, modulo folds)
    and predicts for all. Each row with an id gives one row; an empty table gives none."""
    model = train(docs.where(remainder("doc_id", folds) != held_out), per_lang)
    got = identify(docs, *model)
    return got.select("doc_id", (remainder("doc_id", folds) == held_out).alias("held_out"), "lang_pred", "score")
