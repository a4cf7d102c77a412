"""Encoding and decoding with a sentencepiece BPE model, by vectorised merge rounds.

The symbols of many words lie in one flat array. Each round finds every word's pair of least rank, merges its occurrences from the left where
they don't overlap, and closes the gaps; words without a pair that can be merged drop out. Words repeat, so each is encoded once a worker."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ids_and_texts, text_blocks
from .words import CUT, PieceCoder, ragged

SPACE, NONE = "▁", np.int64(1 << 60)


class PieceModel:
    """Tables of a model file: ids of single characters, and for each pair of ids the id of the piece that they make.

    Holds for models of BPE type with byte fallback, without normalisation, with a dummy space before a text; __init__ checks this."""

    found: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        import sentencepiece

        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        n = lib.get_piece_size()
        self.pieces = [lib.id_to_piece(i) for i in range(n)]
        special = [lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i) or lib.is_unused(i) for i in range(n)]
        normal = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if lib.is_byte(i)}
        if len(byte) != 256 or lib.encode("ﬁ  a", out_type=str)[0] != SPACE or lib.decode(lib.encode("ﬁ  a ")) != "ﬁ  a ":
            raise ValueError("this model isn't BPE with byte fallback and no normalisation")
        if any(SPACE in p.lstrip(SPACE) for p in normal) or any(c not in normal for p in normal for c in p):
            raise ValueError("a piece crosses a word's beginning, or has a character that is no piece")
        self.size, self.bytes = n, np.array([byte[b] for b in range(256)], np.int64)
        order = np.argsort([-lib.get_score(i) for i in range(n)], kind="stable")
        self.rank = np.empty(n, np.int64)
        self.rank[order] = np.arange(n)
        self.letter = np.full(0x110000, -1, np.int32)
        for p, i in normal.items():
            if len(p) == 1:
                self.letter[ord(p)] = i
        pairs = sorted((normal[p[:k]] * n + normal[p[k:]], i) for p, i in normal.items() for k in range(1, len(p)) if p[:k] in normal and p[k:] in normal)
        self.keys, self.made = (np.array(x, np.int64) for x in zip(*pairs, strict=True))
        self.text = [p.replace(SPACE, " ").encode() for p in self.pieces]
        for i in range(n):
            if special[i]:
                self.text[i] = b"" if lib.is_control(i) else " ⁇ ".encode() if lib.is_unknown(i) else self.text[i]
        for b, i in byte.items():
            self.text[i] = bytes([b])
        self.digits = [str(i) for i in range(n)]
        self.breaks = r"\n" if "\n" not in normal else ""

    @classmethod
    def get(cls, path: str) -> PieceModel:
        if path not in cls.found:
            cls.found[path] = cls(path)
        return cls.found[path]

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The id that each pair makes, or -1."""
        key = left.astype(np.int64) * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (left >= 0) & (right >= 0), self.made[at], -1)

    def ranks(self, made: np.ndarray) -> np.ndarray:
        return np.where(made >= 0, self.rank[made], NONE)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all, number for each). words: with SPACE in place of spaces."""
        points = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        word = np.repeat(np.arange(len(words)), np.fromiter(map(len, words), np.int64, len(words)))
        symbol = self.letter[points].astype(np.int64)
        symbol = np.where(symbol < 0, -1 - points.astype(np.int64), symbol)  # a character that is no piece: below 0
        done_symbol, done_word = [], []
        made = np.full(len(symbol), -1, np.int64)  # of each symbol with the next
        if len(symbol) > 1:
            made[:-1] = np.where(word[:-1] == word[1:], self.merged(symbol[:-1], symbol[1:]), -1)
        while len(symbol):
            rank = self.ranks(made)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.concatenate([starts, [len(word)]]))
            least = np.minimum.reduceat(rank, starts)
            ended = least == NONE
            if ended.any():
                out = np.repeat(ended, lengths)
                done_symbol.append(symbol[out])
                done_word.append(word[out])
                symbol, word, made, rank = symbol[~out], word[~out], made[~out], rank[~out]
                least, lengths = least[~ended], lengths[~ended]
                if not len(symbol):
                    break
                starts = np.cumsum(lengths) - lengths
            at = np.flatnonzero(rank == np.repeat(least, lengths))
            number = np.repeat(np.arange(len(starts)), lengths)[at]
            # in a run of overlapping occurrences every other one, from the left
            head = np.concatenate([[True], np.diff(at) > 1])
            run = np.maximum.accumulate(np.where(head, np.arange(len(at)), 0))
            odd = (np.arange(len(at)) - run) % 2 == 1
            at, number = at[~odd], number[~odd]
            at = self.one_by_one(at, number, symbol, word, made, rank)
            symbol[at] = made[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            new = np.cumsum(keep)[at] - 1
            symbol, word, made = symbol[keep], word[keep], made[keep]
            again = np.unique(np.concatenate([new, new[new > 0] - 1]))
            again = again[again < len(symbol)]
            nxt = np.minimum(again + 1, len(symbol) - 1)
            made[again] = np.where((word[again] == word[nxt]) & (nxt > again), self.merged(symbol[again], symbol[nxt]), -1)
        symbol, word = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (done_symbol, done_word))
        order = np.argsort(word, kind="stable")
        symbol, word = symbol[order], word[order]
        strange = np.flatnonzero(symbol < 0)
        if len(strange):
            raw = [chr(-1 - int(s)).encode("utf-8", "replace") for s in symbol[strange]]
            count = np.ones(len(symbol), np.int64)
            count[strange] = [len(r) for r in raw]
            ends = np.cumsum(count)
            out = np.repeat(symbol, count)
            out[ragged((ends - count)[strange], count[strange])] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
            symbol, word = out, np.repeat(word, count)
        return symbol.astype(np.int32), np.bincount(word, minlength=len(words))

    def one_by_one(self, at, number, symbol, word, made, rank) -> np.ndarray:
        """The merges of this round. Where a merge would make a pair of lower rank than its own, that pair's turn comes before the word's next
        occurrence: only the first occurrence of such a word is merged now."""
        many = np.bincount(number, minlength=0)[number] > 1
        if not many.any():
            return at
        i, who = at[many], number[many]
        new, own, n = made[i], rank[i], len(symbol)
        right = np.minimum(i + 2, n - 1)
        to_right = np.where((i + 2 < n) & (word[right] == word[i]), self.ranks(self.merged(new, symbol[right])), NONE)
        left = np.maximum(i - 1, 0)
        after = np.concatenate([[False], i[1:] - i[:-1] == 2])  # the left neighbour has just been merged too
        before = np.where(after, new, symbol[left])
        to_left = np.where((i > 0) & (word[left] == word[i]), self.ranks(self.merged(before, new)), NONE)
        unsafe = np.unique(who[np.minimum(to_left, to_right) < own])
        if not len(unsafe):
            return at
        first = np.concatenate([[True], number[1:] != number[:-1]])
        return at[first | ~np.isin(number, unsafe)]

    def decode(self, ids: list[int]) -> str:
        """Pieces joined, SPACE as a space, runs of byte pieces as UTF-8, without the dummy space."""
        raw = b"".join([self.text[i] for i in ids])
        return raw[raw[:1] == b" " :].decode("utf-8", "replace")


class PieceTexts(PieceCoder):
    """Texts by way of their words: a word begins before a run of spaces; a line's end is a word too if no piece has one."""

    def __init__(self, model: PieceModel):
        super().__init__(model.encode_words)
        self.model = model

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > self.limit:
            self.forget()
        texts = pc.replace_substring(texts.cast(pa.large_string()), " ", SPACE)
        whole = pc.match_substring(texts, CUT)
        if pc.any(whole).as_py():
            parts = [self.encode([SPACE + t if t else t])[0] if w else self.texts(pa.array([t.replace(SPACE, " ")]))[0] for t, w in zip(texts.to_pylist(), whole.to_pylist(), strict=True)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        empty = pc.equal(pc.binary_length(texts), 0)
        texts = pc.if_else(empty, texts, pc.binary_join_element_wise(pa.scalar(SPACE, pa.large_string()), texts, pa.scalar("", pa.large_string())))
        if self.model.breaks:
            texts = pc.replace_substring(texts, "\n", CUT + "\n" + CUT)
        cut = pc.replace_substring_regex(texts, f"([^{SPACE}{CUT}])({SPACE})", "\\1" + CUT + "\\2")
        lists = pc.split_pattern(cut, CUT)
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        entries = self.entries(coded.dictionary.to_pylist())[coded.indices.to_numpy(zero_copy_only=False)]
        return self.gather(entries, offsets - offsets[0])


_texts: dict[str, PieceTexts] = {}


def piece_texts(path: str) -> PieceTexts:
    if path not in _texts:
        _texts[path] = PieceTexts(PieceModel.get(path))
    return _texts[path]


def encode_pieces(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, ids array<int>) of every row with an id; a null or empty text has no ids."""

    def encode(batches):
        coder = piece_texts(model)
        for batch in text_blocks(batches, limit=2_000_000):
            ids, cuts = coder.texts(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(cuts.astype(np.int32)), pa.array(ids))], ["doc_id", "ids"])

    return ids_and_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(encode, "doc_id long, ids array<int>")


def decode_pieces(coded: DataFrame, model: str) -> DataFrame:
    """(doc_id, text) of rows (doc_id, ids)."""

    def decode(batches):
        table = PieceModel.get(model)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([table.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded.select("doc_id", "ids").mapInArrow(decode, "doc_id long, text string")


def round_trip(docs: DataFrame, model: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): each text encoded, and its ids decoded again, in one pass."""

    def both(batches):
        coder = piece_texts(model)
        table = coder.model
        for batch in text_blocks(batches, limit=2_000_000):
            ids, cuts = coder.texts(batch.column(1))
            every = ids.tolist()
            rows = [every[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
            coded = [hashlib.sha256(",".join([table.digits[i] for i in r]).encode()).hexdigest() for r in rows]
            text = [hashlib.sha256(table.decode(r).encode()).hexdigest() for r in rows]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(cuts)), pa.array(coded, pa.string()), pa.array(text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return ids_and_texts(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(both, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
