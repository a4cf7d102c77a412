"""Token ids of many texts by way of their distinct pieces: a piece is encoded once, then looked up."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: A text with one of these is encoded as a whole: a cut between two white spaces could change its ids, and CUT is our own mark.
UNSAFE = r"[\s\x{1c}-\x{1f}\x{85}\p{Z}] |\x{1f}"
CUT = "\x1f"


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The positions starts[i] ... starts[i] + lengths[i] - 1 of all i, in order."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


class PieceCoder:
    """encode(list of strings) -> (ids of all, number for each) is called on distinct pieces only. limit: pieces remembered; beyond it those that were met in one block only are forgotten."""

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self.known: dict[str, int] = {}
        self.flat, self.used = np.zeros(1 << 16, np.int32), 0
        self.starts, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.blocks = np.zeros(0, np.int32)

    def forget(self) -> None:
        keep = self.blocks > 1
        if keep.sum() > self.limit // 2:
            keep &= self.blocks >= np.partition(self.blocks, -self.limit // 4)[-self.limit // 4]
        number = np.cumsum(keep) - 1
        self.known = {k: int(number[v]) for k, v in self.known.items() if keep[v]}
        lengths = self.lengths[keep]
        flat = self.flat[ragged(self.starts[keep], lengths)]
        self.flat, self.used, self.lengths, self.starts = flat, len(flat), lengths, np.cumsum(lengths) - lengths
        self.blocks = np.ones(len(lengths), np.int32)

    def entries(self, pieces: list[str]) -> np.ndarray:
        known = self.known
        found = np.fromiter(map(known.get, pieces, [-1] * len(pieces)), np.int64, len(pieces))
        missing = np.flatnonzero(found < 0)
        if len(missing):
            ids, lengths = self.encode([pieces[i] for i in missing])
            total = len(ids)
            if self.used + total > len(self.flat):
                self.flat = np.concatenate([self.flat[: self.used], np.zeros(max(total, self.used), np.int32)])
            self.flat[self.used : self.used + total] = ids
            first = len(self.starts)
            self.starts = np.concatenate([self.starts, self.used + np.cumsum(lengths) - lengths])
            self.lengths = np.concatenate([self.lengths, lengths])
            self.used += total
            found[missing] = np.arange(first, first + len(missing))
            self.blocks = np.concatenate([self.blocks, np.zeros(len(missing), np.int32)])
            known.update(zip((pieces[i] for i in missing), range(first, first + len(missing)), strict=True))
        self.blocks[found] += 1
        return found

    def gather(self, entries: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of these entries one after the other, and where the texts that begin at the entries numbered by cuts begin among the ids."""
        lengths = self.lengths[entries]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        return self.flat[ragged(self.starts[entries], lengths)], ends[cuts]

    def texts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of texts without nulls. They are cut before a space, and between a letter and a sign: the vocabulary's splitter
        never joins what is on the two sides."""
        if len(self.known) > self.limit:
            self.forget()
        texts = texts.cast(pa.large_string())
        whole = pc.match_substring_regex(texts, UNSAFE).to_numpy(zero_copy_only=False)
        plain = texts.filter(pa.array(~whole)) if whole.any() else texts
        cut = pc.replace_substring_regex(pc.replace_substring(plain, " ", CUT + " "), r"(\p{L})([.,!?;:|*&%$#()\n])", "\\1" + CUT + "\\2")
        lists = pc.split_pattern(cut, CUT)
        offsets = lists.offsets.to_numpy()
        coded = lists.flatten().dictionary_encode()
        entries = self.entries(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy(zero_copy_only=False)]
        ids, cuts = self.gather(entries, offsets - offsets[0])
        if not whole.any():
            return ids, cuts
        odd_ids, odd_lengths = self.encode(texts.filter(pa.array(whole)).to_pylist())
        odd = np.split(odd_ids, np.cumsum(odd_lengths)[:-1])
        parts, k, j = [], 0, 0
        for w in whole:
            parts.append(odd[j] if w else ids[cuts[k] : cuts[k + 1]])
            j, k = j + w, k + (not w)
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


_coders: dict[tuple, PieceCoder] = {}


def byte_letters() -> dict[int, str]:
    """The printable letter by which byte-level vocabularies write each byte: visible Latin-1 as it is, the others from U+0100 on."""
    visible = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return {b: chr(b) if b in visible else chr(next(rest)) for b in range(256)}


def tokenizers_coder(path: str, lower: bool) -> PieceCoder:
    """One for each worker process. Strings of special tokens in a text are ordinary text.

    A piece of Latin letters, with at most a space before it, is one word for the vocabulary's own splitter, so it goes to the library's
    model directly; every other piece goes through the whole tokenizer. lower: the tokenizer lower-cases and drops white space."""
    if (path, lower) not in _coders:
        import os
        import re
        import unicodedata

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True
        model, letters = tokenizer.model, byte_letters()

        plain = re.compile(f" ?[{''.join(c for c in map(chr, range(0x250)) if c.isalpha())}]+").fullmatch
        del letters[ord(CUT)]  # it keeps the words apart

        def words(pieces: list[str]) -> list[str]:
            """Plain pieces as the model has them, all at once; as many strings as pieces."""
            text = CUT.join(pieces)
            if lower:
                text = unicodedata.normalize("NFC", text.replace(" ", "")).lower()
            return text.encode().decode("latin-1").translate(letters).split(CUT)

        def encode(pieces: list[str]) -> tuple[np.ndarray, np.ndarray]:
            got: list = [None] * len(pieces)
            own = [i for i, p in enumerate(pieces) if plain(p)]
            if lower:  # a capital may lower to a letter and a mark
                own = [i for i in own if pieces[i].isascii() or pieces[i].lower().lstrip().isalpha()]
            tokenize = model.tokenize
            for i, w in zip(own, words([pieces[i] for i in own]) if own else (), strict=True):
                got[i] = [t.id for t in tokenize(w)]
            other = [i for i, g in enumerate(got) if g is None]
            for n in range(0, len(other), 256):
                some = other[n : n + 256]
                for i, x in zip(some, tokenizer.encode_batch_fast([pieces[i] for i in some], add_special_tokens=False), strict=True):
                    got[i] = x.ids
            lengths = np.fromiter(map(len, got), np.int64, len(got))
            return np.fromiter(chain.from_iterable(got), np.int32, int(lengths.sum())), lengths

        _coders[(path, lower)] = PieceCoder(encode)
    return _coders[(path, lower)]
