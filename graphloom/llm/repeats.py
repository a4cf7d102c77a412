"""The ground that both repeat removers share: seeds, their groups, and the removal of covered units.

1. Each task cuts its texts into runs of windows with one anchor (see windows.py); copies of a run within the task are settled there.
2. Runs meet by anchor. Equal runs are settled at once: all but the first go. Runs that share an anchor but differ are wanted in full.
3. The texts of wanted runs are fetched, and their windows compared by the remover's own method.
4. The different runs of a very popular anchor could fill a task. They are cut into blocks of up to BLOCK windows, at fixed distances from the anchor,
   so that equal stretches make equal blocks whatever surrounds them. Equal blocks are settled, then the blocks that are left meet by their core, the
   units that all windows of a full block share: a block whose core no other has can't repeat. The others go to the remover's method, by core. Only cores
   with more than MANY different blocks are compared window by window, by hash.
5. Removed windows go back to their documents, and the units that they cover are cut out.

Texts of rows that repeat a doc_id are parts of one document: each has a base, where its units begin in the document."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_texts, lean, look_up, saved, shuffle_parts, text_blocks
from .windows import BYTE_VALUES, Sums, parts, runs, text_bytes, words_of

#: Anchors with more different runs than this are compared by blocks, cores with more different blocks by windows.
MANY = 6000
#: An anchor in more than this share of a sample of documents is dealt out by run instead of by anchor; there are fewer such anchors than
#: the mean number of anchors of a document divided by it.
HOT_SHARE, SAMPLE = 1 / 50, 64
GONE, COMPARE, BY_BLOCK = 0, 1, 2
BLOCK = 16
#: A run's number of windows and the distance to its anchor travel as one number.
SPAN = 1 << 12
#: Rows of one key that a task settles at once.
LONGEST = 400_000


@dataclass(frozen=True)
class Kind:
    """window, gram: sizes in units. within: whether a repeat in the same document counts. words: units are words, else bytes."""

    window: int
    gram: int
    within: bool
    words: bool

    def units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.words:
            return words_of(column)
        raw, offsets = text_bytes(column)
        return BYTE_VALUES[raw], offsets

    def content(self, text: pa.Array) -> bytes | list[bytes]:
        """The units of one text as they are."""
        raw = text_bytes(text)[0].tobytes()
        return raw.split() if self.words else raw

    def joined(self, content: bytes | list[bytes], start: np.ndarray, end: np.ndarray) -> list[bytes]:
        """The units from each start to its end; words with a space between them."""
        cut = [content[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]
        return [b" ".join(x) for x in cut] if self.words else cut

    def cut(self, column: pa.Array) -> dict[str, np.ndarray]:
        """runs() of a block of texts; text is the row's number."""
        units, offsets = self.units(column)
        rows = [(i, int(a), int(s), int(e)) for i, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)) if b - a >= self.window for s, e in parts(int(b - a), self.window)]
        row, base, start, end = (np.array(x, np.int64) for x in zip(*rows, strict=True)) if rows else (np.zeros(0, np.int64),) * 4
        found = []
        for i, j in self._slices(base + start, base + end):
            low, high = base[i] + start[i], base[j - 1] + end[j - 1]
            found.append(runs(units[low:high], (base + start)[i:j] - low, (end - start)[i:j], self.window, self.gram))
            found[-1]["text"] += i
        out = {k: np.concatenate([f[k] for f in found]) if found else np.zeros(0, np.uint64 if k in ("anchor", "content") else np.int64) for k in ("text", "at", "n", "off", "anchor", "content")}
        out["at"] = out["at"] + start[out["text"]]
        out["text"] = row[out["text"]]
        return out

    @staticmethod
    def _slices(starts: np.ndarray, ends: np.ndarray, most: int = 1_900_000) -> list[tuple[int, int]]:
        """Neighbouring texts whose units together number few enough for runs()."""
        out, i = [], 0
        while i < len(starts):
            j = max(i + 1, int(np.searchsorted(ends, starts[i] + most, "right")))
            out.append((i, j))
            i = j
        return out


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the row before in one of the keys."""
    out = np.ones(len(keys[0]), bool)
    if len(out) > 1:
        out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def _later(doc: np.ndarray, at: np.ndarray, head: np.ndarray, within: bool) -> np.ndarray:
    """True where a row repeats the first row of its group (head marks these; rows are sorted by doc, at) and counts as a repeat."""
    lead = np.maximum.accumulate(np.where(head, np.arange(len(head)), 0))
    later = doc > doc[lead]
    return later | (at > at[lead]) if within else later


RUN = "key long, content long, doc long, at long, span int, anchor long, gone boolean"


def _run_rows(kind: Kind, hot: np.ndarray):
    names = [x.split()[0] for x in RUN.split(", ")]

    def flush(held):
        anchor, content, doc, at, span = (np.concatenate([h[i] for h in held]) for i in range(5))
        order = np.lexsort((at, doc, content, anchor))
        anchor, content, doc, at, span = anchor[order], content[order], doc[order], at[order], span[order]
        gone = _later(doc, at, _first_of(anchor, content), kind.within)
        key = anchor.copy()
        if len(hot):
            spot = np.minimum(np.searchsorted(hot, anchor), len(hot) - 1)
            is_hot = hot[spot] == anchor
            key[is_hot] = anchor[is_hot] ^ (content[is_hot] * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(1)
        key[gone] = doc[gone].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        cols = [key.view(np.int64), content.view(np.int64), doc, at, span.astype(np.int32), anchor.view(np.int64), gone]
        for a in range(0, len(key), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(c[a : a + 100_000]) for c in cols], names)

    def emit(batches):
        held, rows = [], 0
        for batch in text_blocks(batches, limit=1_500_000):
            r = kind.cut(batch.column(1))
            doc, base = (batch.column(k).to_numpy()[r["text"]] for k in (0, 2))
            held.append((r["anchor"], r["content"], doc, r["at"] + base, r["n"] + SPAN * r["off"]))
            rows += len(doc)
            if rows > 500_000:
                yield from flush(held)
                held, rows = [], 0
        if rows:
            yield from flush(held)

    return emit


def hot_anchors(texts: DataFrame, kind: Kind) -> np.ndarray:
    """Anchors in many documents of a sample, ascending. They only decide how runs are dealt out, not which are compared."""
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)

    def anchors(batches):
        for batch in text_blocks(batches, limit=1_500_000):
            r = kind.cut(batch.column(1))
            pairs = np.unique(np.stack([r["text"].astype(np.uint64), r["anchor"]]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[1].view(np.int64))], ["anchor"])

    least = max(16, int(sample.count() * HOT_SHARE))
    found = sample.mapInArrow(lean(anchors), "anchor long").groupBy("anchor").count().where(F.col("count") > least).select("anchor").collect()
    return np.sort(np.array([r[0] for r in found], np.int64).view(np.uint64))


WANT = "doc long, anchor long, at long, n int, off int, how int"


def _settle(kind: Kind):
    """Rows sorted by key, content, doc, at -> what is gone, and what is wanted."""
    names = [x.split()[0] for x in WANT.split(", ")]

    def settle(rows: dict[str, np.ndarray], whole: bool, told: int = 0) -> pa.RecordBatch:
        """rows: of whole keys, or (not whole) some of one key's, of which the first `told` stand for rows that have been settled."""
        head_key, head = _first_of(rows["key"]), _first_of(rows["key"], rows["content"])
        later = _later(rows["doc"], rows["at"], head, kind.within)
        number = np.cumsum(head_key) - 1
        contents = np.bincount(number, head).astype(np.int64)[number]
        hot = rows["key"] != rows["anchor"]
        want = ~later & ((contents > 1) | hot | (not whole))
        if kind.within:
            want &= head  # equal runs hold equal windows: the first stands for them
        how = np.where(later, GONE, np.where(hot | (contents > MANY) | (not whole), BY_BLOCK, COMPARE))
        how[rows["gone"]] = GONE
        keep = later | want | rows["gone"]
        keep[:told] = False
        span = rows["span"].astype(np.int32)
        cols = [rows["doc"], rows["anchor"], rows["at"], span % SPAN, span // SPAN, how.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c[keep]) for c in cols], names)

    def stream(batches):
        held: dict[str, np.ndarray] | None = None
        split, told = None, 0  # a key of which rows have been settled already; whether the first row held is one of them
        for batch in batches:
            if not batch.num_rows:
                continue
            now = {k: batch.column(i).to_numpy(zero_copy_only=False) for i, k in enumerate(batch.schema.names)}
            held = now if held is None else {k: np.concatenate([held[k], now[k]]) for k in held}
            if split is not None:
                end = int(np.searchsorted(held["key"], split, "right"))
                same = end == len(held["key"])
                last = int(np.flatnonzero(_first_of(held["content"][:end]))[-1]) if end else 0
                cut = last if same else end
                if cut:
                    yield settle({k: v[:cut] for k, v in held.items()}, False, told)
                    held, told = {k: v[cut:] for k, v in held.items()}, 0
                elif len(held["key"]) > LONGEST:  # one content all along: its first row stands for it
                    yield settle(held, False, told)
                    held, told = {k: v[:1] for k, v in held.items()}, 1
                if same:
                    continue
                split = None
            if not len(held["key"]):
                continue
            last = int(np.flatnonzero(_first_of(held["key"]))[-1])
            if last:
                yield settle({k: v[:last] for k, v in held.items()}, True)
                held = {k: v[last:] for k, v in held.items()}
            if len(held["key"]) > LONGEST:
                split = held["key"][0]
        if held is not None and len(held["key"]):
            yield settle(held, split is None, told)

    return stream


FETCHED = "how int, key long, core long, doc long, at long, n int, off int, data binary"


def _fetch(kind: Kind):
    """Runs to compare, or blocks of runs: n windows from `at` on; the seed that they meet by begins off units later; data has the units."""
    names = [x.split()[0] for x in FETCHED.split(", ")]
    length = kind.window - BLOCK + 1  # of a core

    def rows(how: int, doc: int, key, core, at, n, off, base: int, content):
        data = kind.joined(content, at, at + n + kind.window - 1)
        size = len(at)
        cols = [pa.array(np.full(size, how, np.int32)), pa.array(key), pa.array(core), pa.array(np.full(size, doc)), pa.array(at + base), pa.array(n.astype(np.int32)), pa.array(off.astype(np.int32)), pa.array(data, pa.binary())]
        return pa.RecordBatch.from_arrays(cols, names)

    def blocks(units: np.ndarray, at, n, off):
        """(key, core, at, n, off) of the blocks of these runs."""
        from .words import ragged

        low = int(at[0])
        sums = Sums(units[low : int((at + n).max()) + kind.window - 1])
        place = ragged(at, n.astype(np.int64))
        run = np.repeat(np.arange(len(at)), n)
        block = (off[run] - (place - at[run])) // BLOCK
        first = np.flatnonzero(_first_of(run, block))
        size = np.diff(np.concatenate([first, [len(place)]]))
        start = place[first]
        key = sums.of(start - low, start - low + size + kind.window - 1) ^ (size.astype(np.uint64) * np.uint64(0x9FB21C651E98DF25))
        seed = (at + off)[run[first]] - block[first] * BLOCK
        core = sums.of(seed - low, seed - low + length)
        return key.view(np.int64), core.view(np.int64), start, size, seed - start

    def fetch(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                doc, base, wants = batch.column(0)[i].as_py(), batch.column(2)[i].as_py(), batch.column(3).slice(i, 1).flatten()
                content = kind.content(batch.column(1).slice(i, 1))
                at, n, off, how, anchor = (wants.field(k).to_numpy(zero_copy_only=False) for k in ("at", "n", "off", "how", "anchor"))
                at = at - base
                mine = (at >= 0) & (at + n + kind.window - 1 <= len(content))  # of this part of the document
                p = np.flatnonzero(mine & (how == COMPARE))
                if len(p):
                    yield rows(COMPARE, doc, anchor[p], np.zeros(len(p), np.int64), at[p], n[p], off[p], base, content)
                h = np.flatnonzero(mine & (how == BY_BLOCK))
                if len(h):
                    units, _ = kind.units(batch.column(1).slice(i, 1))
                    h = h[np.argsort(at[h], kind="stable")]
                    for a in range(0, len(h), 4000):
                        some = h[a : a + 4000]
                        key, core, start, size, seed = blocks(units, at[some].astype(np.int64), n[some], off[some].astype(np.int64))
                        yield rows(BY_BLOCK, doc, key, core, start, size, seed, base, content)

    return fetch


def _windows(kind: Kind):
    """Blocks (doc, at, n, data) -> a row for each window."""
    from .words import ragged

    def rows(batches):
        for batch in batches:
            data, n = batch.column(3), batch.column(2).to_numpy().astype(np.int64)
            if kind.words:
                units, offsets = kind.units(data.cast(pa.string()))
            else:
                units = BYTE_VALUES[np.frombuffer(b"".join(data.to_pylist()), np.uint8)]
                offsets = np.concatenate([[0], np.cumsum(pc.binary_length(data).to_numpy(zero_copy_only=False).astype(np.int64))])
            start = ragged(offsets[:-1], n)
            key = Sums(units).of(start, start + kind.window).view(np.int64)
            doc, at = (batch.column(k).to_numpy() for k in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.repeat(doc, n)), pa.array(ragged(at, n))], ["key", "doc", "at"])

    return rows


def _matched(rows: DataFrame, kind: Kind, name: str) -> DataFrame:
    """rows (key, doc, at, ...) with later: whether a row with the same key counts as earlier. Groups are counted before the shuffle."""
    firsts = saved(rows.groupBy("key").agg(F.count("*").alias("copies"), F.min(F.struct("doc", "at")).alias("first")).where("copies > 1"), name)
    later = F.struct("doc", "at") > F.col("first") if kind.within else F.col("doc") > F.col("first.doc")
    return look_up(rows, "key", firsts, "copies").withColumn("later", F.coalesce(later, F.lit(False))).drop("copies", "first")


def with_bases(docs: DataFrame) -> DataFrame:
    """(doc_id, text, base): base is 0, but for rows that repeat a doc_id with other texts: these are the parts of one document, in the order of a hash
    of their text. Rows that repeat both are one part."""
    texts = ids_and_texts(docs)
    twice = texts.groupBy("doc_id").count().where("count > 1").select("doc_id")
    if twice.isEmpty():
        return texts.withColumn("base", F.lit(0).cast("long"))
    mark, size = F.xxhash64(F.coalesce("text", F.lit(""))).alias("mark"), F.octet_length(F.coalesce("text", F.lit(""))) + 1
    parts_of = texts.join(twice, "doc_id", "left_semi").groupBy("doc_id", mark).agg(F.max(size).alias("size"))
    before = Window.partitionBy("doc_id").orderBy("mark").rowsBetween(Window.unboundedPreceding, -1)
    bases = saved(parts_of.select("doc_id", "mark", F.coalesce(F.sum("size").over(before), F.lit(0)).cast("long").alias("base")), "bases")
    return texts.withColumn("mark", mark).join(bases, ["doc_id", "mark"], "left").select("doc_id", "text", F.coalesce("base", F.lit(0).cast("long")).alias("base"))


def repeated_windows(texts: DataFrame, kind: Kind, compare: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(doc, at, n): runs of windows of each document that also start earlier: in a document with a smaller id, or (kind.within) before in the
    same one. texts: with_bases(). compare: (key, doc, at, n, off, data) -> (doc, at, n), for rows that share the seed that key names."""
    hot = hot_anchors(texts, kind)
    cut = texts.mapInArrow(lean(_run_rows(kind, hot)), RUN)
    found = saved(cut.repartition(shuffle_parts(texts.sparkSession), "key").sortWithinPartitions("key", "content", "doc", "at").mapInArrow(lean(_settle(kind)), WANT), "runs")
    wants = found.where(f"how != {GONE}").groupBy("doc").agg(F.collect_set(F.struct("at", "n", "off", "how", "anchor")).alias("wants"))
    fetched = saved(texts.join(wants, F.col("doc_id") == F.col("doc")).select("doc", "text", "base", "wants").mapInArrow(lean(_fetch(kind)), FETCHED), "fetched")

    blocks = saved(_matched(fetched.where(f"how = {BY_BLOCK}").drop("how"), kind, "firsts"), "blocks")
    firsts = blocks.where("not later")
    cores = saved(firsts.groupBy("core").agg(F.count("*").alias("copies")).where("copies > 1"), "cores")
    near = saved(look_up(firsts, "core", cores, "copies", how="inner"), "near")
    windows = near.where(f"copies > {MANY}").select("doc", "at", "n", "data").mapInArrow(lean(_windows(kind)), "key long, doc long, at long")
    gone = found.where(f"how = {GONE}").select("doc", "at", "n").unionByName(blocks.where("later").select("doc", "at", "n"))
    gone = gone.unionByName(_matched(saved(windows, "windows"), kind, "firsts").where("later").select("doc", "at", F.lit(1).alias("n")))
    seeded = fetched.where(f"how = {COMPARE}").select("key", "doc", "at", "n", "off", "data").unionByName(near.where(f"copies <= {MANY}").select(F.col("core").alias("key"), "doc", "at", "n", "off", "data"))
    return gone.unionByName(compare(seeded))


def covered(rows: pa.Array, size: int, window: int, base: int = 0) -> np.ndarray:
    """Which of the size units of a text, the first at base, the windows of its document's list of (at, n) cover."""
    edge = np.zeros(size + 1, np.int64)
    if len(rows):
        at, n = rows.field("at").to_numpy(zero_copy_only=False) - base, rows.field("n").to_numpy(zero_copy_only=False)
        good = (at >= 0) & (at + n + window - 1 <= size)
        np.add.at(edge, at[good], 1)
        np.add.at(edge, at[good] + n[good] + window - 1, -1)
    return np.cumsum(edge[:-1]) > 0


def with_removals(texts: DataFrame, gone: DataFrame) -> DataFrame:
    """(doc_id, text, base, gone): each text and its document's removed runs, null where there are none. They are no more than its windows."""
    each = gone.groupBy("doc").agg(F.collect_list(F.struct("at", "n")).alias("gone"))
    return texts.join(each, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "text", "base", "gone")
