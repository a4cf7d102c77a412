"""The operators against brute force on small tables with nulls, empty and long texts, ties, repeats and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import regex
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm")
import public_tokenizers
from graphloom.llm import exact, imatch, jaccard, langid, packing, pieces, quality, substring, suffix, wavelet, windows, words

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, digest string, bucket int, token long, doc long"
FIXED = dict.fromkeys(["digest"], "clash") | dict.fromkeys(["bucket", "token", "doc"], 7)
WORDS, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def frame(spark, texts):
    rows = [(i, t, None if i is None or i % 5 == 0 else "en", None, None if t is None else len(t), *FIXED.values()) for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


def sample(seed=1, n=60):
    """Texts with copies, near copies, shared passages, repeated lines, nulls, empty and long ones."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    passage = " ".join(word() for _ in range(70))
    texts: list[str | None] = [None, "", " \n\t", "One", "one", "ONE", "two words", "two  words", "ünïcode É ß 日本", "x" * 900, "a b " * 300]
    base = [word() for _ in range(120)]
    for k in range(n):
        kind = k % 6
        if kind == 0:
            texts.append(" ".join(word() for _ in range(rng.randint(1, 150))))
        elif kind == 1:
            texts.append(" ".join(word() for _ in range(20)) + " " + passage + "\n" + " ".join(word() for _ in range(20)))
        elif kind == 2:
            near = list(base)
            near[rng.randrange(120)] = word()
            texts.append(" ".join(near))
        elif kind == 3:
            texts.append(texts[rng.randrange(len(texts))])
        elif kind == 4:
            texts.append("\n".join([" ".join(word() for _ in range(12))] * 9))
        else:
            texts.append((texts[-1] or "").upper())
    ids = list(range(0, 3 * len(texts), 3))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.fixture(scope="module")
def texts():
    return sample()


@pytest.fixture(scope="module")
def docs(spark, texts):
    return frame(spark, texts)


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


def rows(df, *columns):
    return {r["doc_id"]: tuple(r[c] for c in columns) for r in df.collect()}


# -- tokens ----------------------------------------------------------------------------------------------------------------------------------

ODD = ["", " ", "a  b", " x ", "it's  \n here", "\n\n a b", "é́ Σας ΣΑΣ x", "a\x1c b", "a  b", "tab\t c", "a\x1fb c", "don't. x'S'tt", "A.b,,c;d\n\ne", "|a|b| *** z$1 %2", "é.Ω,", "<|endoftext|> a", "İstanbul", "日本語 テキスト 😀"]


@pytest.mark.parametrize(("name", "lower"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_pieces_give_the_library_s_ids(texts, name, lower):
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    every = ODD + [t or "" for _, t in texts]
    ids, cuts = words.tokenizers_coder(path, lower).texts(pa.array(every))
    for k, t in enumerate(every):
        assert ids[cuts[k] : cuts[k + 1]].tolist() == library.encode(t, add_special_tokens=False).ids, t


@pytest.mark.parametrize(("name", "lower"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_plain_pieces_go_to_the_model_at_once(name, lower):
    """The library's ids for pieces of all letters below U+0250 and their marks, and no Python call for each plain piece."""
    import sys

    import tokenizers

    path, rng = public_tokenizers.path(name), random.Random(4)
    coder, library = words.tokenizers_coder(path, lower), tokenizers.Tokenizer.from_file(path)
    library.encode_special_tokens = True
    letters = [c for c in map(chr, range(0x250)) if c.isalpha()]
    odd = ["", " ", "  a", "a ", "\x1f", "a\x1fb", "İ", " İa", "I\u0307", "e\u0301", " ΑΣ", "ŉ", "ª", "a1", ".\nWas", "</w>", "ǅ", *letters, *(" " + c for c in letters)]
    odd += [" " * rng.randint(0, 1) + "".join(rng.choice(letters) for _ in range(rng.randint(1, 9))) for _ in range(2000)]
    rng.shuffle(odd)
    ids, lengths = coder.encode(odd)
    assert [x.tolist() for x in np.split(ids, np.cumsum(lengths)[:-1])] == [x.ids for x in library.encode_batch(odd, add_special_tokens=False)]
    assert [len(x) for x in coder.encode([])] == [0, 0]
    plain, calls = [" " + "".join(rng.choice("abcdefghij") for _ in range(7)) for _ in range(3000)], 0

    def count(frame, event, arg):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        coder.encode(plain)
    finally:
        sys.setprofile(None)
    assert calls < len(plain) / 10


def test_forgotten_pieces_are_encoded_again():
    coder = words.PieceCoder(lambda ps: (np.array([len(p) for p in ps], np.int32), np.ones(len(ps), np.int64)), limit=4)
    for k in range(20):
        text = pa.array([f"a bb{'c' * k} ddd", "a"])
        ids, cuts = coder.texts(text)
        assert ids.tolist() == [1, 3 + k, 4, 1]
        assert cuts.tolist() == [0, 3, 4]


def test_op10_is_sentencepiece(spark, docs, texts, none):
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(2)
    odd = [*ODD, "aaaaaaaaaaaaa", "abababababab  ababab", "<s> </s> <0x41>", "x" * 3001, "\x00a\x01", "    " * 20 + "z", "▁▁a ▁"]
    odd += ["".join(rng.choice("abt hein ▁\n.é①") for _ in range(rng.randint(1, 60))) for _ in range(500)]
    ids, cuts = pieces.piece_texts(path).texts(pa.array(odd))
    for k, t in enumerate(odd):
        got = ids[cuts[k] : cuts[k + 1]].tolist()
        assert got == library.encode(t), t
        assert pieces.PieceModel.get(path).decode(got) == library.decode(got)
    got = rows(pieces.round_trip(docs, path), "n_tokens", "ids_sha256", "decoded_sha256")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for i, t in texts:
        want = library.encode(t or "")
        assert got[i] == (len(want), sha(",".join(map(str, want))), sha(library.decode(want)))
    back = pieces.decode_pieces(pieces.encode_pieces(docs, path), path)
    assert rows(back, "text") == {i: (library.decode(library.encode(t or "")),) for i, t in texts}
    assert pieces.round_trip(none, path).count() == 0


def test_wavelet_matrix():
    rng = np.random.default_rng(3)
    for n in (0, 1, 511, 512, 513, 3000):
        values = rng.integers(0, 50, n).astype(np.uint16)
        m = wavelet.WaveletMatrix.build(values, 16)
        assert (m.unpack() == values).all()
        for v in (0, 7, 49, 60_000):
            at = np.flatnonzero(values == v)
            assert m.count(v) == len(at)
            assert [m.select(v, k) for k in range(min(5, len(at)))] == at[:5].tolist()
        assert all(m.access(i) == values[i] for i in range(0, n, 97))
        if n:
            assert m.count(7, n // 3, n // 2) == (values[n // 3 : n // 2] == 7).sum()


def test_op5_files_hold_all_ids(spark, docs, texts, none, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    for name, table, block in (("a", docs, 1 << 20), ("b", docs, 500), ("c", none, 500)):
        wavelet.write_ids(table, str(tmp_path / name), path, 2, block_tokens=block)
        blocks = spark.read.parquet(str(tmp_path / name))
        got = rows(wavelet.read_ids(blocks), "start", "n_tokens", "ids_crc32")
        if name == "c":
            assert not got
            continue
        start, twos = 0, []
        for i, t in sorted(texts):
            ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
            assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
            start += len(ids)
            twos += [(i, k) for k in np.flatnonzero(ids == 2).tolist()]
        assert wavelet.count_token(blocks, 2).agg(F.sum("n")).first()[0] == len(twos)
        assert sorted(map(tuple, wavelet.occurrences(blocks, 2).collect())) == sorted(twos)


def test_cuts_are_the_cheapest():
    rng = random.Random(6)
    for _ in range(40):
        size = rng.choice([8, 16])
        places = [0]
        while len(places) < 14:
            places.append(places[-1] + rng.randint(1, size // 2))
        costs = [rng.choice([0.0, 4.0, 32.0]) for _ in places]
        best = [0.0] + [1e9] * 13
        pad = lambda n: 0 if n & (n - 1) == 0 and 4 * n >= size else size - n
        for j in range(1, 14):
            best[j] = min(best[i] + pad(places[j] - places[i]) + costs[j] for i in range(j) if places[j] - places[i] <= size)
        cuts = packing.choose_cuts(np.array(places), np.array(costs), size).tolist()
        assert cuts[0] == 0 and cuts[-1] == places[-1]
        assert sum(pad(b - a) + costs[places.index(b)] for a, b in zip(cuts, cuts[1:], strict=False)) == best[-1]


@pytest.mark.parametrize("buffer", [1 << 20, 3000])
def test_op2_pieces_hold_each_id_once(docs, texts, none, buffer):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    out = [r.asDict() for r in packing.pack(docs, path, buffer_tokens=buffer).collect()]
    ids = {i: np.array([*library.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts}
    at = Counter()
    for r in sorted(out, key=lambda r: (r["doc_id"], r["start"])):
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert (r["start"], r["doc_tokens"], r["ids_crc32"]) == (at[r["doc_id"]], len(ids[r["doc_id"]]), zlib.crc32(part.tobytes()))
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(x) for i, x in ids.items()}
    fill = Counter()
    stream = sorted(out, key=lambda r: (r["sequence_id"], r["offset"]))
    for r in stream:
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 2048 and sorted(fill) == list(range(len(fill)))
    assert [(r["doc_id"], r["start"]) for r in stream] == sorted((r["doc_id"], r["start"]) for r in out)
    assert packing.pack(none, path).count() == 0


# -- language and quality ----------------------------------------------------------------------------------------------------------------------


def test_grams_by_hand():
    some = ["Hello, World!", "", "  ", "Él está  aquí 12 ok", "a", "x--y", "ab\ncd "]
    doc, gram, count, letters = langid.grams(some, 3)
    got = [Counter() for _ in some]
    for d, g, c in zip(doc, gram, count, strict=True):
        got[d]["".join(chr(letters[x]) if letters[x] else " " for x in (g // len(letters) ** 2, g // len(letters) % len(letters), g % len(letters)))] += c
    for t, g in zip(some, got, strict=True):
        s = " " + " ".join("".join(c.lower() if c.isalpha() else " " for c in t).split()) + " "
        assert g == (Counter(s[i : i + 3] for i in range(len(s) - 2)) if t.strip() else Counter())


def test_op1_learns_languages(spark, docs, none):
    a, b = "the then there other weather mother", "der die das schon durch nicht"
    rng = random.Random(8)
    make = lambda s: " ".join(rng.choice(s.split()) for _ in range(12))
    table = [(i, make(a if i % 2 else b), "en" if i % 2 else "de") for i in range(200)] + [(500, None, "en"), (501, "12 !", "de"), (502, "the", None)]
    got = {r.doc_id: r for r in langid.language_id(spark.createDataFrame(table, "doc_id long, text string, lang string")).collect()}
    assert len(got) == 203
    assert all(got[i].lang_pred == ("en" if i % 2 else "de") and 0 < got[i].score <= 1 for i in range(200))
    assert (got[500].lang_pred, got[500].score) == (got[501].lang_pred, got[501].score) == ("und", 0.0)
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in got)
    assert langid.language_id(none).count() == 0
    assert set(rows(langid.language_id(docs), "lang_pred").values()) <= {("en",), ("und",)}


def brute_profile(text, dim, n=3):
    """The sum over all n-grams of the products of the letters' vectors, each turned by its place."""
    fold, signs = langid.Letters.get().fold, [0]
    for c in text:
        if fold[ord(c)] or signs[-1]:
            signs.append(int(fold[ord(c)]))
    if signs[-1]:
        signs.append(0)
    total = np.zeros(dim)
    for k in range(len(signs) - n + 1):
        product = np.ones(dim)
        for j in range(n):
            product *= np.roll(langid.Letters.get().rows(np.array([signs[k + j]]), dim)[0], n - 1 - j)
        total += product
    return total / max(np.linalg.norm(total), 1e-9) if any(signs) else np.zeros(dim)


def test_op1_brute_force(spark, texts, docs):
    brute = {i: brute_profile(t or "", 256) for i, t in texts}
    got = langid.vectors([t or "" for _, t in texts], 256)
    assert all(np.allclose(g, brute[i], atol=1e-5) for g, (i, _) in zip(got, texts, strict=True))
    langs = {i: "x" if k % 3 else "y" for k, (i, _) in enumerate(texts)}
    table = spark.createDataFrame([(i, t, langs[i]) for i, t in texts], "doc_id long, text string, lang string")
    names, prototypes = langid.train(table, dim=256)
    assert names == ["x", "y"]
    for name, row in zip(names, prototypes, strict=True):
        total = sum(brute[i] for i, t in texts if langs[i] == name)
        assert np.allclose(row, total / np.linalg.norm(total), atol=1e-4)
    for r in langid.identify(docs, names, prototypes).collect():
        cosine = prototypes @ brute[r.doc_id]
        assert r.lang_pred == ("und" if not brute[r.doc_id].any() else r.lang_pred)
        if r.lang_pred != "und":
            assert cosine[names.index(r.lang_pred)] >= cosine.max() - 1e-5 and abs(r.score - max(0, cosine.max())) < 1e-4


def test_op6_brute_force(spark, texts, docs):
    labels = spark.createDataFrame([(i, k % 2) for k, (i, _) in enumerate(texts)], "doc_id long, quality int")
    space = quality.train(docs, labels)
    given = {i: k % 2 for k, (i, _) in enumerate(texts)}
    vectors = {i: space.project(quality.terms([t or ""]))[0] for i, t in texts}
    assert np.allclose(space.vectors, [vectors[i] for i in sorted(vectors)], atol=1e-5)
    for r in quality.score(docs, space).collect():
        near = sorted(((float(vectors[r.doc_id] @ v), given[i]) for i, v in vectors.items()), reverse=True)
        if near[14][0] - near[15][0] > 1e-6:  # else the last places may be taken by others
            weight = [max(c, 1e-6) ** 8 for c, _ in near[:15]]
            assert abs(r.score - sum(w * y for w, (_, y) in zip(weight, near, strict=False)) / sum(weight)) < 1e-4


def test_op6_separates_junk(spark, docs, none):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    good = lambda: " ".join(word() for _ in range(60)).capitalize() + "."
    junk = lambda: "".join(word() + "### " for _ in range(40)) if rng.random() < 0.5 else (word() + " ") * 60
    table = [(i, good() if i % 3 else junk()) for i in range(240)] + [(900, ""), (901, None)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(240)] + [(5000, 1, 0), (None, 0, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality.quality(spark.createDataFrame(table, "doc_id long, text string"), labels).collect()}
    assert len(got) == 242
    assert np.mean([got[i].predicted == int(i % 3 > 0) for i in range(240) if got[i].held_out]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) and r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) for i, r in got.items())
    assert got[900].score == got[901].score
    kept = quality.keep_good(docs, labels.limit(0))
    assert kept.count() == docs.count() and kept.columns == docs.columns
    assert quality.quality(none, labels).count() == 0


# -- duplicates --------------------------------------------------------------------------------------------------------------------------------


def test_fuse_filter_has_no_false_negative():
    rng = np.random.default_rng(5)
    for n in (0, 1, 2, 3, 10, 1000, 40_000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64))
        made = exact.FuseFilter.build(keys)
        assert made.has(keys).all()
        assert made.has(rng.integers(1 << 63, (1 << 64) - 1, 20_000, dtype=np.uint64)).mean() < 0.001


def test_op3_groups_equal_texts(docs, texts, none):
    got = rows(exact.exact_dedup(docs), "keep_id", "group_size", "kept", "text_sha256")
    norm = {i: (t or "").translate(LOWER) for i, t in texts}
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        assert got[i] == (max(same), len(same), i == max(same), hashlib.sha256(t.encode()).hexdigest())
    kept = exact.keep_distinct(docs)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if g[2]}
    assert exact.exact_dedup(none).count() == 0


def brute_components(texts, n, num, den):
    sets = {}
    for i, t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    label = {i: i for i in sets}
    changed = True
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in linked:
            low = min(label[a], label[b])
            changed |= label[a] != low or label[b] != low
            label[a] = label[b] = low
    return {i: (len(sets[i]), label[i]) for i in sets}


@pytest.mark.parametrize("like", [(3, 90, 100), (5, 80, 100), (1, 50, 100)])
def test_op4_loses_no_link(docs, texts, none, like):
    got = rows(jaccard.similar_groups(docs, jaccard.Likeness(*like)), "n_shingles", "component_id")
    assert got == brute_components(texts, *like)
    if like[0] == 5:
        kept = jaccard.keep_one_of_each(docs)
        assert kept.columns == docs.columns
        assert {r.doc_id for r in kept.collect()} == {i for i, g in got.items() if g[1] == i}
        assert jaccard.similar_groups(none).count() == 0


def test_op4_chains_of_groups(spark):
    rng = random.Random(11)
    base = [f"w{k}" for k in range(40)]
    made = []
    for k in range(45):  # each a little further from the first: no two distant ones link, all are one group
        base = list(base)
        base[rng.randrange(40)] = f"n{k}"
        made.append((k, " ".join(base)))
    like = jaccard.Likeness(1, 90, 100)
    assert rows(jaccard.similar_groups(frame(spark, made), like), "n_shingles", "component_id") == brute_components(made, 1, 90, 100)


def shuffled_bytes(spark):
    sc = spark.sparkContext
    sc._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    stages = sc._jsc.sc().statusStore().stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    return {stages.apply(k).stageId(): stages.apply(k).shuffleWriteBytes() for k in range(stages.size())}


def test_op4_verifies_without_shuffling_all_texts(spark):
    rng = random.Random(5)
    made = [(k, " ".join(f"{rng.getrandbits(32):x}" for _ in range(500))) for k in range(300)]
    made += [(1000 + k, made[k][1] + " more") for k in range(3)]
    like = jaccard.Likeness(3, 90, 100)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as with tables that are too large to be broadcast
    try:
        _, sets, _ = jaccard.similar(frame(spark, made), like)
        names = {r.first: (r.id, r.n) for r in sets.collect()}
        pairs = spark.createDataFrame([(*names[a], *names[b]) for a, b in [(0, 1000), (1001, 1), (2, 1002), (3, 4)]], "a long, n int, b long, m int").select("a", "b", "n", "m")
        seen = shuffled_bytes(spark)
        links = jaccard.verified(pairs, sets, jaccard.ids_and_texts(frame(spark, made)), like)
        assert {(r.a, r.b) for r in links.collect()} == {(names[a][0], names[b][0]) for a, b in [(0, 1000), (1001, 1), (2, 1002)]}
        moved = sum(n for stage, n in shuffled_bytes(spark).items() if stage not in seen)
        assert 0 < moved < sum(len(t) for _, t in made) // 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_op4_parity_bits_bound_the_difference(spark):
    rng = np.random.default_rng(8)
    made = []
    for n in (1, 5, 90, 100, 101, 190, 230, 400, 800, 3000):
        one = rng.integers(0, 1 << 63, n, dtype=np.uint64)
        for m in {n, n * 9 // 10, n // 2}:
            for same in {0, m // 2, m * 9 // 10, m}:
                two = np.concatenate([one[:same], rng.integers(0, 1 << 63, m - same, dtype=np.uint64)])
                made.append((n, m, n + m - 2 * same, *(jaccard.parity(s).view(np.int64).tolist() for s in (one, two))))
    table = spark.createDataFrame(made, "n int, m int, apart int, x array<long>, y array<long>")
    got = table.select("*", jaccard.differing("x", "y").alias("d"), jaccard.differing("y", "x").alias("e")).collect()
    assert all(r.d == r.e <= r.apart for r in got)
    # sets of one size that have nothing in common are told apart
    assert all(r.d > r.n + r.m - 2 * -(-80 * (r.n + r.m) // 180) for r in got if r.n == r.m >= 400 and r.apart == r.n + r.m)


def test_op4_pairs_by_chance_meet_without_their_heads(spark, monkeypatch):
    rng = random.Random(9)
    made = [(k, " ".join(f"{rng.getrandbits(32):x}" for _ in range(500))) for k in range(60)]
    made.append((60, made[0][1] + " more"))
    like = jaccard.Likeness(5, 80, 100)
    _, sets, _ = jaccard.similar(frame(spark, made), like)
    one, two = (sets.select(F.col("id").alias(i), F.col("n").alias(n)) for i, n in (("a", "n"), ("b", "m")))
    pairs = jaccard.saved(one.join(two, F.col("a") < F.col("b")), "pairs")
    met = []

    def with_both(pairs, sets, join=jaccard.with_both):
        met.append((pairs.count(), sets.agg(F.max(F.size("tokens"))).first()[0]))
        return join(pairs, sets)

    monkeypatch.setattr(jaccard, "with_both", with_both)
    links = jaccard.verified(pairs, sets, jaccard.ids_and_texts(frame(spark, made)), like)
    assert links.count() == 1 and max(n for n, _ in met) == 1830
    assert max(n for n, size in met if size > 64) < 60  # pairs that lists of tokens are fetched for


def test_op4_screen_keeps_all_that_is_wanted(spark, monkeypatch):
    every = spark.range(-3000, 3000)
    wanted = every.where("id % 6 = 0")
    for most in (jaccard.SCREEN, 1):  # with one word for all keys nothing is told apart, and nothing lost
        monkeypatch.setattr(jaccard, "SCREEN", most)
        got = {r.id for r in jaccard.screened(every, "id", wanted).collect()}
        assert got >= {r.id for r in wanted.collect()}
        assert len(got) < 1500 if most > 1 else len(got) == 6000
    assert jaccard.screened(every, "id", every.where("id > 5000")).count() == 0


@pytest.mark.parametrize("like", [(3, 90, 100), (5, 80, 100), (1, 50, 100), (2, 100, 101)])
def test_op4_bands_hold_all_sizes_that_fit(spark, like):
    like = jaccard.Likeness(*like)
    n, p, m = (F.col(c) for c in ("n", "p", "m"))
    first = spark.range(1, 91).select(F.col("id").cast("int").alias("n")).withColumn("p", F.explode(F.sequence(F.lit(0), n - F.ceil(F.lit(like.num) * n / float(like.den) - 1e-9).cast("int"))))
    pairs = first.crossJoin(spark.range(1, 185).select(F.col("id").cast("int").alias("m")))
    fit = like.sizes_fit(n, m) & (F.least(n - p, m) >= like.needs(n, m))
    assert pairs.where(fit & ~F.array_contains(like.bands(n, p), like.band(m))).count() == 0
    assert first.where((F.size(like.bands(n, p)) > 3) | (F.size(like.bands(n, p)) < 1)).count() == 0
    if like.den - like.num > 5:
        assert first.agg(F.avg(F.size(like.bands(n, p)))).first()[0] < 2.6


def every_anchor_is_hot(monkeypatch):
    from graphloom.llm import repeats as ground

    def anchors(texts, kind):
        got = [kind.cut(pa.array([r.text], pa.string()))["anchor"] for r in texts.collect() if r.text]
        return np.unique(np.concatenate([*got, np.zeros(0, np.uint64)]))

    monkeypatch.setattr(ground, "hot_anchors", anchors)


#: All runs to the remover's method; blocks that share a core; windows by hash; keys that are settled in slices.
WAYS = {"runs": {}, "blocks": {"hot": True}, "windows": {"hot": True, "MANY": 0}, "slices": {"LONGEST": 3}}


@pytest.fixture(params=WAYS)
def way(request, monkeypatch):
    for name, value in WAYS[request.param].items():
        every_anchor_is_hot(monkeypatch) if name == "hot" else monkeypatch.setattr(f"graphloom.llm.repeats.{name}", value)
    return request.param


def test_op7_removes_later_passages(docs, texts, none, way):
    got = rows(substring.passage_digests(docs), "n_words", "n_removed", "kept_sha256")
    first, total = {}, 0
    for i, t in sorted(texts):
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        gone = np.zeros(len(w), bool)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = True
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        assert got[i] == (len(w), int(gone.sum()), hashlib.sha256(kept.encode()).hexdigest())
        total += int(gone.sum())
    assert total > 500
    assert substring.passage_digests(none).count() == 0


def brute_bytes(texts, length):
    seen, out = set(), {}
    for i, t in sorted(texts):
        raw = (t or "").encode()
        gone = np.zeros(len(raw), bool)
        for k in range(len(raw) - length + 1):
            w = raw[k : k + length]
            if w in seen:
                gone[k : k + length] = True
            seen.add(w)
        out[i] = (raw, gone)
    return out


def test_op9_removes_later_bytes(docs, texts, none, way):
    got = rows(suffix.byte_digests(docs), "n_bytes", "n_removed", "n_spans", "kept_sha256")
    for i, (raw, gone) in brute_bytes(texts, 100).items():
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        assert got[i] == (len(raw), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(raw, np.uint8)[~gone].tobytes()).hexdigest())
    if way == "runs":
        new = suffix.without_repeats(docs)
        assert new.columns == docs.columns
        want = {i: np.frombuffer(raw, np.uint8)[~gone].tobytes().decode("utf-8", "ignore") for i, (raw, gone) in brute_bytes(texts, 100).items()}
        null = {i for i, t in texts if t is None}
        assert {r.doc_id: r.text for r in new.collect()} == {i: None if i in null else t for i, t in want.items()}
        assert suffix.byte_digests(none).count() == 0


def test_interval_expansion():
    rng = random.Random(5)
    for _ in range(60):
        length = rng.choice([5, 8, 12, 20])
        data = [bytes(rng.choice(b"ab\0") for _ in range(rng.randint(0, 60))) for _ in range(rng.randint(1, 8))]
        doc = np.array([rng.randint(0, 3) for _ in data])
        at = np.arange(len(data)) * 1000
        every = sorted((int(d), int(a) + k, x[k : k + length]) for x, d, a in zip(data, doc, at, strict=True) for k in range(len(x) - length + 1))
        first: dict = {}
        want = {(d, p) for d, p, s in every if first.setdefault(s, (d, p)) != (d, p)}
        d, p, n = suffix.later_windows(data, doc, at, length)
        assert {(int(x), int(y) + k) for x, y, m in zip(d, p, n, strict=True) for k in range(m)} == want


def test_long_texts_go_in_parts(monkeypatch):
    assert windows.parts(25, 5, size=10) == [(0, 14), (10, 24), (20, 25)]
    raw = np.frombuffer(("ab cde " * 4000).encode(), np.uint8)
    whole = windows.word_hashes(raw)
    monkeypatch.setattr(windows, "PART", 1000)
    assert (windows.word_hashes(raw) == whole).all()


def test_op8_fingerprints(docs, texts, none):
    got = rows(imatch.fingerprints(docs, low=0.0, high=0.5), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    order = sorted(texts)
    prints: dict[str, set] = {}
    for k, (i, t) in enumerate(order):
        t, after = t or "", order[(k + 1) % len(order)][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        assert got[i][:2] == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= got[i][4] <= 1 and 0 <= got[i][5] <= 1
        prints.setdefault(t, set()).add(got[i][2])
        if edited == t:
            assert got[i][4] == 1.0 and got[i][2] == got[i][3]
        if after == t:
            assert got[i][5] == 1.0
    assert all(len(p) == 1 for p in prints.values())
    assert len({min(p) for p in prints.values()}) > len(prints) * 0.6
    assert imatch.fingerprints(none).count() == 0


def chained(values, seed=42):
    """Spark's xxhash64 of these columns: strings, longs (int) and ints (one-element tuples)."""
    for v in values:
        raw = v.encode() if isinstance(v, str) else v[0].to_bytes(4, "little", signed=True) if isinstance(v, tuple) else v.to_bytes(8, "little", signed=True)
        seed = xxhash.xxh64(raw, seed=seed & (1 << 64) - 1).intdigest()
    return seed - (1 << 64) if seed >> 63 else seed


def brute_prints(texts, low, high):
    terms = lambda t: {w for w in regex.split(r"[^\p{L}\p{N}]+", t.lower()) if w}
    distinct = {t or "" for t in texts}
    frequency = Counter(w for t in distinct for w in terms(t))
    known = {chained([w]) for w, n in frequency.items() if max(1, int(low * len(distinct))) <= n <= max(2, int(high * len(distinct)))}
    subsets = {h: [d + imatch.SUBSETS * k for k, r in enumerate(imatch.RATES) if (d := chained([h, (k,)]) % r) < imatch.SUBSETS] for h in known}

    def fingerprint(t):
        words, found = terms(t), {}
        for h in sorted(chained([w]) for w in words):
            for s in subsets.get(h, []):
                found.setdefault(s, []).append(h)
        codes = sorted((s << 24) + chained(hs) % (1 << 24) for s, hs in found.items())
        if not codes and words:
            whole = chained(sorted(words | {""}, key=str.encode))
            codes = [(w << 24) + chained([whole, (w,)]) % (1 << 24) for w in imatch.WHOLE]
        return codes

    return fingerprint


@pytest.mark.parametrize("band", [(0.0, 0.5), (0.001, 0.1)])
@pytest.mark.parametrize("limit", [200_000, 0])
def test_op8_brute_force(spark, band, limit, monkeypatch):
    monkeypatch.setattr(imatch, "BROADCAST", limit)
    rng = random.Random(3)
    words = [f"w{k}" for k in range(400)]
    texts = [None, "", "...", "only"] + [" ".join(rng.choice(words) for _ in range(rng.randint(1, 90))) for _ in range(60)]
    texts += texts[10:20]
    fingerprint = brute_prints(texts, *band)
    code = lambda x: "".join(f"{c:08X}" for c in x)
    got = {r.doc_id: r for r in imatch.fingerprints(frame(spark, list(enumerate(texts))), *band).collect()}
    whole = [t or "" for t in texts]
    for i, t in enumerate(whole):
        after = whole[(i + 1) % len(whole)]
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (fingerprint(x) for x in (t, edited, after))
        assert (got[i].fingerprint, got[i].edited_fingerprint) == (code(a), code(b))

        def alike(x, y, same):
            either = {k >> 24 for k in x} | {k >> 24 for k in y}
            return float(same) if not either else 1.0 if x == y else len(set(x) & set(y)) / len(either)

        assert abs(got[i].near_edited - alike(a, b, t == edited)) < 1e-9 and abs(got[i].near_next - alike(a, c, t == after)) < 1e-9


def test_op8_tells_hot_groups_apart(spark):
    common = [f"common{k}" for k in range(9)]
    hot = " ".join(f"hot{k}" for k in range(40))
    turned = lambda k, words: " ".join(words[k % len(words) :] + words[: k % len(words)]) + "." * (k // len(words))
    texts = [hot] * 100
    texts += [turned(k, common[:8]) for k in range(40)] + [turned(k, common[1:]) for k in range(40)]
    texts += ["...", "!!!", "", None, ""]
    texts += [" ".join(f"own{k}x{w}" for w in range(30)) for k in range(115)]
    got = rows(imatch.fingerprints(frame(spark, list(enumerate(texts)))), "fingerprint", "near_edited", "near_next")
    assert len(texts) == 300 and {len(got[i][0]) > 0 for i in range(180)} == {True}
    assert len({got[i][0] for i in range(100)}) == 1 and {got[i][2] for i in range(99)} == {1.0}
    assert all(0 < got[i][1] < 1 for i in range(100)) and got[99][2] == 0
    assert len({got[i][0] for i in range(100, 140)}) == 1 and len({got[i][0] for i in range(140, 180)}) == 1
    assert got[138][2] == 1 and got[139][2] == 0 and got[179][2] == 0
    assert [got[i][0] for i in range(180, 185)] == [""] * 5
    assert [got[i][2] for i in range(180, 184)] == [0, 0, 1, 1]


def test_rows_without_id_and_repeated_rows(spark):
    table = frame(spark, [(1, "same text here"), (1, "same text here"), (2, "Same text here"), (None, "no id")])
    assert sorted(r.doc_id for r in exact.keep_distinct(table).where("doc_id is not null").collect()) == [2]
    for keep in (exact.keep_distinct, jaccard.keep_one_of_each, suffix.without_repeats):
        assert keep(table).where("doc_id is null").count() == 1
    assert jaccard.similar_groups(table).where("component_id = 1").count() == 3
    assert {r.n_removed for r in suffix.byte_digests(frame(spark, [(1, "z" * 60 + "y" * 60)] * 2)).collect()} == {0}


def test_repeated_ids_with_different_texts(spark):
    rng = random.Random(12)
    text = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(4)) for _ in range(n))
    x, y, z = text(80), text(80), text(80)
    table = frame(spark, [(1, x + " " + x), (1, y), (2, x), (2, z), (3, y + " tail"), (3, None), (3, "")])
    sha = lambda b: hashlib.sha256(b).hexdigest()
    many = lambda df, *c: sorted(tuple(r[k] for k in c) for r in df.collect())
    # parts of one document: x repeats within the first row of id 1 and in id 2, y in id 3
    got = many(suffix.byte_digests(table), "doc_id", "n_bytes", "n_removed")
    assert got == sorted([(1, 2 * len(x) + 1, len(x)), (1, len(y), 0), (2, len(x), len(x)), (2, len(z), 0), (3, len(y) + 5, len(y)), (3, 0, 0), (3, 0, 0)])
    words = many(substring.passage_digests(table), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert words == sorted([(1, 160, 0, sha(f"{x} {x}".encode())), (1, 80, 0, sha(y.encode())), (2, 80, 80, sha(b"")), (2, 80, 0, sha(z.encode())), (3, 81, 80, sha(b"tail")), (3, 0, 0, sha(b"")), (3, 0, 0, sha(b""))])
    # documents of their own
    like = jaccard.Likeness(3, 90, 100)
    assert many(jaccard.similar_groups(table, like), "doc_id", "n_shingles", "component_id") == [(1, 78, 1), (1, 80, 1), (2, 78, 1), (2, 78, 2), (3, 0, 3), (3, 0, 3), (3, 79, 1)]
    assert exact.exact_dedup(table).count() == 7 and imatch.fingerprints(table).count() == 7
    assert pieces.round_trip(table, PIECES).count() == 7 and langid.language_id(table).count() == 7
    assert sum(r.length for r in packing.pack(table, WORDS).collect()) == sum(r.doc_tokens for r in packing.pack(table, WORDS).where("start = 0").collect())


def test_texts_of_some_megabytes_and_clashing_columns(spark):
    rng = random.Random(13)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(5000)]
    long = " ".join(rng.choice(vocabulary) for _ in range(400_000))
    passage = " ".join(rng.choice(vocabulary) for _ in range(120))
    table = [(1, long), (2, long[:1_500_000] + " " + passage), (3, passage), (4, "q" * 300_000), (5, None)]
    clash = {c: F.lit(7) for c in ("gone", "key", "n", "text2", "__x", "part", "at", "base", "sig", "head", "group", "component", "old", "found")}
    docs = spark.createDataFrame(table, "doc_id long, text string").withColumns(clash)
    got = rows(suffix.byte_digests(docs), "n_bytes", "n_removed")
    assert got[1] == (len(long), 0) and got[3] == (len(passage), len(passage)) and got[2][1] >= 1_500_000 and got[4] == (300_000, 299_999)
    words = rows(substring.passage_digests(docs), "n_words", "n_removed")
    assert words[1] == (400_000, 0) and words[3] == (120, 120) and words[4] == (1, 0)
    groups = rows(jaccard.similar_groups(docs), "component_id")
    assert groups == {i: (i,) for i in range(1, 6)}
    assert {r.kept for r in exact.exact_dedup(docs).collect()} == {True}
    assert len(rows(langid.language_id(docs.withColumn("lang", F.lit("en"))), "lang_pred")) == 5
    labels = spark.createDataFrame([(1, 1), (3, 0)], "doc_id long, quality int")
    assert len(rows(quality.quality(docs, labels), "score")) == 5
    assert rows(imatch.fingerprints(docs), "n_chars")[1] == (len(long),)
    for keep in (exact.keep_distinct, jaccard.keep_one_of_each, suffix.without_repeats):
        assert keep(docs).columns == docs.columns and keep(docs).count() == 5
