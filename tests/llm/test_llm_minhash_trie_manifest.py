"""Circulant MinHash, the prefix trie and the Merkle manifest against brute force: nulls, empty and long texts, ties, repeats, hot groups, clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("graphloom.llm")
from graphloom.llm import manifest, minhash, prefixtrie
from graphloom.llm.jaccard import Likeness

NAMES = ("place", "size", "tree", "key", "rows", "digest", "changed", "level", "lo", "steps", "a", "b", "pa", "depth", "length", "h", "n", "sig", "group", "hub", "__at", "__range", "__stood")


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in NAMES})


# -- circulant MinHash -----------------------------------------------------------------------------------------------------------------------


def shingle_set(text, like):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + like.words]) for i in range(max(1, len(words) - like.words + 1))} if words else set()


def groups_by_brute_force(table, like):
    sets = [shingle_set(t, like) for _, t in table]
    of = list(range(len(table)))

    def find(i):
        while of[i] != i:
            of[i] = of[of[i]]
            i = of[i]
        return i

    for i, x in enumerate(sets):
        for j in range(i):
            if x and sets[j] and like.den * len(x & sets[j]) >= like.num * len(x | sets[j]):
                of[find(i)] = find(j)
    least = {}
    for i, (doc, _) in enumerate(table):
        least[find(i)] = min(doc, least.get(find(i), doc))
    return sorted((doc, len(sets[i]), least[find(i)], doc == least[find(i)]) for i, (doc, _) in enumerate(table))


def near_texts(seed, families, size):
    """Families around a text that is nowhere itself, a few words of which each member has changed: links, near misses and chains."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgé") for _ in range(rng.randint(2, 6)))
    texts = [None, "", " \t\n", "One", "one", "two words", "TWO  words", "a b c d", "a b c d e", "x " * 500, "word " * 3 + "x"]
    for _ in range(families):
        middle = [word() for _ in range(rng.randint(12, 90))]
        for _ in range(size):
            text = list(middle)
            for _ in range(rng.randint(0, max(2, len(text) // 12))):
                text[rng.randrange(len(text))] = word()
            texts += [" ".join(text)] * rng.choice([1, 1, 2])
    ids = list(range(3, 3 + 2 * len(texts), 2))
    rng.shuffle(ids)
    return list(zip(ids, texts, strict=True))


@pytest.mark.parametrize("like", [Likeness(4, 80, 100), Likeness(1, 90, 100)])
def test_op11_loses_no_link(spark, like):
    table = near_texts(like.words, 8, 12)
    docs = clashing(spark.createDataFrame(table, "doc_id long, text string"))
    got = [tuple(r) for r in minhash.near_duplicates(docs, like).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got) == groups_by_brute_force(table, like)


def test_op11_repeated_ids_empty_tables_and_long_texts(spark):
    rng = random.Random(4)
    long = " ".join(str(rng.randrange(5000)) for _ in range(60_000))
    table = [(1, "a b c d e"), (1, "other words of this id"), (2, "A B C D E"), (2, None), (9, long), (4, long[:-200]), (5, long[: len(long) // 2]), (7, "")]
    docs = spark.createDataFrame(table, "doc_id long, text string")
    got = sorted(tuple(r) for r in minhash.near_duplicates(docs).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == groups_by_brute_force(table, Likeness(4, 80, 100))
    assert minhash.near_duplicates(docs.where("false")).count() == 0
    assert minhash.near_duplicates(docs.where("text = ''")).count() == 1


def test_op11_tells_near_misses_apart_without_pairs(spark, monkeypatch):
    """Copies of a text that isn't there, each with changes of its own: all meet in buckets, hardly any is a candidate."""
    rng = random.Random(8)
    middle = [f"w{k}" for k in range(60)]
    texts = []
    for k in range(400):
        words = list(middle)
        for j, spot in enumerate(rng.sample(range(60), 3)):
            words[spot] = f"own{k}-{j}"
        texts.append((k, " ".join(words)))
    texts += [(1000 + k, t.replace("w", "W", 1) + " tail") for k, t in texts[:20]]
    asked = []
    plain = minhash.confirmed
    monkeypatch.setattr(minhash, "confirmed", lambda pairs, *rest: asked.append(pairs.count()) or plain(pairs, *rest))
    like = Likeness(4, 80, 100)
    got = sorted(tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), like).select("doc_id", "n_shingles", "component_id", "kept").collect())
    assert got == groups_by_brute_force(texts, like) and len({r[2] for r in got}) < 420
    assert sum(asked) < 20_000 and asked[1] < 2_000  # of 88 000 pairs


@pytest.mark.parametrize("block", [3, 1000])
def test_op11_meetings_in_blocks(spark, block, monkeypatch):
    """Pairs at their tokens by definition, however the sets of a token are cut into blocks; frequent tokens come as blocks, not as pairs of rows."""
    monkeypatch.setattr(minhash, "BLOCK", block)
    monkeypatch.setattr(minhash, "PAIRS", 5)
    rng, like, rows, sets = random.Random(6), Likeness(4, 80, 100), [], {}
    for k in range(40):
        own = [x for x in range(200, 260) if rng.random() < 0.92] + [1000 * k + j + 1000 for j in range(rng.randint(0, 9))]
        sets[k] = (own, k % 5 if k < 25 else 100 + k)
        kinds = np.bincount(np.array(own) % minhash.KINDS, minlength=minhash.KINDS).astype(np.uint8).tobytes()
        rows += [(k, len(own), sets[k][1], bytearray(kinds), j, x) for j, x in enumerate(sorted(own, key=lambda x: (x < 1000, x))[: len(own) // 4 + 1])]
    heads, want = {(r[0], r[5]): r[4] for r in rows}, set()
    for (a, token), p in heads.items():
        for b in sets:
            (x, g), (y, h), q = sets[a], sets[b], heads.get((b, token))
            if q is None or g == h or not (8 * p <= len(x) and p <= q and 9 * (p + q) <= len(x) + len(y) and 5 * min(len(x), len(y)) >= 4 * max(len(x), len(y))):
                continue
            count = lambda s: np.bincount(np.array(s) % minhash.KINDS, minlength=minhash.KINDS)
            if 9 * np.abs(count(x) - count(y)).sum() <= len(x) + len(y):
                want.add((min(a, b), max(a, b)))
    df = spark.createDataFrame(rows, "id long, n int, group long, kinds binary, pos int, token long")
    blocks = minhash.blocks_of(df)
    assert max(len(r.block) for r in blocks.collect()) <= 40 and sum(len(r.block) for r in blocks.collect()) <= len(rows)
    got = [tuple(r) for r in minhash.meetings(blocks, like).distinct().collect()]
    assert sorted(got) == sorted(want) and 50 < len(want) < 780
    linked = {(a, b) for a in sets for b in sets if a < b and sets[a][1] != sets[b][1] and like.den * len(set(sets[a][0]) & set(sets[b][0])) >= like.num * len(set(sets[a][0]) | set(sets[b][0]))}
    assert linked and linked <= want


@pytest.mark.parametrize("block", [4])
def test_op11_loses_no_link_in_small_blocks(spark, block, monkeypatch):
    monkeypatch.setattr(minhash, "BLOCK", block)
    table = near_texts(21, 3, 40)
    got = [tuple(r) for r in minhash.near_duplicates(spark.createDataFrame(table, "doc_id long, text string")).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got) == groups_by_brute_force(table, Likeness(4, 80, 100))


def test_coordinates_by_definition():
    tokens = np.random.Generator(np.random.PCG64(3)).integers(0, 1 << 63, 3000, dtype=np.uint64)

    def pi(x):
        for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1)):
            x = (x ^ (x >> shift)) * factor & 0xFFFFFFFF
        return x

    sigma = (minhash.mix(tokens ^ minhash.SIGMA) >> np.uint64(32)).tolist()
    got = minhash.coordinates(tokens)
    for k in (0, 1, 77, minhash.COORDINATES - 1):
        assert got[k] == min(pi((s + k) & 0xFFFFFFFF) for s in sigma)
    # the share of equal coordinates is the similarity, and bands of unlike sets differ
    other = minhash.coordinates(np.concatenate([tokens[:2700], tokens[:300] + np.uint64(1)]))
    assert abs((got == other).mean() - 2700 / 3300) < 0.1
    assert (minhash.bands_of(got) == minhash.bands_of(other)).any() and len(set(minhash.bands_of(got).tolist())) == minhash.BANDS


# -- prefix trie -----------------------------------------------------------------------------------------------------------------------------

TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_by_brute_force(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            said = (role or "", text or "")
            tie = hashlib.sha256(f"{len(said[0].encode())}:{said[0]}{said[1]}".encode()).hexdigest()[:32]
            turns.setdefault(c, []).append((turn is not None, turn or 0, tie, said))
    said = {c: [t[3] for t in sorted(v)] for c, v in turns.items()}
    whole = {}
    for c in said:
        h = zlib.crc32(str(c).encode()) % 9
        whole[c] = tuple(said.get(c - c % 5, [])[:h] + said[c][h:])
    members, kids, leaves, saves = {}, {}, {}, {}
    for c, s in whole.items():
        for d in range(len(s) + 1):
            members.setdefault(s[:d], []).append(c)
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[k] for k in kids.get(p, [])) or 1
        saves[p] = sum(saves[k] for k in kids.get(p, [])) + ((len(members[p]) - 1) * len(p[-1][1].encode()) if p else 0)
    sha = lambda p, m: hashlib.sha256(",".join(map(str, sorted(c for c in m if len(whole[c]) == len(p)))).encode()).hexdigest()
    return sorted(((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), len(kids.get(p, [])), leaves[p], saves[p], sha(p, m)) for p, m in members.items()), key=str)


def conversations(seed, n):
    """Shared openings, copies, forks, nulls, turns that repeat, conversations with no turn left."""
    rng = random.Random(seed)
    opening, rows = [("system", "be brief é"), ("user", "hi"), (None, None), ("user", "hi")], []
    for c in rng.sample(range(4 * n), n):
        kind, length = rng.randrange(5), rng.randint(1, 11)
        if kind == 0:
            turns = [(rng.choice(["user", "assistant", None]), rng.choice(["a", "b", None, "long text " * 9])) for _ in range(length)]
        elif kind == 1:
            turns = (opening * 3)[:length]
        else:
            turns = opening[: rng.randint(0, 4)] + [("user", rng.choice("xyz"))] * (length % 3) + [("user", str(rng.randrange(3 * n)))]
        order = [None if k == 0 and kind == 1 else k // (2 if kind == 0 else 1) for k in range(len(turns))]
        rows += [(c, k, *t) for k, t in zip(order, turns, strict=True)]
    rng.shuffle(rows)
    return [*rows, *rows[:5], (None, 1, "user", "no id")]


@pytest.mark.parametrize(("cells", "block", "held", "piece"), [(1 << 28, 4096, 1_000_000, 1_000_000), (1 << 16, 2, 7, 10), (8, 3, 50, 1)])
def test_op12_is_the_trie(spark, cells, block, held, piece, monkeypatch):
    for name, value in (("CELLS", cells), ("BLOCK", block), ("HELD", held), ("PIECE", piece), ("CELL_BLOCK", min(cells, 1 << 16))):
        monkeypatch.setattr(prefixtrie, name, value)
    table = conversations(block, 90)
    df = clashing(spark.createDataFrame(table, "conv_id long, turn long, role string, text string"))
    assert sorted((tuple(r) for r in prefixtrie.prefix_trie(df).select(*TRIE).collect()), key=str) == trie_by_brute_force(table)


def test_op12_hot_copies_one_long_conversation_and_none(spark, monkeypatch):
    monkeypatch.setattr(prefixtrie, "BLOCK", 64)
    rows = [(c, k, "user", f"turn {k}") for c in range(700) for k in range(2)] + [(c, k, "user", f"word {k % 7}") for c in (5000, 5001) for k in range(700)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted((tuple(r) for r in prefixtrie.prefix_trie(df).select(*TRIE).collect()), key=str) == trie_by_brute_force(rows)
    assert prefixtrie.prefix_trie(df.where("false")).count() == 0
    one = prefixtrie.prefix_trie(df.where("conv_id = 3 and turn = 0")).collect()
    assert sorted((r.depth, r.n_convs) for r in one) == [(0, 1)] + [(1, 1)] * (zlib.crc32(b"3") % 9 == 0)


def test_estimates_are_never_below_the_count(spark):
    rng = np.random.Generator(np.random.PCG64(5))
    keys = rng.integers(-(1 << 62), 1 << 62, (5000, 2))
    twice = np.concatenate([keys, keys[:700]])
    df = spark.createDataFrame([tuple(map(int, r)) for r in twice], "a long, b long").repartition(4)
    sketch = prefixtrie.count_prefixes(df, len(twice))
    several = sketch.several(keys[:, 0].copy(), keys[:, 1].copy())
    assert several[:700].all() and several[700:].mean() < 0.02
    assert [prefixtrie.Sketch.width_for(n) for n in (0, 1 << 14, 1 << 40)] == [1 << 16, 1 << 17, 1 << 28]


# -- Merkle manifest -------------------------------------------------------------------------------------------------------------------------

MANIFEST = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest_by_brute_force(rows):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf = lambda r: digest(*[field(r[k]) for k in (0, 3, 2, 4, 1)])

    def levels(found):
        out = [list(found)]
        while len(out[-1]) > 1:
            out.append([digest(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
        return out

    def way(tree, i):
        for level in tree[:-1]:
            yield level[i // 3 * 3 : i], level[i + 1 : i // 3 * 3 + 3]
            i //= 3

    sources = {}
    for r in sorted(rows, key=lambda r: (r[3] is not None, (r[3] or "").encode(), r[0] is not None, r[0] or 0, leaf(r))):
        sources.setdefault(r[3], []).append(r)
    trees = [levels(map(leaf, v)) for v in sources.values()]
    top, out = levels([t[-1][0] for t in trees]), []
    for k, v in enumerate(sources.values()):
        for i, r in enumerate(v):
            steps = [*way(trees[k], i), *way(top, k)]
            cut = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 2 == 0 and r[1] is not None
            now = leaf((r[0], r[1].replace("\n", ""), *r[2:])) if cut else leaf(r)
            for left, right in steps:
                now = digest(*left, now, *right)
            out.append((r[0], leaf(r), trees[k][-1][0], top[-1][0], digest(*[x for a, b in steps for x in a + b]), now, now == top[-1][0]))
    return sorted(out, key=str)


def documents(n, seed=7):
    rng = random.Random(seed)
    source = lambda: rng.choice(["hot", "hot", "hot", None, "", "é", "z", "Z", *[f"s{k}" for k in range(30)]])
    text = lambda: rng.choice([None, "", "a\nb", "\n", "ünï\ncode", "plain", "x\n" * 500])
    return [(rng.choice([i, i, i, None, i // 2]), text(), rng.choice([None, "en", ""]), source(), rng.choice([None, 0, -4, 12])) for i in range(n)]


@pytest.mark.parametrize(("n", "levels"), [(0, 6), (1, 6), (4, 6), (1500, 2), (800, 6)])
def test_op13_is_the_manifest(spark, n, levels, monkeypatch):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    table = documents(n)
    table += table[: n // 30]
    df = clashing(spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long"))
    assert sorted((tuple(r) for r in manifest.tamper_check(df).select(*MANIFEST).collect()), key=str) == manifest_by_brute_force(table)


def test_op13_untampered_rows_and_texts_of_some_megabytes(spark):
    table = [(i, "line\n" * 300_000 if i < 2 else f"text {i}", "en", "one", None) for i in range(10)]
    df = spark.createDataFrame(table, "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.verified for r in manifest.manifest(df).collect()} == {True}
    assert sorted((tuple(r) for r in manifest.tamper_check(df).select(*MANIFEST).collect()), key=str) == manifest_by_brute_force(table)


# -- SQL -------------------------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_minhash", "op12_prefix_trie", "op13_merkle"])
def test_sql_gives_the_query_s_rows(spark, name):
    import duckdb
    from graphloom.llm import queries

    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.execute(f"create view {t} as select * from '{folder}/{t}.parquet'")
    found = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in found.description]
    df = queries.queries()[name](spark, folder)
    assert sorted(df.columns) == sorted(names)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted(found.fetchall(), key=str)
