"""Near-duplicate groups by circulant MinHash, confirmed on whole sets.

Two permutations give all coordinates of a signature. The first one, sigma, breaks up whatever structure the tokens have; the second one, pi, is
shifted circularly by k for the k-th coordinate: h_k = min over tokens of pi(sigma(token) + k). Both work on numbers of 32 bits, where a
shift is an addition that wraps around.

1. Equal sets are one set from here on, named by a 128-bit signature.
2. BANDS bands of WIDTH coordinates are hashed; sets that have a band in common lie in one bucket. At a similarity of 0.8 two sets miss each other
   in all of 48 bands of 5 with a probability of (1 - 0.8^5)^48 = 5e-9, and less above.
3. Only groups are asked for, so a bucket need not be compared pair by pair. In each bucket the set with the fewest rare tokens is the hub, of a
   family of near copies the one with the fewest changes. The others are compared with it. Sets that are in one group by now, through whatever bucket, need no
   comparison.
4. Sets of buckets that still hold several groups are told apart by their rarest tokens. If all tokens are put in one order, the rare ones first, and
   two sets link, the tokens that stand before their first common one are no more than |A| + |B| less twice the least overlap: (|A| + |B|) / 9 at
   0.8. So one of the two has that token among its first n / 8, the other among its first n / 4. Near misses around a text of their own, each with
   many changes of its own, have these changes there, and never meet. For those with few changes, numbers of tokens of 128 kinds are compared where they
   meet: the differences add up to no more than what one has and the other lacks. The sets at a token travel as blocks of BLOCK at most; tasks compare
   a block with a block, as arrays.
5. A pair is compared first by its coordinates, of which 8 bits are kept: those that agree in fewer than least_agreeing() of them are 6 standard
   deviations below the threshold. Whole sets are fetched and counted for the others."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import forget, ids_and_texts, look_up, saved, text_blocks
from .components import components
from .jaccard import Likeness, _lists, _names, fetch_sets, frequent_tokens, group_names, signature, with_both
from .windows import mix

BANDS, WIDTH = 48, 5
COORDINATES = BANDS * WIDTH
#: Tokens that are handled at once.
CHUNK = 1024
#: Kinds of tokens that are counted for step 4, by their remainder.
KINDS = 128
#: Sets of a token that are one row, in the mean; pairs of them that are compared at once.
BLOCK, PAIRS = 256, 8192
SIGMA = np.uint64(0x632BE59BD9B4E019)
SHIFTS = np.arange(COORDINATES, dtype=np.uint32)


def least_agreeing(like: Likeness) -> int:
    """Coordinates in which two sets that link agree at least, but for a chance of one in 10^9."""
    t = like.num / like.den
    return int(COORDINATES * t - 6 * (COORDINATES * t * (1 - t)) ** 0.5)


def pi(y: np.ndarray, spare: np.ndarray) -> None:
    """A permutation of the 32-bit numbers, in place: shifts and multiplications by odd numbers can all be undone."""
    for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
        np.right_shift(y, np.uint32(shift), out=spare)
        np.bitwise_xor(y, spare, out=y)
        np.multiply(y, np.uint32(factor), out=y)
    np.right_shift(y, np.uint32(16), out=spare)
    np.bitwise_xor(y, spare, out=y)


def coordinates(tokens: np.ndarray) -> np.ndarray:
    """h_0, h_1, ... of a set that isn't empty."""
    sigma = (mix(tokens ^ SIGMA) >> np.uint64(32)).astype(np.uint32)
    least = np.full(COORDINATES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(sigma), CHUNK):
        y = sigma[i : i + CHUNK, None] + SHIFTS
        pi(y, np.empty_like(y))
        np.minimum(least, y.min(axis=0), out=least)
    return least


def bands_of(least: np.ndarray) -> np.ndarray:
    """A 64-bit number for each band."""
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, WIDTH).T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column)
    return out


def signatures(texts: DataFrame, like: Likeness, hot: Broadcast) -> DataFrame:
    """(doc, n, rare, sig, bands, coords): size of each text's set, number of its tokens that aren't among the frequent ones, name, band numbers, and 8 bits of
    each coordinate; empty sets have no bands."""

    def rare(s: np.ndarray) -> int:
        token = hot.value[0]
        return len(s) - int(np.count_nonzero(token[np.minimum(np.searchsorted(token, s), len(token) - 1)] == s)) if len(token) else len(s)

    def emit(batches):
        for batch in text_blocks(batches, limit=1_500_000):
            sets = like.sets(batch.column(1))
            found = [coordinates(s) if len(s) else SHIFTS[:0] for s in sets]
            bands = _lists([bands_of(x) if len(x) else np.zeros(0, np.uint64) for x in found])
            coords = pa.array([x.astype(np.uint8).tobytes() for x in found], pa.binary())
            counts = [pa.array([f(s) for s in sets], pa.int32()) for f in (len, rare)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, pa.array([signature(s) for s in sets], pa.binary()), bands, coords], ["doc", "n", "rare", "sig", "bands", "coords"])

    return texts.mapInArrow(emit, "doc long, n int, rare int, sig binary, bands array<long>, coords binary")


def close(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """Those of the pairs (a, b) whose coordinates agree often enough."""
    least = least_agreeing(like)

    def agree(batches):
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(-1, COORDINATES) for k in (2, 3))
            yield batch.select(["a", "b"]).filter(pa.array((x == y).sum(axis=1) >= least))

    coords = sets.join(_names(pairs), "id", "left_semi").select("id", F.col("coords").alias("tokens"))
    return with_both(pairs, coords).select("a", "b", "x", "y").mapInArrow(agree, "a long, b long")


def confirmed(pairs: DataFrame, sets: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose whole sets link."""
    near = saved(close(pairs, sets, like), "close")
    whole = fetch_sets(texts, sets.join(_names(near), "id", "left_semi").select("id", "sig", F.col("first").alias("doc")), like)
    both, n, m = F.size(F.array_intersect("x", "y")), F.size("x"), F.size("y")
    links = saved(with_both(near, whole).where(like.den * both >= like.num * (n + m - both)).select("a", "b"), "links")
    forget(near, whole)
    return links


def rarest(texts: DataFrame, wanted: DataFrame, like: Likeness, hot: Broadcast) -> DataFrame:
    """(id, n, group, kinds, pos, token): the first tokens of the sets wanted (id, n, sig, first, group), those that are frequent in a sample
    behind all others; kinds counts the set's tokens by their remainders, a byte each."""

    def head(s: np.ndarray) -> np.ndarray:
        token, place = hot.value
        rank = np.zeros(len(s), np.int64)
        if len(token) and len(s):
            at = np.minimum(np.searchsorted(token, s), len(token) - 1)
            rank = np.where(token[at] == s, place[at], 0)
        return s[np.argsort(rank, kind="stable")][: len(s) * (like.den - like.num) // like.num + 1]

    def kinds(s: np.ndarray) -> bytes:
        return np.minimum(np.bincount((s % np.uint64(KINDS)).astype(np.int64), minlength=KINDS), 255).astype(np.uint8).tobytes()

    def emit(batches):
        for batch in text_blocks(batches, limit=1_500_000):
            sets = like.sets(batch.column(1))
            columns = [pa.array([signature(s) for s in sets], pa.binary()), pa.array([kinds(s) for s in sets], pa.binary()), _lists([head(s) for s in sets])]
            yield pa.RecordBatch.from_arrays(columns, ["sig", "kinds", "head"])

    found = texts.join(wanted.select("first").distinct(), F.col("doc_id") == F.col("first"), "left_semi").mapInArrow(emit, "sig binary, kinds binary, head array<long>").dropDuplicates(["sig"])
    return found.join(wanted, "sig").select("id", "n", "group", "kinds", F.posexplode("head").alias("pos", "token"))


def blocks_of(tokens: DataFrame) -> DataFrame:
    """(token, parts, part, block): rows (id, n, group, kinds, pos, token) of the tokens that sets of several groups have, in blocks of about BLOCK rows."""
    several = tokens.groupBy("token").agg(F.min("group").alias("g"), F.max("group").alias("h"), F.count("*").alias("size")).where("g != h")
    rows = tokens.join(several.select("token", F.ceil(F.col("size") / BLOCK).cast("int").alias("parts")), "token")
    return rows.groupBy("token", "parts", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part")).agg(F.collect_list(F.struct("id", "n", "group", "kinds", "pos")).alias("block"))


def meetings(blocks: DataFrame, like: Likeness) -> DataFrame:
    """(a, b), a < b: the sets of different groups that meet at a token early enough to link, as far as two bounds of the tokens that one has and the other
    lacks tell: those before the common one, and by how much counts of any kind differ. A pair may come once for each token."""
    most, of = like.den - like.num, like.den + like.num

    def arrays(column: pa.Array) -> tuple[list[int], list[np.ndarray]]:
        flat = column.flatten()
        bounds = np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))]).tolist()
        numbers = [flat.field(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in ("id", "n", "group", "pos")]
        return bounds, [*numbers, np.frombuffer(b"".join(flat.field("kinds").to_pylist()), np.uint8).reshape(-1, KINDS)]

    def meet(x: list[np.ndarray], y: list[np.ndarray]):
        early = np.flatnonzero(2 * like.num * x[3] <= most * x[1])
        (a, n, g, p), (b, m, h, q) = ([v[early, None] for v in x[:4]], y[:4])
        fit = (g != h) & (p <= q) & (of * (p + q) <= most * (n + m)) & (like.den * np.minimum(n, m) >= like.num * np.maximum(n, m))
        left, right = np.nonzero(fit)
        left = early[left]
        for k in range(0, len(left), PAIRS):
            i, j = left[k : k + PAIRS], right[k : k + PAIRS]
            differ = np.abs(x[4][i].astype(np.int16) - y[4][j]).sum(axis=1, dtype=np.int64)
            near = of * differ <= most * (x[1][i] + y[1][j])
            yield x[0][i[near]], y[0][j[near]]

    def emit(batches):
        for batch in batches:
            (at, x), (to, y) = arrays(batch.column(0)), arrays(batch.column(1))
            found, held = [], 0
            for r in range(batch.num_rows):
                one = [v[at[r] : at[r + 1]] for v in x]
                other = [v[to[r] : to[r + 1]] for v in y] if to[r] < to[r + 1] else one
                for a, b in meet(one, other):
                    found.append(np.stack([np.minimum(a, b), np.maximum(a, b)]))
                    held += len(a)
                if found and (held > 1_000_000 or r == batch.num_rows - 1):
                    pair = np.unique(np.concatenate(found, axis=1), axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], ["a", "b"])
                    found, held = [], 0

    # a token's only block meets itself; of several each meets each, in as many rows
    alone = blocks.where("parts = 1").select(F.col("block").alias("x"), F.slice("block", 1, 0).alias("y"))
    many = blocks.where("parts > 1").withColumn("with", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    ones = many.select("token", F.col("part").alias("i"), F.col("with").alias("j"), F.col("block").alias("x"))
    others = many.select("token", F.col("with").alias("i"), F.col("part").alias("j"), F.col("block").alias("y"))
    return alone.unionByName(ones.join(others, ["token", "i", "j"]).select("x", "y")).mapInArrow(emit, "a long, b long")


def similar_by_minhash(docs: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sets, links) as jaccard.similar has them: links join all sets that link, directly or through others."""
    texts = ids_and_texts(docs)
    hot = texts.sparkSession.sparkContext.broadcast(frequent_tokens(texts, like))
    found = saved(signatures(texts, like, hot), "signatures")
    rows = saved(found.select("doc", "n", "sig"), "rows")
    one = [F.first(c).alias(c) for c in ("n", "rare", "bands", "coords")]
    # copies are counted before the shuffle
    sets = saved(found.where("n > 0").groupBy("sig").agg(F.min("doc").alias("first"), F.count("*").alias("copies"), *one).withColumn("id", F.monotonically_increasing_id()), "distinct")
    forget(found)

    entries = sets.select(F.explode("bands").alias("key"), "id", "n", "rare")
    hubs = entries.groupBy("key").agg(F.count("*").alias("size"), F.min(F.struct("rare", F.xxhash64("id").alias("draw"), "id", "n")).alias("hub")).where("size > 1")
    hubs = saved(hubs.select("key", "size", F.col("hub.id").alias("b"), F.col("hub.n").alias("m")), "hubs")
    others = saved(look_up(entries, "key", hubs, "size", how="inner").where("id != b"), "others")
    pair = [F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b")]
    asked = saved(others.where(like.sizes_fit(F.col("n"), F.col("m"))).select(*pair).distinct(), "pairs")
    links = confirmed(asked, sets, texts, like)

    groups = components(links).withColumnRenamed("node", "id")
    there = others.where("size > 2").select("key", "id").join(groups, "id", "left").select("key", "id", F.coalesce("component", "id").alias("group"))
    mixed = there.groupBy("key").agg(F.min("group").alias("g"), F.max("group").alias("h")).where("g != h").select("key")
    open_sets = there.join(mixed, "key", "left_semi").select("id", "group").distinct()
    wanted = saved(sets.select("id", "n", "sig", "first").join(open_sets, "id"), "open")
    tokens = saved(rarest(texts, wanted, like, hot), "rarest")
    blocks = saved(blocks_of(tokens), "blocks")
    met = meetings(blocks, like).distinct()
    more = saved(met.join(asked, ["a", "b"], "left_anti"), "pairs")
    forget(hubs, others, tokens, blocks)
    links = links.unionByName(confirmed(more, sets, texts, like))
    return rows, sets, links


def near_duplicates(docs: DataFrame, like: Likeness = Likeness(4, 80, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): component_id is the least doc_id that links reach, a document's own where it has none; kept, whether that
    is the document itself.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A null text, or one without words, has the empty set and links with nothing, so it is kept. Each row
    is a document of its own: rows that repeat a doc_id have each their own text's set and group. Other columns are never read; an empty table gives no
    rows. Tokens are 64-bit hashes of shingles."""
    return group_names(*similar_by_minhash(docs, like)).withColumn("kept", F.col("doc_id") == F.col("component_id"))


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') as words from documents where doc_id is not null
), s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 4 then [array_to_string(words, ' ')] else list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) end as shingles from w
), e as (select doc_id, len(shingles) as n, unnest(shingles) as g from s),
pairs as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), sym as (select a, b from pairs union all select b, a from pairs),
reach as (select doc_id as node, doc_id as seen from s union select node, b from reach join sym on a = seen)
select s.doc_id, cast(len(shingles) as bigint) as n_shingles, min(seen) as component_id, s.doc_id = min(seen) as kept from s join reach on node = s.doc_id group by s.doc_id, shingles
"""
