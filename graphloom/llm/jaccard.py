"""Join of documents whose n-gram sets are alike, by groups and their token unions.

A document's tokens are hashes of its distinct word n-grams. In any fixed order of tokens, two sets with Jaccard similarity t share one of each
other's first n - ceil(t n) + 1 tokens; rare tokens come first, so that few documents meet by chance.

1. Equal sets are one set from here on, named by a 128-bit signature.
2. Partition: of all sets with a token in their prefix and about the same size, the one with the fewest rarer tokens before it is the token's hub: of
   a family of near copies, the one with the fewest words of its own. The others are compared with it. Links found make groups of similar documents: as
   many comparisons as prefix tokens, however large a group is.
3. What may still link lies in different groups that share a prefix token. The token-group matrix has a row for each group and token of its
   members' heads: the groups' unions, never held in one place. A query has a row for each token of its head; the rows that meet are counted for each
   query and group, and a group with too few has no member that links with the query. A group of one document is its own union.
4. Only groups that pass are opened: the query is compared with the members that it shares a prefix token with.

Unrelated sets that share a prefix token by chance grow with the square of the input, so pairs first meet by a few words of parity bits: the bits that
differ are no more than the tokens that only one of the sets has. Only pairs that may link by these have their heads fetched.

A head is the prefix and n / 10 tokens more. Sets that link have heads with n / 10 tokens in common, n of the smaller (with fewer, the first
common token of the rest would come too late for t n in all), so heads decide almost every candidate; whole sets are fetched for the others."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, ids_and_texts, lean, look_up, saved, text_blocks
from .components import components
from .windows import Sums, mix, parts, words_of

#: Tokens in at least this share of a sample of documents (1 of SAMPLE, FEWEST at least) come after all others, by frequency. There are fewer of
#: them than the mean number of tokens divided by the share. They decide the order only, so any sample gives right results.
HOT_SHARE, SAMPLE, FEWEST = 1 / 2000, 32, 4
#: Tokens for each word of parity bits: of unrelated sets half of the bits differ, many more than linked ones may have.
PER_WORD = 100
#: Words of the filter that keeps unwanted rows out of shuffles, at most.
SCREEN = 1 << 20


@dataclass(frozen=True)
class Likeness:
    """words: of a shingle; two sets link when den * |both| >= num * |either|."""

    words: int = 3
    num: int = 90
    den: int = 100

    def least(self, n: np.ndarray) -> np.ndarray:
        """ceil(t n): tokens of a set of n that any set linked with it has too."""
        return -(-self.num * n // self.den)

    def more(self, n):
        """Tokens that heads of linked sets have in common, at least; of numbers, arrays or columns of sizes."""
        return F.floor((n + 9) / 10) if isinstance(n, Column) else (n + 9) // 10

    def sets(self, column: pa.Array) -> list[np.ndarray]:
        """The sorted distinct tokens of each text; a text of fewer words than a shingle has one token, one without words none."""
        text = pc.ascii_lower(pc.fill_null(column, ""))
        words, bounds = words_of(text)
        out = []
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            n = b - a
            if n > self.words:
                got = [self._shingles(words[a + s : a + e]) for s, e in parts(n, self.words)]
                out.append(np.unique(got[0] if len(got) == 1 else np.concatenate(got)))
            else:
                whole = Sums(words[a:b]).of(np.zeros(1, np.int64), np.full(1, n)) if n else np.zeros(0, np.uint64)
                out.append(mix(whole + np.uint64(n)))
        return out

    def _shingles(self, words: np.ndarray) -> np.ndarray:
        return mix(Sums(words).grams(self.words) + np.uint64(self.words))

    def linked(self, both: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        return self.den * both >= self.num * (n + m - both)

    # the same as columns
    def sizes_fit(self, n: Column, m: Column) -> Column:
        return self.den * F.least(n, m) >= self.num * F.greatest(n, m)

    def needs(self, n: Column, m: Column) -> Column:
        """|both| of sets of n and m tokens that link, at least."""
        return F.ceil(F.lit(self.num) * (n + m) / float(self.num + self.den) - 1e-9)

    def band(self, n: Column) -> Column:
        """Sizes that may link lie in the same band or in neighbouring ones."""
        return F.floor(F.log(n.cast("double")) / math.log(self.den / self.num) + 1e-9).cast("int")

    def bands(self, n: Column, p: Column) -> Column:
        """The bands of all sizes m of sets that link with one of n tokens, if its first token in common is at place p: of the n - p that are left
        there are needs(n, m) in common, so the later the token, the smaller is the largest m."""
        low = F.ceil(F.lit(self.num) * n / float(self.den) - 1e-9)
        high = F.floor(F.lit(self.num + self.den) * (n - p) / float(self.num) - n + 1e-9)
        return F.sequence(self.band(low), self.band(F.greatest(low, high)))


def frequent_tokens(texts: DataFrame, like: Likeness) -> tuple[np.ndarray, np.ndarray]:
    """(tokens ascending, place of each in the order by frequency) of the tokens that are frequent in a sample."""
    sample = texts.where(F.pmod(F.xxhash64("doc_id"), F.lit(SAMPLE)) == 0)

    def tokens(batches):
        for batch in text_blocks(batches, limit=1_500_000):
            every = np.concatenate([*like.sets(batch.column(1)), np.zeros(0, np.uint64)])
            token, count = np.unique(every, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(count)], ["token", "n"])

    least = max(FEWEST, int(sample.count() * HOT_SHARE))
    found = sample.mapInArrow(lean(tokens), "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    rows = found.toArrow()
    token, count = rows["token"].to_numpy().view(np.uint64), rows["n"].to_numpy()
    place = np.empty(len(token), np.int64)
    place[np.lexsort((token, count))] = np.arange(1, len(token) + 1)
    order = np.argsort(token)
    return token[order], place[order]


def signature(tokens: np.ndarray) -> bytes:
    return np.array([mix(tokens).sum(dtype=np.uint64), mix(tokens ^ np.uint64(0xA5A5A5A5A5A5A5A5)).sum(dtype=np.uint64)]).tobytes()


def parity(tokens: np.ndarray) -> np.ndarray:
    """A bit for each remainder of the tokens' hashes: whether an odd number of tokens has it. The number of words is a power of two."""
    size = 64 << max(0, math.ceil(math.log2(max(1, len(tokens)) / PER_WORD)))
    odd = np.bincount((mix(tokens ^ np.uint64(0x3C6EF372FE94F82A)) & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def differing(x: str, y: str) -> Column:
    """Bits in which the parities x and y differ: at most the number of tokens that only one of the sets has. A longer one is folded to the length
    of the other; 0 where it is more than twice as long."""
    short = F.least(F.size(x), F.size(y))
    folded = lambda v: F.when(F.size(v) > short, F.zip_with(F.slice(v, F.lit(1), short), F.slice(v, short + 1, short), lambda p, q: p.bitwiseXOR(q))).otherwise(F.col(v))
    bits = F.aggregate(F.zip_with(folded(x), folded(y), lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, n: total + n)
    return F.when(F.greatest(F.size(x), F.size(y)) <= 2 * short, bits).otherwise(0)


def _lists(rows: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*rows, np.zeros(0, np.uint64)]).view(np.int64)))


def prefixes(texts: DataFrame, like: Likeness) -> DataFrame:
    """(doc, n, sig, bits, head): size, signature and parity bits of each text's set, and its first tokens in order."""
    hot = texts.sparkSession.sparkContext.broadcast(frequent_tokens(texts, like))

    def first(s: np.ndarray) -> np.ndarray:
        token, place = hot.value
        n = len(s)
        if not n:
            return s
        rank = np.zeros(n, np.int64)
        if len(token):
            at = np.minimum(np.searchsorted(token, s), len(token) - 1)
            rank = np.where(token[at] == s, place[at], 0)
        return s[np.argsort(rank, kind="stable")][: n - int(like.least(n)) + int(like.more(n))]

    def emit(batches):
        for batch in text_blocks(batches, limit=1_500_000):
            sets = like.sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int32()), pa.array([signature(s) for s in sets], pa.binary()), _lists([parity(s) for s in sets]), _lists([first(s) for s in sets])], ["doc", "n", "sig", "bits", "head"])

    return texts.mapInArrow(lean(emit), "doc long, n int, sig binary, bits array<long>, head array<long>")


def fetch_sets(texts: DataFrame, wanted: DataFrame, like: Likeness) -> DataFrame:
    """(id, tokens) of the wanted sets (id, sig, doc), each once; doc is the id of a text that has the set."""

    def emit(batches):
        for batch in text_blocks(batches, limit=1_500_000):
            sets = like.sets(batch.column(1))
            yield pa.RecordBatch.from_arrays([pa.array([signature(s) for s in sets], pa.binary()), _lists(sets)], ["sig", "tokens"])

    found = texts.join(wanted.select("doc").distinct(), F.col("doc_id") == F.col("doc"), "left_semi").dropDuplicates(["doc_id", "text"])
    return saved(found.mapInArrow(lean(emit), "sig binary, tokens array<long>").join(wanted, "sig").dropDuplicates(["sig"]).select("id", "tokens"), "sets")


def with_both(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b, ...) with x, y: what sets (id, tokens) has for a and for b."""
    return pairs.join(sets.select(F.col("id").alias("a"), F.col("tokens").alias("x")), "a").join(sets.select(F.col("id").alias("b"), F.col("tokens").alias("y")), "b")


def screened(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """rows whose key may be among wanted (key), before the join that decides: rows that are not wanted stay out of its shuffle, but for a few in a hundred.

    A Bloom filter of one 64-bit word and four of its bits for each key, as rows that are broadcast: a word for eight keys, SCREEN words at most. With more
    keys than these can tell apart more rows pass, and none is lost."""
    words = max(1, min(wanted.count() // 8, SCREEN))
    word = F.expr(f"pmod(xxhash64({key}), {words}L)")
    mask = F.expr(" | ".join(f"shiftleft(1L, cast(shiftright(xxhash64({key}, 1), {6 * k}) & 63 as int))" for k in range(4)))
    filled = wanted.select(word.alias("__word"), mask.alias("__mask")).groupBy("__word").agg(F.bit_or("__mask").alias("__bits"))
    return rows.join(F.broadcast(filled), (word == F.col("__word")) & (F.col("__bits").bitwiseAND(mask) == mask), "left_semi")


def _names(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct()


def verified(pairs: DataFrame, sets: DataFrame, texts: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b, n, m) that link: those that may by their parity bits, and whose heads have enough in common, are compared by their whole sets."""
    both = F.size(F.array_intersect("x", "y"))
    n, m = F.col("n"), F.col("m")
    pairs = saved(with_both(pairs, sets.select("id", F.col("bits").alias("tokens"))).where(differing("x", "y") <= n + m - 2 * like.needs(n, m)).select("a", "b", "n", "m"), "near")
    heads = screened(sets, "id", _names(pairs)).join(_names(pairs), "id", "left_semi").select("id", F.col("head").alias("tokens"))
    close = saved(with_both(pairs, heads).where(both >= like.more(F.least("n", "m"))).select("a", "b"), "close")
    wanted = saved(screened(sets, "id", _names(close)).join(_names(close), "id", "left_semi").select("id", "sig", F.col("first").alias("doc")), "wanted")
    whole = fetch_sets(screened(texts, "doc_id", wanted.select(F.col("doc").alias("doc_id"))), wanted, like)
    found = with_both(close, whole).select("a", "b", F.size("x").alias("n"), F.size("y").alias("m"), both.alias("both"))
    links = saved(found.where(like.den * F.col("both") >= like.num * (F.col("n") + F.col("m") - F.col("both"))).select("a", "b"), "links")
    forget(pairs, close, wanted, whole)
    return links


def qualifying(questions: DataFrame, members: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """(a, group) of the questions (a, group, n, least) whose query has enough tokens of its head in the group's union to link with a member.
    members: (id, group). Every row is a number: no task and no cell holds a union."""
    asked = sets.join(questions.select(F.col("a").alias("id")).distinct(), "id", "left_semi").select(F.col("id").alias("a"), "head")
    open_groups = questions.select("group").distinct()
    matrix = members.join(open_groups, "group", "left_semi").join(sets.select("id", "head"), "id").select("group", F.explode("head").alias("token")).distinct()
    rows = questions.join(asked, "a").select("a", "group", F.least("n", "least").alias("size"), F.explode("head").alias("token"))
    counted = rows.join(matrix, ["group", "token"]).groupBy("a", "group").agg(F.count("*").alias("both"), F.first("size").alias("size"))
    return counted.where(F.col("both") >= like.more(F.col("size"))).select("a", "group")


def similar(docs: DataFrame, like: Likeness) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows, sets, links): (doc, n, sig) of every row; (id, sig, n, first, copies, bits, head) of every set that isn't empty, where first is the least
    doc_id that has it and id a number that is given when the table is written; links (a, b) between sets that join all sets that link, directly or through others."""
    texts = ids_and_texts(docs)
    found = saved(prefixes(texts, like), "prefixes")
    rows = saved(found.select("doc", "n", "sig"), "rows")
    # copies are counted before the shuffle
    sets = saved(found.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.min("doc").alias("first"), F.count("*").alias("copies"), F.first("bits").alias("bits"), F.first("head").alias("head")).withColumn("id", F.monotonically_increasing_id()), "distinct")
    forget(found)

    prefix = F.slice("head", 1, F.col("n") - F.ceil(F.lit(like.num) * F.col("n") / float(like.den) - 1e-9).cast("int") + 1)
    entries = sets.select("id", "n", F.posexplode(prefix).alias("pos", "token"))
    counts = entries.groupBy("token").agg(F.count("*").alias("size")).where("size > 1").select("token")
    shared = saved(entries.join(counts, "token").withColumn("band", like.band(F.col("n"))), "shared")
    upper = lambda n, p, m, q: 1 + F.least(n - p - 1, m - q - 1)  # noqa: E731  tokens in common, if this is the first of them
    n, p, m, q = (F.col(c) for c in ("n", "pos", "m", "q"))
    fit = like.sizes_fit(n, m) & (upper(n, p, m, q) >= like.needs(n, m))

    hubs = shared.groupBy("token", "band").agg(F.min(F.struct("pos", F.xxhash64("id").alias("draw"), "n", "id")).alias("hub")).select("token", "band", F.col("hub.id").alias("b"), F.col("hub.n").alias("m"), F.col("hub.pos").alias("q"))
    with_hub = shared.withColumnRenamed("id", "a").join(hubs, ["token", "band"])
    first = saved(with_hub.where(F.col("a") != F.col("b")).where(fit).select("a", "b", "n", "m").distinct(), "pairs")
    links = verified(first, sets, texts, like)

    # groups so far; each set without a link is one of its own
    groups = saved(components(links), "groups")
    there = shared.join(groups.withColumnRenamed("node", "id"), "id", "left").select("token", "id", "n", "pos", "band", F.coalesce("component", "id").alias("group"), F.col("component").isNotNull().alias("many"))
    mixed = there.groupBy("token").agg(F.min("group").alias("g"), F.max("group").alias("h")).where("g != h").select("token")
    met = saved(there.join(mixed, "token", "left_semi"), "mixed")
    forget(shared)
    there = saved(met.join(met.groupBy("token", "group").agg(F.count("*").alias("own")), ["token", "group"]), "sized")
    forget(met)
    # a group's own is the same wherever it is at a token
    stats = there.groupBy("token", "band", "group", "many").agg(F.min("n").alias("least"), F.max("n").alias("most"), F.max(n - p).alias("rest"), F.first("own").alias("size"))
    asked = there.select("token", F.col("id").alias("a"), "n", "pos", F.col("group").alias("mine"), "own", F.explode(like.bands(n, p)).alias("band"))
    may = asked.join(stats, ["token", "band"])
    # of two groups at a token the one with fewer members there asks
    may = may.where((F.col("group") != F.col("mine")) & ((F.col("size") > F.col("own")) | ((F.col("size") == F.col("own")) & (F.col("group") > F.col("mine")))))
    fits = (like.den * F.col("most") >= like.num * n) & (like.num * F.col("least") <= like.den * n) & (F.least(n - p, F.col("rest")) >= like.needs(n, F.col("least")))
    questions = saved(may.where(fits).groupBy("a", "group", "many").agg(F.first("n").alias("n"), F.min("least").alias("least")), "questions")
    members = groups.select(F.col("node").alias("id"), F.col("component").alias("group"))
    opened = saved(qualifying(questions.where("many"), members, sets, like), "opened")
    asks = there.join(opened.withColumnRenamed("a", "id").withColumnRenamed("group", "other"), "id").select("token", F.col("id").alias("a"), "n", "pos", F.col("other").alias("group"))
    answers = there.select("token", "group", F.col("id").alias("b"), F.col("n").alias("m"), F.col("pos").alias("q"))
    # a group of one is named by its set, which is all that there is to open
    alone = questions.where("not many").select("a", F.col("group").alias("b"), "n", F.col("least").alias("m"))
    second = asks.join(answers, ["token", "group"]).where(fit).select("a", "b", "n", "m").unionByName(alone).distinct()
    tried = first.select("a", "b").unionByName(first.select(F.col("b").alias("a"), F.col("a").alias("b")))
    more = saved(second.join(tried, ["a", "b"], "left_anti"), "second")
    forget(there, questions)
    return rows, sets, links.unionByName(verified(more, sets, texts, like))


def group_names(rows: DataFrame, sets: DataFrame, links: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row, from what similar() returns."""
    groups = saved(components(links), "components").withColumnRenamed("node", "id")
    named = sets.join(groups, "id", "left").select("sig", "first", "copies", F.coalesce("component", "id").alias("group"))
    least = named.groupBy("group").agg(F.min("first").alias("component_id"), F.count("*").alias("sets"))
    table = look_up(named, "group", least, "sets", how="inner").select("sig", "copies", "component_id")
    names = saved(table, "named")
    forget(sets)
    out = look_up(rows, "sig", names, "copies")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc").alias("component_id"))


def similar_groups(docs: DataFrame, like: Likeness = Likeness()) -> DataFrame:
    """(doc_id, n_shingles, component_id): component_id is the least doc_id that links reach, a document's own where it has none.

    Words are `[^\\x20\\x09-\\x0D]+` after lower-casing A-Z. A null text, or one without words, has the empty set and links with nothing. Each
    row is a document of its own: rows that repeat a doc_id have each their own text's set and group. An empty table gives no rows. Tokens are
    64-bit hashes: within a pair of sets, two different shingles are taken for one with a probability of about |a| |b| / 2^64."""
    return group_names(*similar(docs, like))


def keep_one_of_each(docs: DataFrame, like: Likeness = Likeness(5, 80, 100)) -> DataFrame:
    """The rows of docs, with all their columns, that have the least doc_id of their group. Rows without an id stay. Where an id repeats, its rows
    stay as long as one of them does: which one went couldn't be told by the id."""
    found = similar_groups(docs, like).select(F.col("doc_id").alias("__id"), (F.col("doc_id") == F.col("component_id")).alias("__stays"))
    gone = found.groupBy("__id").agg(F.max("__stays").alias("__stays")).where("not __stays").select("__id")
    return docs.join(gone, F.col("doc_id").cast("long") == F.col("__id"), "left_anti")


ORACLE_SQL = r"""
with recursive w as (
  select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x != '') as words from documents where doc_id is not null
), s as (
  select doc_id, case when len(words) = 0 then [] when len(words) < 3 then [array_to_string(words, ' ')] else list_distinct(list_transform(range(1, len(words) - 1), lambda i: array_to_string(words[i:i + 2], ' '))) end as shingles from w
), e as (select doc_id, len(shingles) as n, unnest(shingles) as g from s),
pairs as (
  select a.doc_id as a, b.doc_id as b from e a join e b on a.g = b.g and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 90 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 90 * (a.n + b.n - count(*))
), sym as (select a, b from pairs union all select b, a from pairs),
reach as (select doc_id as node, doc_id as seen from s union select node, b from reach join sym on a = seen)
select s.doc_id, cast(len(shingles) as bigint) as n_shingles, min(seen) as component_id from s join reach on node = s.doc_id group by s.doc_id, shingles
"""
