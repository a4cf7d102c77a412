"""A Merkle manifest of a dataset: a digest for each row, a tree of digests for each source, one root over all, and a proof for each row.

Every node of a tree is labelled with the interval of leaf ranks that it covers: [lo, hi), where a node of level l begins at a multiple of 3^l. Labels
say all that links say: a node's ancestors are the nodes whose intervals contain its own, and the siblings on a row's way to the root are what is left
of each ancestor when the part that holds the row is taken out of it.

1. Rows are ranked within their source by ranges of (source, doc_id), so a source of any size is spread over many tasks.
2. Levels are built in buckets of six: a group of at most 3^6 neighbouring nodes gives all six levels above it with one shuffle.
3. In each bucket its lowest nodes are joined with the bucket's other nodes, level by level: on (tree, level, lo / 3^level), where the interval contains
   the node's. Such a join finds one ancestor for each node and level, whatever the sizes of the trees.
4. The ways through the buckets are put one after the other from the top down. A bucket has 729 times fewer nodes than the one below it.

The roots of the sources are the leaves of one more tree, which is made by the same steps."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.places import ranked
from .common import crc32_sql, forget, look_up, remainder, saved, ship

FANOUT = 3
#: Levels of a bucket: 3^6 = 729 digests, 23 kB, is the longest list.
LEVELS = 6
STEPS = "array<struct<level: int, left: binary, right: binary>>"


def hexed(digest: Column) -> Column:
    return F.lower(F.hex(digest))


def digest_of(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leaf_digest(values: list[Column]) -> Column:
    """Of each value: `-` if it is null, else the number of its UTF-8 bytes, a colon, and itself; all together hashed."""
    field = lambda v: F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v))
    return digest_of(F.concat(*[field(v.cast("string")) for v in values]))


def power(level: Column | int) -> Column:
    """3^level, exactly."""
    powers = F.array(*[F.lit(FANOUT**k).cast("long") for k in range(40)])
    return F.element_at(powers, F.lit(level + 1) if isinstance(level, int) else level + 1)


def _above(kids: Column) -> Column:
    """The digests of the nodes over each run of three kids."""
    runs = F.sequence(F.lit(0), F.floor((F.size(kids) - 1) / FANOUT).cast("int"))
    return F.transform(runs, lambda i: digest_of(F.concat_ws("", F.transform(F.slice(kids, i * FANOUT + 1, FANOUT), hexed))))


def _covers(begin: Column, width: int) -> Column:
    return F.struct(begin.alias("lo"), F.least(begin + width, F.col("size")).alias("hi")).alias("covers")


def _labelled(level: int) -> Column:
    """The nodes of one level with their intervals, from the digests d{level} and those below; `from` is where the first begins."""
    wide, narrow, below = FANOUT**level, FANOUT ** (level - 1), F.col(f"d{level - 1}")

    def node(digest, i):
        begin = F.col("from") + i.cast("long") * wide
        kids = F.transform(F.slice(below, i * FANOUT + 1, FANOUT), lambda d, k: F.struct(_covers(begin + k.cast("long") * narrow, narrow), d.alias("digest")))
        return F.struct(F.lit(level).alias("level"), _covers(begin, wide), kids.alias("kids"), digest.alias("digest"))

    return F.transform(F.col(f"d{level}"), node)


@dataclass
class Forest:
    """roots: (tree, root); paths: (tree, place, steps) of all leaves of trees with several: the siblings on the way up, those on the left and those on
    the right of each level. tables: written for these two."""

    roots: DataFrame
    paths: DataFrame
    tables: list[DataFrame]


def bucket_nodes(base: DataFrame, low: int) -> DataFrame:
    """(tree, size, level, lo, hi, kids, digest) of levels low + 1 to low + LEVELS over the nodes base (tree, size, lo, digest) of level low. kids are the
    digests below with their intervals. A tree ends at the level that has one node."""
    over = FANOUT ** (low + LEVELS)
    groups = base.groupBy("tree", "size", F.floor(F.col("lo") / F.lit(over)).cast("long").alias("group"))
    made = groups.agg(F.array_sort(F.collect_list(F.struct("lo", "digest"))).alias("rows")).select("tree", "size", (F.col("group") * over).alias("from"), F.col("rows.digest").alias(f"d{low}"))
    for level in range(low + 1, low + LEVELS + 1):
        made = made.withColumn(f"d{level}", F.when(F.col("size") > FANOUT ** (level - 1), _above(F.col(f"d{level - 1}"))))
    found = [F.coalesce(_labelled(level), F.array()) for level in range(low + 1, low + LEVELS + 1)]
    return made.select("tree", "size", F.explode(F.concat(*found)).alias("x")).select("tree", "size", "x.level", "x.covers.lo", "x.covers.hi", "x.kids", "x.digest")


def bucket_steps(base: DataFrame, nodes: DataFrame, low: int) -> DataFrame:
    """(tree, lo, steps): for each node of base, the siblings on its way through the bucket's nodes."""
    levels = F.filter(F.sequence(F.lit(low + 1), F.lit(low + LEVELS)), lambda level: F.col("size") > power(level - 1))
    asks = base.select("tree", F.col("lo").alias("at"), F.explode(levels).alias("level")).withColumn("bucket", F.floor(F.col("at") / power(F.col("level"))))
    held = nodes.select("tree", "level", "lo", "hi", "kids").withColumn("bucket", F.floor(F.col("lo") / power(F.col("level"))))
    met = asks.join(held, ["tree", "level", "bucket"]).where((F.col("lo") <= F.col("at")) & (F.col("at") < F.col("hi")))
    joined = lambda kids: F.unhex(F.concat_ws("", F.transform(kids, lambda k: F.hex(k["digest"]))))
    left = joined(F.filter("kids", lambda k: k["covers"]["hi"] <= F.col("at")))
    right = joined(F.filter("kids", lambda k: k["covers"]["lo"] > F.col("at")))
    step = F.struct(F.col("level"), left.alias("left"), right.alias("right"))
    return met.groupBy("tree", F.col("at").alias("lo")).agg(F.array_sort(F.collect_list(step)).alias("steps"))


def forest(leaves: DataFrame, most: int) -> Forest:
    """leaves: (tree, place, size, digest), where size is the tree's number of leaves, and most the greatest of these."""
    base = leaves.select("tree", "size", F.col("place").alias("lo"), "digest")
    roots, ways, tables, low = base.where("size = 1").select("tree", F.col("digest").alias("root")), [], [], 0
    while most > FANOUT**low:
        base = base.where(F.col("size") > FANOUT**low)
        nodes = saved(bucket_nodes(base, low), "nodes")
        ways.append(saved(bucket_steps(base, nodes, low), "steps"))
        roots = roots.unionByName(nodes.where((F.col("lo") == 0) & (F.col("hi") == F.col("size"))).groupBy("tree").agg(F.min_by("digest", "level").alias("root")))
        tables += [nodes, ways[-1]]
        low += LEVELS
        base = nodes.where(F.col("level") == low).select("tree", "size", "lo", "digest")
    if not ways:
        return Forest(roots, leaves.where("false").select("tree", "place", F.lit(None).cast(STEPS).alias("steps")), tables)
    paths = ways[-1]
    for k in range(len(ways) - 2, -1, -1):
        over = FANOUT ** ((k + 1) * LEVELS)
        upper = paths.select("tree", F.col("lo").alias("block"), F.col("steps").alias("upper"))
        below = ways[k].withColumn("block", F.floor(F.col("lo") / over) * over)
        paths = below.join(upper, ["tree", "block"], "left").select("tree", "lo", F.concat("steps", F.coalesce("upper", F.array().cast(STEPS))).alias("steps"))
    return Forest(roots, paths.withColumnRenamed("lo", "place"), tables)


def folded(digest: Column, steps: Column) -> Column:
    """The root, as hex text, that a leaf's digest and its siblings lead to."""
    return F.aggregate(steps, hexed(digest), lambda d, s: F.sha2(F.concat(hexed(s["left"]), d, hexed(s["right"])), 256))


def manifest(docs: DataFrame, tampered: tuple[Column, Column] | None = None) -> DataFrame:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), a row for each row of docs.

    A leaf is the digest of doc_id, source, lang, n_chars and text. Rows of a source are ordered by doc_id, a null one first, and rows that repeat a doc_id
    by their leaves. Every three neighbours, at the end fewer, become one node, until one is left: the subroot; subroots in the order of their sources, null
    first, become the root in the same way. proof_sha256 is the hash of the siblings on the way from leaf to root. folded_root is what the row's digest now and
    these siblings lead to; verified says whether that is the root. tampered: (which rows, text that they have now); none: the rows are as they were. A null in any
    column has a digest of its own, different from that of an empty text. Other columns of docs are never read; an empty table gives no rows."""
    ship(docs.sparkSession)
    doc_id, source, lang, n_chars, text = (F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text"))
    which, now = tampered or (F.lit(False), text)
    changed = F.when(F.coalesce(which, F.lit(False)) & ~text.eqNullSafe(now), leaf_digest([doc_id, source, lang, n_chars, now]))
    digests = saved(docs.select(doc_id.cast("long").alias("doc_id"), source.cast("string").alias("source"), leaf_digest([doc_id, source, lang, n_chars, text]).alias("digest"), changed.alias("changed")), "digests")
    rows = ranked(digests, ["source"], ["doc_id", "digest"], "leaves")
    sources = saved(rows.groupBy("source").agg(F.count("*").alias("rows")), "sources")
    numbered = ranked(sources, [], ["source"], "trees")
    # the rows of one source meet their source's number by way of look_up, which splits hot ones
    key = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null")).alias("key")
    keyed = numbered.select(key, F.col("place").alias("tree"), "rows")
    leaves = saved(look_up(rows.select("*", key), "key", keyed, "rows", how="inner").drop("key", "rows"), "numbered")
    most = leaves.agg(F.max("size")).first()[0]
    if most is None:
        return leaves.select("doc_id", *[F.lit(None).cast("string").alias(c) for c in ("leaf", "subroot", "root", "proof_sha256", "folded_root")], F.lit(None).cast("boolean").alias("verified"))
    below = forest(leaves.select("tree", "place", "size", "digest"), most)
    tops = saved(below.roots.join(numbered.select(F.col("place").alias("tree"), "rows", F.col("size").alias("sources")), "tree"), "subroots")
    above = forest(tops.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("place"), F.col("sources").alias("size"), F.col("root").alias("digest")), tops.agg(F.max("sources")).first()[0])
    root = F.lit(above.roots.first()["root"])
    none = F.array().cast(STEPS)
    ends = saved(tops.join(above.paths.select(F.col("place").alias("tree"), F.col("steps").alias("upper")), "tree", "left").select("tree", "rows", F.col("root").alias("subroot"), F.coalesce("upper", none).alias("upper")), "ends")
    proved = leaves.join(below.paths, ["tree", "place"], "left")
    steps = F.concat(F.coalesce("steps", none), "upper")
    out = look_up(proved, "tree", ends, "rows", how="inner").select("doc_id", "digest", "changed", "subroot", steps.alias("steps"))
    proof = F.sha2(F.concat_ws("", F.transform("steps", lambda s: F.concat(hexed(s["left"]), hexed(s["right"])))), 256)
    out = out.select("doc_id", hexed(F.col("digest")).alias("leaf"), hexed(F.col("subroot")).alias("subroot"), hexed(root).alias("root"), proof.alias("proof_sha256"), folded(F.coalesce("changed", "digest"), F.col("steps")).alias("folded_root"))
    forget(digests, rows, sources)
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def tamper_check(docs: DataFrame) -> DataFrame:
    """The manifest of docs against rows of which every other one, by the crc32 of its id, has lost its line ends."""
    return manifest(docs, (remainder("doc_id", 2) == 0, F.translate("text", "\n", "")))


def _leaf_sql(text: str) -> str:
    return "sha256(" + " || ".join(f"case when {c} is null then '-' else strlen(cast({c} as varchar)) || ':' || cast({c} as varchar) end" for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"


ORACLE_SQL = f"""
with recursive d as (select row_number() over () as id, *, {_leaf_sql('text')} as leaf, case when {crc32_sql('doc_id')} % 2 = 0 then {_leaf_sql("replace(text, chr(10), '')")} else {_leaf_sql('text')} end as now from documents),
r as (select *, row_number() over (partition by source order by doc_id nulls first, leaf) - 1 as place, count(*) over (partition by source) as n, dense_rank() over (order by source nulls first) - 1 as tree from d),
up as (
  select tree, 0 as level, place, n, leaf as digest from r
  union all select tree, level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by place)) from up where n > 1 group by tree, level, n, place // 3
), tops as (
  select 0 as level, tree as place, count(*) over () as n, digest from up where n = 1
  union all select level + 1, place // 3, (n + 2) // 3, sha256(string_agg(digest, '' order by place)) from tops where n > 1 group by level, n, place // 3
), nodes as (select tree, level, place, n, digest from up union all select -1, level, place, n, digest from tops),
height as (select tree, max(level) as height from up group by 1),
ways as (
  select id, r.tree, level, place // cast(pow(3, level) as bigint) as spot, level as step from r join (select distinct tree, level from nodes where n > 1 and tree >= 0) l on l.tree = r.tree
  union all select id, -1, level, r.tree // cast(pow(3, level) as bigint), height + level from r join height h on h.tree = r.tree, (select distinct level from nodes where n > 1 and tree = -1)
), steps as (
  select id, step, coalesce(string_agg(digest, '' order by place) filter (place < spot), '') as left_of, coalesce(string_agg(digest, '' order by place) filter (place > spot), '') as right_of
  from ways w join nodes k on k.tree = w.tree and k.level = w.level and k.place // 3 = w.spot // 3 group by 1, 2
), folded as (
  select id, 0 as step, now as digest from r
  union all select f.id, f.step + 1, sha256(left_of || digest || right_of) from folded f join steps s on s.id = f.id and s.step = f.step
), proof as (select id, string_agg(left_of || right_of, '' order by step) as proof, max(step) + 1 as step from steps group by 1)
select doc_id, leaf, k.digest as subroot, (select digest from tops where n = 1) as root, sha256(coalesce(proof, '')) as proof_sha256, f.digest as folded_root, f.digest = (select digest from tops where n = 1) as verified
from r join up k on k.tree = r.tree and k.n = 1 left join proof p on p.id = r.id join folded f on f.id = r.id and f.step = coalesce(p.step, 0)
"""
