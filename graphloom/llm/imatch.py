"""I-Match fingerprints, with DataFrame functions only.

Terms whose document frequency lies in a band make the lexicon. Many random subsets of the lexicon are fixed by hashing, at four rates. For each
subset the document's distinct terms in it are sorted and hashed together; the hashes of all subsets that are not empty are the fingerprint.
A document without a term in any subset has hashes of all its terms instead.
Whole-lexicon hashes change with any term, sparse subsets survive edits of the others, so the share of equal hashes tells how alike two texts
are, whatever their length."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import ids_and_texts, saved, shuffle_parts

#: A subset at rate r holds each term with probability 1/r; there are SUBSETS disjoint ones of each rate.
RATES, SUBSETS = (64, 256, 1024, 4096), 32
#: Subset numbers for the hashes of all terms: three of 24 bits, as they stand alone for a whole text.
WHOLE = tuple(range(SUBSETS * len(RATES), SUBSETS * len(RATES) + 3))
#: Band of document frequencies, as shares of all distinct texts. It alone bounds the lexicon, to the mean number of terms of a document divided by LOW.
LOW, HIGH = 0.001, 0.1
#: Rows of a lexicon that is broadcast; a larger one is joined by a shuffle.
BROADCAST = 200_000
#: Ranges of doc_id for each shuffle partition: where some meet in one task, it is by little.
RANGES = 4


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits, with the empty string among them."""
    return F.array_union(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), F.array(F.lit("")))


def lexicon(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(term, subset): hashes of the terms whose document frequency lies within [low, high] of all distinct texts, each with the subsets that
    it is in. The empty term stands in subset -1, so that every document has one. Copies
    count once: else a text with many would have no term in the band."""
    rows = ids_and_texts(docs).select(F.coalesce("text", F.lit("")).alias("text"))
    n = rows.select(F.xxhash64("text")).distinct().count()
    counts = rows.distinct().select(F.explode(terms(F.col("text"))).alias("word")).where("word != ''").groupBy(F.xxhash64("word").alias("term")).count()
    kept = saved(counts.where(F.col("count").between(max(1, int(low * n)), max(2, int(high * n)))).select("term"), "terms")
    drawn = [F.pmod(F.xxhash64("term", F.lit(k)), F.lit(r)) for k, r in enumerate(RATES)]
    places = F.array(*[F.when(d < SUBSETS, (d + SUBSETS * k).cast("int")) for k, d in enumerate(drawn)])
    found = kept.select("term", F.explode(F.filter(places, lambda x: x.isNotNull())).alias("subset"))
    empty = docs.sparkSession.range(1).select(F.xxhash64(F.lit("")).alias("term"), F.lit(-1).alias("subset"))
    return saved(found.unionByName(empty), "lexicon")


def ranges(rows: DataFrame, n: int) -> Column:
    """The number of the range of doc_id, of n of about the same size, that a row is in: by two short searches among the bounds."""
    bounds = sorted(set(rows.select(F.percentile_approx("doc_id", [i / n for i in range(1, n)], 100_000) if n > 1 else F.array()).first()[0] or []))
    if not bounds:
        return F.lit(0)
    step = max(1, int(len(bounds) ** 0.5))
    parts = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    upto = lambda xs: F.size(F.filter(xs, lambda x: x <= F.col("doc_id")))
    longs = lambda xs: F.array(*[F.lit(int(x)).cast("long") for x in xs])
    first = F.greatest(upto(longs([p[0] for p in parts])) - 1, F.lit(0))
    return (first * step + upto(F.element_at(F.array(*[longs(p) for p in parts]), first + 1))).cast("int")


def with_next(docs: DataFrame) -> DataFrame:
    """(part, pos, ghost, doc_id, text, next): each text and that of the next document by doc_id, after the last that of the first.

    Rows are dealt by ranges of doc_id; each range also gets the first row of the range after it, as a ghost, so one shuffle does."""
    spark = docs.sparkSession
    rows = ids_and_texts(docs).withColumn("text", F.coalesce("text", F.lit("")))
    rows = rows.withColumn("part", ranges(rows, RANGES * shuffle_parts(spark)))
    firsts = sorted(tuple(r) for r in rows.groupBy("part").agg(F.min("doc_id")).collect())  # a row for each range
    pairs = [F.struct(F.lit(firsts[(k + 1) % len(firsts)][1]).cast("long").alias("doc_id"), F.lit(p).cast("int").alias("ghost_of")) for k, (p, _) in enumerate(firsts)]
    ghosts = spark.range(1).select(F.inline(F.array(*pairs)))
    own = F.struct(F.col("part"), F.lit(False).alias("ghost"))
    copy = F.struct(F.col("ghost_of").alias("part"), F.lit(True).alias("ghost"))
    copies = rows.join(F.broadcast(ghosts), "doc_id", "left").select("doc_id", "text", F.explode(F.when(F.col("ghost_of").isNull(), F.array(own)).otherwise(F.array(own, copy))).alias("x"))
    order = Window.partitionBy("part").orderBy("ghost", "doc_id", "text")
    return copies.select("x.part", "x.ghost", "doc_id", "text").select("part", F.row_number().over(order).alias("pos"), "ghost", "doc_id", "text", F.coalesce(F.lead("text").over(order), F.lit("")).alias("next"))


def code(subset: Column, hashed: Column) -> Column:
    return subset.cast("long") * (1 << 24) + F.pmod(hashed, F.lit(1 << 24))


def likeness(a: Column, b: Column, same: Column) -> Column:
    """Equal hashes, as a share of the subsets that are not empty in either; 1 for equal fingerprints, if empty only for the `same` text."""
    places = lambda x: F.transform(x, lambda c: F.shiftright(c, 24))
    either = F.size(F.array_union(places(a), places(b)))
    return F.when(either == 0, same.cast("double")).when(a == b, F.lit(1.0)).otherwise(F.size(F.array_intersect(a, b)) / either)


def fingerprints(docs: DataFrame, low: float = LOW, high: float = HIGH) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row with an id.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of the next document. A null text
    counts as empty. Equal texts have equal fingerprints; a text without letters and digits has an empty one, alike only to an equal text.
    Rows that repeat a doc_id follow each other, by text. A single document is its own next; an empty table gives no rows."""
    if ids_and_texts(docs).isEmpty():
        names = ("doc_id", "long"), ("n_chars", "long"), ("edited_sha256", "string"), ("fingerprint", "string"), ("edited_fingerprint", "string"), ("near_edited", "double"), ("near_next", "double")
        return docs.select(*[F.lit(None).cast(t).alias(n) for n, t in names]).limit(0)
    half = (F.length("text") / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.length("text") - half), F.substring("next", F.lit(1), half))
    base = with_next(docs).select("part", "pos", "ghost", "doc_id", F.length("text").cast("long").alias("n_chars"), "text", edited.alias("edited")).withColumn("sha", F.sha2("edited", 256)).withColumn("key", F.xxhash64("text")).withColumn("edited_key", F.xxhash64("edited"))
    kinds = F.when(F.col("ghost"), F.array(F.struct(F.lit(0).alias("kind"), F.col("text")))).otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("text"))))
    both = base.select("part", "pos", F.struct("ghost", "doc_id", "n_chars", "sha", "key", "edited_key").alias("about"), F.explode(kinds).alias("x"))
    split = both.select("part", "pos", "x.kind", "about", terms(F.col("x.text")).alias("words"))
    whole = F.when(F.size("words") > 1, F.xxhash64(F.sort_array("words")))
    at_empty = lambda c: F.when(F.col("word") == "", F.col(c)).alias(c)
    words = split.select("part", "pos", "kind", "about", whole.alias("whole"), F.explode("words").alias("word")).select("part", "pos", "kind", at_empty("about"), at_empty("whole"), F.xxhash64("word").alias("term"))
    known = lexicon(docs, low, high)
    found = words.join(F.broadcast(known) if known.count() <= BROADCAST else known.hint("shuffle_merge"), "term")
    sets = found.groupBy("part", "pos", "kind", "subset").agg(F.xxhash64(F.sort_array(F.collect_list("term"))).alias("hash"), F.first("about", True).alias("about"), F.first("whole", True).alias("whole"))
    hashes = F.when(F.col("subset") >= 0, code(F.col("subset"), F.col("hash")))
    of_kind = lambda k, c: F.when(F.col("kind") == k, c)
    found = [x for k in (0, 1) for x in (F.sort_array(F.collect_list(of_kind(k, hashes))).alias(f"found{k}"), F.first(of_kind(k, F.col("whole")), True).alias(f"whole{k}"))]
    alone = lambda k: F.array(*[code(F.lit(w), F.xxhash64(f"whole{k}", F.lit(w))) for w in WHOLE])
    prints = sets.groupBy("part", "pos").agg(*found, F.first("about", True).alias("about"))
    prints = prints.select("part", "pos", "about", *[F.when((F.size(f"found{k}") == 0) & F.col(f"whole{k}").isNotNull(), alone(k)).otherwise(F.col(f"found{k}")).alias(f"print{k}") for k in (0, 1)])
    order = Window.partitionBy("part").orderBy("pos")
    as_text = lambda x: F.array_join(F.transform(x, lambda c: F.lpad(F.hex(c), 8, "0")), "")
    out = prints.select("about.*", "print0", "print1", F.lead("print0").over(order).alias("after"), F.lead("about.key").over(order).alias("next_key")).where("not ghost")
    return out.select("doc_id", "n_chars", F.col("sha").alias("edited_sha256"), as_text("print0").alias("fingerprint"), as_text("print1").alias("edited_fingerprint"), likeness(F.col("print0"), F.col("print1"), F.col("key") == F.col("edited_key")).alias("near_edited"), likeness(F.col("print0"), F.col("after"), F.col("key") == F.col("next_key")).alias("near_next"))
