"""Large JSON documents, read and written object by object.

A document of one object a line, or of no lines at all, is text that Spark can split: at each closing brace an object ends. So readers cut files there, in
as many tasks as the file has blocks, and nothing larger than one object and what stands before it is ever a value. Writers put an object on each line of a
file, between lines that open and close the document. Objects are flat: their values are strings, numbers, booleans, nulls or arrays of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a document, about.
DOCUMENT_BYTES = 64_000_000
def _masked(text: Column) -> Column:
    """text with two dashes for each backslash and what it is in front of: no quote is left that doesn't begin or end a string."""
    return F.regexp_replace(text, r"(?s)\\.", "--")


def _open_quotes(text: Column) -> Column:
    """1 where a text has an odd number of quotes, without those behind a backslash."""
    return F.length(F.regexp_replace(_masked(text), '[^"]', "")) % 2


def _last_brace(masked: Column) -> Column:
    """Place, from 1, of the last opening brace outside of strings; 0 if there is none."""
    start = F.struct(F.lit(0).alias("at"), F.lit(0).alias("found"), F.lit(False).alias("inside"))

    def step(s, part):
        here = F.when(F.contains(part, F.lit("{")), s["at"] + F.length(part) - F.instr(F.reverse(part), "{") + 1)
        return F.struct((s["at"] + F.length(part) + 1).alias("at"), F.coalesce(F.when(~s["inside"], here), s["found"]).alias("found"), (~s["inside"]).alias("inside"))

    return F.aggregate(F.split(masked, '"', -1), start, step, lambda s: s["found"])


def _objects(rows: DataFrame) -> DataFrame:
    """rows (text, ...) with the object that the text ends in, without its closing brace, and before, what stands in front of it; both of
    the text and, as before_masked, of the masked text. Rows without an object go."""
    found = rows.withColumn("masked", _masked(F.col("text"))).withColumn("brace", _last_brace(F.col("masked"))).where("brace > 0")
    head = lambda c: F.left(F.col(c), F.col("brace") - 1)
    return found.select(*rows.columns, F.substring(F.col("text"), F.col("brace"), F.length("text")).alias("object"), head("text").alias("before"), head("masked").alias("before_masked"))


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """(file, at, text): what stands before each closing brace of the files that isn't part of a string; at ascends within a file."""
    raw = spark.read.option("lineSep", "}").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")
    at = F.struct("block", "row").alias("at")
    quoted = raw.withColumn("odd", _open_quotes(F.col("value")))
    torn = quoted.where("odd = 1").select("file").distinct()
    if torn.isEmpty():
        return raw.select("file", at, F.col("value").alias("text"))
    whole = quoted.join(torn, "file", "left_anti").select("file", at, F.col("value").alias("text"))
    # strings with braces in them: a piece goes on in the next one where the quotes so far, in its block and in those before, are odd
    rows = quoted.join(torn, "file", "left_semi")
    inside = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, 0)
    blocks = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    quotes = rows.groupBy("file", "block").agg(F.sum("odd").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(blocks), F.lit(0)).alias("before"))
    ended = rows.withColumn("so_far", F.sum("odd").over(inside)).join(quotes, ["file", "block"]).withColumn("ends", ((F.col("so_far") + F.col("before")) % 2 == 0).cast("int"))
    counts = ended.groupBy("file", "block").agg(F.sum("ends").alias("n")).select("file", "block", F.coalesce(F.sum("n").over(blocks), F.lit(0)).alias("first"))
    numbered = ended.withColumn("number", F.sum("ends").over(inside) - F.col("ends")).join(counts, ["file", "block"]).withColumn("number", F.col("number") + F.col("first"))
    parts = F.array_sort(F.collect_list(F.struct("block", "row", "value")))
    joined = numbered.groupBy("file", "number").agg(parts.alias("parts"))
    return whole.unionByName(joined.select("file", F.struct(F.get("parts", F.lit(0))["block"].alias("block"), F.get("parts", F.lit(0))["row"].alias("row")).alias("at"), F.array_join(F.col("parts.value"), "}").alias("text")))


def sections(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(file, section, object): the objects in the arrays of these names, of files that hold one document each."""
    found = _objects(pieces(spark, path))
    names_in = F.filter(F.array(*[F.lit(n) for n in names]), lambda n: F.regexp_like(F.col("before"), F.concat(F.lit('"'), n, F.lit(r'"\s*:\s*\[\s*$'))))
    marked = found.select("file", "at", "object", F.get(names_in, F.lit(0)).alias("begins"))
    starts = marked.where("begins is not null").groupBy("file").agg(F.array_sort(F.collect_list(F.struct("at", F.col("begins").alias("name")))).alias("starts"))
    here = F.filter("starts", lambda s: s["at"] <= F.col("at"))
    named = marked.join(starts, "file").withColumn("here", here).where(F.size("here") > 0)
    return named.select("file", F.element_at("here", -1)["name"].alias("section"), F.concat("object", F.lit("}")).alias("object"))


def entries(spark: SparkSession, path: str) -> DataFrame:
    """(key, object): the entries of JSON maps from text to flat objects."""
    found = _objects(pieces(spark, path)).where(F.regexp_like("before_masked", F.lit(r'"\s*:\s*$')))
    key = F.regexp_replace("before_masked", r"\s*:\s*$", "")
    size = F.length(F.element_at(F.split(key, '"', -1), -2))
    raw = F.substring(F.col("before"), F.length(key) - size, size)
    return found.select(F.get(F.from_json(F.concat(F.lit('["'), raw, F.lit('"]')), "array<string>"), F.lit(0)).alias("key"), F.concat("object", F.lit("}")).alias("object"))


def write_documents(rows: DataFrame, frame: list[str], path: str, document_bytes: int = DOCUMENT_BYTES) -> None:
    """Writes rows (id, part, text) as JSON documents, a file for each, of about document_bytes: the objects of part 0 between frame[0] and frame[1], those
    of part 1 between frame[1] and frame[2], and so on, in the order of id. Rows with the same id go to the same document; one without rows is an
    empty document."""
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = -(-total // document_bytes) or 1
    placed = rows.select(F.pmod(F.xxhash64("id"), F.lit(shards)).alias("shard"), (2 * F.col("part") + 1).alias("place"), "id", "text")
    lines = [F.struct(F.lit(2 * k).alias("place"), F.lit(x).alias("text")) for k, x in enumerate(frame)]
    frames = rows.sparkSession.range(shards).select(F.col("id").alias("shard"), F.inline(F.array(*lines)))
    both = placed.unionByName(frames, allowMissingColumns=True).repartition("shard")
    first = F.row_number().over(Window.partitionBy("shard", "place").orderBy("id")) == 1
    text = F.when(first | (F.col("place") % 2 == 0), F.col("text")).otherwise(F.concat(F.lit(","), "text"))
    both.select("shard", "place", "id", text.alias("text")).sortWithinPartitions("shard", "place", "id").select("shard", "text").write.partitionBy("shard").text(path)
