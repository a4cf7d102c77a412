"""Annotation logs as they grow: state lives in the checkpoint, keyed by image and by benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.metrics import summary_rates
from ..scratch import new_path
from ..sources.readers import ANNOTATION_SCHEMA


def stream_summary(spark: SparkSession, folder: str, schema: str, by: str, chunk: int = 200) -> DataFrame:
    """(by, inputs, mean_value) over all JSON files of a folder (columns of schema: by, value), read at most `chunk` files a trigger until none is left.

    The running counts and sums live in the state store, keyed by `by`; every trigger's changed rows replace older ones by batch id, so a
    trigger that is repeated after a failure changes nothing. Values are summed as decimals: the order of arrival doesn't matter."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", chunk).json(folder)
    totals = rows.groupBy(by).agg(F.count("*").alias("inputs"), F.sum(F.col("value").cast("decimal(30,6)")).alias("total"))
    out, check = new_path(spark, "summary"), new_path(spark, "summary-log")

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = totals.writeStream.outputMode("update").option("checkpointLocation", check).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.option("basePath", out).parquet(f"{out}/batch=*")
    last = found.groupBy(by).agg(F.max_by(F.struct("inputs", "total"), "batch").alias("v"))
    return last.select(by, F.col("v.inputs").alias("inputs"), F.round((F.col("v.total") / F.col("v.inputs")).cast("double"), 6).alias("mean_value"))


def stream_benchmarks(spark: SparkSession, folder: str, truth: DataFrame, out: str, log: str, chunk: int = 200) -> None:
    """Adds what annotation logs have brought since the last call to the running counters of each benchmark.

    folder holds JSON files of the annotation schema; truth (filename, benchmark, smi, conf_least) is a table that says what each image is, and from which
    confidence an annotation counts as sure. Files that an earlier call has read are known from the checkpoint in log, which also holds the state: the
    images seen so far, so that an image annotated again, in another file too, counts once, and the counters inputs, processed, correct, wrong and caught of
    each benchmark. Annotations of images that truth lacks are left out. Every trigger writes the benchmarks that it has changed under its number in
    out: a trigger that is repeated after a failure replaces its own rows. Ends when no file is left."""
    rows = spark.readStream.schema(ANNOTATION_SCHEMA).option("maxFilesPerTrigger", chunk).json(folder)
    seen = rows.select(F.col("`file-info`.filename").alias("filename"), F.col("smi").alias("found"), "conf").where("filename is not null").dropDuplicates(["filename"])
    known = seen.join(truth.select("filename", "benchmark", "smi", "conf_least"), "filename")
    done = F.col("found").isNotNull() & (F.col("found") != "")
    good = F.coalesce(F.col("found") == F.col("smi"), F.lit(False))
    doubted = F.coalesce(F.col("conf") < F.col("conf_least"), F.lit(True))
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    counters = known.groupBy("benchmark").agg(F.count("*").alias("inputs"), one(done).alias("processed"), one(done & good).alias("correct"), one(done & ~good).alias("wrong"), one(done & ~good & doubted).alias("caught"))

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = counters.writeStream.outputMode("update").option("checkpointLocation", log).foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()


def benchmarks_so_far(spark: SparkSession, out: str) -> DataFrame:
    """(benchmark, inputs, processed, precision, detected_error_rate), as metrics.benchmark_summary has them for the whole log, from the last row that
    stream_benchmarks wrote for each benchmark."""
    schema = "benchmark string, inputs long, processed long, correct long, wrong long, caught long, batch long"
    found = spark.read.schema(schema).option("basePath", out).parquet(f"{out}/batch=*")
    last = found.groupBy("benchmark").agg(F.max_by(F.struct("inputs", "processed", "correct", "wrong", "caught"), "batch").alias("v"))
    return summary_rates(last.select("benchmark", "v.*"))
