"""What the operators of this package share: reading tables, shared scratch tables, skew-safe lookups."""

from __future__ import annotations

import ctypes

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import forget, saved, shared_dir, ship  # noqa: F401

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Bytes of text that a Python task handles as one numpy block.
BLOCK_BYTES = 6_000_000


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def ids_and_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) alone, so that other columns of the caller can't clash; rows without an id can't be named in a result and are left out."""
    ship(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id is not null")


def remainder(doc_id: str | Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; null for a null id."""
    return F.crc32((F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")) % F.lit(n)


def crc32_sql(column: str) -> str:
    """DuckDB SQL for the crc32 of a whole number as text, bit by bit."""
    x = f"cast({column} as varchar)"
    bits = f"flatten(list_transform(range(1, length({x}) + 1), lambda i: list_transform(range(0, 8), lambda k: (ord(substring({x}, i, 1)) >> k) & 1)))"
    return f"xor(list_reduce(list_prepend(cast(4294967295 as bigint), {bits}), lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))), 4294967295)"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def shuffle_parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def look_up(rows: DataFrame, key: str, table: DataFrame, weight: str, share: int = 200, how: str = "left") -> DataFrame:
    """rows joined with table, which has one row for each key and in weight the number of rows with that key.

    A key with more than 1/share of all weights would fill one task. There are fewer than share such keys, whatever the input's size,
    so these are broadcast; all others go through a shuffled join."""
    total, most = table.agg(F.sum(weight), F.max(weight)).first()
    least = max(1000, (total or 0) // share)
    hot = table.where(F.col(weight) > least)
    keys = [r[0] for r in hot.select(key).limit(share).collect()] if (most or 0) > least else []  # mostly there are none, and no second job
    if not keys:
        return rows.join(table, key, how)
    is_hot = F.col(key).isin(keys)
    return rows.where(is_hot).join(F.broadcast(table.where(is_hot)), key, how).unionByName(rows.where(~F.coalesce(is_hot, F.lit(False))).join(table.where(~is_hot), key, how))


def _drop_tokenizers() -> None:
    from . import words

    words._coders.clear()


def give_back() -> None:
    """Returns free memory of Arrow and of the C library to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of GNU's library only
    if trim:
        trim(0)


def lean(work, tokens: bool = False):
    """work, for mapInArrow, in a worker process that Spark keeps for tasks of all operators: tokenizers that another operator left there go first,
    unless work needs tokens, and free memory is given back at the end of the task."""

    def run(batches):
        if not tokens:
            _drop_tokenizers()
        try:
            yield from work(batches)
        finally:
            give_back()

    return run


def text_blocks(batches, column: str = "text", limit: int = BLOCK_BYTES):
    """Slices of the Arrow batches with at most limit bytes of text each, or one row."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(column))), 0).to_numpy(zero_copy_only=False)
        start, held = 0, 0
        for i in range(n):
            if i > start and held + sizes[i] > limit:
                yield batch.slice(start, i - start)
                start, held = i, 0
            held += int(sizes[i])
        yield batch.slice(start, n - start)
