"""Blocks of whole images for numpy: every task gets its images' rows in order, and works on many images at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import saved, ship

#: Rows of one block, about; and of one image that a task works on alone: images with more go by joins.
BLOCK_ROWS, IMAGE_ROWS = 1_000_000, 2_000_000


def large_images(rows: DataFrame, most: int | None = None) -> DataFrame:
    """(image_id) of images with more rows than a task should hold."""
    return rows.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > (IMAGE_ROWS if most is None else most)).select("image_id")


def written(rows: DataFrame, name: str, most: int | None = None) -> tuple[DataFrame, DataFrame | None]:
    """(rows as a written table, its large images or None). Images are looked at only where the whole table has more rows than one image may have."""
    table = saved(rows, name)
    if table.count() <= (IMAGE_ROWS if most is None else most):
        return table, None
    large = large_images(table, most)
    return table, None if large.isEmpty() else large


def by_image(rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str, block: int = BLOCK_ROWS) -> DataFrame:
    """What work makes of blocks of whole images. rows have image_id first and come by image; work gets about `block` rows, or one image."""
    ship(rows.sparkSession)

    def stream(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(batch)
            size += batch.num_rows
            if size < block:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            cut = pc.index(table.column(0), table.column(0)[-1]).as_py()  # where the last image begins
            if cut:
                yield from work(table.slice(0, cut)).to_batches()
            held = table.slice(cut).to_batches()
            size = table.num_rows - cut
        if size:
            yield from work(pa.Table.from_batches(held).combine_chunks()).to_batches()

    return rows.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(stream, schema)


def image_numbers(table: pa.Table) -> tuple[np.ndarray, pa.Array]:
    """(number of each row's image, from 0; the images)."""
    coded = pc.dictionary_encode(table.column(0).combine_chunks())
    return coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), coded.dictionary


def numbers(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def least_linked(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node that links (a, b) reach: roots hook to the lesser root of a link, then every node looks up to its root."""
    up = np.arange(n)
    while len(a):
        x, y = up[a], up[b]
        apart = x != y
        if not apart.any():
            break
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(up, np.maximum(x, y), np.minimum(x, y))
        while True:
            higher = up[up]
            if (higher == up).all():
                break
            up = higher
    return up
