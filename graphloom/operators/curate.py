"""Curation of image sets: samples, splits, checks and transforms of keypoints."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import saved
from .places import ranked


def draw(key: str, seed: int = 0) -> Column:
    """A number from 0 to 999 982 from an integer key by plain arithmetic, the same on every engine."""
    return F.pmod(F.col(key) * 7919 + 104729 * (seed + 1), F.lit(999_983))


def sample_two_tier(rows: DataFrame, priority: Column, key: str, n: int, most: int = 1_500_000, seed: int = 0) -> DataFrame:
    """n rows: drawn from the priority rows if there are more than n, else all of these and the rest drawn from the others."""
    if n > most:
        raise ValueError(f"at most {most} rows can be drawn")
    tier = F.when(priority, 0).otherwise(1)
    return rows.orderBy(tier, draw(key, seed), key).limit(n)


def split_name(key: str, seed: int = 0) -> Column:
    """train, val or test, about 80, 10 and 10 of 100."""
    bucket = draw(key, seed) % 100
    return F.when(bucket < 80, "train").when(bucket < 90, "val").otherwise("test")


def duplicate_rows(rows: DataFrame, k: int) -> DataFrame:
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))


def unflatten_keypoints(rows: DataFrame, column: str, offset: int = 0) -> DataFrame:
    """image_id and idx, x, y of each triple x, y, v of a flat array; v is dropped, offset added to both; an incomplete triple is left out."""
    starts = F.filter(F.sequence(F.lit(0), F.greatest(F.size(column) - 3, F.lit(0)), F.lit(3)), lambda i: i + 2 < F.size(column))
    points = F.transform(starts, lambda i: F.struct((F.get(F.col(column), i) + offset).alias("x"), (F.get(F.col(column), i + 1) + offset).alias("y")))
    return rows.select("image_id", F.posexplode(points).alias("idx", "p")).select("image_id", "idx", "p.x", "p.y")


def flatten_keypoints(kp: DataFrame) -> DataFrame:
    """(image_id, keypoints): x, y, 2 of all keypoints in order; one image's keypoints are a few hundred."""
    points = F.array_sort(F.collect_list(F.struct("idx", "x", "y")))
    two = F.lit(2).cast(kp.schema["x"].dataType)
    return kp.groupBy("image_id").agg(F.flatten(F.transform(points, lambda p: F.array(p.x, p.y, two))).alias("keypoints"))


def rescale_up(c: str, factor: int = 4) -> Column:
    return F.floor(F.col(c) * factor + factor // 2)


def rescale_down(c: str, factor: int = 4) -> Column:
    """Truncated towards zero."""
    return (F.col(c) / factor).cast("long")


def affine_keypoints(kp: DataFrame, matrices: DataFrame, margin: int = 0) -> DataFrame:
    """Keypoints moved by the image's matrix (a, b, c, d, e, f: rows of 2 x 3), in a frame shifted by the margin; truncated."""
    x, y = F.col("x") + margin, F.col("y") + margin
    moved = lambda p, q, r: (F.round(F.col(p) * x + F.col(q) * y + F.col(r), 6) - margin).cast("long")
    return kp.join(matrices, "image_id").select("image_id", "idx", moved("a", "b", "c").alias("x"), moved("d", "e", "f").alias("y"))


def sane_images(kp: DataFrame, width: int, least: int = 2) -> DataFrame:
    """(image_id) of images with at least `least` keypoints, all within [0, width)."""
    inside = F.bool_and((F.col("x") >= 0) & (F.col("x") < width) & (F.col("y") >= 0) & (F.col("y") < width))
    return kp.groupBy("image_id").agg(F.count("*").alias("n"), inside.alias("inside")).where((F.col("n") >= least) & F.col("inside")).select("image_id")


def same_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    """(image_id) of images that have as many keypoints after a transform as before."""
    a, b = before.groupBy("image_id").agg(F.count("*").alias("n")), after.groupBy("image_id").agg(F.count("*").alias("m"))
    return a.join(b, "image_id").where("n = m").select("image_id")


def clean_only(images: DataFrame, atoms: DataFrame, bad: Column) -> DataFrame:
    """Images without an atom that is bad (a placeholder or a display label)."""
    return images.join(atoms.where(bad).select("image_id").distinct(), "image_id", "left_anti")


def benchmark_filter(flags: DataFrame, clean: bool) -> DataFrame:
    """flags (are_markush, are_molecules, are_abbreviated arrays of boolean, nb_structures): keeps exactly one structure that isn't markush, and with
    clean not abbreviated either; rows with no molecule flag set go."""
    any_of = lambda c: F.exists(c, lambda x: x)
    good = ~any_of("are_markush") & (F.col("nb_structures") == 1) & any_of("are_molecules")
    return flags.where(good & ~any_of("are_abbreviated") if clean else good)


def position_slice(rows: DataFrame, order: str, low: int, high: int, by: str | None = None) -> DataFrame:
    """Rows at positions strictly between low and high, from 0, within each value of `by`: of each value, a task passes on no more than its first `high`
    rows. Without `by`, positions are given range by range of order, so the whole table is no task's work; rows that are equal in order come as they stand."""
    if by:
        placed = rows.withColumn("__n", F.row_number().over(Window.partitionBy(by).orderBy(order))).where(F.col("__n") <= high).withColumn("position", F.col("__n") - 1).drop("__n")
    else:
        placed = ranked(saved(rows, "rows"), [], [order], "positions").withColumnRenamed("place", "position").drop("size")
    return placed.where((F.col("position") > low) & (F.col("position") < high))


def head_n(rows: DataFrame, order: str, n: int, by: str | None = None) -> DataFrame:
    """The first n rows by position, within each value of `by`: without it a top-n of each task first, then of all."""
    return position_slice(rows, order, -1, n, by).drop("position") if by else rows.orderBy(order).limit(n)


def concat_shards(shards: list[DataFrame]) -> DataFrame:
    """The rows of all shards; columns that a shard lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), shards)


def drop_ids(rows: DataFrame, bad: DataFrame, key: str) -> DataFrame:
    return rows.join(bad.select(key).distinct(), key, "left_anti")


def dropped_share(before: DataFrame, after: DataFrame, by: str) -> DataFrame:
    """Share of rows lost, rounded to 4 places, for each value of `by`."""
    a, b = before.groupBy(by).agg(F.count("*").alias("n")), after.groupBy(by).agg(F.count("*").alias("m"))
    return a.join(b, by, "left").select(by, F.round(1 - F.coalesce("m", F.lit(0)) / F.col("n"), 4).alias("dropped"))


def jitter_keypoints(kp: DataFrame, u: Column, v: Column, high: float, low: int, width: int) -> DataFrame:
    """Keypoints moved within a disc of radius high: u gives the radius (square root), v the angle, both from 0 to 1; clamped to [low, width - 1]."""
    r, angle = F.sqrt(u) * high, v * 2 * F.acos(F.lit(-1.0))
    clamp = lambda c: F.least(F.greatest(F.round(c, 4), F.lit(float(low))), F.lit(float(width - 1)))
    return kp.select("image_id", "idx", clamp(F.col("x") + r * F.cos(angle)).alias("x"), clamp(F.col("y") + r * F.sin(angle)).alias("y"))


def add_decoys(nodes: DataFrame, edges: DataFrame, chance: Column, pick: Column, dx: int, dy: int) -> tuple[DataFrame, DataFrame]:
    """In images where chance holds, the node that pick ranks first is copied to a shifted place as class Decoy, numbered after all others, with
    Decoy edges to the original and to its neighbours."""
    chosen = nodes.where(chance).withColumn("__n", F.row_number().over(Window.partitionBy("image_id").orderBy(pick, "idx"))).where("__n = 1")
    size = nodes.groupBy("image_id").agg((F.max("idx") + 1).alias("new"))
    made = chosen.join(size, "image_id").select("image_id", "idx", "new", (F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    copies = made.select("image_id", F.col("new").alias("idx"), "x", "y", F.lit("Decoy").alias("class"))
    near = edges.join(made.select("image_id", "idx", "new"), "image_id").where("b = idx or e = idx").select("image_id", F.when(F.col("b") == F.col("idx"), F.col("e")).otherwise(F.col("b")).alias("b"), F.col("new").alias("e"))
    links = near.unionByName(made.select("image_id", F.col("idx").alias("b"), F.col("new").alias("e"))).withColumn("class", F.lit("Decoy"))
    return nodes.unionByName(copies), edges.select("image_id", "b", "e", "class").unionByName(links)


def batch_score(rows: DataFrame, scorer: Callable, schema: str, chunk: int = 200) -> DataFrame:
    """rows with what scorer (an iterator of pandas frames to one) makes of them, at most `chunk` rows at a time; the model is loaded once a task."""

    def chunked(frames):
        def pieces():
            for frame in frames:
                for a in range(0, len(frame), chunk):
                    yield frame.iloc[a : a + chunk]

        return scorer(pieces())

    return rows.mapInPandas(chunked, schema)


def drop_short_batches(rows: DataFrame, batch: str, n: int) -> DataFrame:
    """Rows of batches that have at least n."""
    return rows.withColumn("__n", F.count("*").over(Window.partitionBy(batch))).where(F.col("__n") >= n).drop("__n")
