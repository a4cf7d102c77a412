"""Fixed points over image graphs: connected components, merged boxes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..scratch import remove, saved
from .blocks import by_image, image_numbers, least_linked, numbers, written
from .geometry import overlapping_boxes

LABELS = "image_id string, node long, component long"


def _labelled(table: pa.Table) -> pa.Table:
    """(image_id, node, component) of the links (image_id, a, b) of some images."""
    image, names = image_numbers(table)
    a, b = numbers(table, "a", "b")
    value, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    # nodes in the order of (image, node), so the least number of a part is its least node
    key, place = np.unique(np.concatenate([image, image]) * len(value) + code, return_inverse=True)
    least = least_linked(len(key), place[: len(a)], place[len(a) :])
    return pa.table({"image_id": names.take(pa.array(key // len(value))), "node": value[key % len(value)], "component": value[key[least] % len(value)]}, pa.schema([("image_id", pa.string()), ("node", pa.int64()), ("component", pa.int64())]))


def components(links: DataFrame, most: int | None = None) -> DataFrame:
    """(image_id, node, component) of every node of links (image_id, a, b); component is the least node that links reach within the image.

    Images of up to `most` links (blocks.IMAGE_ROWS) are settled in one task each, many a block. What is left, the links of larger ones, is first
    thinned task by task to a forest of the links there, then contracted: every node joins the neighbour, or itself, that a hash ranks first. That
    takes several nodes to one, so images soon are small enough; what each node became is looked up at the end."""
    columns = links.select(F.col("image_id").cast("string").alias("image_id"), F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))
    left, large = written(columns, "links", most)
    if large is None:
        out = saved(by_image(left, _labelled, LABELS), "components")
        remove(left)
        return out
    settled, became, spent = [], [], [left]
    small = lambda rows, large: by_image(rows.join(large, "image_id", "left_anti"), _labelled, LABELS)
    while True:
        settled.append(saved(small(left, large), "components"))  # images that have been small enough since the last round
        here = left.join(large, "image_id", "left_semi")
        forest = saved(_forest(here), "forest")
        both = forest.unionByName(forest.select("image_id", F.col("b").alias("a"), F.col("a").alias("b")))
        ranked = lambda c, turn=len(became): F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("n"))
        first = both.groupBy("image_id", F.col("a").alias("node")).agg(F.min(ranked("b")).alias("x"))
        leaders = saved(first.select("image_id", "node", F.least("x", ranked("node"))["n"].alias("leader")), "leaders")
        to = lambda rows, end: rows.join(leaders.withColumnRenamed("node", end), ["image_id", end]).drop(end).withColumnRenamed("leader", end)
        left, large = written(to(to(forest, "a"), "b").where("a != b").select("image_id", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "links", most)
        became.append(leaders)
        spent += [forest, left, leaders, settled[-1]]
        if large is None:
            break
    last = saved(by_image(left, _labelled, LABELS), "components")
    for turn in range(len(became) - 1, -1, -1):
        leaders, known = became[turn], last.select("image_id", F.col("node").alias("leader"), "component")
        last = leaders.join(known, ["image_id", "leader"], "left").select("image_id", "node", F.coalesce("component", "leader").alias("component"))
        last = saved(last.unionByName(settled[turn]) if turn else last, "contracted")
        spent.append(last)
    least = last.groupBy("image_id", "component").agg(F.min("node").alias("least"))
    named = last.join(least, ["image_id", "component"]).select("image_id", "node", F.col("least").alias("component"))
    named = named.unionByName(settled[0])
    # nodes of large images that are linked with themselves alone have no place in a forest
    loops = spent[0].where("a = b").select("image_id", F.col("a").alias("node")).distinct().join(named, ["image_id", "node"], "left_anti")
    out = saved(named.unionByName(loops.withColumn("component", F.col("node"))), "components")
    remove(*spent)
    return out


def _forest(links: DataFrame) -> DataFrame:
    """The links that some links of large images, wherever they lie, leave: one for each node that isn't the least of its part of a block."""

    def thin(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.num_rows
            if size >= 1_000_000:
                yield from stars(held)
                held, size = [], 0
        if size:
            yield from stars(held)

    def stars(held):
        found = _labelled(pa.Table.from_batches(held).combine_chunks())
        kept = found.filter(pa.compute.not_equal(found["node"], found["component"]))
        yield from pa.table({"image_id": kept["image_id"], "a": kept["component"], "b": kept["node"]}).to_batches()

    return links.mapInArrow(thin, "image_id string, a long, b long").distinct()


def _counted(table: pa.Table) -> pa.Table:
    """(image_id, fragments) of the rows (image_id, a, b, node) of some images: 0 for a link, 1 for a node, which is linked with itself, 2 for a
    node without a number, which is none."""
    image, names = image_numbers(table)
    a, b, node = numbers(table, "a", "b", "node")
    value, code = np.unique(np.concatenate([a, b]), return_inverse=True)
    key, place = np.unique(np.concatenate([image, image]) * len(value) + code, return_inverse=True)
    least = least_linked(len(key), place[: len(a)], place[len(a) :])
    parts = np.unique(least[place[: len(a)][node == 1]])
    found = np.bincount(key[parts] // len(value), minlength=len(names))
    there = np.unique(image[node > 0])
    return pa.table({"image_id": names.take(pa.array(there)), "fragments": found[there]}, pa.schema([("image_id", pa.string()), ("fragments", pa.int64())]))


def fragment_counts(nodes: DataFrame, edges: DataFrame, most: int | None = None) -> DataFrame:
    """(image_id, fragments): connected components of each image's nodes (image_id, idx), lone nodes included. Images of up to `most` rows are
    counted in one task each, many a block; larger ones by components()."""
    kind = nodes.schema["image_id"].dataType
    row = lambda d, a, b, node: d.select(F.col("image_id").cast("string").alias("image_id"), a.cast("long").alias("a"), b.cast("long").alias("b"), node.cast("int").alias("node"))
    here, idx = nodes.where("image_id is not null"), F.coalesce("idx", F.lit(0))
    links = edges.where("image_id is not null and b is not null and e is not null")
    rows, large = written(row(here, idx, idx, F.when(F.col("idx").isNull(), 2).otherwise(1)).unionByName(row(links, F.col("b"), F.col("e"), F.lit(0))), "rows", most)
    out = by_image(rows if large is None else rows.join(large, "image_id", "left_anti"), _counted, "image_id string, fragments long")
    if large is not None:
        left = rows.join(large, "image_id", "left_semi")
        named = left.where("node > 0").select("image_id", F.when(F.col("node") == 1, F.col("a")).alias("node")).join(components(left.where("node = 0").select("image_id", "a", "b"), most), ["image_id", "node"], "left")
        out = out.unionByName(named.groupBy("image_id").agg(F.countDistinct(F.coalesce("component", "node")).alias("fragments")))
    nameless = nodes.where("image_id is null").groupBy("image_id").agg(F.countDistinct("idx").alias("fragments"))
    out = saved(out.withColumn("image_id", F.col("image_id").cast(kind)).unionByName(nameless), "fragments")
    remove(rows)
    return out


SIDES = ("x0", "y0", "x1", "y1")
BOXES = "image_id string, box_id long, x0 double, y0 double, x1 double, y1 double"
#: Pairs of boxes that a sweep looks at in one go.
SWEPT = 2_000_000


def _touching(image: np.ndarray, sides: list[np.ndarray], margin: float):
    """(a, b) of overlapping boxes: along x, each box meets those that begin before it ends."""
    x0, y0, x1, y1 = sides
    order = np.lexsort((x0, image))
    # the end of each box's reach among the sorted beginnings of its image
    begin = np.unique(x0)
    place = image[order] * (len(begin) + 1) + np.searchsorted(begin, x0[order])
    reach = np.searchsorted(place, image[order] * (len(begin) + 1) + np.searchsorted(begin, x1[order] + margin, "left"), "left")
    reach = np.maximum(reach, np.arange(len(order)) + 1)
    count = reach - np.arange(len(order)) - 1
    ends, at = np.cumsum(count), 0
    while at < len(order):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SWEPT, "right")))
        n = count[at:upto]
        i = np.repeat(np.arange(at, upto), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(n) - n, n)
        i, j = order[i], order[j]
        apart = np.maximum(x0[i] - x1[j], x0[j] - x1[i])
        hit = (apart < margin) & (y0[i] < y1[j]) & (y0[j] < y1[i])
        yield i[hit], j[hit]
        at = upto


def _merged(table: pa.Table, margin: float) -> pa.Table:
    """The boxes of some images, merged until none overlap."""
    image, names = image_numbers(table)
    box, *sides = numbers(table, "box_id", *SIDES)
    order = np.lexsort((box, image))
    image, box, sides = image[order], box[order], [s[order] for s in sides]
    while True:
        pairs = [(i, j) for i, j in _touching(image, sides, margin) if len(i)]
        if not pairs:
            break
        head = least_linked(len(box), np.concatenate([i for i, _ in pairs]), np.concatenate([j for _, j in pairs]))
        for k, side in enumerate(sides):
            (np.minimum if k < 2 else np.maximum).at(side, head, side.copy())
        kept = head == np.arange(len(box))
        image, box, sides = image[kept], box[kept], [s[kept] for s in sides]
    return pa.table([names.take(pa.array(image)).cast(pa.string()), pa.array(box), *[pa.array(s) for s in sides]], names=["image_id", "box_id", *SIDES])


def merge_boxes(boxes: DataFrame, margin: int = 30, most: int | None = None) -> DataFrame:
    """(image_id, box_id, x0, y0, x1, y1): overlapping boxes replaced by the box around them, again and again until none overlap; box_id is the
    least of those merged. An image of up to `most` boxes is swept in one task; larger ones go by grid squares and components."""
    kind = boxes.schema["x0"].dataType
    now, large = written(boxes.select("image_id", F.col("box_id").cast("long").alias("box_id"), *[F.col(c).cast("double").alias(c) for c in SIDES]), "boxes", most)
    swept = lambda rows: by_image(rows, lambda table: _merged(table, margin), BOXES)
    out = swept(now) if large is None else swept(now.join(large, "image_id", "left_anti")).unionByName(_merged_by_rounds(now.join(large, "image_id", "left_semi"), margin))
    return out.select("image_id", "box_id", *[F.col(c).cast(kind).alias(c) for c in SIDES])


def _merged_by_rounds(now: DataFrame, margin: int) -> DataFrame:
    while True:
        pairs = saved(overlapping_boxes(now, margin), "pairs")
        if pairs.isEmpty():
            return now
        found = components(pairs)
        named = now.join(found.withColumnRenamed("node", "box_id"), ["image_id", "box_id"], "left")
        sides = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
        now = saved(named.groupBy("image_id", F.coalesce("component", "box_id").alias("box_id")).agg(*sides), "boxes")
        remove(pairs, found)
