"""Sparse raster tables: ink(image_id, x, y), cells(image_id, y, x, v)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..scratch import remove, saved
from .blocks import by_image, image_numbers, least_linked, numbers, written


def binarise(cells: DataFrame, threshold: float = 0.6) -> DataFrame:
    """Cells that are ink: not above the threshold."""
    return cells.where(F.col("v") <= threshold)


def tight_bbox(ink: DataFrame, images: DataFrame, width: int, least: int = 60) -> DataFrame:
    """(image_id, x0, y0, x1, y1): the box around the ink; widened by half the missing length on each side where both sides are no longer than
    `least`; the whole image where there is no ink."""
    box = ink.groupBy("image_id").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1"))
    small = (F.col("x1") - F.col("x0") <= least) & (F.col("y1") - F.col("y0") <= least)
    padx, pady = (F.floor((least - (F.col(b) - F.col(a))) / 2) for a, b in (("x0", "x1"), ("y0", "y1")))
    sides = {"x0": F.col("x0") - padx, "y0": F.col("y0") - pady, "x1": F.col("x1") + padx, "y1": F.col("y1") + pady}
    box = box.select("image_id", *[F.when(small, v).otherwise(F.col(k)).alias(k) for k, v in sides.items()])
    return images.select("image_id").join(box, "image_id", "left").select("image_id", *[F.coalesce(F.col(k), F.lit(0 if k in ("x0", "y0") else width)).cast("long").alias(k) for k in ("x0", "y0", "x1", "y1")])


def _near_ink(edges: DataFrame, ink: DataFrame, half: Column, test: Column, cell: int) -> DataFrame:
    """Edges joined with the ink cells around (cx, cy) within `half`: by the grid squares that the window covers, so an equi join."""
    span = lambda c: F.sequence(F.floor((F.col(c) - F.col("__half")) / cell), F.floor((F.col(c) + F.col("__half")) / cell))
    squares = edges.withColumn("__half", half).withColumn("__gx", F.explode(span("cx"))).withColumn("__gy", F.explode(span("cy")))
    dots = ink.select("image_id", F.col("x").alias("ix"), F.col("y").alias("iy"), F.floor(F.col("x") / cell).alias("__gx"), F.floor(F.col("y") / cell).alias("__gy"))
    return squares.join(dots, ["image_id", "__gx", "__gy"]).where(test)


def _centred(edges: DataFrame) -> DataFrame:
    return edges.withColumn("cx", F.floor((F.col("bx") + F.col("ex")) / 2)).withColumn("cy", F.floor((F.col("by") + F.col("ey")) / 2))


def inked_edges(edges: DataFrame, ink: DataFrame, share: float = 0.3, least: int = 15, cell: int = 64) -> DataFrame:
    """Edges with at least one ink cell in the upright window around their floored midpoint, of side max(int(share * bond_size), least), the
    upper bounds left out."""
    side = F.greatest(F.floor(share * F.col("bond_size")), F.lit(least))
    low, high = F.floor(side / 2), side - F.floor(side / 2)
    inside = lambda i, c: (F.col(i) >= F.col(c) - low) & (F.col(i) < F.col(c) + high)
    hit = _near_ink(_centred(edges), ink, side, inside("ix", "cx") & inside("iy", "cy"), cell).select("image_id", "b", "e").distinct()
    return edges.join(hit, ["image_id", "b", "e"], "left_semi")


def _turned(cx: str, cy: str, side: Column) -> Column:
    """Ink strictly within the square of this side around (cx, cy), turned along the edge."""
    ux, uy = (F.col("ex") - F.col("bx")) / F.col("dist"), (F.col("ey") - F.col("by")) / F.col("dist")
    dx, dy = F.col("ix") - F.col(cx), F.col("iy") - F.col(cy)
    return (F.round(F.abs(dx * ux + dy * uy), 6) < side / 2) & (F.round(F.abs(dx * uy - dy * ux), 6) < side / 2)


def inked_edges_rotated(edges: DataFrame, ink: DataFrame, share: float = 0.3, cell: int = 64) -> DataFrame:
    """As inked_edges, with the square of share * bond_size turned along the edge."""
    side = share * F.col("bond_size")
    hit = _near_ink(_centred(edges).where("dist > 0"), ink, side, _turned("cx", "cy", side), cell).select("image_id", "b", "e").distinct()
    return edges.join(hit, ["image_id", "b", "e"], "left_semi")


def wedge_direction(edges: DataFrame, ink: DataFrame, share: float = 0.3, cell: int = 64) -> DataFrame:
    """(image_id, b, e, ink_b, ink_e, direction) of edges with length: UP where the quarter next to b has less ink than that next to e, else DOWN."""
    side = share * F.col("bond_size")
    counts = []
    for name, (near, far) in {"b": ("b", "e"), "e": ("e", "b")}.items():
        at = edges.where("dist > 0").withColumn("cx", F.floor((3 * F.col(near + "x") + F.col(far + "x")) / 4)).withColumn("cy", F.floor((3 * F.col(near + "y") + F.col(far + "y")) / 4))
        counts.append(_near_ink(at, ink, side, _turned("cx", "cy", side), cell).groupBy("image_id", "b", "e").agg(F.count("*").alias(f"ink_{name}")))
    keys = ["image_id", "b", "e"]
    rows = edges.where("dist > 0").select(*keys).join(counts[0], keys, "left").join(counts[1], keys, "left").na.fill(0, ["ink_b", "ink_e"])
    return rows.withColumn("direction", F.when(F.col("ink_b") < F.col("ink_e"), "UP").otherwise("DOWN"))


def heat_sigma(sizes: DataFrame) -> DataFrame:
    """(image_id, sigma) of (image_id, bond_size): max(round(bond_size / 40), 2)."""
    return sizes.select("image_id", F.greatest(F.round(F.col("bond_size") / 40), F.lit(2.0)).alias("sigma"))


def render_heatmap(kp: DataFrame, sigma: DataFrame, width: int = 256) -> DataFrame:
    """(image_id, y, x, v): the greatest of Gaussian patches around the keypoints, of radius 3 sigma (image_id, sigma); images with a patch
    that lies outside altogether are left out."""
    both = kp.join(sigma, "image_id").withColumn("r", F.floor(3 * F.col("sigma")).cast("int"))
    outside = (F.col("x") + F.col("r") < 0) | (F.col("y") + F.col("r") < 0) | (F.col("x") - F.col("r") >= width) | (F.col("y") - F.col("r") >= width)
    good = both.join(both.where(outside).select("image_id").distinct(), "image_id", "left_anti")
    cells = good.withColumn("dx", F.explode(F.sequence(-F.col("r"), F.col("r")))).withColumn("dy", F.explode(F.sequence(-F.col("r"), F.col("r"))))
    value = F.exp(-(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")) / (2 * F.col("sigma") * F.col("sigma")))
    cells = cells.select("image_id", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"), value.alias("v"))
    inside = F.col("x").between(0, width - 1) & F.col("y").between(0, width - 1)
    return cells.where(inside).groupBy("image_id", "y", "x").agg(F.round(F.max("v"), 6).alias("v"))


def _block_maxima(table: pa.Table, n: int) -> pa.Table:
    """As _maxima, for the cells of some images: each offset of the neighbourhood is one search for all cells among the sorted cells."""
    image, names = image_numbers(table)
    y, x, v, is_open = numbers(table, "y", "x", "v") + [table.column("open").to_numpy(zero_copy_only=False)]
    r = n // 2
    x0, y0 = x.min() - r, y.min() - r
    wide = int(x.max() - x0) + r + 1
    tall = int(y.max() - y0) + r + 1
    key = (image * tall + (y - y0)) * wide + (x - x0)
    order = np.argsort(key, kind="stable")
    sorted_key, tried = key[order], np.flatnonzero(is_open)
    low = np.zeros(len(key), bool)
    links = []
    for dy in range(-r, r + 1):
        for dx in range(-r, r + 1):
            if not dy and not dx:
                continue
            ask = key[tried] + dy * wide + dx
            at = np.minimum(np.searchsorted(sorted_key, ask), len(key) - 1)
            there = sorted_key[at] == ask
            mine, other = tried[there], order[at[there]]
            low[mine] |= (v[other] > v[mine]) | ((v[other] == v[mine]) & ~is_open[other])
            same = (v[other] == v[mine]) & is_open[other] & (mine < other)
            links.append(np.stack([mine[same], other[same]]))
    pairs = np.concatenate([*links, np.zeros((2, 0), np.int64)], axis=1)
    head = least_linked(len(key), pairs[0], pairs[1])
    sunk = np.zeros(len(key), bool)
    sunk[head[low]] = True
    return table.filter(pa.array(is_open & ~sunk[head])).select(["image_id", "y", "x", "v", "cell"])


def _maxima(cells: DataFrame, n: int, most: int | None = None) -> DataFrame:
    """The open cells of (image_id, y, x, v, cell, open) with no greater cell in their n x n neighbourhood nor beside any cell of their plateau,
    which is the set of equal cells linked by such neighbourhoods; cells that aren't open are known to be none. A task works on whole images; those of
    more than `most` cells go by joins."""
    kinds = {f.name: f.dataType.simpleString() for f in cells.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("image_id", "y", "x", "v", "cell"))
    rows, large = written(cells.select("image_id", "y", "x", "v", "cell", "open"), "cells", most)
    if large is None:
        out = saved(by_image(rows, lambda table: _block_maxima(table, n), schema), "maxima")
        remove(rows)
        return out
    return by_image(rows.join(large, "image_id", "left_anti"), lambda table: _block_maxima(table, n), schema).unionByName(_joined_maxima(rows.join(large, "image_id", "left_semi"), n))


def _joined_maxima(cells: DataFrame, n: int) -> DataFrame:
    from .components import components

    r = n // 2
    high = cells.where("open")
    offsets = F.explode(F.sequence(F.lit(-r), F.lit(r)))
    around = high.withColumn("dy", offsets).withColumn("dx", offsets).where("dx != 0 or dy != 0")
    around = around.select("image_id", "cell", "v", (F.col("y") + F.col("dy")).alias("y"), (F.col("x") + F.col("dx")).alias("x"))
    pairs = around.join(cells.select("image_id", "y", "x", F.col("v").alias("w"), F.col("cell").alias("other"), F.col("open").alias("other_open")), ["image_id", "y", "x"])
    below = pairs.where("w > v or (w = v and not other_open)").select("image_id", "cell").distinct()
    flat = components(pairs.where("w = v and other_open").select("image_id", F.col("cell").alias("a"), F.col("other").alias("b")))
    named = high.join(flat.select("image_id", F.col("node").alias("cell"), "component"), ["image_id", "cell"], "left").withColumn("plateau", F.coalesce("component", "cell"))
    lower = named.join(below, ["image_id", "cell"], "left_semi").select("image_id", "plateau").distinct()
    return named.join(lower, ["image_id", "plateau"], "left_anti").select("image_id", "y", "x", "v", "cell")


def heatmap_peaks(cells: DataFrame, threshold: float = 0.1, n: int = 5, long_bond: float = 35.0, wide: int = 15, most: int = 300) -> DataFrame:
    """(image_id, y, x, v): cells above the threshold that are regional maxima under n x n neighbourhoods; all cells of a plateau count. Images
    of 2 to `most` peaks whose bond size is over long_bond are done again with `wide`; their peaks are among the first ones, so only these
    are tried."""
    from .geometry import bond_size

    high = cells.where(F.col("v") > threshold).select("image_id", "y", "x", "v", (F.col("y").cast("long") * (1 << 20) + F.col("x")).alias("cell"))
    first = _maxima(high.withColumn("open", F.lit(True)), n)
    few = first.groupBy("image_id").count().where(F.col("count").between(2, most)).select("image_id")
    sizes = bond_size(first.join(few, "image_id", "left_semi").select("image_id", F.col("cell").alias("idx"), "x", "y"))
    again = saved(sizes.where(F.col("bond_size") > long_bond).select("image_id"), "long-bonds")
    tried = first.select("image_id", "cell", F.lit(True).alias("open"))
    rest = high.join(again, "image_id", "left_semi").join(tried, ["image_id", "cell"], "left").withColumn("open", F.coalesce("open", F.lit(False)))
    return first.join(again, "image_id", "left_anti").unionByName(_maxima(rest, wide)).drop("cell")
