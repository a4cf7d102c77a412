"""Point sets of images: neighbours, candidate edges, obstruction, matching by boxes.

Tables are keyed by image_id; keypoints(image_id, idx, x, y) with idx in scan order; edges(image_id, b, e) with b > e."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import remove, saved

#: Side of the grid squares by which points and boxes meet.
SQUARE = 64


def distance(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """Euclidean, rounded to 6 places, so that ties are ties on every engine."""
    return F.round(F.sqrt((x0 - x1) * (x0 - x1) + (y0 - y1) * (y0 - y1)), 6)


def squares(x0: Column, y0: Column, x1: Column, y1: Column, cell: int | Column = SQUARE) -> Column:
    """The grid squares that a box touches, for F.inline: (gx, gy)."""
    span = lambda a, b: F.sequence(F.floor(a / cell), F.floor(b / cell))
    return F.flatten(F.transform(span(x0, x1), lambda gx: F.transform(span(y0, y1), lambda gy: F.struct(gx.alias("gx"), gy.alias("gy")))))


def points_in_boxes(boxes: DataFrame, points: DataFrame, cell: int = SQUARE) -> DataFrame:
    """boxes (image_id, x0, y0, x1, y1, ...) joined with the points (image_id, x, y, ...) in them, borders included: an equi join on image and square."""
    inside = F.col("x").between(F.col("x0"), F.col("x1")) & F.col("y").between(F.col("y0"), F.col("y1"))
    spread = boxes.select("*", F.inline(squares(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), cell)))
    placed = points.withColumn("gx", F.floor(F.col("x") / cell)).withColumn("gy", F.floor(F.col("y") / cell))
    return spread.join(placed, ["image_id", "gx", "gy"]).where(inside).drop("gx", "gy")


#: Keypoints of an image that are compared pair by pair: as many as cap_keypoints keeps. Larger images go by widening squares.
MOST_PAIRED = 300
PAIRS = ["image_id", "b", "e", "bx", "by", "ex", "ey", "dist"]


def _ends(kp: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The keypoints as upper ends (image_id, b, bx, by) and as lower ends (image_id, e, ex, ey)."""
    return tuple(kp.select("image_id", F.col("idx").alias(end), F.col("x").cast("double").alias(f"{end}x"), F.col("y").cast("double").alias(f"{end}y")) for end in "be")


def _with_distance(pairs: DataFrame) -> DataFrame:
    return pairs.where("b > e").withColumn("dist", distance(F.col("bx"), F.col("by"), F.col("ex"), F.col("ey"))).select(*PAIRS)


def nearest_lower(kp: DataFrame, k: int = 6, most: int = MOST_PAIRED) -> DataFrame:
    """(image_id, b, e, bx, by, ex, ey, dist, rank): the k nearest lower-index keypoints of each keypoint; ties go to the lower index.

    Images of up to `most` keypoints are compared pair by pair. In a larger image keypoints meet those in their grid square and the eight around it. All
    keypoints nearer than a square's side are among these, so a keypoint whose k-th neighbour is nearer is settled; the others go on with squares of twice
    the side. Squares begin with about two keypoints each, and after a round with squares of n keypoints only about one in n / k of the keypoints is
    open, so each round looks at about as many pairs as the first."""
    sizes = kp.groupBy("image_id").agg(F.count("*").alias("n"), F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y")).alias("extent"))
    large = sizes.where(F.col("n") > most).select("image_id", F.greatest(F.col("extent") * F.sqrt(2 / F.col("n")), F.lit(1.0)).alias("side"), "extent")
    nearest = Window.partitionBy("image_id", "b").orderBy("dist", "e")
    ranked = lambda pairs: pairs.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)
    if large.isEmpty():
        b, e = _ends(kp)
        return ranked(_with_distance(b.join(e, "image_id")))
    large = saved(large, "large-images")
    b, e = _ends(kp.join(large, "image_id", "left_anti"))
    out = ranked(_with_distance(b.join(e, "image_id")))
    b, e = _ends(kp)
    open_ends, e = saved(b.join(large, "image_id"), "open"), e.join(large.select("image_id"), "image_id", "left_semi")
    while not open_ends.isEmpty():
        square = lambda c: F.floor(F.col(c) / F.col("side"))
        sides = open_ends.select("image_id", "side").distinct()
        around = open_ends.select("*", F.inline(squares(F.col("bx") - F.col("side"), F.col("by") - F.col("side"), F.col("bx") + F.col("side"), F.col("by") + F.col("side"), F.col("side"))))
        placed = e.join(sides, "image_id").select("image_id", "e", "ex", "ey", square("ex").alias("gx"), square("ey").alias("gy"))
        found = ranked(_with_distance(around.join(placed, ["image_id", "gx", "gy"])))
        far = found.groupBy("image_id", "b").agg(F.max("dist").alias("far"), F.count("*").alias("found"))
        near = F.coalesce((F.col("found") == k) & (F.col("far") < F.col("side")), F.lit(False)) | (F.col("side") > F.col("extent"))
        judged = saved(open_ends.join(far, ["image_id", "b"], "left").withColumn("settled", near).drop("far", "found"), "judged")
        out = out.unionByName(saved(found.join(judged.where("settled").select("image_id", "b"), ["image_id", "b"], "left_semi"), "nearest"))
        rest = saved(judged.where("not settled").drop("settled").withColumn("side", F.col("side") * 2), "open")
        remove(open_ends, judged)
        open_ends = rest
    remove(open_ends)
    return out


def bond_size(kp: DataFrame, default: float = 100.0, most: int = MOST_PAIRED) -> DataFrame:
    """(image_id, bond_size): linear 75th percentile of each keypoint's distance to its nearest lower-index one; default where there is no pair."""
    sizes = nearest_lower(kp, 1, most).groupBy("image_id").agg(F.percentile("dist", F.lit(0.75)).alias("size"))
    return kp.select("image_id").distinct().join(sizes, "image_id", "left").select("image_id", F.coalesce("size", F.lit(default)).alias("bond_size"))


def cap_keypoints(kp: DataFrame, most: int = 300) -> DataFrame:
    """The first `most` keypoints of each image in scan order."""
    w = Window.partitionBy("image_id").orderBy("idx")
    return kp.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def in_turned_box(px: Column, py: Column, edges_have: str = "", along: float = 0.8, across: float = 0.2) -> Column:
    """Whether a point lies strictly inside the rectangle around an edge's floored midpoint, turned along the edge: int(along * length) long and
    int(across * length) wide."""
    bx, by, ex, ey, d = (F.col(edges_have + c) for c in ("bx", "by", "ex", "ey", "dist"))
    mx, my = F.floor((bx + ex) / 2), F.floor((by + ey) / 2)
    ux, uy = (ex - bx) / d, (ey - by) / d
    lengthwise = F.abs((px - mx) * ux + (py - my) * uy)
    sideways = F.abs((px - mx) * uy - (py - my) * ux)
    return (F.round(lengthwise, 6) < F.floor(d * along) / 2) & (F.round(sideways, 6) < F.floor(d * across) / 2)


def unobstructed(edges: DataFrame, kp: DataFrame) -> DataFrame:
    """Edges without a keypoint in the turned rectangle between their ends. Edges of no length have no rectangle and stay."""
    half = F.ceil(F.col("dist") / 2) + 1  # the turned rectangle lies in this square around the middle
    middle = {c: (F.col(f"b{c}") + F.col(f"e{c}")) / 2 for c in "xy"}
    around = edges.where("dist > 0").select("image_id", "b", "e", "bx", "by", "ex", "ey", "dist", *[(middle[c] + k * half).alias(f"{c}{i}") for c in "xy" for i, k in ((0, -1), (1, 1))])
    points = kp.select("image_id", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    hit = points_in_boxes(around, points).where(in_turned_box(F.col("x"), F.col("y"))).select("image_id", "b", "e").distinct()
    return edges.join(hit, ["image_id", "b", "e"], "left_anti")


def propose_edges(kp: DataFrame, factor: float = 1.75, k: int = 6, ink: DataFrame | None = None, restricted: bool = True) -> DataFrame:
    """Nearest lower neighbours; unless not restricted, those that are no longer than factor bond sizes, not obstructed and, where ink is given, drawn over."""
    if not restricted:
        return nearest_lower(kp, k).join(bond_size(kp), "image_id")
    size = bond_size(kp)
    near = nearest_lower(kp, k).join(size, "image_id").where(F.col("dist") <= factor * F.col("bond_size"))
    clear = unobstructed(near, kp)
    if ink is not None:
        from .raster import inked_edges

        clear = inked_edges(clear, ink)
    return clear


def missing_edges(proposed: DataFrame, truth: DataFrame) -> DataFrame:
    """Proposed edges that truth has in neither direction."""
    pair = [F.least("b", "e").alias("__lo"), F.greatest("b", "e").alias("__hi")]
    return proposed.select("*", *pair).join(truth.select("image_id", *pair).distinct(), ["image_id", "__lo", "__hi"], "left_anti").drop("__lo", "__hi")


def crowded_images(gt: DataFrame, w: int = 10) -> DataFrame:
    """(image_id) of images in which two true boxes of half width w overlap."""
    boxes = gt.select("image_id", F.col("idx").alias("i"), *_box(w))
    return points_in_boxes(boxes, gt.select("image_id", "idx", "x", "y"), 2 * w).where("i < idx").select("image_id").distinct()


def _box(w: int) -> list[Column]:
    """The square around a point of whole numbers in which other points are nearer than 2 w in x and in y."""
    return [(F.col(c) + k * (2 * w - 1)).alias(f"{c}{i}") for c in "xy" for i, k in ((0, -1), (1, 1))]


def matched_truth(gt: DataFrame, pred: DataFrame, w: int = 10) -> DataFrame:
    """True keypoints with a predicted box that overlaps theirs; places are whole numbers."""
    boxes = gt.select("image_id", "idx", *_box(w))
    hit = points_in_boxes(boxes, pred.select("image_id", "x", "y"), 2 * w).select("image_id", "idx").distinct()
    return gt.join(hit, ["image_id", "idx"], "left_semi")


def keypoint_scores(gt: DataFrame, pred: DataFrame, w: int = 10) -> DataFrame:
    """(image_id, n_gt, n_pred, matched, precision, recall) of images that aren't crowded; null where nothing was predicted."""
    count = lambda df, name: df.groupBy("image_id").agg(F.count("*").alias(name))
    rows = count(gt, "n_gt").join(count(pred, "n_pred"), "image_id", "left").join(count(matched_truth(gt, pred, w), "matched"), "image_id", "left")
    rows = rows.join(crowded_images(gt, w), "image_id", "left_anti").na.fill(0, ["n_pred", "matched"])
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a) / F.col(b), 6))
    return rows.withColumn("precision", share("matched", "n_pred")).withColumn("recall", share("matched", "n_gt"))


def keypoint_summary(scores: DataFrame) -> DataFrame:
    """(images, both_one, precision, recall) of keypoint_scores: the share of images with both scores 1, and the means; an image without a score has 0."""
    of = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    both = F.when((of("precision") == 1) & (of("recall") == 1), 1.0).otherwise(0.0)
    return scores.agg(F.count("*").alias("images"), F.round(F.avg(both), 6).alias("both_one"), F.round(F.avg(of("precision")), 6).alias("precision"), F.round(F.avg(of("recall")), 6).alias("recall"))


def overlapping_boxes(boxes: DataFrame, margin: int = 30) -> DataFrame:
    """(image_id, a, b), a < b: pairs whose gap in x is below the margin and whose extents in y overlap."""
    sides = ("x0", "y0", "x1", "y1")
    wide = squares(F.col("x0") - margin, F.col("y0"), F.col("x1") + margin, F.col("y1"))
    a = boxes.select("image_id", F.col("box_id").alias("a"), *[F.col(c).alias(f"a_{c}") for c in sides], F.inline(wide))
    b = boxes.select("image_id", F.col("box_id").alias("b"), *[F.col(c).alias(f"b_{c}") for c in sides], F.inline(squares(*map(F.col, sides))))
    apart = F.greatest(F.col("a_x0") - F.col("b_x1"), F.col("b_x0") - F.col("a_x1"))
    level = (F.col("a_y0") < F.col("b_y1")) & (F.col("b_y0") < F.col("a_y1"))
    return a.join(b, ["image_id", "gx", "gy"]).where((F.col("a") < F.col("b")) & (apart < margin) & level).select("image_id", "a", "b").distinct()


def nodes_in_boxes(nodes: DataFrame, boxes: DataFrame, least: int = 2) -> DataFrame:
    """(image_id, box_id, idx) of the boxes that hold at least `least` nodes, borders included."""
    held = points_in_boxes(boxes, nodes.select("image_id", "idx", "x", "y"))
    w = Window.partitionBy("image_id", "box_id")
    return held.withColumn("__n", F.count("*").over(w)).where(F.col("__n") >= least).select("image_id", "box_id", "idx")


def trisect(edges: DataFrame, n: int = 3) -> DataFrame:
    """n points on each edge (bx, by, ex, ey), with weights k and n + 1 - k; adds k, px, py."""
    at = lambda a, b: F.round((F.col("k") * F.col(b) + (n + 1 - F.col("k")) * F.col(a)) / (n + 1), 6)
    return edges.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("px", at("bx", "ex")).withColumn("py", at("by", "ey"))


def grid_points(images: DataFrame, width: int, step: int) -> DataFrame:
    """(image_id, idx, x, y): a regular grid over each image, x first."""
    per = -(-width // step)
    cells = images.select("image_id", F.explode(F.sequence(F.lit(0), F.lit(per * per - 1))).alias("idx"))
    return cells.select("image_id", "idx", (F.floor(F.col("idx") / per) * step).cast("int").alias("x"), ((F.col("idx") % per) * step).cast("int").alias("y"))


def grid_edges(points: DataFrame) -> DataFrame:
    """(image_id, b, e): each point with the next below it in its column; the last of a column links with none."""
    w = Window.partitionBy("image_id", "x").orderBy("y")
    return points.select("image_id", F.col("idx").alias("b"), F.lead("idx").over(w).alias("e")).where("e is not null")
