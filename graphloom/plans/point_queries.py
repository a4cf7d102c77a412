"""Queries over keypoints, boxes, ink and heat."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import components, geometry, raster
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

DIST = "round(sqrt((cast(a.x as double) - b.x) * (cast(a.x as double) - b.x) + (cast(a.y as double) - b.y) * (cast(a.y as double) - b.y)), 6)"
LOWER = f"low as (select a.image_id, a.idx as b, b.idx as e, cast(a.x as double) as bx, cast(a.y as double) as by, cast(b.x as double) as ex, cast(b.y as double) as ey, {DIST} as dist from {{kp}} a join {{kp}} b on a.image_id = b.image_id and a.idx > b.idx)"
SIZE = "size as (select image_id, quantile_cont(m, 0.75) as bond_size from (select image_id, b, min(dist) as m from low group by all) group by 1)"
NEAR = "near as (select * from (select *, row_number() over (partition by image_id, b order by dist, e) as rank from low) where rank <= 6)"
IN_BOX = """round(abs((p.x - floor((bx + ex) / 2)) * (ex - bx) / dist + (p.y - floor((by + ey) / 2)) * (ey - by) / dist), 6) < floor(dist * 0.8) / 2
  and round(abs((p.x - floor((bx + ex) / 2)) * (ey - by) / dist - (p.y - floor((by + ey) / 2)) * (ex - bx) / dist), 6) < floor(dist * 0.2) / 2"""
PROPOSED = f"prop as (select n.* from near n join size s using (image_id) where dist <= 1.75 * bond_size and not exists (select 1 from {{kp}} p where p.image_id = n.image_id and n.dist > 0 and {IN_BOX}))"


@query(f"with {LOWER}, {SIZE} select k.image_id, round(coalesce(bond_size, 100), 6) as bond_size from (select distinct image_id from {{kp}}) k left join size using (image_id)")
def bond_size_by_image(t):
    return geometry.bond_size(t.kp).select("image_id", F.round("bond_size", 6).alias("bond_size"))


WHOLE = "kpl as (select cast(label as string) as image_id, cast(row_number() over (partition by label order by vec_id) - 1 as int) as idx, cast(floor(1000 * cast(embedding#0 as double)) as int) as x, cast(floor(1000 * cast(embedding#1 as double)) as int) as y from {embeddings})"


@query(f"with {WHOLE}, {LOWER.replace('{kp}', 'kpl')}, {NEAR} select image_id, b, e, dist, rank from near")
def candidate_edges_large(t):
    """One image for each label, which grows with the table: by widening squares."""
    order = Window.partitionBy("label").orderBy("vec_id")
    at = lambda k: F.floor(F.col("embedding")[k].cast("double") * 1000).cast("int")
    kp = t.embeddings.select(F.col("label").cast("string").alias("image_id"), (F.row_number().over(order) - 1).alias("idx"), at(0).alias("x"), at(1).alias("y"))
    return geometry.nearest_lower(kp, most=0).select("image_id", "b", "e", "dist", "rank")


@query(f"with {LOWER}, {NEAR} select image_id, b, e, dist, rank from near")
def candidate_edges(t):
    return geometry.nearest_lower(t.kp).select("image_id", "b", "e", "dist", F.col("rank").cast("long").alias("rank"))


@query(f"with {LOWER}, {SIZE}, {NEAR}, {PROPOSED} select image_id, b, e, dist from prop")
def proposed_edges(t):
    return geometry.propose_edges(t.kp).select("image_id", "b", "e", "dist")


INKED = "side as (select p.*, floor((bx + ex) / 2) as cx, floor((by + ey) / 2) as cy, greatest(floor(0.3 * bond_size), 15) as side from prop p join size using (image_id))"


@query(f"with {LOWER}, {SIZE}, {NEAR}, {PROPOSED}, {INKED} select image_id, b, e from side s where exists (select 1 from {{ink}} i where i.image_id = s.image_id and i.x >= cx - floor(side / 2) and i.x < cx + side - floor(side / 2) and i.y >= cy - floor(side / 2) and i.y < cy + side - floor(side / 2))")
def proposed_inked_edges(t):
    return geometry.propose_edges(t.kp, ink=t.ink).select("image_id", "b", "e")


@query(f"with {LOWER}, {SIZE}, {NEAR}, {PROPOSED}, truth as (select image_id, e as b, b as e from prop where (b + e) % 3 = 0) select image_id, b, e from prop p where not exists (select 1 from truth t where t.image_id = p.image_id and least(t.b, t.e) = least(p.b, p.e) and greatest(t.b, t.e) = greatest(p.b, p.e))")
def missing_edges(t):
    prop = geometry.propose_edges(t.kp).select("image_id", "b", "e")
    return geometry.missing_edges(prop, prop.where("(b + e) % 3 = 0").select("image_id", F.col("e").alias("b"), F.col("b").alias("e")))


@query("select image_id, idx, x, y from {kp} where idx < 30")
def cap_points(t):
    return geometry.cap_keypoints(t.kp, 30).select("image_id", "idx", "x", "y")


SCORES = """g as (select image_id, idx, 40 * x as x, 40 * y as y from {kp}), p as (select image_id, 40 * x + (vec_id * 7919) % 41 - 20 as x, 40 * y + (vec_id * 104729) % 41 - 20 as y from {kp} where x % 5 != 0),
crowd as (select distinct a.image_id from g a join g b on a.image_id = b.image_id and a.idx < b.idx and abs(a.x - b.x) < 20 and abs(a.y - b.y) < 20),
m as (select image_id, count(*) as matched from g where exists (select 1 from p where p.image_id = g.image_id and abs(p.x - g.x) < 20 and abs(p.y - g.y) < 20) group by 1),
s as (select a.image_id, n_gt, coalesce(n_pred, 0) as n_pred, coalesce(matched, 0) as matched, round(coalesce(matched, 0) / nullif(n_pred, 0), 6) as precision, round(coalesce(matched, 0) / n_gt, 6) as recall
from (select image_id, count(*) as n_gt from g group by 1) a left join (select image_id, count(*) as n_pred from p group by 1) b using (image_id) left join m using (image_id)
where a.image_id not in (select image_id from crowd))"""


def _scores(t):
    gt = t.kp.selectExpr("image_id", "idx", "40 * x as x", "40 * y as y")
    pred = t.kp.where("x % 5 != 0").selectExpr("image_id", "40 * x + (vec_id * 7919) % 41 - 20 as x", "40 * y + (vec_id * 104729) % 41 - 20 as y")
    return geometry.keypoint_scores(gt, pred)


@query(f"with {SCORES} select * from s")
def keypoint_pr(t):
    return _scores(t)


@query(f"with {SCORES} select count(*) as images, round(avg(case when precision = 1 and recall = 1 then 1.0 else 0.0 end), 6) as both_one, round(avg(coalesce(precision, 0)), 6) as precision, round(avg(coalesce(recall, 0)), 6) as recall from s")
def keypoint_totals(t):
    return geometry.keypoint_summary(_scores(t))


@query("""select a.image_id, a.box_id as a, b.box_id as b from {boxes} a join {boxes} b on a.image_id = b.image_id and a.box_id < b.box_id
where greatest(a.x0 - b.x1, b.x0 - a.x1) < 30 and a.y0 < b.y1 and b.y0 < a.y1""")
def box_overlaps(t):
    return geometry.overlapping_boxes(t.boxes)


@query()
def box_merge(t):
    return components.merge_boxes(t.boxes)


@query("""select image_id, box_id, idx from (select b.image_id, b.box_id, k.idx, count(*) over (partition by b.image_id, b.box_id) as n from {boxes} b join {kp} k on k.image_id = b.image_id and k.x between b.x0 and b.x1 and k.y between b.y0 and b.y1) where n >= 2""")
def crowded_boxes(t):
    return geometry.nodes_in_boxes(t.kp, t.boxes)


@query("select image_id, b, e, k, round((k * ex + (4 - k) * bx) / 4, 6) as px, round((k * ey + (4 - k) * by) / 4, 6) as py from {edges}, (select unnest([1, 2, 3]) as k)")
def trisect(t):
    return geometry.trisect(t.edges).select("image_id", "b", "e", "k", "px", "py")


@query("""with g as (select image_id, i as idx, (i // 16) * 64 as x, (i % 16) * 64 as y from (select distinct image_id from {kp}), (select unnest(range(256)) as i))
select image_id, b, e from (select image_id, idx as b, lead(idx) over (partition by image_id, x order by y) as e from g) where e is not null""")
def grid(t):
    return geometry.grid_edges(geometry.grid_points(t.kp.select("image_id").distinct(), 1024, 64))


SIZED = "sized as (select *, 60.0 as bond_size from {edges})"
MID = "floor((bx + ex) / 2) as cx, floor((by + ey) / 2) as cy"


def _sized(t):
    return t.edges.withColumn("bond_size", F.lit(60.0))


@query(f"with {SIZED}, c as (select *, {MID} from sized) select image_id, b, e from c where exists (select 1 from {{ink}} i where i.image_id = c.image_id and i.x >= cx - 9 and i.x < cx + 9 and i.y >= cy - 9 and i.y < cy + 9)")
def inked_edges(t):
    return raster.inked_edges(_sized(t), t.ink).select("image_id", "b", "e")


TURNED = "round(abs((i.x - cx) * (ex - bx) / dist + (i.y - cy) * (ey - by) / dist), 6) < 9 and round(abs((i.x - cx) * (ey - by) / dist - (i.y - cy) * (ex - bx) / dist), 6) < 9"


@query(f"with {SIZED}, c as (select *, {MID} from sized where dist > 0) select image_id, b, e from c where exists (select 1 from {{ink}} i where i.image_id = c.image_id and {TURNED})")
def inked_edges_rotated(t):
    return raster.inked_edges_rotated(_sized(t), t.ink).select("image_id", "b", "e")


@query(f"""with {SIZED}, s as (select * from sized where dist > 0),
p as (select *, floor((3 * bx + ex) / 4) as cx, floor((3 * by + ey) / 4) as cy, 'b' as side from s union all select *, floor((3 * ex + bx) / 4), floor((3 * ey + by) / 4), 'e' from s),
n as (select p.image_id, p.b, p.e, side, count(*) as n from p join {{ink}} i on i.image_id = p.image_id and {TURNED} group by all)
select s.image_id, s.b, s.e, coalesce(x.n, 0) as ink_b, coalesce(y.n, 0) as ink_e, case when coalesce(x.n, 0) < coalesce(y.n, 0) then 'UP' else 'DOWN' end as direction
from s left join n x on x.image_id = s.image_id and x.b = s.b and x.e = s.e and x.side = 'b' left join n y on y.image_id = s.image_id and y.b = s.b and y.e = s.e and y.side = 'e'""")
def wedge_direction(t):
    return raster.wedge_direction(_sized(t), t.ink)


@query("select vec_id, i - 1 as at, round(cast(embedding[i] as double), 6) as v from {embeddings}, (select unnest(range(1, 65)) as i) where cast(embedding[i] as double) <= 0.1")
def binarise(t):
    cells = t.embeddings.select("vec_id", F.posexplode("embedding").alias("at", "v")).withColumn("v", F.col("v").cast("double"))
    return raster.binarise(cells, 0.1).withColumn("v", F.round("v", 6)).withColumn("at", F.col("at").cast("long"))


@query("""with box as (select image_id, min(x) as x0, min(y) as y0, max(x) as x1, max(y) as y1 from (select image_id || '/' || cast(floor(x / 100.0) as int) as image_id, x, y from {ink}) group by 1),
w as (select *, x1 - x0 <= 60 and y1 - y0 <= 60 as small from box), im as (select distinct image_id || '/' || cast(floor(x / 100.0) as int) as image_id from {ink} union select distinct image_id || '/blank' from {ink})
select image_id, cast(coalesce(case when small then x0 - floor((60 - (x1 - x0)) / 2) else x0 end, 0) as bigint) as x0, cast(coalesce(case when small then y0 - floor((60 - (y1 - y0)) / 2) else y0 end, 0) as bigint) as y0,
cast(coalesce(case when small then x1 + floor((60 - (x1 - x0)) / 2) else x1 end, 1024) as bigint) as x1, cast(coalesce(case when small then y1 + floor((60 - (y1 - y0)) / 2) else y1 end, 1024) as bigint) as y1 from im left join w using (image_id)""")
def tight_bbox(t):
    ink = t.ink.withColumn("image_id", F.concat_ws("/", "image_id", F.floor(F.col("x") / 100).cast("string")))
    blank = t.ink.select(F.concat("image_id", F.lit("/blank")).alias("image_id"))  # images without ink
    return raster.tight_bbox(ink, ink.select("image_id").union(blank).distinct(), 1024)


@query(f"""with {LOWER}, {SIZE}, sigma as (select k.image_id, greatest(round(coalesce(bond_size, 100) / 40), 2) as sigma from (select distinct image_id from {{kp}}) k left join size using (image_id)),
k as (select image_id, ((x % 256) + 256) % 256 as x, ((y % 256) + 256) % 256 as y, sigma, cast(floor(3 * sigma) as int) as r from {{kp}} join sigma using (image_id)),
o as (select image_id, sigma, x, y, unnest(range(-r, r + 1)) as dx, r from k), c as (select *, unnest(range(-r, r + 1)) as dy from o)
select image_id, cast(y + dy as int) as y, cast(x + dx as int) as x, round(max(exp(-(dx * dx + dy * dy) / (2 * sigma * sigma))), 6) as v from c where x + dx between 0 and 255 and y + dy between 0 and 255 group by 1, 2, 3""")
def heatmap(t):
    kp = t.kp.select("image_id", "idx", F.pmod("x", F.lit(256)).alias("x"), F.pmod("y", F.lit(256)).alias("y"))
    return raster.render_heatmap(kp, raster.heat_sigma(geometry.bond_size(t.kp)))


@query()
def peaks(t):
    image = F.concat_ws("/", "image_id", F.floor(F.col("vec_id") / 200).cast("string"))  # about 20 keypoints an image, however many rows
    kp = t.kp.select(image.alias("image_id"), "idx", F.pmod("x", F.lit(256)).alias("x"), F.pmod("y", F.lit(256)).alias("y"))
    return raster.heatmap_peaks(raster.render_heatmap(kp, kp.select("image_id").distinct().withColumn("sigma", F.lit(2.0))))


@query("select image_id, b, e, dist from {edges}")
def edge_length(t):
    e = t.edges
    return e.select("image_id", "b", "e", geometry.distance(F.col("bx"), F.col("by"), F.col("ex"), F.col("ey")).alias("dist"))
