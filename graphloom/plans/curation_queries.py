"""Queries over curated sets: samples, splits, checks, transforms."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from ..operators import curate
from ..sources import readers
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

DRAW = "((({key} * 7919 + 104729) % 999983) + 999983) % 999983"


@query("select doc_id, lang from (select doc_id, lang, row_number() over (order by case when lang = 'es' then 0 else 1 end, " + DRAW.format(key="doc_id").replace("{", "{{") + ", doc_id) as n from {documents}) where n <= 300")
def two_tier_sample(t):
    return curate.sample_two_tier(t.documents, F.col("lang") == "es", "doc_id", 300).select("doc_id", "lang")


SPLIT = "case when (" + DRAW.format(key="doc_id") + ") % 100 < 80 then 'train' when (" + DRAW.format(key="doc_id") + ") % 100 < 90 then 'val' else 'test' end"


@query(f"select lang, {SPLIT} as split, count(*) as n from {{documents}} group by 1, 2")
def split_counts(t):
    return t.documents.groupBy("lang", curate.split_name("doc_id").alias("split")).agg(F.count("*").alias("n"))


@query("select doc_id, lang, cast(copy as int) as copy from {documents}, (select unnest([0, 1, 2]) as copy)")
def duplicate_rows(t):
    return curate.duplicate_rows(t.documents.select("doc_id", "lang"), 3)


@query("select cast(vec_id as string) as image_id, cast(i as int) as idx, floor(1000 * cast(embedding[3 * i + 1] as double)) - 1 as x, floor(1000 * cast(embedding[3 * i + 2] as double)) - 1 as y from {embeddings}, (select unnest(range(21)) as i)")
def unflatten_keypoints(t):
    rows = t.embeddings.select(F.col("vec_id").cast("string").alias("image_id"), F.transform("embedding", lambda v: F.floor(1000 * v.cast("double")).cast("double")).alias("flat"))
    return curate.unflatten_keypoints(rows, "flat", -1)


@query("select image_id, flatten(list([cast(x as int), cast(y as int), 2] order by idx)) as keypoints from {kp} group by 1")
def flatten_keypoints(t):
    return curate.flatten_keypoints(t.kp)


@query("select image_id, idx, cast(x * 4 + 2 as bigint) as up_x, cast(y * 4 + 2 as bigint) as up_y, cast(trunc(x / 4.0) as bigint) as down_x, cast(trunc(y / 4.0) as bigint) as down_y from {kp}")
def rescale(t):
    return t.kp.select("image_id", "idx", curate.rescale_up("x").alias("up_x"), curate.rescale_up("y").alias("up_y"), curate.rescale_down("x").alias("down_x"), curate.rescale_down("y").alias("down_y"))


@query("""select image_id, idx, cast(trunc(round(0.5 * (x + 10) + 0.25 * (y + 10) + label, 6) - 10) as bigint) as x, cast(trunc(round(-0.25 * (x + 10) + 0.5 * (y + 10) + 2 * label, 6) - 10) as bigint) as y
from (select *, cast(split_part(image_id, '-', 1) as int) as label from {kp})""")
def affine(t):
    label = F.split_part("image_id", F.lit("-"), F.lit(1)).cast("int")
    matrices = t.kp.select("image_id").distinct().select("image_id", F.lit(0.5).alias("a"), F.lit(0.25).alias("b"), label.alias("c"), F.lit(-0.25).alias("d"), F.lit(0.5).alias("e"), (2 * label).alias("f"))
    return curate.affine_keypoints(t.kp, matrices, 10)


@query("""with k as (select cast(vec_id % 97 as string) as image_id, x, y from {kp}), p as (select image_id, x from k where x + y > -180)
select a.image_id, n = coalesce(m, 0) as same_count from (select image_id, count(*) as n, bool_and(x >= -250 and x < 250 and y >= -250 and y < 250) as inside from (select image_id, x, y from k) group by 1) a
left join (select image_id, count(*) as m from p group by 1) b using (image_id) where n >= 2 and inside""")
def sanity_filter(t):
    kp = t.kp.select(F.pmod("vec_id", F.lit(97)).cast("string").alias("image_id"), "x", "y")
    moved = kp.withColumn("x", F.col("x") + 250).withColumn("y", F.col("y") + 250)
    same = curate.same_counts(kp, kp.where("x + y > -180")).withColumn("same", F.lit(True))
    return curate.sane_images(moved, 500).join(same, "image_id", "left").select("image_id", F.coalesce("same", F.lit(False)).alias("same_count"))


@query("select o_orderkey, o_orderpriority from {orders} where o_orderkey not in (select l_orderkey from {lineitem} where l_returnflag = 'R')")
def clean_only(t):
    atoms = t.lineitem.select(F.col("l_orderkey").alias("image_id"), "l_returnflag")
    return curate.clean_only(t.orders.withColumnRenamed("o_orderkey", "image_id"), atoms, F.col("l_returnflag") == "R").select(F.col("image_id").alias("o_orderkey"), "o_orderpriority")


FLAGS = "select l_orderkey, bool_or(l_returnflag = 'R') as markush, bool_or(l_linestatus = 'O') as molecule, bool_or(l_quantity > 45) as short, count(*) as nb_structures from {lineitem} group by 1"


def _flags(t):
    return t.lineitem.groupBy("l_orderkey").agg(F.collect_list(F.col("l_returnflag") == "R").alias("are_markush"), F.collect_list(F.col("l_linestatus") == "O").alias("are_molecules"), F.collect_list(F.col("l_quantity") > 45).alias("are_abbreviated"), F.count("*").alias("nb_structures"))


@query(f"select l_orderkey, nb_structures from ({FLAGS}) where not markush and molecule and not short and nb_structures = 1")
def benchmark_filter(t):
    return curate.benchmark_filter(_flags(t), clean=True).select("l_orderkey", "nb_structures")


@query(f"select l_orderkey, short from ({FLAGS}) where not markush and molecule and nb_structures = 1")
def benchmark_filter_all(t):
    return curate.benchmark_filter(_flags(t), clean=False).select("l_orderkey", F.exists("are_abbreviated", lambda x: x).alias("short"))


@query("select o_orderpriority, o_orderkey, position from (select *, row_number() over (partition by o_orderpriority order by o_orderkey) - 1 as position from {orders}) where position > 0 and position < 50")
def slices(t):
    return curate.position_slice(t.orders, "o_orderkey", 0, 50, by="o_orderpriority").select("o_orderpriority", "o_orderkey", F.col("position").cast("long").alias("position"))


@query("select o_orderkey, position from (select o_orderkey, row_number() over (order by o_orderdate, o_orderkey) - 1 as position from {orders}) where position > 100 and position < 900")
def slices_all(t):
    rows = t.orders.select("o_orderkey", F.struct("o_orderdate", "o_orderkey").alias("at"))
    return curate.position_slice(rows, "at", 100, 900).select("o_orderkey", F.col("position").cast("long").alias("position"))


@query("select doc_id, n_chars from (select doc_id, n_chars, row_number() over (order by n_chars, doc_id) as r from {documents}) where r <= 40")
def head_all(t):
    return curate.head_n(t.documents.select("doc_id", "n_chars", F.struct("n_chars", "doc_id").alias("at")), "at", 40).drop("at")


@query("select o_orderpriority, round(1 - cast(sum(case when o_orderkey in (select l_orderkey from {lineitem} where l_quantity > 49) then 0 else 1 end) as double) / count(*), 4) as dropped from {orders} group by 1")
def dropped_rows(t):
    left = curate.drop_ids(t.orders.withColumnRenamed("o_orderkey", "image_id"), t.lineitem.where("l_quantity > 49").select(F.col("l_orderkey").alias("image_id")), "image_id")
    return curate.dropped_share(t.orders, left, "o_orderpriority")


U, V = "((vec_id * 7919) % 1000) / 1000.0", "((vec_id * 104729) % 1000) / 1000.0"


@query(f"""select image_id, idx, least(greatest(round(x + sqrt({U}) * 8 * cos(({V}) * 2 * acos(-1.0)), 4), -400.0), 399.0) as x, least(greatest(round(y + sqrt({U}) * 8 * sin(({V}) * 2 * acos(-1.0)), 4), -400.0), 399.0) as y from {{kp}}""")
def jitter(t):
    return curate.jitter_keypoints(t.kp, F.expr(U).cast("double"), F.expr(V).cast("double"), 8.0, -400, 400)


CHOSEN = """chosen as (select * from (select *, row_number() over (partition by image_id order by (idx * 7919) % 31, idx) as n from {kp} where cast(split_part(image_id, '-', 1) as int) % 2 = 0) where n = 1),
size as (select image_id, max(idx) + 1 as fresh from {kp} group by 1), made as (select image_id, idx, x, y, fresh from chosen join size using (image_id))"""


def _decoys(t):
    nodes = t.kp.select("image_id", "idx", "x", "y", F.lit("C").alias("class"))
    even = F.split_part("image_id", F.lit("-"), F.lit(1)).cast("int") % 2 == 0
    return curate.add_decoys(nodes, t.edges.withColumn("class", F.lit("None")), even, (F.col("idx") * 7919) % 31, 15, -10)


@query(f"""with {CHOSEN} select image_id, b, e, 'None' as class from {{edges}} union all
select e.image_id, case when e.b = m.idx then e.e else e.b end, m.fresh, 'Decoy' from {{edges}} e join made m on e.image_id = m.image_id and (e.b = m.idx or e.e = m.idx) union all
select image_id, idx, fresh, 'Decoy' from made""")
def decoys(t):
    return _decoys(t)[1]


@query(f"with {CHOSEN} select image_id, idx, x, y, 'C' as class from {{kp}} union all select image_id, fresh, x + 15, y - 10, 'Decoy' from made")
def decoy_nodes(t):
    return _decoys(t)[0]


@query("select vec_id, label, round(list_sum(list_transform(range(1, 65), lambda i: cast(embedding[i] as double) * i)), 4) as score from {embeddings}")
def batch_score(t):
    def scorer(frames):
        weights = np.arange(1.0, 65.0)
        for pdf in frames:
            scores = np.round(np.stack(pdf["embedding"]).astype(np.float64) @ weights, 4) if len(pdf) else []
            yield pd.DataFrame({"vec_id": pdf["vec_id"], "label": pdf["label"], "score": scores})

    return curate.batch_score(t.embeddings, scorer, "vec_id long, label int, score double")


@query("select vec_id, label from (select *, count(*) over (partition by vec_id // 64) as n from {embeddings}) where n >= 64")
def short_batches(t):
    rows = t.embeddings.select("vec_id", "label", F.floor(F.col("vec_id") / 64).alias("batch"))
    return curate.drop_short_batches(rows, "batch", 64).drop("batch")


@query("select doc_id as id, 'images/' || doc_id || '.png' as image_filename, 'molfiles/' || doc_id || '.mol' as molfile_filename, replace(source, 'src', 'set-') as source from {documents}")
def hub_rows(t):
    rows = readers.read_hub_parquet(t.documents.select(F.col("doc_id").alias("id"), "source"))
    return readers.rename_paths(rows, ["source"], "src", "set-")


@query("select doc_id, lang from (select doc_id, lang, row_number() over (partition by lang order by doc_id) as r from {documents}) where r <= 5")
def head_rows(t):
    return curate.head_n(t.documents.select("doc_id", "lang"), "doc_id", 5, by="lang")


@query("select doc_id as id, text, lang from {documents} union all select item_id, text, null from {benchmark} union all select conv_id * 1000 + turn, text, null from {conversations}")
def shards(t):
    return curate.concat_shards([t.documents.select(F.col("doc_id").alias("id"), "text", "lang"), t.benchmark.select(F.col("item_id").alias("id"), "text"), t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")])
