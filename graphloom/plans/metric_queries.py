"""Queries over predictions and ground truth."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics
from ..scratch import new_path
from ..sources import readers, sinks
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query

VOCABULARY = ["click", "view", "purchase", "signup", "logout", "error", "None"]
VOCAB = "vocab as (select unnest(['" + "', '".join(VOCABULARY) + "']) as symbol)"
POPULATION = f"with {VOCAB}, pop as (select v.symbol, 1 + coalesce(n, 0) as population from vocab v left join (select event_type, count(*) as n from {{events}} group by 1) e on e.event_type = v.symbol)"


def _population(t):
    vocab = t.spark.range(1).select(F.explode(F.array(*[F.lit(v) for v in VOCABULARY])).alias("symbol"))
    return metrics.class_population(t.events, vocab, "event_type")


@query(POPULATION + " select symbol, population from pop")
def class_population(t):
    return _population(t)


@query(POPULATION + " select symbol, population, case when population > (select quantile_cont(cast(population as double), 0.2) from pop) then 1 else 3 end as weight from pop")
def class_weights(t):
    return metrics.class_weights(_population(t))


CONFUSION = "with conf as (select g as gt, p as pred, cast((select count(*) from {truth} t where t.gt = g and t.pred = p) as bigint) as n from (select unnest([0, 1, 2]) as g), (select unnest([0, 1, 2]) as p))"


def _confusion(t):
    labels = t.spark.range(3).select(F.col("id").cast("int").alias("label"))
    return metrics.confusion_matrix(t.truth, labels)


@query(CONFUSION + " select gt, pred, n from conf")
def confusion(t):
    return _confusion(t)


@query(CONFUSION + " select gt, pred, case when share < 0.005 then 0 else round(share, 6) end as share from (select *, n / sum(n) over (partition by gt) as share, sum(n) over (partition by gt) as total from conf) where total > 0")
def confusion_rows(t):
    return metrics.row_normalised(_confusion(t))


@query(CONFUSION + """, r as (select l as label, (select sum(n) from conf where gt = l) as support, (select sum(n) from conf where pred = l) as predicted, (select n from conf where gt = l and pred = l) as hit from (select unnest([0, 1, 2]) as l)),
q as (select cast(label as varchar) as label, case when predicted > 0 then hit / predicted else 0 end as precision, case when support > 0 then hit / support else 0 end as recall, support from r),
f as (select *, case when precision + recall > 0 then 2 * precision * recall / (precision + recall) else 0 end as f1 from q)
select label, round(precision, 6) as precision, round(recall, 6) as recall, round(f1, 6) as f1, cast(support as bigint) as support from f
union all select 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1), 6), cast(sum(support) as bigint) from f
union all select 'weighted avg', round(sum(precision * support) / sum(support), 6), round(sum(recall * support) / sum(support), 6), round(sum(f1 * support) / sum(support), 6), cast(sum(support) as bigint) from f""")
def class_report(t):
    return metrics.classification_report(_confusion(t))


@query("select batch, coalesce(kind, 'all') as kind, round(100 * avg(case when gt = pred then 1.0 else 0.0 end), 4) as accuracy, bool_and(gt = pred) as all_correct from {truth} group by grouping sets ((batch, kind), (batch))")
def node_accuracy(t):
    return metrics.node_accuracy(t.truth)


FLAGS = "f as (select o_orderpriority as priority, l_orderkey as key, case when l_returnflag = 'R' then 'A' else 'N' end as gt, case when l_linestatus = 'F' and l_linenumber % 5 != 0 then 'A' else 'N' end as pred from {lineitem} join {orders} on l_orderkey = o_orderkey)"


def _flags(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(F.col("o_orderpriority").alias("priority"), F.col("l_orderkey").alias("key"), F.when(F.col("l_returnflag") == "R", "A").otherwise("N").alias("gt"), F.when((F.col("l_linestatus") == "F") & (F.col("l_linenumber") % 5 != 0), "A").otherwise("N").alias("pred"))


@query(f"with {FLAGS} select priority, round(avg(case when g = p then 1.0 else 0.0 end), 6) as accuracy from (select priority, key, list_sort(list(distinct gt)) as g, list_sort(list(distinct pred)) as p from f group by 1, 2) group by 1")
def subset_accuracy(t):
    return metrics.subset_accuracy(_flags(t), "key", "priority")


@query(f"with {FLAGS} select priority, round(avg(case when g = p then 1.0 else 0.0 end), 6) as accuracy from (select priority, key, list_sort(list(gt)) as g, list_sort(list(pred)) as p from f group by 1, 2) group by 1")
def multiset_accuracy(t):
    return metrics.multiset_accuracy(_flags(t), "key", "priority")


@query("""with g as (select event_id // 4 as image_id, list_sort(list(distinct event_type)) as v from {events} where event_id % 2 = 0 and event_type != 'view' group by 1),
p as (select event_id // 4 as image_id, list_sort(list(distinct event_type)) as v from {events} where event_id % 2 = 1 and event_type != 'view' group by 1)
select round(avg(case when g.v is null then 0.0 else 1.0 end), 6) as with_labels, round(avg(case when g.v is not null then case when coalesce(g.v = p.v, false) then 1.0 else 0.0 end end), 6) as accuracy
from (select distinct event_id // 4 as image_id from {events}) i left join g using (image_id) left join p using (image_id)""")
def superatom_accuracy(t):
    """Four events an image, two of the truth and two predicted; a view is no label."""
    rows = t.events.select(F.floor(F.col("event_id") / 4).alias("image_id"), F.col("event_type").alias("label"), "event_id")
    kept = rows.where("label != 'view'")
    return metrics.superatom_accuracy(kept.where("event_id % 2 = 0"), kept.where("event_id % 2 = 1"), rows)


@query("select image_id, step, conf, pred from (select *, row_number() over (partition by image_id order by conf desc, step) as n from {runs}) where n = 1")
def best_candidate(t):
    return metrics.best_candidate(t.runs)


@query("""select benchmark, count(*) as inputs, cast(sum(p::int) as bigint) as processed, round(case when sum(p::int) > 0 then sum((p and c)::int) / sum(p::int) else 0 end, 4) as precision,
round(case when sum((p and not c)::int) > 0 then sum((p and not c and s)::int) / sum((p and not c)::int) else 0 end, 4) as detected_error_rate
from (select o_orderpriority as benchmark, o_orderkey % 10 != 0 as p, o_orderstatus = 'F' as c, o_orderkey % 3 = 0 as s from {orders}) group by 1""")
def benchmark_summary(t):
    rows = t.orders.select(F.col("o_orderpriority").alias("benchmark"), (F.col("o_orderkey") % 10 != 0).alias("processed"), (F.col("o_orderstatus") == "F").alias("correct"), (F.col("o_orderkey") % 3 == 0).alias("sentinel"))
    return metrics.benchmark_summary(rows)


@query("select l_orderkey, max(case when l_returnflag = 'A' then l_quantity end) as \"A\", max(case when l_returnflag = 'N' then l_quantity end) as \"N\", max(case when l_returnflag = 'R' then l_quantity end) as \"R\" from {lineitem} group by 1")
def model_compare(t):
    return metrics.compare_models(t.lineitem, "l_orderkey", "l_returnflag", ["A", "N", "R"], F.max("l_quantity"))


LOGITS = "l as (select cast(label as string) as image_id, list_transform(embedding, lambda x: cast(x as double) * 10) as v, vec_id from {embeddings})"


def _logits(t):
    return t.embeddings.select(F.col("label").cast("string").alias("image_id"), "vec_id", F.transform("embedding", lambda x: x.cast("double") * 10).alias("logits"))


@query(f"with {LOGITS} select image_id, round(min(1 / list_sum(list_transform(v, lambda x: exp(x - list_max(v))))), 3) as conf from l group by 1")
def confidence(t):
    return metrics.graph_confidence(_logits(t))


@query(f"with {LOGITS} select vec_id, cast(list_position(v, list_max(v)) - 1 as bigint) as class_id from l")
def argmax(t):
    return _logits(t).select("vec_id", metrics.argmax(F.col("logits")).alias("class_id"))


@query("with e as (select round(min(value) + (max(value) - min(value)) * (101 - 20) / 100, 6) as threshold from {events}) select event_id, value as conf, threshold, value > threshold as above from {events}, e")
def conf_threshold(t):
    return metrics.confidence_threshold(t.events.select("event_id", F.col("value").alias("conf")), 20)


@query("select event_id, case when value <= 5 then 1 when value <= 20 then 2 when value <= 50 then 3 else 4 end as bin from {events}")
def bin_index(t):
    return t.events.select("event_id", metrics.bin_index(F.col("value"), [0, 5, 20, 50, 80]).alias("bin"))


@query("""with e as (select cast(floor(avg(o_totalprice) - stddev_samp(o_totalprice)) as bigint) as lo, cast(floor(avg(o_totalprice) + stddev_samp(o_totalprice)) as bigint) as hi from {orders})
select o_orderkey, case when o_totalprice <= lo then 'Small (<=' || lo || ')' when o_totalprice >= hi then 'Big (>=' || hi || ')' else 'Medium (' || lo || '-' || hi || ')' end as size from {orders}, e""")
def size_class(t):
    return metrics.size_class(t.orders, "o_totalprice").select("o_orderkey", "size")


@query("select l_returnflag, l_linestatus, count(*) as n, sum(l_quantity) as l_quantity, cast(sum(l_linenumber) as bigint) as l_linenumber from {lineitem} group by grouping sets ((l_returnflag, l_linestatus), (l_returnflag))")
def nested_totals(t):
    return metrics.nested_totals(t.lineitem, "l_returnflag", "l_linestatus", ["l_quantity", "l_linenumber"])


def _grams_sql(clean: str) -> str:
    """CTEs g1 to g4 of clipped n-gram matches of {pairs}, on characters of the texts as `clean` makes them."""
    base = f"c as (select id, {clean.format(c='gt')} as g, {clean.format(c='pred')} as p from {{pairs}})"
    signs = lambda x: f"(select id, unnest(string_split({x}, '')) as c, unnest(range(1, len(string_split({x}, '')) + 1)) as i from c where {x} != '')"
    ahead = lambda k: f"lead(c, {k}) over (partition by id order by i)"
    side = lambda x: f"select n, id, gram, count(*) as k from (select id, unnest([1, 2, 3, 4]) as n, unnest([c, c || {ahead(1)}, c || {ahead(1)} || {ahead(2)}, c || {ahead(1)} || {ahead(2)} || {ahead(3)}]) as gram from {signs(x)}) where gram is not null group by all"
    return f"{base}, gg as ({side('g')}), pp as ({side('p')}), m as (select gg.id, gg.n, sum(least(gg.k, pp.k)) as m from gg join pp using (id, n, gram) group by 1, 2)"


_BLEU = """, j as (select c.id, c.g, c.p, length(g) as lg, length(p) as lp, coalesce(m1.m, 0) as m1, coalesce(m2.m, 0) as m2, coalesce(m3.m, 0) as m3, coalesce(m4.m, 0) as m4 from c
left join m m1 on m1.id = c.id and m1.n = 1 left join m m2 on m2.id = c.id and m2.n = 2 left join m m3 on m3.id = c.id and m3.n = 3 left join m m4 on m4.id = c.id and m4.n = 4)"""


_PRECISIONS = """, b as (select id, m1 > 0 and lp > 0 as hit, case when lp > lg then 1.0 else exp(1 - lg / greatest(lp, 1)) end as bp,
(case when m1 > 0 then m1 else 0.1 end) / greatest(lp, 1)::double as q1, (case when m2 > 0 then m2 else 0.1 end) / greatest(lp - 1, 1)::double as q2, (case when m3 > 0 then m3 else 0.1 end) / greatest(lp - 2, 1)::double as q3, (case when m4 > 0 then m4 else 0.1 end) / greatest(lp - 3, 1)::double as q4 from j)"""


@query("with " + _grams_sql("{c}") + _BLEU + _PRECISIONS + """
select id, case when hit then round(bp * q1, 6) else 0 end as bleu_1, case when hit then round(bp * q2, 6) else 0 end as bleu_2, case when hit then round(bp * q3, 6) else 0 end as bleu_3, case when hit then round(bp * q4, 6) else 0 end as bleu_4,
case when hit then round(bp * exp((ln(q1) + ln(q2) + ln(q3) + ln(q4)) / 4), 6) else 0 end as bleu_average from b""")
def bleu(t):
    return metrics.bleu(t.pairs).drop("gt", "pred")


@query("with " + _grams_sql("regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')") + _BLEU + " select id, " + ", ".join(f"case when m{n} > 0 then round(2.0 * m{n} / (lg + lp - {2 * n - 2}), 6) else 0 end as rouge_{n}" for n in (1, 2, 3, 4)) + " from j")
def rouge_n(t):
    return metrics.rouge_n(t.pairs).drop("gt", "pred")


@query()
def rouge_l(t):
    return metrics.rouge_l(t.pairs).drop("gt", "pred")


_ASCII = "regexp_replace({c}, '[^\\x00-\\x7F]', '?', 'g')"


#: DuckDB counts bytes, so letters of two bytes become control characters there, each its own; distances stay what they are.
LETTERS = "ÄÇÈÉÊÍÑÓÖÜßäçèéêíñóöüáúâô"
_BYTE = "translate({c}, '" + LETTERS + "', " + " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 14 + len(LETTERS) - 8)]) + ")"


@query(f"select id, cast(levenshtein({_BYTE.format(c='gt')}, {_BYTE.format(c='pred')}) as int) as levenshtein, gt = pred as levenshtein0 from {{pairs}}")
def levenshtein_score(t):
    return metrics.levenshtein_score(t.pairs).drop("gt", "pred")


@query("""with g as (select id, kind, c || lead(c, 1) over w || lead(c, 2) over w as gram from (select id, kind, unnest(string_split(x, '')) as c, unnest(range(1, len(string_split(x, '')) + 1)) as i from (select id, 'a' as kind, gt as x from {pairs} union all select id, 'b', pred from {pairs}) where x != '') window w as (partition by id, kind order by i)),
u as (select id, gram, count(distinct kind) as n from g where gram is not null group by 1, 2), t as (select id, count(*) as either, count(*) filter (where n = 2) as both from u group by 1)
select p.id, case when pred = '' then 0 else coalesce(round(t.both / t.either, 6), 0) end as tanimoto, pred != '' and gt = pred as exact from {pairs} p left join t using (id)""")
def similarity(t):
    grams = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(c) - 2), lambda i: F.concat(c[i - 1], c[i], c[i + 1])))
    signs = lambda c: F.split(F.col(c), "(?!^)(?!$)")
    scored = t.pairs.where("pred != ''").withColumn("__g", signs("gt")).withColumn("__p", signs("pred"))
    safe = lambda c: F.when(F.size(c) >= 3, grams(F.col(c))).otherwise(F.array().cast("array<string>"))
    scores = metrics.exact_match(scored).select("id", metrics.tanimoto(safe("__g"), safe("__p")).alias("tanimoto"), "exact")
    return metrics.with_default_scores(t.pairs.select("id"), scores, "id", {"tanimoto": 0.0, "exact": False})


@query("""select 'documents' as side, doc_id, n_chars as score from {documents} where doc_id in (select doc_id from {labels}) union all
select 'labels', doc_id, quality from {labels} where doc_id in (select doc_id from {documents})""")
def common_ids(t):
    a, b = metrics.common_ids(t.documents.select("doc_id", F.col("n_chars").alias("score")), t.labels.select("doc_id", F.col("quality").alias("score")), "doc_id")
    return a.withColumn("side", F.lit("documents")).unionByName(b.withColumn("side", F.lit("labels")), allowMissingColumns=True)


@query("with " + _grams_sql("{c}") + _BLEU + _PRECISIONS + """, s as (select b.id, case when hit then round(bp * exp((ln(q1) + ln(q2) + ln(q3) + ln(q4)) / 4), 6) else 0 end as bleu, g = p and p != '' as exact from b join j using (id))
select lang, count(*) as molecules, count(*) filter (where exact) as exact, round(avg(bleu), 4) as bleu, count(*) filter (where quality = 1 and not exact) as outliers
from s join {documents} on doc_id = id left join {labels} using (doc_id) group by 1""")
def evaluate(t):
    """From predictions to a report for each language: scores of what was predicted, defaults for the rest, means, and labelled rows that went wrong."""
    scores = metrics.bleu(metrics.exact_match(t.pairs.where("pred != ''"))).select("id", "exact", F.col("bleu_average").alias("bleu"))
    truth = t.documents.select(F.col("doc_id").alias("id"), "lang").join(t.labels.select(F.col("doc_id").alias("id"), (F.col("quality") == 1).alias("valid")), "id", "left")
    rows = metrics.with_default_scores(truth, scores, "id", {"exact": False, "bleu": 0.0})
    bad = metrics.outliers(rows.where("valid").withColumnRenamed("exact", "correct")).groupBy("lang").agg(F.count("*").alias("outliers"))
    report = rows.groupBy("lang").agg(F.count("*").alias("molecules"), F.count_if(F.col("exact")).alias("exact"), F.round(F.avg("bleu"), 4).alias("bleu"))
    return report.join(bad.withColumnRenamed("lang", "__lang"), F.col("lang").eqNullSafe(F.col("__lang")), "left").drop("__lang").na.fill(0, ["outliers"])


@query("""with r as (select cast(doc_id as varchar) as image_id, lang as benchmark, coalesce(b.text = d.text, false) as correct, n_chars as nb_atoms, contains(d.text, '@') as stereochemistry, l.quality = 1 as valid
from {documents} d join {labels} l using (doc_id) left join {benchmark} b on b.item_id = doc_id % 40)
select benchmark, count(*) as molecules, count(*) filter (correct) as correct, count(*) filter (not correct) as outliers, sum(nb_atoms) as atoms from r where nb_atoms < 1500 and not stereochemistry and valid group by 1""")
def evaluate_files(t):
    """The whole chain: predictions to their file, scores and information of each molecule to maps, all read back, chosen for the report, and summed up."""
    rows = t.documents.join(t.labels, "doc_id").withColumn("image_id", F.col("doc_id").cast("string"))
    predicted, scored, informed = (new_path(t.spark, x) for x in ("predictions", "scores", "information"))
    guess = rows.join(t.benchmark.select(F.col("item_id").alias("item"), F.col("text").alias("guess")), F.col("doc_id") % 40 == F.col("item"), "left")
    sinks.write_prediction_csv(guess.select(F.concat(F.lit("images/"), "image_id", F.lit(".png")).alias("path"), F.hex("guess").alias("smiles")), predicted)
    back = t.spark.read.schema("image_filename string, smiles string").option("header", "true").csv(predicted)
    pairs = rows.select("image_id", F.hex("text").alias("gt"), (F.col("quality") == 1).alias("valid"), F.col("lang").alias("benchmark")).join(back.select(F.regexp_replace("image_filename", r"\.png$", "").alias("image_id"), F.col("smiles").alias("pred")), "image_id", "left")
    sinks.write_score_map(metrics.exact_match(pairs).select("image_id", F.col("exact").alias("correct"), "valid", "benchmark"), scored, 50_000)
    sinks.write_score_map(rows.select("image_id", F.contains("text", F.lit("@")).alias("stereochemistry"), F.col("n_chars").alias("nb_atoms")), informed, 50_000)
    scores = readers.read_score_map(t.spark, scored, "correct:boolean,valid:boolean,benchmark:string")
    info = readers.read_score_map(t.spark, informed, "stereochemistry:boolean,nb_atoms:bigint")
    chosen = metrics.select_for_report(scores, info, rows.select("image_id").where("false"), "image_id")
    wrong = metrics.outliers(chosen).groupBy("benchmark").agg(F.count("*").alias("outliers"))
    report = chosen.groupBy("benchmark").agg(F.count("*").alias("molecules"), F.count_if(F.col("correct")).alias("correct"), F.sum("nb_atoms").alias("atoms"))
    return report.join(wrong.withColumnRenamed("benchmark", "__b"), F.col("benchmark").eqNullSafe(F.col("__b")), "left").drop("__b").na.fill(0, ["outliers"])
