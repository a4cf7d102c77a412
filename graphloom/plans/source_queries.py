"""Queries that write files and read them back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import labels, metrics
from ..operators.curate import concat_shards
from ..scratch import new_path
from ..sources import readers, sinks
from ..streaming.annotations import benchmarks_so_far, stream_benchmarks
from ..streaming.annotations import stream_summary as summarise_stream
from .fixtures import TABLES
from .registry import Registry

REGISTRY = Registry()
query = REGISTRY.query


#: The pages' images, of which each fifth has a preprocessed copy beside it.
PAGE_IMAGES = "select regexp_extract(url, '([^/]*)$', 1) as name, regexp_replace(url, '/$', '') || '.png' as path, page_id from {pages}"


@query(f"with i as ({PAGE_IMAGES}) select regexp_extract(path, '([^/]*)$', 1) as name from i")
def manifest_roundtrip(t):
    images = t.pages.select(F.concat(F.regexp_replace("url", "/$", ""), F.lit(".png")).alias("path"), "page_id")
    copies = images.where("page_id % 5 = 0").select(text.preprocessed_name(F.col("path")).alias("path"))
    path = new_path(t.spark, "manifest")
    sinks.write_manifest(readers.drop_preprocessed(images.select("path").unionByName(copies)), path)
    return readers.read_manifest(t.spark, path).select(text.basename(F.col("path")).alias("name"))


@query(f"with i as ({PAGE_IMAGES}) select path, left(regexp_extract(path, '([^/]*)$', 1), length(regexp_extract(path, '([^/]*)$', 1)) - 4) || '_preprocessed.png' as name from i")
def preprocessed_names(t):
    images = t.pages.select(F.concat(F.regexp_replace("url", "/$", ""), F.lit(".png")).alias("path"))
    return images.select("path", text.preprocessed_name(F.col("path")).alias("name"))


@query(" union all ".join(f"select '{x}.parquet' as name, count(*) as n from {{{x}}}" for x in TABLES))
def table_files(t):
    files = readers.list_images(t.spark, t.sf_dir, "*.parquet")
    names = files.select(F.regexp_extract("path", r"([^/]+\.parquet)(/.*)?$", 1).alias("name")).distinct()  # a table may be a folder of files
    counts = concat_shards([getattr(t, x).agg(F.count("*").alias("n")).select(F.lit(f"{x}.parquet").alias("name"), "n") for x in TABLES])
    return names.join(counts, "name")


STEM = "substring(regexp_extract(url, '([^/]*)$', 1), 1, greatest(length(regexp_extract(url, '([^/]*)$', 1)) - 4, 0))"


@query(f"""with i as (select {STEM} as stem, url from {{pages}}), l as (select 'page' || (doc_id % 400) as stem, doc_id from {{documents}})
select l.doc_id, i.url, i.url is not null as paired from l left join i on i.stem = l.stem""")
def pair_by_stem(t):
    images = t.pages.select(F.col("url").alias("path"))
    files = t.documents.select(F.concat(F.lit("page"), (F.col("doc_id") % 400).cast("string"), F.lit(".mol")).alias("path"), "doc_id")
    pairs, alone = readers.pair_images_labels(images, files.select("path").distinct())
    named = files.join(pairs.select(F.col("label").alias("path"), F.col("image").alias("url")), "path").select("doc_id", "url", F.lit(True).alias("paired"))
    return named.unionByName(files.join(alone.select(F.col("label").alias("path")), "path").select("doc_id", F.lit(None).cast("string").alias("url"), F.lit(False).alias("paired")))


@query("select doc_id as image_id, 'images/' || doc_id || '.png' as image_filename, [cast(n_chars as int), cast(n_chars + 7 as int), 2, cast(doc_id as int), 5, 2] as keypoints from {documents} where text is not null")
def coco_roundtrip(t):
    docs = readers.read_hub_parquet(t.documents.select(F.col("doc_id").alias("id"), "n_chars", F.col("text").isNotNull().alias("read")))
    images = docs.select("id", "image_filename", "molfile_filename", F.lit("C").alias("smiles"), F.lit(1024).alias("width"), F.lit(1024).alias("height"))
    two = F.lit(2).cast("long")
    keypoints = docs.where("read").select(F.col("id").alias("image_id"), F.array("n_chars", F.col("n_chars") + 7, two, F.col("id"), F.lit(5).cast("long"), two).alias("keypoints"))
    path = new_path(t.spark, "coco")
    sinks.write_coco(images, keypoints, path, document_bytes=100_000)
    return readers.read_coco(t.spark, path).select(F.col("image_id").cast("long").alias("image_id"), "image_filename", "keypoints")


@query("select doc_id as image_id, 'images/' || doc_id || '.png' as image_filename, [cast(n_chars as int), 2, 2] as keypoints from {documents}")
def coco_lines(t):
    """A document on each line, for every hundred images."""
    image = F.struct(F.col("doc_id").cast("int").alias("id"), F.concat(F.lit("images/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("image_filename"))
    note = F.struct(F.col("doc_id").cast("int").alias("image_id"), F.array(F.col("n_chars").cast("int"), F.lit(2), F.lit(2)).alias("keypoints"))
    docs = t.documents.groupBy(F.floor(F.col("doc_id") / 100).alias("n")).agg(F.collect_list(image).alias("images"), F.collect_list(note).alias("annotations"))
    path = new_path(t.spark, "coco-lines")
    docs.drop("n").write.json(path)
    return readers.read_coco(t.spark, path, lines=True).select(F.col("image_id").cast("long").alias("image_id"), "image_filename", "keypoints")


@query("select text as image_id, min(doc_id) as doc_id, max(n_chars) as n_chars, [min(lang), 'a}{\"b\\'] as langs from {documents} group by 1")
def score_map_texts(t):
    """A map whose keys are whole texts, and whose values hold braces, quotes and backslashes."""
    rows = t.documents.groupBy(F.col("text").alias("image_id")).agg(F.min("doc_id").alias("doc_id"), F.max("n_chars").alias("n_chars"), F.array(F.min("lang"), F.lit('a}{"b\\')).alias("langs"))
    path = new_path(t.spark, "texts")
    sinks.write_score_map(rows, path, document_bytes=300_000)
    return readers.read_score_map(t.spark, path, "doc_id:bigint,n_chars:bigint,langs:array<string>")


@query("select entry as label, population, [smiles] as smiles, rank() over (order by population desc) as rank from {dictionary}")
def dictionary_read(t):
    rows = t.dictionary.select(F.col("entry").alias("label"), F.col("population").cast("int").alias("population"), "smiles", "position")
    a, b, c = (new_path(t.spark, f"dictionary-{x}") for x in "abc")
    third = lambda k: rows.where(F.col("position") % 3 == k)
    third(0).select("label", "smiles", "population").write.option("header", "true").csv(a)
    third(1).select("label", "population", F.concat(F.lit("['"), "smiles", F.lit("']")).alias("smiles")).write.option("header", "true").csv(b)
    sinks.write_dictionary_json(third(2).select("label", "population", F.array("smiles").alias("smiles")), c)
    merged = labels.merge_dictionaries(labels.merge_dictionaries(readers.read_dictionary_csv(t.spark, a, "A"), readers.read_dictionary_csv(t.spark, b, "B")), readers.read_dictionary_json(t.spark, c))
    return labels.rank_dictionary(merged).select("label", F.col("population").cast("long").alias("population"), "smiles", F.col("rank").cast("long").alias("rank"))


@query("select event_type as symbol, cast(row_number() over (order by event_type) as int) as class_id from (select distinct event_type from {events})")
def vocabulary_read(t):
    path = new_path(t.spark, "vocabulary")
    names = t.events.groupBy().agg(F.array_sort(F.collect_set("event_type")).alias("names"))
    names.select(F.to_json(F.map_from_arrays("names", F.sequence(F.lit(1), F.size("names")))).alias("value")).write.text(path)
    return readers.read_vocabulary(t.spark, path)


@query("""select text as smi, case when text in ('C', '') then 0.0 else turn / 8 end as conf, 'conv' || conv_id as filename from (select conv_id, turn, case turn % 5 when 0 then null when 1 then 'C' when 2 then '' else text end as text from {conversations}) where text is not null and text != ''""")
def annotation_log(t):
    raw = F.when(F.col("turn") % 5 == 0, None).when(F.col("turn") % 5 == 1, "C").when(F.col("turn") % 5 == 2, "").otherwise(F.col("text"))
    smiles, conf = metrics.confidence_override(raw, F.col("turn") / 8)
    rows = t.conversations.select(smiles.alias("smiles"), conf.alias("conf"), F.concat(F.lit("conv"), F.col("conv_id").cast("string")).alias("filename"), F.array().cast("array<string>").alias("abbreviations"), F.array().cast("array<string>").alias("abbreviations_ocr"))
    path = new_path(t.spark, "annotations")
    sinks.write_annotations(rows, path)
    return readers.read_predictions(t.spark, path).select("smi", "conf", F.col("`file-info`.filename").alias("filename"))


@query("select 'doc' || doc_id || '.png' as image_filename, lang as smiles from {documents}")
def prediction_csv(t):
    rows = t.documents.select(F.concat(F.lit("a/b/doc"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path"), F.col("lang").alias("smiles"))
    path = new_path(t.spark, "predictions")
    sinks.write_prediction_csv(rows, path)
    return t.spark.read.schema("image_filename string, smiles string").option("header", "true").csv(path)


@query("select cast(d.doc_id as varchar) as image_id, quality = 1 as correct, n_chars as nb_atoms from {documents} d join {labels} l using (doc_id) where n_chars < 1500 and lang != 'es' and source != 'src0' and toxic = 0 and quality = 0")
def scores_read(t):
    rows = t.documents.join(t.labels, "doc_id").withColumn("image_id", F.col("doc_id").cast("string"))
    a, b = new_path(t.spark, "scores"), new_path(t.spark, "information")
    sinks.write_score_map(rows.select("image_id", (F.col("quality") == 1).alias("correct"), (F.col("toxic") == 0).alias("valid")), a, 20_000)
    sinks.write_score_map(rows.select("image_id", (F.col("lang") == "es").alias("stereochemistry"), F.col("n_chars").alias("nb_atoms")), b, 20_000)
    scores = readers.read_score_map(t.spark, a, "correct:boolean,valid:boolean")
    info = readers.read_score_map(t.spark, b, "stereochemistry:boolean,nb_atoms:bigint")
    chosen = metrics.select_for_report(scores, info, rows.where("source = 'src0'").select("image_id"), "image_id")
    return metrics.outliers(chosen).select("image_id", "correct", "nb_atoms")


@query("select o_orderpriority as benchmark, count(*) as n, round(avg(o_totalprice), 2) as mean_price from {orders} group by 1")
def scores_written(t):
    path = new_path(t.spark, "benchmarks")
    sinks.write_scores(t.orders.select(F.col("o_orderpriority").alias("benchmark"), "o_orderkey", "o_totalprice"), path)
    back = t.spark.read.schema("o_orderkey long, o_totalprice double, benchmark string").json(path)
    return back.groupBy("benchmark").agg(F.count("*").alias("n"), F.round(F.avg("o_totalprice"), 2).alias("mean_price"))


@query("select split, count(*) as n, min(name) as first_name from (select case when doc_id % 10 < 8 then 'train' when doc_id % 10 = 8 then 'val' else 'test' end as split, doc_id || '.png' as name from {documents}) group by 1")
def split_lists(t):
    split = F.when(F.col("doc_id") % 10 < 8, "train").when(F.col("doc_id") % 10 == 8, "val").otherwise("test")
    path = new_path(t.spark, "splits")
    sinks.write_split_lists(t.documents.select(split.alias("split"), F.concat(F.lit("x/"), F.col("doc_id").cast("string"), F.lit(".png")).alias("path")), path)
    back = t.spark.read.schema("name string, split string").csv(path)
    return back.groupBy("split").agg(F.count("*").alias("n"), F.min("name").alias("first_name"))


@query("""with low as (select a.image_id, a.idx as b, min(round(sqrt((cast(a.x as double) - b.x) * (cast(a.x as double) - b.x) + (cast(a.y as double) - b.y) * (cast(a.y as double) - b.y)), 6)) as m from {kp} a join {kp} b on a.image_id = b.image_id and a.idx > b.idx group by 1, 2)
select image_id as name, round(quantile_cont(m, 0.75), 2) as bond_size from low group by 1""")
def bond_size_log(t):
    from ..operators.geometry import bond_size

    path = new_path(t.spark, "bond-sizes")
    sinks.write_bond_sizes(bond_size(t.kp), path)
    return t.spark.read.schema("name string, bond_size double").json(path)


def _documents(t):
    """A document for every four pages, with a picture for each page: its class by the page's number."""
    name = F.element_at(F.array(F.lit("chemistry_molecular_structure"), F.lit("photo"), F.lit("bar_chart")), (F.col("page_id") % 3 + 1).cast("int"))
    notes = F.array(F.struct(F.array(F.struct(name.alias("class_name"))).alias("predicted_classes")))
    size = F.struct(F.length("html").cast("double").alias("width"), F.length("url").cast("double").alias("height"))
    picture = F.struct(F.concat(F.lit("#/pictures/"), F.col("page_id").cast("string")).alias("self_ref"), F.struct(size.alias("size")).alias("image"), notes.alias("annotations"))
    rows = t.pages.groupBy(F.floor(F.col("page_id") / 4).alias("doc")).agg(F.array_sort(F.collect_list(F.struct("page_id", picture.alias("p"))), lambda a, b: (a.page_id - b.page_id).cast("int")).alias("x"))
    return rows.select("doc", F.transform("x", lambda x: x.p).alias("pictures"))


@query("select page_id // 4 as doc, chr(35) || '/pictures/' || page_id as self_ref from {pages} where page_id % 3 = 0")
def docling_pictures(t):
    return readers.docling_pictures(_documents(t)).select("doc", F.col("picture.self_ref").alias("self_ref"))


@query("""select page_id // 4 as doc, cast(row_number() over (partition by page_id // 4 order by page_id) - 1 as int) as pos, case when page_id % 3 = 0 then 1 else 0 end as molecules, case when page_id % 3 = 0 then cast(length(html) as double) end as right_edge from {pages}""")
def docling_enrich(t):
    docs = _documents(t)
    found = readers.docling_pictures(docs).select("doc", F.col("picture.self_ref").alias("self_ref"), F.lit("CCO").alias("smi"), F.lit(0.9).alias("conf"))
    rich = sinks.enrich_docling(docs, found).select("doc", F.posexplode("pictures").alias("pos", "p"))
    corner = F.get(F.get(F.get(F.col("p.molecules"), F.lit(0))["segmentation"], F.lit(1)), F.lit(0))
    return rich.select("doc", "pos", F.size("p.molecules").alias("molecules"), corner.alias("right_edge"))


@query("select event_type, count(*) as inputs, round(avg(value), 6) as mean_value from {events} group by 1")
def stream_summary(t):
    path = new_path(t.spark, "events")
    t.events.select("event_type", "value").repartition(6).write.json(path)
    return summarise_stream(t.spark, path, "event_type string, value double", "event_type", chunk=2)


@query("""with a as (select source as benchmark, true as processed, case when n_chars % 3 = 0 then 'xx' else lang end = lang as correct, (doc_id % 10) / 10.0 < 0.4 as sentinel from {documents})
select benchmark, count(*) as inputs, count(*) as processed, round(count(*) filter (correct) / count(*), 4) as precision, round(case when count(*) filter (not correct) > 0 then count(*) filter (not correct and sentinel) / count(*) filter (not correct) else 0.0 end, 4) as detected_error_rate from a group by 1""")
def stream_benchmark(t):
    """Annotation logs that come in two lots, some images in both; the stream stops between them and goes on from its checkpoint."""
    found = F.when(F.col("n_chars") % 3 == 0, "xx").otherwise(F.col("lang"))
    none = F.array().cast("array<string>")
    rows = t.documents.select("doc_id", found.alias("smiles"), none.alias("abbreviations"), none.alias("abbreviations_ocr"), ((F.col("doc_id") % 10) / 10).alias("conf"), F.col("doc_id").cast("string").alias("filename"))
    truth = t.documents.select(F.col("doc_id").cast("string").alias("filename"), F.col("source").alias("benchmark"), F.col("lang").alias("smi"), F.lit(0.4).alias("conf_least"))
    folder, out, log = (new_path(t.spark, f"annotations-{x}") for x in ("in", "out", "log"))
    for lot in ("doc_id % 2 = 0", "doc_id % 2 = 1 or doc_id % 7 = 0"):
        sinks.write_annotations(rows.where(lot).drop("doc_id").repartition(3), folder)
        stream_benchmarks(t.spark, folder, truth, out, log, chunk=2)
    return benchmarks_so_far(t.spark, out)
