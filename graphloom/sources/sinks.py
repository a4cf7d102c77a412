"""Writers: manifests, annotation logs, COCO files, split lists, scores, dictionaries, enriched documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import basename
from ..operators.small import small
from .documents import DOCUMENT_BYTES, write_documents


def write_manifest(images: DataFrame, path: str, most: int | None = None) -> None:
    """The paths in order; only the first `most` of them, where that is given."""
    paths = images.select("path").orderBy("path")
    (paths if most is None else paths.limit(most)).write.json(path)


def annotation_rows(rows: DataFrame, version: str, program: str) -> DataFrame:
    """rows (smiles, abbreviations, abbreviations_ocr, conf, filename) in the shape of the annotation log; rows without SMILES give none."""
    return rows.where("smiles is not null").select(
        F.col("smiles").alias("smi"), "abbreviations", "abbreviations_ocr", "conf",
        F.struct(F.col("filename").alias("filename"), F.lit(1).alias("image_nbr")).alias("file-info"), F.struct(F.lit(version).alias("version"), F.lit(program).alias("program")).alias("annotator"),
    )


def write_annotations(rows: DataFrame, path: str, version: str = "1.0", program: str = "graphloom") -> None:
    annotation_rows(rows, version, program).write.mode("append").json(path)


def write_coco(images: DataFrame, keypoints: DataFrame, path: str, document_bytes: int = DOCUMENT_BYTES) -> None:
    """images (id, image_filename, molfile_filename, smiles, width, height) and keypoints (image_id, keypoints flat) as COCO documents of about
    document_bytes; images without keypoints, and keypoints without an image, are left out."""
    rows = images.join(keypoints.withColumnRenamed("image_id", "id"), "id")
    image = F.struct("width", "height", "image_filename", "molfile_filename", "smiles", F.col("id").cast("int").alias("id"), F.lit(1).alias("license"), F.lit("").alias("date_captured"))
    note = F.struct(F.col("id").cast("int").alias("image_id"), F.col("keypoints").cast("array<int>").alias("keypoints"), F.lit(0).alias("iscrowd"))
    part = lambda k, x: F.struct(F.lit(k).alias("part"), F.to_json(x).alias("text"))
    head = '{"info": {"description": "keypoints"}, "licenses": [{"id": 1, "name": "", "url": ""}], "images": ['
    write_documents(rows.select("id", F.inline(F.array(part(0, image), part(1, note)))), [head, '], "annotations": [', "]}"], path, document_bytes)


def write_split_lists(rows: DataFrame, path: str) -> None:
    """rows (split, path): base names, in a folder for each split."""
    rows.select("split", basename(F.col("path")).alias("name")).write.partitionBy("split").csv(path)


def write_prediction_csv(rows: DataFrame, path: str) -> None:
    rows.select(basename(F.col("path")).alias("image_filename"), "smiles").write.option("header", "true").csv(path)


def write_scores(scores: DataFrame, path: str) -> None:
    """Rows with their benchmark, in a folder for each."""
    scores.write.partitionBy("benchmark").json(path)


def write_score_map(scores: DataFrame, path: str, document_bytes: int = DOCUMENT_BYTES) -> None:
    """scores (image_id, ...) as JSON maps from image to an object, of about document_bytes each."""
    entry = F.concat(_quoted("image_id"), F.lit(": "), F.to_json(F.struct(*[c for c in scores.columns if c != "image_id"]), {"ignoreNullFields": "false"}))
    write_documents(scores.select(F.col("image_id").alias("id"), F.lit(0).alias("part"), entry.alias("text")), ["{", "}"], path, document_bytes)


def _quoted(column: str) -> Column:
    """A text as JSON has it: the one element of an array, without the brackets."""
    array = F.to_json(F.array(F.col(column).cast("string")))
    return F.substring(array, F.lit(2), F.length(array) - 2)


def write_dictionary_json(dictionary: DataFrame, path: str) -> None:
    """(label, population, smiles array) as one JSON map, most populous first. A dictionary's size is checked."""
    entry = F.concat(_quoted("label"), F.lit(": "), F.to_json(F.struct("population", "smiles")))
    order = F.struct((-F.col("population")).alias("p"), F.col("label").alias("l"))
    write_documents(small(dictionary).select(order.alias("id"), F.lit(0).alias("part"), entry.alias("text")), ["{", "}"], path, 1 << 62)


def bond_size_rows(sizes: DataFrame) -> DataFrame:
    """(name, bond_size) rounded to 2 places."""
    return sizes.select(basename(F.col("image_id")).alias("name"), F.round("bond_size", 2).alias("bond_size"))


def write_bond_sizes(sizes: DataFrame, path: str) -> None:
    bond_size_rows(sizes).write.json(path)


def enrich_docling(docs: DataFrame, predictions: DataFrame) -> DataFrame:
    """docs (doc, pictures) with a molecule annotation put behind those of each picture that a prediction (doc, self_ref, smi, conf) is for; its
    segmentation is the image's rectangle. Pictures keep their order."""
    each = docs.select("doc", F.posexplode("pictures").alias("pos", "p")).withColumn("self_ref", F.col("p.self_ref"))
    w, h = F.col("p.image.size.width"), F.col("p.image.size.height")
    zero = F.lit(0.0)
    molecule = F.struct(F.lit("molecule_data").alias("kind"), F.col("smi").alias("smi"), F.col("conf").alias("conf"), F.array(F.array(zero, zero), F.array(w, zero), F.array(w, h), F.array(zero, h)).alias("segmentation"))
    named = each.join(predictions, ["doc", "self_ref"], "left").withColumn("molecules", F.filter(F.array(molecule), lambda m: m.smi.isNotNull()))
    picture = F.struct("pos", F.struct("p.self_ref", "p.image", "p.annotations", F.col("molecules").alias("molecules")).alias("p"))
    return named.groupBy("doc").agg(F.transform(F.array_sort(F.collect_list(picture), lambda a, b: a.pos - b.pos), lambda x: x.p).alias("pictures"))
