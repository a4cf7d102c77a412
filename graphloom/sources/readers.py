"""Readers: image lists, manifests, COCO files, dictionaries, logs, scores. Schemas are given, never inferred."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import stem
from .documents import entries, sections

IMAGE_SCHEMA = "width int, height int, image_filename string, molfile_filename string, smiles string, id int, license int, date_captured string"
NOTE_SCHEMA = "image_id int, keypoints array<int>, iscrowd int"
COCO_SCHEMA = f"images array<struct<{IMAGE_SCHEMA}>>, annotations array<struct<{NOTE_SCHEMA}>>"
ANNOTATION_SCHEMA = "smi string, abbreviations array<string>, abbreviations_ocr array<string>, conf double, `file-info` struct<filename:string,image_nbr:int>, annotator struct<version:string,program:string>"
STRUCTURE_CLASS = "chemistry_molecular_structure"


def list_images(spark: SparkSession, folder: str, pattern: str = "*.{png,TIF}") -> DataFrame:
    """(path, length, modified) of the files; their content is not read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "length", F.col("modificationTime").alias("modified"))


def drop_preprocessed(images: DataFrame) -> DataFrame:
    return images.where(~F.col("path").contains("preprocessed"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("path string").json(path)


def pair_images_labels(images: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Images and label files (path) with one stem, and the labels that have no image."""
    i, m = images.select(stem(F.col("path")).alias("stem"), F.col("path").alias("image")), labels.select(stem(F.col("path")).alias("stem"), F.col("path").alias("label"))
    return i.join(m, "stem"), m.join(i.select("stem"), "stem", "left_anti")


def read_coco(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """(image_id, image_filename, molfile_filename, smiles, keypoints) of COCO files: images joined with their annotations, document by document.

    A file is one document, of any size, that is read in pieces by several tasks; with lines it has a document on each line."""
    if lines:
        docs = spark.read.schema(COCO_SCHEMA).json(path).select(F.concat(F.col("_metadata.file_path"), F.monotonically_increasing_id().cast("string")).alias("file"), "images", "annotations")
        images, notes = docs.select("file", F.inline("images")), docs.select("file", F.inline("annotations"))
    else:
        objects = sections(spark, path, ["info", "licenses", "images", "annotations"])
        of = lambda name, schema: objects.where(F.col("section") == name).select("file", F.from_json("object", schema).alias("v")).select("file", "v.*")
        images, notes = of("images", IMAGE_SCHEMA), of("annotations", NOTE_SCHEMA)
    images = images.select("file", F.col("id").alias("image_id"), "image_filename", "molfile_filename", "smiles")
    return images.join(notes.select("file", "image_id", "keypoints"), ["file", "image_id"]).drop("file")


def read_hub_parquet(rows: DataFrame) -> DataFrame:
    """rows (id) with the file names that go with each id."""
    return rows.withColumn("image_filename", F.concat(F.lit("images/"), F.col("id").cast("string"), F.lit(".png"))).withColumn("molfile_filename", F.concat(F.lit("molfiles/"), F.col("id").cast("string"), F.lit(".mol")))


def rename_paths(rows: DataFrame, columns: list[str], old: str, new: str) -> DataFrame:
    return rows.withColumns({c: F.replace(F.col(c), F.lit(old), F.lit(new)) for c in columns})


def read_dictionary_csv(spark: SparkSession, path: str, form: str) -> DataFrame:
    """(label, population, smiles array). form A: label, smiles, population with plain smiles; form B: label, population, smiles as a list literal."""
    names = "label string, smiles string, population int" if form == "A" else "label string, population int, smiles string"
    rows = spark.read.schema(names).option("header", "true").option("escape", '"').csv(path)
    smiles = F.array("smiles") if form == "A" else F.from_json(F.replace(F.col("smiles"), F.lit("'"), F.lit('"')), "array<string>")
    return rows.select("label", "population", smiles.alias("smiles"))


def read_dictionary_json(spark: SparkSession, path: str) -> DataFrame:
    """(label, population, smiles array) of JSON maps; an empty map gives no rows."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", "map<string,struct<population:int,smiles:array<string>>>")).alias("label", "v")).select("label", "v.population", "v.smiles")


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(symbol, class_id) of a JSON map; the inverse is the same table."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,int>")).alias("symbol", "class_id"))


def read_predictions(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ANNOTATION_SCHEMA).json(path)


def read_score_map(spark: SparkSession, path: str, fields: str, lines: bool = False) -> DataFrame:
    """(image_id, fields) of JSON maps from image to a flat object: one of any size for each file, which is read in pieces, or one for each line."""
    if not lines:
        return entries(spark, path).select(F.col("key").alias("image_id"), F.from_json("object", f"struct<{fields}>").alias("v")).select("image_id", "v.*")
    return spark.read.text(path).select(F.explode(F.from_json("value", f"map<string,struct<{fields}>>")).alias("image_id", "v")).select("image_id", "v.*")


def docling_pictures(docs: DataFrame) -> DataFrame:
    """The pictures of documents (doc, pictures) whose first annotation's first class is a molecular structure."""
    pictures = docs.select("doc", F.posexplode("pictures").alias("pos", "picture"))
    first = F.get(F.get(F.col("picture.annotations"), F.lit(0))["predicted_classes"], F.lit(0))["class_name"]
    return pictures.where(first == STRUCTURE_CLASS).select("doc", "pos", "picture")
