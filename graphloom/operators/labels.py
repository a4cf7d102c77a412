"""Dictionaries of label text: mining, reading, matching."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import READER_COSTS, UNIT_COSTS
from .nearest import compared, nearest_entries
from .small import small


def dictionary_from_labels(groups: DataFrame) -> DataFrame:
    """(label, population, smiles) of groups (label, smiles): the most frequent smiles of each label, of equals the least."""
    counts = groups.groupBy("label", "smiles").agg(F.count("*").alias("n"))
    first = Window.partitionBy("label").orderBy(F.desc("n"), "smiles")
    best = counts.withColumn("population", F.sum("n").over(Window.partitionBy("label"))).withColumn("__n", F.row_number().over(first))
    return best.where("__n = 1").select("label", "population", "smiles")


def dictionary_all_smiles(groups: DataFrame) -> DataFrame:
    """(label, population, smiles): all distinct smiles of each label, sorted."""
    return groups.groupBy("label").agg(F.count("*").alias("population"), F.array_sort(F.collect_set("smiles")).alias("smiles"))


def merge_dictionaries(left: DataFrame, right: DataFrame, key: str = "label") -> DataFrame:
    """All entries; right's where both have the key."""
    return left.join(right.select(key), key, "left_anti").unionByName(right)


def label_attachments(group_atoms: DataFrame, bonds: DataFrame, exactly_one: bool = False) -> DataFrame:
    """(file, group_id, atom): atoms outside a group that a SINGLE bond links to it; groups with none don't appear. exactly_one: bonds of any type, and
    only groups with one such atom. group_atoms (file, group_id, atom), bonds (file, b, e, type)."""
    kept = bonds if exactly_one else bonds.where("type = 'SINGLE'")
    ends = kept.select("file", F.inline(F.array(F.struct(F.col("b").alias("atom"), F.col("e").alias("other")), F.struct(F.col("e").alias("atom"), F.col("b").alias("other")))))
    found = group_atoms.join(ends, ["file", "atom"]).select("file", "group_id", F.col("other").alias("atom")).distinct().join(group_atoms, ["file", "group_id", "atom"], "left_anti")
    if exactly_one:
        found = found.withColumn("__n", F.count("*").over(Window.partitionBy("file", "group_id"))).where("__n = 1").drop("__n")
    return found


def coincident_atoms(atoms: DataFrame) -> DataFrame:
    """(image_id, x, y, atoms) of places with more than one atom."""
    return atoms.groupBy("image_id", "x", "y").agg(F.array_sort(F.collect_list("idx")).alias("atoms")).where(F.size("atoms") > 1)


def edit_candidates(texts: DataFrame, dictionary: DataFrame, limit: float = 150.0, weighted: bool = True) -> DataFrame:
    """(text, entry, population, position, dist) of each distinct text that the dictionary (entry, population, position) lacks with all entries closer
    than limit."""
    unknown = _unknown(texts, dictionary)
    return compared(unknown, dictionary, limit, READER_COSTS if weighted else UNIT_COSTS, closest=False).join(dictionary, "entry").select("text", "entry", "population", "position", "dist")


def _unknown(texts: DataFrame, dictionary: DataFrame) -> DataFrame:
    return texts.where("text is not null").select("text").distinct().join(dictionary.select(F.col("entry").alias("text")), "text", "left_anti")


def correct_spelling(texts: DataFrame, dictionary: DataFrame, weighted: bool = True, limit: float = 150.0) -> DataFrame:
    """texts with column corrected: known texts as they are, others the closest entry of the dictionary (entry, population, position), of equals the most
    populous, then the first; with none closer than limit the text itself. A null stays null."""
    best = Window.partitionBy("text").orderBy(F.desc("population"), "position")
    near = nearest_entries(_unknown(texts, dictionary), dictionary, limit, weighted).join(dictionary, "entry")
    found = near.withColumn("__n", F.row_number().over(best)).where("__n = 1").select("text", F.col("entry").alias("corrected"), "dist")
    return texts.join(found, "text", "left").withColumn("corrected", F.coalesce("corrected", "text"))


def label_to_node(labels: DataFrame, atoms: DataFrame, dictionary: DataFrame) -> DataFrame:
    """labels (text) with kind and value: atom and its symbol if the reader's map (text, symbol) has it; fragment and its smiles if the dictionary
    (text, smiles) has it; else alias and [text]. Both tables are dictionaries, whose size is checked."""
    named = labels.join(small(atoms.select("text", "symbol")), "text", "left").join(small(dictionary.select("text", "smiles")), "text", "left")
    kind = F.when(F.col("symbol").isNotNull(), "atom").when(F.col("smiles").isNotNull(), "fragment").otherwise("alias")
    value = F.coalesce("symbol", "smiles", F.concat(F.lit("["), F.col("text"), F.lit("]")))
    return named.withColumn("kind", kind).withColumn("value", value).drop("symbol", "smiles")


def rank_dictionary(dictionary: DataFrame) -> DataFrame:
    """dictionary with rank by population; one task ranks a dictionary, whose size is checked."""
    return small(dictionary).withColumn("rank", F.rank().over(Window.partitionBy(F.lit(0)).orderBy(F.desc("population"))))


def atom_population(atoms: DataFrame, drop: list[str] | None = None) -> DataFrame:
    """(symbol, population) of atoms (symbol, charge), charged ones under `symbol,charge`, most frequent first; symbols in drop are left out."""
    kept = atoms.where(~F.col("symbol").isin(drop)) if drop else atoms
    name: Column = F.when(F.col("charge") != 0, F.concat_ws(",", "symbol", F.col("charge").cast("string"))).otherwise(F.col("symbol"))
    return kept.groupBy(name.alias("symbol")).agg(F.count("*").alias("population")).orderBy(F.desc("population"), F.desc("symbol"))
