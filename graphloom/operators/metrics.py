"""Scores of predictions against ground truth."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.distance import clipped_matches, lcs_length
from .small import small


#: Labels of a confusion matrix: its size is their square.
MOST_LABELS = 1000

# -- classes ---------------------------------------------------------------------------------------------------------------------------------


def class_population(rows: DataFrame, vocabulary: DataFrame, column: str = "class") -> DataFrame:
    """(symbol, population) of every symbol of the vocabulary, counting from 1."""
    counts = rows.groupBy(F.col(column).alias("symbol")).agg(F.count("*").alias("n"))
    return vocabulary.select("symbol").join(counts, "symbol", "left").select("symbol", (1 + F.coalesce("n", F.lit(0))).alias("population"))


def class_weights(population: DataFrame, share: float = 0.2) -> DataFrame:
    """1 for classes more populous than the share's percentile, else 3."""
    edge = population.agg(F.percentile("population", F.lit(share)).alias("edge"))
    return population.join(F.broadcast(edge), how="cross").select("symbol", "population", F.when(F.col("population") > F.col("edge"), 1).otherwise(3).alias("weight"))


def confusion_matrix(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(gt, pred, n) over all pairs of labels (label), of which there are MOST_LABELS at most, zeros kept."""
    grid = labels.select(F.col("label").alias("gt")).join(small(labels.select(F.col("label").alias("pred")), MOST_LABELS), how="cross")
    return grid.join(rows.groupBy("gt", "pred").agg(F.count("*").alias("n")), ["gt", "pred"], "left").na.fill(0, ["n"])


def row_normalised(confusion: DataFrame) -> DataFrame:
    """Shares of each true class that has rows; shares below 0.005 are 0."""
    total = F.sum("n").over(Window.partitionBy("gt"))
    share = confusion.withColumn("total", total).where("total > 0").withColumn("share", F.col("n") / F.col("total"))
    return share.select("gt", "pred", F.when(F.col("share") < 0.005, 0.0).otherwise(F.round("share", 6)).alias("share"))


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def classification_report(confusion: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of each label, with the averages `macro avg` and `weighted avg`."""
    by_gt = confusion.groupBy(F.col("gt").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("gt") == F.col("pred"), F.col("n"))).alias("hit"))
    by_pred = confusion.groupBy(F.col("pred").alias("label")).agg(F.sum("n").alias("predicted"))
    rows = by_gt.join(by_pred, "label").withColumn("precision", _ratio(F.col("hit"), F.col("predicted"))).withColumn("recall", _ratio(F.col("hit"), F.col("support")))
    rows = rows.withColumn("f1", _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).select(F.col("label").cast("string").alias("label"), "precision", "recall", "f1", "support")
    parts = ["precision", "recall", "f1"]
    macro = rows.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in parts], F.sum("support").alias("support"))
    weighted = rows.agg(F.lit("weighted avg").alias("label"), *[_ratio(F.sum(F.col(c) * F.col("support")), F.sum("support")).alias(c) for c in parts], F.sum("support").alias("support"))
    return rows.unionByName(macro).unionByName(weighted).select("label", *[F.round(c, 6).alias(c) for c in parts], F.col("support").cast("long").alias("support"))


def node_accuracy(rows: DataFrame) -> DataFrame:
    """rows (batch, kind, gt, pred) -> (batch, kind, accuracy in percent, all_correct) for each kind and, under `all`, for both."""
    hit = (F.col("gt") == F.col("pred")).cast("int")
    got = rows.rollup("batch", "kind").agg(F.round(100 * F.avg(hit), 4).alias("accuracy"), (F.min(hit) == 1).alias("all_correct"))
    return got.where("batch is not null").select("batch", F.coalesce("kind", F.lit("all")).alias("kind"), "accuracy", "all_correct")


def subset_accuracy(rows: DataFrame, by: str, within: str) -> DataFrame:
    """(within, accuracy): share of `by` whose sets of gt and pred are equal."""
    sets = rows.groupBy(within, by).agg(F.array_sort(F.collect_set("gt")).alias("g"), F.array_sort(F.collect_set("pred")).alias("p"))
    return sets.groupBy(within).agg(F.round(F.avg((F.col("g") == F.col("p")).cast("int")), 6).alias("accuracy"))


def multiset_accuracy(rows: DataFrame, by: str, within: str) -> DataFrame:
    """As subset_accuracy, counting repeats: no value is more frequent on one side."""
    side = lambda c: rows.groupBy(within, by, F.col(c).alias("v")).agg(F.count("*").alias(c))
    both = side("gt").join(side("pred"), [within, by, "v"], "full")
    same = both.groupBy(within, by).agg(F.min((F.coalesce("gt", F.lit(0)) == F.coalesce("pred", F.lit(0))).cast("int")).alias("same"))
    return same.groupBy(within).agg(F.round(F.avg("same"), 6).alias("accuracy"))


def superatom_accuracy(gt: DataFrame, pred: DataFrame, images: DataFrame) -> DataFrame:
    """(with_labels, accuracy): share of images that have true labels (image_id, label), and share of these whose predicted set is equal."""
    sets = lambda d, n: d.groupBy("image_id").agg(F.array_sort(F.collect_set("label")).alias(n))
    rows = images.select("image_id").distinct().join(sets(gt, "g"), "image_id", "left").join(sets(pred, "p"), "image_id", "left")
    return rows.agg(F.round(F.avg(F.col("g").isNotNull().cast("int")), 6).alias("with_labels"), F.round(F.avg(F.when(F.col("g").isNotNull(), F.coalesce(F.col("g") == F.col("p"), F.lit(False)).cast("int"))), 6).alias("accuracy"))


# -- runs and benchmarks -----------------------------------------------------------------------------------------------------------------------


def best_candidate(runs: DataFrame) -> DataFrame:
    """The run of each image with the greatest conf, of equals the lowest step."""
    return runs.withColumn("__n", F.row_number().over(Window.partitionBy("image_id").orderBy(F.desc("conf"), "step"))).where("__n = 1").drop("__n")


def benchmark_summary(scores: DataFrame) -> DataFrame:
    """scores (benchmark, processed, correct, sentinel) -> inputs, processed, precision, detected error rate (sentinels among errors; 0 if none)."""
    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    done, good = F.col("processed"), F.col("correct")
    return summary_rates(scores.groupBy("benchmark").agg(F.count("*").alias("inputs"), one(done).alias("processed"), one(done & good).alias("correct"), one(done & ~good).alias("wrong"), one(done & ~good & F.col("sentinel")).alias("caught")))


def summary_rates(counters: DataFrame) -> DataFrame:
    """benchmark_summary of its counters (benchmark, inputs, processed, correct, wrong, caught)."""
    rate = lambda a, b: F.round(F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0), 4)
    return counters.select("benchmark", "inputs", "processed", rate("correct", "processed").alias("precision"), rate("caught", "wrong").alias("detected_error_rate"))


def compare_models(scores: DataFrame, key: str, model: str, models: list[str], value: Column) -> DataFrame:
    """One row for each key, a column for each model; null where a model has nothing."""
    return scores.groupBy(key).pivot(model, models).agg(value)


def confidence_override(smiles: Column, conf: Column) -> tuple[Column, Column]:
    """(smiles, conf): nothing recognised (`C` or empty) has confidence 0; an empty result is null."""
    return F.when(smiles != "", smiles), F.when(smiles.isin("C", ""), 0.0).otherwise(conf)


# -- confidences -----------------------------------------------------------------------------------------------------------------------------


def softmax_max(logits: Column) -> Column:
    top = F.array_max(logits)
    return 1 / F.aggregate(F.transform(logits, lambda x: F.exp(x - top)), F.lit(0.0), lambda a, x: a + x)


def argmax(values: Column) -> Column:
    """Place, from 0, of the first greatest value."""
    return F.array_position(values, F.array_max(values)) - 1


def graph_confidence(nodes: DataFrame) -> DataFrame:
    """(image_id, conf): least over the nodes of the greatest softmax, 3 places."""
    return nodes.groupBy("image_id").agg(F.round(F.min(softmax_max(F.col("logits"))), 3).alias("conf"))


def confidence_threshold(rows: DataFrame, limit: int, bins: int = 100) -> DataFrame:
    """rows (conf) with threshold, the edge `limit` from the top of equal-width bins between the extremes, and whether conf is above it."""
    ends = rows.agg(F.min("conf").alias("lo"), F.max("conf").alias("hi"))
    edge = F.round(F.col("lo") + (F.col("hi") - F.col("lo")) * (bins + 1 - limit) / bins, 6)
    return rows.join(F.broadcast(ends), how="cross").withColumn("threshold", edge).withColumn("above", F.col("conf") > F.col("threshold")).drop("lo", "hi")


def bin_index(value: Column, bins: list[float]) -> Column:
    """Least i from 1 with value <= bins[i]; the last where value is above all."""
    found = F.filter(F.sequence(F.lit(1), F.lit(len(bins) - 1)), lambda i: value <= F.element_at(F.array(*[F.lit(float(b)) for b in bins]), i + 1))
    return F.coalesce(F.get(found, F.lit(0)), F.lit(len(bins) - 1))


def size_class(rows: DataFrame, column: str) -> DataFrame:
    """rows with size: Small up to int(mean - sd), Big from int(mean + sd), else Medium; the name tells the bounds."""
    ends = rows.agg(F.floor(F.avg(column) - F.stddev_samp(column)).alias("lo"), F.floor(F.avg(column) + F.stddev_samp(column)).alias("hi"))
    lo, hi = F.col("lo"), F.col("hi")
    name = F.when(F.col(column) <= lo, F.concat(F.lit("Small (<="), lo, F.lit(")"))).when(F.col(column) >= hi, F.concat(F.lit("Big (>="), hi, F.lit(")"))).otherwise(F.concat(F.lit("Medium ("), lo, F.lit("-"), hi, F.lit(")")))
    return rows.join(F.broadcast(ends), how="cross").withColumn("size", name).drop("lo", "hi")


def nested_totals(rows: DataFrame, outer: str, inner: str, values: list[str] | None = None) -> DataFrame:
    """(outer, inner, n, sums of values): counts and sums by outer and inner, and under null inner by outer. A null inner of the rows counts in the
    outer's row alone."""
    sums = [F.sum(c).alias(c) for c in values or []]
    found = rows.rollup(outer, inner).agg(F.grouping_id().alias("__level"), F.count("*").alias("n"), *sums)
    return found.where(F.col(outer).isNotNull() & ((F.col("__level") == 1) | F.col(inner).isNotNull())).drop("__level")


# -- texts -----------------------------------------------------------------------------------------------------------------------------------


def _with_matches(rows: DataFrame, gt: Column, pred: Column) -> DataFrame:
    """rows with the texts to compare (__g, __p) and __m, the clipped matches of their character 1- to 4-grams: one pass over each pair."""
    rows = rows.withColumn("__g", F.coalesce(gt, F.lit(""))).withColumn("__p", F.coalesce(pred, F.lit("")))
    return rows.withColumn("__m", clipped_matches(F.col("__g"), F.col("__p")))


def bleu(rows: DataFrame) -> DataFrame:
    """rows (gt, pred) with bleu_1 to bleu_4, each alone, and bleu_average, over characters; a zero match counts as 0.1; no common character at all, or an
    empty prediction, gives 0."""
    columns, rows = rows.columns, _with_matches(rows, F.col("gt"), F.col("pred"))
    g, p = F.length("__g"), F.length("__p")
    match = {n: F.element_at("__m", n) for n in (1, 2, 3, 4)}
    precision = {n: F.when(match[n] > 0, match[n]).otherwise(0.1) / F.greatest(p - n + 1, F.lit(1)) for n in match}
    brevity = F.when(p > g, 1.0).otherwise(F.exp(1 - g / F.greatest(p, F.lit(1))))
    some = (match[1] > 0) & (p > 0)
    each = [F.when(some, F.round(brevity * precision[n], 6)).otherwise(0.0).alias(f"bleu_{n}") for n in match]
    logs = reduce(lambda a, b: a + b, [F.log(precision[n]) for n in match]) / 4
    return rows.select(*columns, *each, F.when(some, F.round(brevity * F.exp(logs), 6)).otherwise(0.0).alias("bleu_average"))


def _letters(text: str) -> Column:
    return F.regexp_replace(F.lower(text), "[^a-z0-9]", "")


def _f_measure(match: Column, g: Column, p: Column) -> Column:
    return F.when((match > 0) & (g > 0) & (p > 0), F.round(2 * match / (g + p), 6)).otherwise(0.0)


def rouge_n(rows: DataFrame) -> DataFrame:
    """rows (gt, pred) with rouge_1 to rouge_4: F-measures of character n-grams; only letters and digits count, case doesn't."""
    columns, rows = rows.columns, _with_matches(rows, _letters("gt"), _letters("pred"))
    return rows.select(*columns, *[_f_measure(F.element_at("__m", n), F.length("__g") - n + 1, F.length("__p") - n + 1).alias(f"rouge_{n}") for n in (1, 2, 3, 4)])


def rouge_l(rows: DataFrame) -> DataFrame:
    """rows (gt, pred) with rouge_l: F-measure of the longest common subsequence."""
    g, p = _letters("gt"), _letters("pred")
    return rows.withColumn("rouge_l", _f_measure(lcs_length(g, p), F.length(g), F.length(p)))


def exact_match(rows: DataFrame) -> DataFrame:
    """rows (gt, pred) with exact: whether they are equal; false where one is null."""
    return rows.withColumn("exact", F.coalesce(F.col("gt") == F.col("pred"), F.lit(False)))


def levenshtein_score(rows: DataFrame) -> DataFrame:
    return rows.withColumn("levenshtein", F.levenshtein("gt", "pred")).withColumn("levenshtein0", F.col("levenshtein") == 0)


def tanimoto(a: Column, b: Column) -> Column:
    """Shared bits of two arrays of set bits, as a share of all; 0 where both are empty."""
    either = F.size(F.array_union(a, b))
    return F.when(either > 0, F.round(F.size(F.array_intersect(a, b)) / either, 6)).otherwise(0.0)


def with_default_scores(truth: DataFrame, scores: DataFrame, key: str, defaults: dict) -> DataFrame:
    """A row for each row of truth; where scores has none, the default scores."""
    return truth.join(scores, key, "left").na.fill(defaults)


def select_for_report(scores: DataFrame, info: DataFrame, charged: DataFrame, key: str, most: int = 1500) -> DataFrame:
    """Valid scores of molecules without stereochemistry and charged atoms, with fewer than `most` atoms."""
    return scores.join(info, key).where((F.col("nb_atoms") < most) & ~F.col("stereochemistry") & F.col("valid")).join(charged.select(key).distinct(), key, "left_anti")


def common_ids(a: DataFrame, b: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows of two score sets whose key is in both."""
    return a.join(b.select(key).distinct(), key, "left_semi"), b.join(a.select(key).distinct(), key, "left_semi")


def outliers(scores: DataFrame) -> DataFrame:
    return scores.where(~F.col("correct"))
