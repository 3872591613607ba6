"""Scores of predictions, class weights, and the sets that errors lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import origin_of


def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weights n / (classes * count)."""
    n = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = n.agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"))
    return n.join(F.broadcast(whole), F.lit(True)).select(label, "n", (F.col("total") / (F.col("k") * F.col("n"))).alias("weight"))


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def accuracy(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.agg(F.avg((F.col(truth) == F.col(predicted)).cast("double")).alias("accuracy"))


def classification_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """Precision, recall, F1 and support of each class, then accuracy, macro and weighted averages; 0 where undefined."""
    cells = df.groupBy(F.col(truth).cast("string").alias("t"), F.col(predicted).cast("string").alias("p")).agg(F.count(F.lit(1)).alias("n"))
    each = cells.select(F.explode(F.array(F.struct(F.col("t").alias("class"), F.lit(1).alias("is_t"), F.lit(0).alias("is_p")), F.struct(F.col("p").alias("class"), F.lit(0).alias("is_t"), F.lit(1).alias("is_p")))).alias("s"), "t", "p", "n")
    sums = each.groupBy(F.col("s.class").alias("class")).agg(F.sum(F.col("n") * F.col("s.is_t")).alias("support"), F.sum(F.col("n") * F.col("s.is_p")).alias("said"), F.sum(F.when((F.col("t") == F.col("p")) & (F.col("s.is_t") == 1), F.col("n")).otherwise(0)).alias("hit"))
    ratio = lambda a, b: F.when(b == 0, 0.0).otherwise(a / b)
    rows = sums.withColumn("precision", ratio(F.col("hit"), F.col("said"))).withColumn("recall", ratio(F.col("hit"), F.col("support")))
    rows = rows.withColumn("f1", ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))
    whole = F.sum("support")
    mean = rows.agg(*(F.avg(c).alias(c) for c in ("precision", "recall", "f1")), whole.alias("support")).withColumn("class", F.lit("macro avg"))
    weighted = rows.agg(*((F.sum(F.col(c) * F.col("support")) / whole).alias(c) for c in ("precision", "recall", "f1")), whole.alias("support")).withColumn("class", F.lit("weighted avg"))
    acc = rows.agg((F.sum("hit") / whole).alias("f1"), whole.alias("support")).select(F.lit(None).cast("double").alias("precision"), F.lit(None).cast("double").alias("recall"), "f1", "support", F.lit("accuracy").alias("class"))
    order = ["class", "precision", "recall", "f1", "support"]
    return rows.select(*order).unionByName(acc.select(*order)).unionByName(mean.select(*order)).unionByName(weighted.select(*order))


def errors(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.filter(~F.col(truth).eqNullSafe(F.col(predicted)))


def error_pairs(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return errors(df, truth, predicted).groupBy(truth, predicted).agg(F.count(F.lit(1)).alias("n"))


def with_sequence_stats(df: DataFrame, values: str) -> DataFrame:
    """Mean and sample standard deviation of each row's array."""
    x, n = F.col(values), F.size(values)
    mean = F.aggregate(x, F.lit(0.0), lambda s, v: s + v) / n
    spread = F.aggregate(x, F.lit(0.0), lambda s, v: s + F.pow(v - F.col("mean"), F.lit(2)))
    return df.withColumn("mean", mean).withColumn("std", F.when(n > 1, F.sqrt(spread / (n - 1))))


def curation_set(df: DataFrame, ident: str, truth: str, predicted: str, target: str) -> DataFrame:
    """False positives and negatives of a class, with the reason and the survey their ids name."""
    wrong = errors(df, truth, predicted)
    reason: Column = F.when(F.col(predicted) == target, "false_positive").when(F.col(truth) == target, "false_negative")
    return wrong.withColumn("reason", reason).filter(F.col("reason").isNotNull()).select(ident, F.col(truth).alias("original_class"), "reason", origin_of(F.col(ident).cast("string")).alias("origin"))


def reinforcement_candidates(wrong: DataFrame, source: DataFrame, train: DataFrame, key: str) -> DataFrame:
    """Ids with errors that the source has and training has not seen."""
    return wrong.select(key).distinct().join(source.select(key).distinct(), key, "left_semi").join(train.select(key).distinct(), key, "left_anti")
