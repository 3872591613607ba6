"""Counts and summaries of datasets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def class_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))


def dataset_summary(df: DataFrame, key: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.col(key)).alias("n_objects"))


def schema_summary(df: DataFrame) -> DataFrame:
    """One row a column: position (from 1), column, type, n_rows, n_null; counted in one pass."""
    counts = df.agg(F.count(F.lit(1)).alias("n_rows"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"n{i}") for i, c in enumerate(df.columns)))
    rows = [F.struct(F.lit(i + 1).cast("long").alias("position"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.col("n_rows"), F.col(f"n{i}").alias("n_null")) for i, f in enumerate(df.schema.fields)]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def raw_and_normalized(df: DataFrame, raw: str, normalized: str) -> DataFrame:
    """Counts of raw labels, each with the count of its class repeated."""
    by_raw = df.groupBy(raw, normalized).agg(F.count(F.lit(1)).alias("n_raw"))
    by_class = by_raw.groupBy(normalized).agg(F.sum("n_raw").alias("n_normalized"))
    return by_raw.join(by_class, normalized)


def objects_by_class(df: DataFrame, key: str, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count_distinct(F.col(key)).alias("n_objects"))


def null_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(c).isNull()).alias(f"null_{c}") for c in columns))


def coalesced_counts(df: DataFrame, first: str, second: str, out: str = "label") -> DataFrame:
    return df.groupBy(F.coalesce(first, second).alias(out)).agg(F.count(F.lit(1)).alias("n"))


def clean_mission(mission: Column) -> Column:
    return F.replace(F.upper(F.trim(mission)), F.lit("NONE"), F.lit("ZTF"))


def mission_counts(df: DataFrame, mission: str) -> DataFrame:
    return df.groupBy(clean_mission(F.col(mission)).alias("mission")).agg(F.count(F.lit(1)).alias("n"))


def recount(counts: DataFrame, label: str, n: str) -> DataFrame:
    """Counts added up again after labels were mapped."""
    return counts.groupBy(label).agg(F.sum(n).alias(n))


def class_by_dataset(df: DataFrame, key: str, label: str, dataset: str, datasets: list[str]) -> DataFrame:
    """Objects by class and dataset, with a TOTAL row and column; an object counts once in a dataset."""
    cells = df.groupBy(label, dataset).agg(F.count_distinct(F.col(key)).alias("n"))
    table = cells.groupBy(label).pivot(dataset, datasets).sum("n").na.fill(0)
    total = table.agg(F.lit("TOTAL").alias(label), *(F.coalesce(F.sum(d), F.lit(0)).alias(d) for d in datasets))
    both = table.unionByName(total)
    return both.withColumn("TOTAL", sum((F.col(d) for d in datasets[1:]), F.col(datasets[0])))


def unknown_share(df: DataFrame, dataset: str, label: str) -> DataFrame:
    unknown = F.count_if(F.col(label) == "Unknown")
    return df.groupBy(dataset).agg(F.count(F.lit(1)).alias("n_rows"), unknown.alias("n_unknown"), F.round(100.0 * unknown / F.count(F.lit(1)), 2).alias("pct_unknown"))


def all_hold(df: DataFrame, condition: Column) -> DataFrame:
    return df.agg(F.bool_and(condition).alias("all_hold"))


def status_counts(df: DataFrame, status: str) -> DataFrame:
    """Counts by the part of a status before its colon."""
    return df.groupBy(F.split(F.col(status), ":")[0].alias("status")).agg(F.count(F.lit(1)).alias("n"))


def progress(todo: DataFrame, done: DataFrame, key: str) -> DataFrame:
    both = todo.select(key).distinct().join(done.select(key).distinct().withColumn("_done", F.lit(1)), key, "left")
    return both.agg(F.count(F.lit(1)).alias("n_total"), F.count("_done").alias("n_done"), F.round(100.0 * F.count("_done") / F.count(F.lit(1)), 2).alias("pct_done"))
