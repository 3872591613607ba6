"""Joins, set operations, caps, samples and orderings with defined results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def stable_order(ident: str, seed: int = 42) -> Column:
    """An order that looks random and that id and seed decide."""
    return F.md5(F.concat(F.col(ident).cast("string"), F.lit(str(seed))))


def stable_rank(df: DataFrame, ident: str, keys: list[str], rank: str, total: str | None = None, seed: int = 42) -> DataFrame:
    """df with each row's place from 1 on in stable order among those with its keys (all rows without keys), and their number.

    Rows are numbered in 4096 buckets, the first digits of the order, after the counts of the buckets before; so no task
    holds a class or the table."""
    order = stable_order(ident, seed)
    marked = df.withColumn("_bucket", F.substring(order, 1, 3))
    counts = marked.groupBy(*keys, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    whole = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    named = [F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)]
    before = counts.select(*named, F.col("_bucket").alias("_at"), (F.sum("_n").over(whole.orderBy("_bucket")) - F.col("_n")).alias("_before"), F.sum("_n").over(whole).alias("_total"))
    inside = marked.withColumn("_inside", F.row_number().over(Window.partitionBy(*keys, "_bucket").orderBy(order, ident)))
    same = F.col("_bucket") == F.col("_at")
    for i, k in enumerate(keys):
        same &= inside[k].eqNullSafe(F.col(f"_key{i}"))
    placed = inside.join(before, same).withColumn(rank, F.col("_before") + F.col("_inside"))
    placed = placed.withColumn(total, F.col("_total")) if total else placed
    return placed.drop("_bucket", "_inside", "_at", "_before", "_total", *(f"_key{i}" for i in range(len(keys))))


def preview(df: DataFrame, ident: str, group: str, n: int, seed: int = 42) -> DataFrame:
    """n rows of each group (a file, a batch), picked by id and seed."""
    w = Window.partitionBy(group).orderBy(stable_order(ident, seed), ident)
    return df.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") <= n).drop("_r")


def counts_in_order(df: DataFrame, label: str) -> DataFrame:
    """Rows of each class, the most frequent first, then by class."""
    return df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).orderBy(F.col("n").desc(), label)


def join_labels(df: DataFrame, catalog: DataFrame, key: str, label: str, default: str = "Unknown") -> DataFrame:
    """Every row with its object's label, default without one. Of repeated keys in the catalog the smallest label counts."""
    one = catalog.groupBy(key).agg(F.min(label).alias(label))
    return df.join(one, key, "left").withColumn(label, F.coalesce(F.col(label), F.lit(default)))


def keep_first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in the given order."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_r", F.row_number().over(w)).filter("_r = 1").drop("_r")


def discrepancies(left: DataFrame, right: DataFrame, key: str, a: str, b: str) -> DataFrame:
    """Rows of left whose a differs from b of the right row; a missing value differs from any other."""
    return left.join(right, key, "left").filter(~F.col(a).eqNullSafe(F.col(b)))


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str = "NO_ENCONTRADO") -> DataFrame:
    """Every row with its key's value, default without one. Of repeated keys in the table the smallest value counts."""
    one = table.groupBy(key).agg(F.min(value).alias(value))
    return df.join(one, key, "left").withColumn(value, F.coalesce(F.col(value), F.lit(default)))


def cap_classes(df: DataFrame, ident: str, label: str, cap: int | None, overrides: dict[str, int | None] | None = None, always: DataFrame | None = None, seed: int = 42) -> DataFrame:
    """At most cap objects of each class in stable order; overrides set a class's own cap (None: all, 0: none); ids in
    always stay beyond the cap, but not in a class of cap 0."""
    top = 2**62
    limit = F.lit(top if cap is None else cap)
    for name, own in (overrides or {}).items():
        limit = F.when(F.col(label) == name, F.lit(top if own is None else own)).otherwise(limit)
    marked = stable_rank(df, ident, [label], "_rank", seed=seed).withColumn("_limit", limit)
    if always is None:
        return marked.filter(F.col("_rank") <= F.col("_limit")).drop("_rank", "_limit")
    marked = marked.join(always.select(ident).distinct().withColumn("_always", F.lit(True)), ident, "left")
    return marked.filter((F.col("_rank") <= F.col("_limit")) | (F.col("_always") & (F.col("_limit") > 0))).drop("_rank", "_limit", "_always")


def seeded_sample(df: DataFrame, ident: str, n: int, seed: int = 42) -> DataFrame:
    return df.orderBy(stable_order(ident, seed), ident).limit(n)


def stratified_split(df: DataFrame, ident: str, label: str, test: float = 0.1, validation: float = 0.2222, seed: int = 42, into_train: DataFrame | None = None) -> DataFrame:
    """df with split: of each class the first share test, of the rest the share validation, in stable order. Ids in
    into_train are moved to train, never copied."""
    n_test = F.floor(F.col("_all") * test)
    n_val = F.floor((F.col("_all") - F.col("_test")) * validation)
    split = F.when(F.col("_rank") <= F.col("_test"), "test").when(F.col("_rank") <= F.col("_test") + F.col("_val"), "val").otherwise("train")
    ranked = stable_rank(df, ident, [label], "_rank", "_all", seed)
    out = ranked.withColumn("_test", n_test).withColumn("_val", n_val).withColumn("split", split).drop("_rank", "_all", "_test", "_val")
    if into_train is None:
        return out
    forced = into_train.select(ident).distinct().withColumn("_forced", F.lit(True))
    return out.join(forced, ident, "left").withColumn("split", F.when(F.col("_forced"), "train").otherwise(F.col("split"))).drop("_forced")


def exclude(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_anti")


def only(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return df.join(ids.select(key).distinct(), key, "left_semi")


def flagged_first(df: DataFrame, flag: Column, order: list, n: int) -> DataFrame:
    """The first n rows, those without the flag before those with it."""
    return df.withColumn("_flag", flag).orderBy("_flag", *order).limit(n).drop("_flag")
