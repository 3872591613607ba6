"""Exact quantiles of groups of any size.

Groups of up to SPREAD rows are aggregated as they are. A larger group (one object, or the whole table where there is no
key) never meets in one task: mergeable sketches over all tasks give a grid of values, the two of its cells around the
wanted rank become the new range, rows below the range are counted and those inside it get a sketch of their own, until
few enough different values are left to be ranked exactly. Sketches only choose ranges; the rank is always counted.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a group up to which its values meet in one task; so at most one group in that many rows is a large one.
SPREAD = 1 << 20
#: Cells of a grid, cells kept on both sides of a rank (a sketch errs by GRID / ACCURACY of one), accuracy of sketches.
GRID, MARGIN, ACCURACY = 1000, 3, 10_000

Wanted = dict[str, tuple[Column, list[float]]]


@dataclass(frozen=True)
class Groups:
    """Rows of the largest group of keys, and the keys of those beyond SPREAD as local rows: one at most for so many rows."""

    keys: list[str]
    most: int
    large: DataFrame | None = None


def groups_of(df: DataFrame, keys: list[str]) -> Groups:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    most = sizes.agg(F.max("_n")).first()[0] or 0
    if most <= SPREAD:
        return Groups(keys, most)
    found = sizes.filter(F.col("_n") > SPREAD).drop("_n")
    return Groups(keys, most, F.broadcast(_renamed(df.sparkSession.createDataFrame(found.collect(), found.schema), keys)))


def _renamed(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})


def _same(keys: list[str]) -> Column:
    """Equal keys, nulls too; of the right side under the names that _renamed gives."""
    return reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_key{i}")) for i, k in enumerate(keys)))


def _joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    return left.join(_renamed(right, keys), _same(keys), how).drop(*(f"_key{i}" for i in range(len(keys))))


def _percentile(value: Column, probs: list[float]) -> Column:
    return F.percentile(F.when(~F.isnan(value), value), F.array(*map(F.lit, probs)))


def _selected(points: DataFrame, keys: list[str], probs: list[float], most: int) -> DataFrame:
    """keys and q, the quantiles of _v, of large groups of up to most rows, as local rows; no group is gathered.

    Between rounds the range of each wanted rank is on the driver: one row a large group and probability."""
    spark, by = points.sparkSession, [*keys, "_i"]
    sizes = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_m"))
    ranks = sizes.select(*keys, "_m", F.posexplode(F.array(*map(F.lit, probs))).alias("_i", "_p")).withColumn("_pos", F.col("_p") * (F.col("_m") - 1))
    none = F.lit(None).cast("double")
    state = ranks.select(*by, "_pos", F.floor("_pos").alias("_lo"), F.ceil("_pos").alias("_hi"), none.alias("_a"), none.alias("_b"))
    under = F.coalesce(F.col("_v") < F.col("_a"), F.lit(False))
    inside = F.coalesce(F.col("_v") >= F.col("_a"), F.lit(True)) & F.coalesce(F.col("_v") <= F.col("_b"), F.lit(True))

    def held(rows: DataFrame) -> DataFrame:
        return spark.createDataFrame(rows.collect(), rows.schema)

    def meet() -> DataFrame:
        return points.join(F.broadcast(_renamed(state, keys)), _same(keys)).drop(*(f"_key{i}" for i in range(len(keys))))

    state, left = held(state), most
    while left > SPREAD:
        value = F.when(inside, F.col("_v"))
        cells = F.percentile_approx(value, F.array(*(F.lit(i / GRID) for i in range(GRID + 1))), ACCURACY)
        known = meet().groupBy(*by, "_pos", "_lo", "_hi", "_a", "_b").agg(F.count_if(under).alias("_below"), F.count(value).alias("_in"), cells.alias("_g"))
        cell = lambda rank: (F.col(rank) - F.col("_below")) / F.col("_in") * GRID
        low, high = (F.floor(cell("_lo")) - MARGIN).cast("int"), (F.ceil(cell("_hi")) + MARGIN).cast("int")
        # the ends of a grid are not the ends of the values for sure: there the range stays
        a, b = F.when(low <= 0, F.col("_a")).otherwise(F.get("_g", low)), F.when(high >= GRID, F.col("_b")).otherwise(F.get("_g", high))
        state = held(known.select(*by, "_pos", "_lo", "_hi", a.alias("_a"), b.alias("_b")))
        left = left * (2 * MARGIN + 3) // GRID
    # values below the range are one row, equal values inside it one row each, with their numbers
    values = meet().filter(under | inside).groupBy(*by, "_pos", "_lo", "_hi", F.when(inside, F.col("_v")).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    ranked = values.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*by).orderBy(F.col("_v").asc_nulls_first())))
    at = lambda rank: F.min(F.when(F.col("_upto") > F.col(rank), F.col("_v")))
    picked = ranked.groupBy(*by, "_pos", "_lo", "_hi").agg(at("_lo").alias("_x"), at("_hi").alias("_y"))
    q = F.when((F.col("_lo") == F.col("_hi")) | (F.col("_x") == F.col("_y")), F.col("_x")).otherwise((F.col("_hi") - F.col("_pos")) * F.col("_x") + (F.col("_pos") - F.col("_lo")) * F.col("_y"))
    return held(picked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", q.alias("q")))), lambda s: s["q"]).alias("q")))


def group_quantiles(df: DataFrame, keys: list[str], wanted: Wanted, aggs: tuple[Column, ...] = (), groups: Groups | None = None) -> DataFrame:
    """keys, the aggregates aggs, and for each wanted name an array of the exact quantiles of its value, linear between ranks.

    Nulls and NaN have no rank; a group without values has null; null keys are a group; an empty table has none. groups:
    the sizes of the groups, where they are known; else they are counted first."""
    groups = groups or groups_of(df, keys)
    whole = lambda rows: rows.groupBy(*keys).agg(*aggs, *(_percentile(v, p).alias(n) for n, (v, p) in wanted.items()))
    if groups.large is None:
        return whole(df)
    rows = df.join(groups.large, _same(keys), "left_semi")
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_rows"), *aggs).drop("_rows")
    for name, (value, probs) in wanted.items():
        points = rows.select(*keys, value.cast("double").alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
        out = _joined(out, F.broadcast(_selected(points, keys, probs, groups.most).withColumnRenamed("q", name)), keys)
    return whole(df.join(groups.large, _same(keys), "left_anti")).unionByName(out)


def attach(df: DataFrame, stats: DataFrame, groups: Groups) -> DataFrame:
    """df with its group's row of stats; rows of large groups stay where they are and meet a broadcast row."""
    keys = groups.keys
    if groups.large is None:
        return _joined(df, stats, keys)
    few = F.broadcast(stats.join(groups.large, _same(keys), "left_semi"))
    return _joined(df.join(groups.large, _same(keys), "left_anti"), stats, keys).unionByName(_joined(df.join(groups.large, _same(keys), "left_semi"), few, keys))
