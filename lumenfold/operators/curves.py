"""Per-curve operators over long observation tables: one row a point, grouped by object."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.arrays import clip, is_finite, mask, pad, robust
from .quantiles import Groups, attach, group_quantiles, groups_of

FEATURES = ["f_std", "f_iqr", "f_amplitude", "f_median", "f_mad", "f_skew", "f_kurtosis"]
MIN_POINTS, MIN_STD = 30, 1e-4


def _finite(value: str) -> Column:
    return F.when(is_finite(F.col(value)), F.col(value))


def impute_median(df: DataFrame, key: str, value: str, out: str = "imputed") -> DataFrame:
    """Values that are not finite become the median of the finite ones of their curve."""
    groups = groups_of(df, [key])
    medians = group_quantiles(df.select(key, value), [key], {"_q": (_finite(value), [0.5])}, groups=groups)
    return attach(df, medians, groups).withColumn(out, F.coalesce(_finite(value), F.col("_q")[0])).drop("_q")


def normalize_by_median(df: DataFrame, key: str, value: str, out: str = "normalized") -> DataFrame:
    """Values in medians of their curve, which values that are no number do not move."""
    groups = groups_of(df, [key])
    medians = group_quantiles(df.select(key, value), [key], {"_q": (F.col(value), [0.5])}, groups=groups)
    return attach(df, medians, groups).withColumn(out, F.col(value) / F.col("_q")[0]).drop("_q")


def curve_stats(df: DataFrame, key: str, value: str, label: Column | None = None, groups: Groups | None = None) -> DataFrame:
    """One row a curve after median imputation: counts, moments, quartiles and median deviation, and its label.

    The imputed points are computed once: adding copies of the median does not move it, so deviations are known with it."""
    groups = groups or groups_of(df, [key])
    medians = group_quantiles(df.select(key, value), [key], {"_q": (_finite(value), [0.5])}, groups=groups)
    points = attach(df, medians, groups).withColumn("_x", F.coalesce(_finite(value), F.col("_q")[0]))
    aggs = [F.count(F.lit(1)).alias("n"), F.count(_finite(value)).alias("n_finite"), F.stddev_pop("_x").alias("std"), F.min("_x").alias("low"), F.max("_x").alias("high"), F.skewness("_x").alias("skew"), F.kurtosis("_x").alias("kurt")]
    if label is not None:
        aggs.append(label.alias("label"))
    wanted = {"q": (F.col("_x"), [0.25, 0.5, 0.75]), "_mad": (F.abs(F.col("_x") - F.col("_q")[0]), [0.5])}
    return group_quantiles(points, [key], wanted, tuple(aggs), groups).withColumn("mad", F.col("_mad")[0]).drop("_mad")


def discard_reason(stats: DataFrame, min_points: int = MIN_POINTS, min_std: float = MIN_STD, has_label: bool = True) -> Column:
    """Why a curve is left out, in fixed order, or ok."""
    scaled = F.greatest(F.abs(F.col("low") - F.col("q")[1]), F.abs(F.col("high") - F.col("q")[1]))
    out = F.when(F.col("label").isNull() | (F.col("label") == "Unknown"), "unknown_class") if has_label else F.when(F.lit(False), "unknown_class")
    return out.when(F.col("n_finite") == 0, "all_invalid").when(F.col("n") < min_points, "short_curve").when(F.col("std") < min_std, "low_std").when(~is_finite(scaled), "nan_or_inf_after_norm").otherwise("ok")


def features_of(stats: DataFrame, key: str) -> DataFrame:
    """The seven features of every curve from its statistics; those that are not finite are 0, and skew, kurtosis and amplitude are clipped."""
    safe = lambda c: F.when(is_finite(c), c).otherwise(0.0)
    columns = {
        "f_std": safe(F.col("std")), "f_iqr": safe(F.col("q")[2] - F.col("q")[0]), "f_amplitude": clip(safe(F.col("high") - F.col("low")), 0, 100), "f_median": safe(F.col("q")[1]),
        "f_mad": safe(F.col("mad")), "f_skew": clip(safe(F.col("skew")), -10, 10), "f_kurtosis": clip(safe(F.col("kurt")), -20, 20),
    }
    return stats.select(key, "n", *(c.alias(n) for n, c in columns.items()))


def curve_features(df: DataFrame, key: str, value: str) -> DataFrame:
    """The seven features of every curve after median imputation."""
    return features_of(curve_stats(df, key, value), key)


def normalize_robust(df: DataFrame, key: str, value: str, out: str = "scaled") -> DataFrame:
    """Values minus their curve's median in its interquartile ranges, clipped."""
    groups = groups_of(df, [key])
    quartiles = group_quantiles(df.select(key, value), [key], {"_q": (F.col(value), [0.25, 0.5, 0.75])}, groups=groups)
    return attach(df, quartiles, groups).withColumn(out, robust(F.col(value), F.col("_q")[1], F.col("_q")[2] - F.col("_q")[0])).drop("_q")


def to_sequences(df: DataFrame, key: str, order: list[str], value: str, length: int) -> DataFrame:
    """One row a curve: its first length values in order, padded, and their mask. Points beyond length never meet."""
    w = Window.partitionBy(key).orderBy(*order)
    kept = df.withColumn("_i", F.row_number().over(w)).filter(F.col("_i") <= length)
    whole = kept.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", F.col(value).alias("x")))), lambda s: s["x"]).alias("_values"))
    return whole.select(key, pad(F.col("_values"), length).alias("sequence"), mask(F.col("_values"), length).alias("mask"))


def feature_quartiles(features: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """feature, q: the quartiles of each feature over all objects, exact by selection; with accuracy (say 10,000) from
    sketches, within 1 / accuracy of the ranks."""
    at = [0.25, 0.5, 0.75]
    long = features.select(F.explode(F.array(*(F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("x")) for c in columns))).alias("f")).select("f.*")
    if accuracy is not None:
        return long.groupBy("feature").agg(F.percentile_approx("x", F.array(*map(F.lit, at)), accuracy).alias("q"))
    return group_quantiles(long, ["feature"], {"q": (F.col("x"), at)})


def apply_scaling(features: DataFrame, columns: list[str], quartiles: DataFrame) -> DataFrame:
    """Each feature minus its median in interquartile ranges by given quartiles (feature, q); what is not finite becomes 0."""
    one = quartiles.groupBy().pivot("feature", columns).agg(F.first("q"))  # one row, an array a feature
    one = one.select(*(F.col(c).alias(f"_q_{c}") for c in columns))
    scaled = lambda c: (F.col(c) - F.col(f"_q_{c}")[1]) / (F.col(f"_q_{c}")[2] - F.col(f"_q_{c}")[0] + F.lit(1e-8))
    joined = features.join(F.broadcast(one), F.lit(True))
    return joined.select(*(c for c in features.columns if c not in columns), *(F.when(is_finite(scaled(c)), scaled(c)).otherwise(0.0).alias(c) for c in columns))


def scale_features(features: DataFrame, columns: list[str], accuracy: int | None = None) -> DataFrame:
    """Each feature minus its median in interquartile ranges over all objects; what is not finite becomes 0."""
    return apply_scaling(features, columns, feature_quartiles(features, columns, accuracy))


def encode_labels(df: DataFrame, label: str, out: str = "label_idx") -> DataFrame:
    """Sorted different labels as 0, 1, ...; only they are numbered together, then join back."""
    classes = df.select(label).distinct().withColumn(out, F.row_number().over(Window.partitionBy(F.lit(0)).orderBy(label)) - 1)
    return df.join(classes, label)


def first_label(df: DataFrame, key: str, label: str, order: list[str]) -> DataFrame:
    return df.groupBy(key).agg(F.min_by(label, F.struct(*order)).alias(label))


def length_distribution(df: DataFrame, key: str) -> DataFrame:
    """Distribution of the number of points of a curve."""
    n = df.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    moments = n.agg(F.count(F.lit(1)).alias("n_curves"), F.avg("n").alias("mean"), F.stddev_samp("n").alias("std"), F.min("n").alias("min"), F.max("n").alias("max"))
    often = n.groupBy("n").agg(F.count(F.lit(1)).alias("times"))  # few different lengths, whatever the number of curves
    quantiles = often.agg(F.percentile("n", F.array(*(F.lit(p) for p in (0.5, 0.75, 0.9, 0.95, 0.99))), F.col("times")).alias("q"))
    s = moments.join(quantiles, F.lit(True))  # one row each
    return s.select("n_curves", "mean", "std", "min", *(F.col("q")[i].alias(f"p{p}") for i, p in enumerate((50, 75, 90, 95, 99))), "max")


def validity_by_class(df: DataFrame, key: str, label: str, value: str) -> DataFrame:
    """Valid and invalid curves of each class; a curve without finite values or without spread is invalid."""
    finite = F.when(is_finite(F.col(value)), F.col(value))
    per = df.groupBy(key).agg(F.min(label).alias(label), F.count(finite).alias("n"), F.stddev_pop(finite).alias("s"))
    bad = (F.col("n") == 0) | (F.coalesce("s", F.lit(0.0)) == 0)
    return per.groupBy(label).agg(F.count_if(~bad).alias("n_valid"), F.count_if(bad).alias("n_invalid"))


def feature_summary(features: DataFrame, columns: list[str]) -> DataFrame:
    """One row a feature: mean, population std, extremes, and how many are NaN, infinite or zero."""
    long = features.select(F.posexplode(F.array(*(F.col(c).cast("double") for c in columns))).alias("pos", "x"))
    fin = F.when(is_finite(F.col("x")), F.col("x"))
    out = long.groupBy("pos").agg(F.avg(fin).alias("mean"), F.stddev_pop(fin).alias("std"), F.min(fin).alias("min"), F.max(fin).alias("max"), F.count_if(F.isnan("x")).alias("n_nan"), F.count_if(F.abs("x") == float("inf")).alias("n_inf"), F.count_if(F.col("x") == 0).alias("n_zero"))
    return out.withColumn("feature", F.array(*(F.lit(c) for c in columns))[F.col("pos")]).drop("pos")


def observation_window(df: DataFrame, key: str, time: str) -> DataFrame:
    """Every row with the first and last time of its curve."""
    w = Window.partitionBy(key)
    return df.withColumn("start_time", F.min(time).over(w)).withColumn("end_time", F.max(time).over(w))


def first_long_curve(df: DataFrame, key: str, curve: str, value: str, least: int = 500) -> DataFrame:
    """For each object the first curve with at least that many values."""
    n = df.groupBy(key, curve).agg(F.count(F.when(is_finite(F.col(value)), 1)).alias("n_points")).filter(F.col("n_points") >= least)
    return n.withColumn("_r", F.row_number().over(Window.partitionBy(key).orderBy(curve))).filter("_r = 1").drop("_r")
