"""The three whole preparations: one schema for all files, catalogs matched on the sky, curves ready for training."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import is_finite, robust
from ..functions.labels import normalize_labels
from ..operators.curves import FEATURES, MIN_POINTS, MIN_STD, apply_scaling, curve_stats, discard_reason, encode_labels, feature_quartiles, features_of, scale_features, to_sequences
from ..operators.matching import nearest_on_sky
from ..operators.quantiles import attach, groups_of
from ..operators.relations import cap_classes, exclude, stratified_split
from ..sources.schema import backfill_labels, unify


def unify_observations(frames: list[DataFrame], raw: str = "clase_variable", normalized: str = "clase_variable_normalizada") -> DataFrame:
    """Observation tables of any schema as one, with both label columns; rows without any label or of unknown class go."""
    df = backfill_labels(unify(frames), raw, normalized)
    return normalize_labels(df.drop(normalized), raw, normalized).filter(F.col(normalized) != "Unknown")


def match_catalogs(objects: DataFrame, catalog: DataFrame, radius_arcsec: float, low: float, high: float) -> DataFrame:
    """Objects (id, ra, dec) with declination from low to high and their nearest catalog entry within the radius."""
    near = nearest_on_sky(objects.filter(F.col("dec").between(low, high)), catalog, radius_arcsec / 3600, ("id", "ra", "dec"), ("id", "ra", "dec"))
    return objects.join(near, objects["id"] == near["probe_id"]).drop("probe_id")


def _described(points: DataFrame, length: int, min_points: int, min_std: float, label: Column | None, cached: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Statistics of all curves with the reason to leave them out, the raw features of the good ones, and their sequences."""
    groups = groups_of(points, ["id"])
    stats = curve_stats(points, "id", "value", label, groups)
    stats = stats.withColumn("reason", discard_reason(stats, min_points, min_std, has_label=label is not None))
    stats = stats.persist() if cached else stats
    good = stats.filter(F.col("reason") == "ok")
    # quartiles of the imputed points are known from the statistics, and their median is that of the finite points
    kept = attach(points.join(good.select("id"), "id", "left_semi"), good.select("id", F.col("q").alias("_q")), groups)
    imputed = F.when(is_finite(F.col("value")), F.col("value")).otherwise(F.col("_q")[1])
    scaled = kept.withColumn("scaled", robust(imputed, F.col("_q")[1], F.col("_q")[2] - F.col("_q")[0]))
    return stats, features_of(good, "id").drop("n"), to_sequences(scaled, "id", ["time", "scaled"], "scaled", length)


@dataclass(frozen=True)
class Preparation:
    """What a preparation learned, to be applied to other curves without learning again: classes in index order, the
    quartiles of each feature, and the limits that curves must meet."""

    length: int
    min_points: int
    min_std: float
    classes: list[str]
    quartiles: dict[str, list[float]]

    def save(self, spark: SparkSession, path: str) -> None:
        """As one line of JSON below path."""
        spark.createDataFrame([(json.dumps(asdict(self), ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(path)

    @staticmethod
    def load(spark: SparkSession, path: str) -> Preparation:
        return Preparation(**json.loads(spark.read.text(path).first()["value"]))

    def quartile_rows(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(list(self.quartiles.items()), "feature string, q array<double>")

    def encode(self, label: Column) -> Column:
        """The index of a label, null for one that was not there when the preparation was fitted."""
        known = F.create_map(*(F.lit(x) for pair in zip(self.classes, range(len(self.classes)), strict=True) for x in pair)) if self.classes else None
        return F.lit(None).cast("int") if known is None else F.try_element_at(known, label)

    def apply(self, points: DataFrame) -> tuple[DataFrame, DataFrame]:
        """Samples (id, label, label_idx, sequence, mask, scaled features) and discard reasons of whole curves (id, time,
        value, and label if they have one). No cap, no split, nothing is fitted; a label that was not there has a null index."""
        spark, labelled = points.sparkSession, "label" in points.columns
        if labelled:
            labels = points.groupBy("id").agg(F.min_by("label", F.struct("time", "value")).alias("label"))
            points = points.drop("label").join(labels, "id")
        stats, features, sequences = _described(points, self.length, self.min_points, self.min_std, F.min("label") if labelled else None)
        label = F.col("label") if labelled else F.lit(None).cast("string")
        named = stats.filter(F.col("reason") == "ok").select("id", label.alias("label")).withColumn("label_idx", self.encode(F.col("label")))
        samples = named.join(sequences, "id").join(apply_scaling(features, FEATURES, self.quartile_rows(spark)), "id")
        return samples.select("id", "label", "label_idx", "sequence", "mask", *FEATURES), stats.select("id", label.alias("label"), "reason")


def _chosen(points: DataFrame, cap: int | None, overrides: dict[str, int | None] | None, excluded: DataFrame | None, reinforced: DataFrame | None) -> DataFrame:
    """Points of the objects that caps and exclusions leave, with their first label; capped before curves are collected."""
    if excluded is not None:
        points = exclude(points, excluded, "id")
    labels = points.groupBy("id").agg(F.min_by("label", F.struct("time", "value")).alias("label"))
    return points.drop("label").join(cap_classes(labels, "id", "label", cap, overrides, reinforced), "id")


def _samples(encoded: DataFrame, sequences: DataFrame, scaled: DataFrame, reinforced: DataFrame | None) -> DataFrame:
    """Ids are split alone: sequences are long and move once."""
    split = stratified_split(encoded, "id", "label", into_train=reinforced)
    return split.join(sequences, "id").join(scaled, "id").select("id", "label", "label_idx", "sequence", "mask", *FEATURES, "split")


def prepare_curves(points: DataFrame, length: int, cap: int | None = None, overrides: dict[str, int | None] | None = None, excluded: DataFrame | None = None, reinforced: DataFrame | None = None, min_points: int = MIN_POINTS, min_std: float = MIN_STD) -> tuple[DataFrame, DataFrame]:
    """Training samples and discard reasons from points (id, time, value, label).

    Samples: id, label, label_idx, sequence, mask, the scaled features and split; ids travel with their rows throughout.
    """
    stats, features, sequences = _described(_chosen(points, cap, overrides, excluded, reinforced), length, min_points, min_std, F.min("label"))
    good = stats.filter(F.col("reason") == "ok").select("id", "label")
    return _samples(encode_labels(good, "label"), sequences, scale_features(features, FEATURES), reinforced), stats.select("id", "label", "reason")


def fit_curves(points: DataFrame, length: int, cap: int | None = None, overrides: dict[str, int | None] | None = None, excluded: DataFrame | None = None, reinforced: DataFrame | None = None, min_points: int = MIN_POINTS, min_std: float = MIN_STD) -> tuple[Preparation, DataFrame, DataFrame]:
    """The fitted preparation, and what prepare_curves gives, by the fitted values.

    What is fitted reaches the driver: the classes and three numbers a feature. The statistics, one row a curve, are
    read for it more than once and stay cached until the caller's session drops them."""
    spark = points.sparkSession
    stats, features, sequences = _described(_chosen(points, cap, overrides, excluded, reinforced), length, min_points, min_std, F.min("label"), cached=True)
    good = stats.filter(F.col("reason") == "ok").select("id", "label")
    classes = [r["label"] for r in good.select("label").distinct().orderBy("label").collect()]
    quartiles = {r["feature"]: r["q"] for r in feature_quartiles(features, FEATURES).collect()}
    fitted = Preparation(length, min_points, min_std, classes, {f: quartiles.get(f) or [0.0, 0.0, 0.0] for f in FEATURES})
    scaled = apply_scaling(features, FEATURES, fitted.quartile_rows(spark))
    return fitted, _samples(good.withColumn("label_idx", fitted.encode(F.col("label"))), sequences, scaled, reinforced), stats.select("id", "label", "reason")
