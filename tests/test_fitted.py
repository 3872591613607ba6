"""A fitted preparation is saved, loaded and applied, to a table and to a stream of files, without fitting again."""

import math

import numpy as np
from pyspark.sql import functions as F

from lumenfold.operators.curves import FEATURES
from lumenfold.plans.prepare import Preparation, fit_curves, prepare_curves
from lumenfold.streaming.ingest import prepare_new_files

SCHEMA = "id string, time double, value double, label string"


def curves(spark, n=30, seed=1, labels=("EA", "RR", "SR")):
    r = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        size = 20 if i % 10 == 9 else int(r.integers(30, 60))
        x = r.normal(size=size) * (i + 1)
        x[::7] = [math.nan, math.inf, -math.inf][i % 3]
        rows += [(f"o{i}", float(t), float(v), labels[i % len(labels)]) for t, v in enumerate(x)]
    return spark.createDataFrame([*rows, ("none", 0.0, None, "EA"), ("unknown", 0.0, 1.0, "Unknown")], SCHEMA)


def plain(df, *drop):
    return sorted((tuple(tuple(np.round(v, 9)) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.drop(*drop).collect()), key=repr)


def test_loaded_preparation_gives_the_same_samples(spark, tmp_path):
    points = curves(spark)
    fitted, samples, reasons = fit_curves(points, 40)
    fitted.save(spark, str(tmp_path / "fit"))
    loaded = Preparation.load(spark, str(tmp_path / "fit"))
    assert loaded == fitted and loaded.classes == ["EA", "RR", "SR"] and set(loaded.quartiles) == set(FEATURES)
    again, why = loaded.apply(points)
    assert plain(again) == plain(samples, "split") and plain(why) == plain(reasons)
    assert {r["reason"] for r in why.collect()} == {"ok", "short_curve", "all_invalid", "unknown_class"}
    assert plain(prepare_curves(points, 40)[0]) == plain(samples)


def test_new_curves_are_scaled_by_the_old_ones(spark):
    fitted, samples, _ = fit_curves(curves(spark), 40)
    one = curves(spark).filter("id = 'o3'")
    got, _ = fitted.apply(one)
    assert plain(got) == plain(samples.filter("id = 'o3'"), "split")  # alone, it would be scaled by itself to zero
    unseen, _ = fitted.apply(one.withColumn("label", F.lit("new")))
    assert [(r["label"], r["label_idx"]) for r in unseen.select("label", "label_idx").collect()] == [("new", None)]
    bare, why = fitted.apply(one.drop("label"))
    assert plain(bare, "label", "label_idx") == plain(got, "label", "label_idx") and why.first()["reason"] == "ok"
    assert fitted.apply(one.limit(0))[0].count() == 0


def test_stream_of_files_is_prepared_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    points = curves(spark)
    fitted, samples, _ = fit_curves(points, 40)
    halves = [points.filter(F.xxhash64("id") % 2 == i) for i in (0, 1)] + [points.filter(F.xxhash64("id") % 2 == -1)]
    for half in halves:
        half.coalesce(1).write.mode("append").parquet(src)
        prepare_new_files(spark, src, out, state, fitted, points.schema).awaitTermination()
    prepare_new_files(spark, src, out, state, fitted, points.schema).awaitTermination()
    got = spark.read.parquet(f"{out}/samples").drop("run")
    assert plain(got) == plain(samples, "split")
