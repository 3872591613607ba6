"""Quantiles by distributed selection against numpy, with groups far beyond what a task may gather."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import curves, quantiles
from lumenfold.operators.quantiles import attach, group_quantiles, groups_of

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.999, 1.0]


def shapes(n, r):
    """Values that are hard to select from: ties, outliers, steps, wide ranges, two far clusters."""
    return {
        "normal": r.normal(size=n), "ties": r.integers(0, 3, n).astype(float), "constant": np.full(n, 2.5), "outliers": np.where(r.random(n) < 1e-3, 1e300, r.normal(size=n)),
        "wide": np.exp(r.normal(size=n) * 100), "one_heavy": np.where(r.random(n) < 0.6, 7.0, r.normal(size=n)), "sorted": np.arange(n, dtype=float), "signs": np.where(r.random(n) < 0.5, -1.0, 1.0) * np.exp(r.normal(size=n) * 50),
    }


@pytest.mark.parametrize("spread", [20, 300])
def test_selection_matches_numpy(spark, monkeypatch, spread):
    monkeypatch.setattr(quantiles, "SPREAD", spread)
    r = np.random.default_rng(spread)
    rows, want = [], {}
    for key, x in [*shapes(6000, r).items(), ("small", r.normal(size=19)), ("two", np.array([1.0, 2.0])), (None, r.normal(size=900))]:
        want[key] = np.quantile(x, PROBS)
        rows += [(key, float(v), 1) for v in x] + [(key, None, 2), (key, float("nan"), 3)]
    rows.append(("empty", None, 1))
    df = spark.createDataFrame(rows, "k string, v double, n int").repartition(5)
    got = {g["k"]: g for g in group_quantiles(df, ["k"], {"q": (F.col("v"), PROBS), "half": (F.col("v") * 2, [0.5])}, (F.count(F.lit(1)).alias("rows"),)).collect()}
    assert set(got) == {*want, "empty"} and got["empty"]["q"] is None
    for key, q in want.items():
        assert np.allclose(got[key]["q"], q, rtol=1e-12, atol=0) and np.allclose(got[key]["half"], [2 * q[3]], rtol=1e-12)
    assert got["normal"]["rows"] == 6002 and groups_of(df, ["k"]).most == 6002
    alone = group_quantiles(df.filter("k = 'wide'"), ["k"], {"q": (F.col("v"), PROBS)}).first()["q"]
    assert np.allclose(alone, want["wide"], rtol=1e-12)
    assert group_quantiles(df.limit(0), ["k"], {"q": (F.col("v"), PROBS)}).count() == 0


def skewed(spark, n=3000):
    """One object with a third of the rows, invalid values in every fifth row."""
    r = np.random.default_rng(2)
    rows = [("hot" if i % 3 == 0 else f"o{i % 40}", i, [float("nan"), None, float("inf")][i % 3] if i % 5 == 0 else float(x)) for i, x in enumerate(r.normal(size=n) * 3)]
    return spark.createDataFrame([*rows, ("none", 0, None)], "id string, t long, v double").repartition(6), rows


def test_curves_with_a_hot_object(spark, monkeypatch):
    df, rows = skewed(spark)
    plain = {c: sorted(map(tuple, f(df).collect()), key=repr) for c, f in CURVES.items()}
    monkeypatch.setattr(quantiles, "SPREAD", 200)
    for c, f in CURVES.items():
        out = f(df)
        assert close(sorted(map(tuple, out.collect()), key=repr), plain[c])
    hot = np.array([v for k, _, v in rows if k == "hot" and v is not None and math.isfinite(v)])
    f = next(r for r in curves.curve_features(df, "id", "v").collect() if r["id"] == "hot")
    x = np.r_[hot, np.full(f["n"] - len(hot), np.median(hot))]
    assert math.isclose(f["f_mad"], np.median(np.abs(x - np.median(x)))) and math.isclose(f["f_iqr"], np.subtract(*np.quantile(x, [0.75, 0.25])))


CURVES = {
    "impute": lambda df: curves.impute_median(df, "id", "v"), "robust": lambda df: curves.normalize_robust(df, "id", "v"),
    "features": lambda df: curves.curve_features(df, "id", "v"),
}


def close(a, b):
    flat = lambda r: [y for x in r for y in (x if isinstance(x, list) else [x])]
    same = lambda x, y: x == y or (isinstance(x, float) and isinstance(y, float) and (math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-12) or (math.isnan(x) and math.isnan(y))))
    return len(a) == len(b) and all(all(map(same, flat(r), flat(s))) for r, s in zip(a, b, strict=True))


def test_rows_of_a_hot_group_stay_spread(spark, monkeypatch):
    monkeypatch.setattr(quantiles, "SPREAD", 200)
    df, _ = skewed(spark)
    stats = group_quantiles(df, ["id"], {"q": (F.col("v"), [0.5])})
    joined = attach(df, stats, groups_of(df, ["id"]))
    sizes = [r["n"] for r in joined.filter("id = 'hot'").groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 1000 and len(sizes) >= 5 and max(sizes) < 400


def test_features_scale_over_many_objects(spark, monkeypatch):
    r = np.random.default_rng(5)
    x = r.normal(size=(2000, 2)) * [1, 100]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    plain = sorted(map(tuple, curves.scale_features(df, ["a", "b"]).collect()))
    monkeypatch.setattr(quantiles, "SPREAD", 100)
    got = sorted(map(tuple, curves.scale_features(df, ["a", "b"]).collect()))
    assert close(got, plain)
    q = np.quantile(x, [0.25, 0.5, 0.75], axis=0)
    assert np.allclose([g[1:] for g in got], (x - q[1]) / (q[2] - q[0] + 1e-8))
