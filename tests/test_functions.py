import math
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lumenfold.functions import arrays as A
from lumenfold.functions import ids as I
from lumenfold.functions import labels as L
from lumenfold.operators import curves as C
from lumenfold.operators import evaluate as V
from lumenfold.operators import relations as R
from lumenfold.operators.matching import nearest_on_sky
from lumenfold.plans import prepare
from lumenfold.plans.queries import GOLDEN
from lumenfold.sources import schema

INF, NAN = float("inf"), float("nan")


def classes_of(spark, labels):
    df = spark.createDataFrame(list(enumerate(labels)), "k int, raw string")
    found = dict(L.normalize_labels(df, "raw", "c").select("k", "c").collect())
    return [found[i] for i in range(len(labels))]


def test_label_rules(spark):
    known = [*GOLDEN.items(), (None, "Unknown"), ("3", "Unknown"), ("SR|M", "Irregular"), ("BCEP+SPB", "Variable"), ("X|CV:E", "Cataclysmic"), (" ea | nothing ", "Eclipsing Binary"), ("x/UGSU+E", "Cataclysmic"), ("a|b/c+d:e:", "Eclipsing Binary")]
    assert classes_of(spark, [k for k, _ in known]) == [v for _, v in known]


def test_labels_of_parts(spark):
    r = random.Random(3)
    whole = {label: name for name, labels in L.CLASS_LABELS.items() for label in labels if label == label.upper() and not set(label) & set("|/+:-_")}
    pairs = [(a, mark, b) for a, b, mark in ((r.choice(list(whole)), r.choice(list(whole)), r.choice("|/+:")) for _ in range(300)) if f"{a}{mark}{b}" not in {x for v in L.CLASS_LABELS.values() for x in v}]
    got = classes_of(spark, [f"{a} {mark}{b.lower()}" for a, mark, b in pairs])
    assert got == [min(whole[a], whole[b], key=L.PREFERENCE.index) for a, _, b in pairs]
    odd = ["".join(r.choice("EADSCTRLM|/+: -_") for _ in range(r.randrange(12))) for _ in range(300)]
    assert set(classes_of(spark, odd)) <= {*L.CLASS_LABELS, "Unknown"}


def test_rare_classes_and_needed_slices(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate("aaabbc")] + [(9, None)], "k int, c string")
    assert {r["k"]: r["c"] for r in L.fold_rare(df, "c", 2).collect()} == {0: "a", 1: "a", 2: "a", 3: "b", 4: "b", 5: "RARE", 9: "RARE"}
    assert sorted(r["k"] for r in I.needed_slices(df, "c", 2).collect() if r["c"]) == [0, 1, 2]
    assert I.needed_slices(df, "c").count() == 6
    assert [r[0] for r in spark.createDataFrame([("V 12",), ("x",)], "i string").select(I.prefixed(F.col("i"), "VSX_TESS")).collect()] == ["TIC_12", None]


def test_stable_ranks_are_those_of_one_sort(spark):
    df = spark.createDataFrame([(i, "xyz"[i % 3] if i % 7 else None) for i in range(400)], "k int, c string")
    got = {r["k"]: (r["r"], r["n"]) for r in R.stable_rank(df, "k", ["c"], "r", "n").collect()}
    order = [r["k"] for r in df.orderBy(R.stable_order("k"), "k").collect()]
    for c in ("x", "y", "z", None):
        own = [k for k in order if ("xyz"[k % 3] if k % 7 else None) == c]
        assert [got[k] for k in own] == [(i + 1, len(own)) for i in range(len(own))]
    assert [r["k"] for r in R.stable_rank(df, "k", [], "r").orderBy("r").collect()] == order
    assert R.preview(df, "k", "c", 2).count() == 8
    assert [tuple(r) for r in R.counts_in_order(df.filter("c is not null"), "c").collect()] == sorted(((c, sum("xyz"[i % 3] == c for i in range(400) if i % 7)) for c in "xyz"), key=lambda x: (-x[1], x[0]))
    assert R.stable_rank(df.filter("false"), "k", ["c"], "r").count() == 0


def test_labels_in_a_frame(spark):
    df = spark.createDataFrame([(1, "EA"), (2, None), (3, ""), (4, "EA")], "k int, raw string")
    assert dict(L.normalize_labels(df, "raw", "c").select("k", "c").collect()) == {1: "Eclipsing Binary", 2: "Unknown", 3: "Unknown", 4: "Eclipsing Binary"}


def test_dirty_magnitudes(spark):
    df = spark.createDataFrame([(x,) for x in [">23.6", " 14.2 ", "abc", "inf", None, ""]], "m string")
    assert [r[0] for r in df.select(A.parse_magnitude(F.col("m"))).collect()] == [23.6, 14.2, None, INF, None, None]


def test_degenerate_curves(spark):
    r = random.Random(1)
    curves = {"nan": [NAN] * 40, "n29": [r.random() for _ in range(29)], "n30": [r.random() for _ in range(30)], "flat": [2.0] * 40, "iqr0": [1.0] * 38 + [5.0, 9.0], "inf": [INF] + [r.random() for _ in range(35)]}
    df = spark.createDataFrame([(k, i, x, "EB") for k, v in curves.items() for i, x in enumerate(v)], "id string, time int, value double, label string")
    s = C.curve_stats(df, "id", "value", F.min("label"))
    got = dict(s.select("id", C.discard_reason(s)).collect())
    assert got == {"nan": "all_invalid", "n29": "short_curve", "n30": "ok", "flat": "low_std", "iqr0": "ok", "inf": "ok"}
    f = {x["id"]: x for x in C.curve_features(df, "id", "value").collect()}
    assert f["flat"]["f_skew"] == 0 and f["iqr0"]["f_iqr"] == 0 and math.isfinite(f["inf"]["f_std"])
    scaled = {(x["id"], x["time"]): x["scaled"] for x in C.normalize_robust(df.filter("id = 'iqr0'"), "id", "value").collect()}
    assert scaled[("iqr0", 39)] == 8.0
    out, reasons = prepare.prepare_curves(df, 32, reinforced=df.filter("id = 'n30'").select("id"))
    rows = {x["id"]: x for x in out.collect()}
    assert set(rows) == {"n30", "iqr0", "inf"} and rows["n30"]["split"] == "train" and sum(rows["n30"]["mask"]) == 30 and len(rows["inf"]["sequence"]) == 32
    assert reasons.count() == 6


def test_sky_edges_against_brute_force(spark):
    r = random.Random(7)
    pts = [(359.9995, 0.0), (0.0005, 0.0), (10.0, 89.9995), (190.0, 89.9995), (20.0, -89.999), (200.0, -89.9999), (50.0, 89.0), (50.2, 89.0), (0.0, 90.0), (0.0, -90.0)]
    pts += [(r.uniform(0, 360), math.degrees(math.asin(r.uniform(-1, 1)))) for _ in range(400)] + [(r.uniform(0, 360), r.choice([-1, 1]) * r.uniform(88.5, 90)) for _ in range(100)]
    other = [(ra + r.uniform(-0.5, 0.5), max(-90.0, min(90.0, de + r.uniform(-0.5, 0.5)))) for ra, de in pts] + [(0.0, 0.0), (0.0, 0.0)]
    a, b = spark.createDataFrame([(i, *p) for i, p in enumerate(pts)], "id int, ra double, dec double"), spark.createDataFrame([(i, *p) for i, p in enumerate(other)], "id int, ra double, dec double")

    def sep(p, q):
        (r1, d1), (r2, d2) = ((math.radians(x) for x in z) for z in (p, q))
        return math.degrees(2 * math.asin(math.sqrt(min(1, math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((r2 - r1) / 2) ** 2))))

    for radius in (0.002, 0.7, 25.0, 100.0):
        got = {x["probe_id"]: (x["target_id"], x["separation"]) for x in nearest_on_sky(a, b, radius, ("id", "ra", "dec"), ("id", "ra", "dec")).collect()}
        for i, p in enumerate(pts):
            s, j = min((round(sep(p, q), 11), j) for j, q in enumerate(other))
            if s <= radius - 1e-9:
                assert abs(got[i][1] - s) < 1e-8 and (got[i][0] == j or abs(sep(p, other[got[i][0]]) - s) < 1e-8)
            elif s > radius + 1e-9:
                assert i not in got


def test_caps_and_splits(spark):
    df = spark.createDataFrame([(i, "abc"[i % 3]) for i in range(90)] + [(900, "one"), (901, "two"), (902, "two")], "id int, label string")
    always = df.filter("id in (0, 1, 2, 3, 4)").select("id")
    out = R.cap_classes(df, "id", "label", 5, {"a": None, "b": 0, "c": 2}, always).collect()
    n = {c: sum(r["label"] == c for r in out) for c in ("a", "b", "c", "one")}
    assert n["a"] == 30 and n["b"] == 0 and n["one"] == 1 and 2 <= n["c"] <= 3
    split = R.stratified_split(df, "id", "label", into_train=always)
    assert split.count() == 93 and split.filter("id < 5 and split <> 'train'").count() == 0
    assert {r["split"] for r in split.filter("label in ('one', 'two')").collect()} == {"train"}


def test_report_with_classes_never_predicted(spark):
    df = spark.createDataFrame([("a", "b"), ("a", "a"), ("c", "a")], "t string, p string")
    rows = {r["class"]: r for r in V.classification_report(df, "t", "p").collect()}
    assert rows["b"]["recall"] == 0 and rows["c"]["precision"] == 0 and abs(rows["accuracy"]["f1"] - 1 / 3) < 1e-12 and rows["a"]["precision"] == 0.5


def test_sanitize(spark):
    df = spark.createDataFrame([([NAN, None, INF, -INF, 2.0, 9.0],)], "v array<double>")
    assert df.select(A.sanitize(F.col("v"))).first()[0] == [0.0, 0.0, 5.0, -5.0, 2.0, 5.0]


def test_ids(spark):
    df = spark.createDataFrame([("KIC 00123 x",), ("none",), ("TIC_77",), (None,)], "i string")
    assert [r[0] for r in df.select(I.prefixed(F.col("i"), "TESS")).collect()] == ["TIC_00123", None, "TIC_77", None]
    assert [r[0] for r in df.select(I.clean_tic(F.col("i"))).collect()] == ["TIC_MISSING", "TIC_MISSING", "TIC_77", "TIC_MISSING"]


def test_schema_zoo(spark):
    a = spark.createDataFrame([("x", 1, 2.5)], "id_objeto string, HJD int, error double")
    b = spark.createDataFrame([(5, "7.5", NAN, True)], "oid long, mjd string, hjd double, good boolean")
    c = spark.createDataFrame([("z", 3.0, 4.0)], "ID string, time double, tiempo double")
    out = schema.unify([a, b, c])
    assert out.schema.simpleString() == "struct<id:string,time:string,flux_err:double,good:boolean>"
    assert {r["id"]: r["time"] for r in out.collect()} == {"x": "1", "5": "7.5", "z": "3.0"}
    assert schema.find_column(["HJD", "flux"], "time") == "HJD" and schema.find_column(["flux"], "time") is None
    with pytest.raises(ValueError):
        schema.require(a, ["period"])
    assert schema.coordinate_columns(["ra", "dec"]) == ("ra", "dec")
