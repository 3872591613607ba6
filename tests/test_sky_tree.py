"""The tree of sky cells: a probe meets few of the targets within the radius, and the results stay those of brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.operators import matching

NAMES = ("id", "ra", "dec")


def frame(spark, points):
    rows = [(i, None if a is None else float(a), None if b is None else float(b)) for i, (a, b) in enumerate(points)]
    return spark.createDataFrame(rows, "id long, ra double, dec double")


def even(n, seed):
    r = np.random.default_rng(seed)
    return np.c_[r.random(n) * 360, r.random(n) * 180 - 90]


@pytest.mark.parametrize("k", [1, 3])
def test_targets_met_do_not_grow_with_the_targets(spark, k):
    """Every target lies within the radius of every probe; declinations are even, so the poles are dense."""
    met = []
    for n in (1000, 8000):
        p, t = matching._placed(frame(spark, even(n, 1)), NAMES, "probe_id", "1"), matching._placed(frame(spark, even(n, 2)), NAMES, "target_id", "2")
        cut = matching._cut(p, t)
        p, t = matching._in_cells(p, cut), matching._in_cells(t, cut)
        near = matching._kept(p, matching._tree(t, len(cut)), len(cut), 180.0, k).groupBy("group").agg(F.sum("n").alias("met"))
        met.append(p.groupBy(F.col("cell").alias("group")).count().join(near, "group").agg(F.sum(F.col("count") * F.col("met")) / n).first()[0])
    assert met[1] < 1.5 * met[0] and met[1] < 500


@pytest.mark.parametrize(("radius", "k", "probes", "targets", "dense"), [(180.0, 4, 40, 8, 20), (3.0, 2, 10, 6, 4096)])
def test_odd_places_match_brute_force(spark, monkeypatch, radius, k, probes, targets, dense):
    """Copies at one place on both sides, poles, 0 h, opposite points, coordinates beyond a turn or missing."""
    for name, value in (("PROBES", probes), ("TARGETS", targets), ("DENSE", dense)):
        monkeypatch.setattr(matching, name, value)
    odd = [(0.0, 90.0), (180.0, 90.0), (77.0, -90.0), (359.9999, 0.0), (0.0001, 0.0), (-0.5, 10.0), (359.5, 10.0), (719.5, 10.0), (45.0, 35.26), (225.0, -35.26)]
    a = [*map(tuple, even(60, 3)), *odd, *[(200.0, 20.0)] * 70, (None, 1.0), (1.0, None), (math.nan, 2.0), (2.0, math.inf)]
    b = [*map(tuple, even(150, 4)), *odd, *[(200.0, 20.0)] * 50, *[(200.0 + i * 1e-9, 20.0) for i in range(12)], (None, 1.0), (3.0, math.nan)]
    got = {}
    for g in matching.nearest_on_sky(frame(spark, a), frame(spark, b), radius, NAMES, NAMES, k).collect():
        got.setdefault(g["probe_id"], []).append((g["separation"], g["target_id"]))
    for i, (ra1, dec1) in enumerate(a):
        want = []
        for j, (ra2, dec2) in enumerate(b):
            if all(x is not None and math.isfinite(x) for x in (ra1, dec1, ra2, dec2)):
                h = math.sin(math.radians(dec2 - dec1) / 2) ** 2 + math.cos(math.radians(dec1)) * math.cos(math.radians(dec2)) * math.sin(math.radians(ra2 % 360 - ra1 % 360) / 2) ** 2
                s = math.degrees(2 * math.asin(math.sqrt(min(1.0, h))))
                want += [(s, j)] if s <= radius else []
        want, found = sorted(want)[:k], sorted(got.get(i, []))
        assert [round(s, 9) for s, _ in found] == [round(s, 9) for s, _ in want]
        if (ra1, dec1) == (200.0, 20.0):
            assert [j for _, j in found] == [160 + j for j in range(k)]
