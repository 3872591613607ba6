import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumenfold.llm.inner_product import search_cell, top_k_inner_product
from lumenfold.llm.prefix_forest import bounds, nearest_neighbours

NAN, INF = float("nan"), float("inf")


def odd_vectors(spark, seed=0, n=300, d=8):
    """Random vectors with copies, ties, a hot vector and every kind of unusable row, and columns of clashing names."""
    r = np.random.default_rng(seed)
    v = r.normal(size=(n, d)).astype(np.float32)
    v[50:150] = v[3]
    v[200] = -v[3]
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    bad = [(1000, None), (1050, []), (1100, [0.0] * d), (1200, [NAN] + [1.0] * (d - 1)), (1300, [INF] + [1.0] * (d - 1)), (1400, [None] + [1.0] * (d - 1)), (1500, [1.0] * (d + 1)), (None, [1.0] * d)]
    df = spark.createDataFrame([(i, x, 1, 2, 3.0) for i, x in [*rows, *bad]], "vec_id long, embedding array<float>, block int, chunk int, score double")
    return df, {i: np.array(x, float) for i, x in rows}


def test_inner_products_match_brute_force(spark, monkeypatch):
    import lumenfold.llm.inner_product as m

    monkeypatch.setattr(m, "BLOCK_ROWS", 64)
    monkeypatch.setattr(m, "CHUNK_ROWS", 4)
    df, v = odd_vectors(spark)
    got = top_k_inner_product(df, F.col("vec_id") % 25 == 0, k=5).collect()
    v = {**v, 1100: np.zeros(8)}
    ints = {i: np.floor(256 * x).astype(int) for i, x in v.items()}
    for q in [i for i in v if i % 25 == 0]:
        want = sorted((-int(ints[q] @ x), i) for i, x in ints.items() if i != q)[:5]
        rows = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert rows == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert {r["query_id"] for r in got} <= set(v)


def test_large_components_stay_exact():
    x = np.array([[2.0**40, 1.0], [2.0**40, 2.0]])
    i, ids, score = search_cell(np.array([1, 2]), x, np.array([9]), np.array([[2.0**20, 3.0]]), np.array([-(2.0**62)]), np.eye(2), 2)
    assert ids.tolist() == [2, 1] and score.tolist() == [2**60 + 6, 2**60 + 3]


def test_forest_against_brute_force(spark):
    df, v = odd_vectors(spark, seed=4)
    got = nearest_neighbours(df, F.col("vec_id") % 25 == 0, k=10).collect()
    hit = total = 0
    for q in [i for i in v if i % 25 == 0]:
        want = sorted((math.sqrt(((v[q] - x) ** 2).sum()), i) for i, x in v.items() if i != q)[:10]
        rows = {r["rank"]: (r["vec_id"], r["score"]) for r in got if r["query_id"] == q}
        assert sorted(rows) == list(range(1, 11))
        hit += len({i for _, i in want} & {i for i, _ in rows.values()})
        total += 10
        assert all(abs(s - math.sqrt(((v[q] - v[i]) ** 2).sum())) < 1e-12 for i, s in rows.values())
    assert hit / total >= 0.9 and not {r["query_id"] for r in got} & {1000, 1050, 1100, 1200, 1300, 1400}


def test_forest_prunes_in_small_runs_and_blocks(spark, monkeypatch):
    import lumenfold.llm.prefix_forest as m

    for name, v in (("RUN_ROWS", 8), ("BLOCK_ROWS", 500), ("CHUNK_ROWS", 7), ("HASHED", 100)):
        monkeypatch.setattr(m, name, v)
    seen = {}
    monkeypatch.setattr(m, "materialize", lambda df, label, f=m.materialize: seen.setdefault(label, f(df, label)))
    r = np.random.default_rng(1)
    x = (r.normal(size=(40, 16))[r.integers(0, 40, 2000)] + r.normal(size=(2000, 16)) * 0.2).astype(np.float32).astype(float)
    x[0] = -50 * x[1:].mean(axis=0) + 90  # far from all, so its runs may be empty
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = nearest_neighbours(df, F.col("vec_id") % 100 == 0, k=10, candidates=30).collect()
    hit = 0
    for q in range(0, 2000, 100):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = 1e9
        mine = {g["rank"]: g["vec_id"] for g in got if g["query_id"] == q}
        assert sorted(mine) == list(range(1, 11))
        hit += len(set(np.argsort(d, kind="stable")[:10]) & set(mine.values()))
    assert hit >= 0.9 * 200
    read = seen["forest-visits"].selectExpr("query", "aggregate(transform(lists, x -> octet_length(x) / 8), 0D, (a, b) -> a + b) as n").groupBy("query").sum("n").collect()
    assert np.median([x[1] for x in read]) < 2000 * 40 / 10


def test_bounds_are_those_of_a_scan():
    keys = np.sort(np.random.default_rng(5).integers(0, 1 << 63, 500) >> 20 << 20)
    h = np.r_[keys[::50], np.random.default_rng(6).integers(0, 1 << 63, 20)]
    for level in range(10):
        low, high = bounds(keys, h, level)
        assert (high - low == [(keys >> (63 - 7 * level) == q >> (63 - 7 * level)).sum() for q in h]).all() if level else (high - low == 500).all()


def test_repeated_rows_take_no_places(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(60, 6))
    once = [(i, v.tolist()) for i, v in enumerate(x)]
    more = [(1, (x[1] + (j + 1) * 1e-9).tolist()) for j in range(30)]  # one id with 31 vectors, all near each other
    copies = [(100 + i, x[2].tolist()) for i in range(40)]
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want, got = (sorted(map(tuple, nearest_neighbours(frame(t), F.col("vec_id") % 25 == 0, k=10).collect())) for t in (once, once * 12))
    assert got == want and len(want) == 30
    ids = [g["vec_id"] for g in nearest_neighbours(frame(once + more), F.col("vec_id") == 0, k=10).collect()]
    assert len(set(ids)) == 10
    near = sorted((g["rank"], g["vec_id"], g["score"]) for g in nearest_neighbours(frame(once + copies), F.col("vec_id") == 2, k=10).collect())
    assert [v for _, v, _ in near] == list(range(100, 110)) and all(s == 0 for _, _, s in near)
    df, _ = odd_vectors(spark, n=210)
    want, got = (sorted(map(tuple, nearest_neighbours(t, F.col("vec_id") % 25 == 0, k=10).collect())) for t in (df, df.unionByName(df)))
    assert got == want


@pytest.mark.parametrize("search", [top_k_inner_product, nearest_neighbours])
def test_empty_tables_and_few_candidates(spark, search):
    df, _ = odd_vectors(spark)
    assert search(df.filter("vec_id < 0"), F.col("vec_id") % 50 == 0).count() == 0
    few = search(df.filter("vec_id in (0, 1, 2)"), F.col("vec_id") == 0).collect()
    assert sorted(r["rank"] for r in few) == [1, 2]


def test_low_and_wide_scores_are_kept(spark):
    frame = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    rows = [(0, [2.0**23.5]), (1, [-(2.0**23)]), (2, [1.0]), (50, [2.0**23.6])]
    got = sorted(map(tuple, top_k_inner_product(frame(rows), F.col("vec_id") % 50 == 0).collect()))
    ints = {i: math.floor(256 * v[0]) for i, v in rows}
    want = [(q, k + 1, i, -s if -s < 2**63 else None) for q in (0, 50) for k, (s, i) in enumerate(sorted((-ints[q] * x, i) for i, x in ints.items() if i != q))]
    assert got == want and min(s for *_, s in got if s) < -(2**62)
    wide = [(i, [2.0**40 * x, 3.0 + i]) for i, x in enumerate((1, -1, 2, 2, -3))]
    got = sorted(map(tuple, top_k_inner_product(frame(wide), F.col("vec_id") == 0).collect()))
    assert [r[2] for r in got] == [3, 2, 1, 4] and [r[3] for r in got] == [None] * 4
    near = [(0, [2.0**24, 1 / 256]), *((i, [2.0**20, i % 3 / 256]) for i in range(1, 9))]  # scores beyond doubles that differ by little
    got = sorted(map(tuple, top_k_inner_product(frame(near), F.col("vec_id") == 0).collect()))
    assert [r[2] for r in got] == [2, 5, 8, 1, 4] and len({r[3] for r in got}) == 2


def test_several_vectors_of_a_query_id(spark):
    rows = [(0, [5.0]), (0, [-5.0]), (1, [1.0]), (2, [2.0])]
    for order in (rows, rows[::-1]):
        for parts in (1, 4):
            df = spark.createDataFrame(order, "vec_id long, embedding array<double>").repartition(parts)
            got = sorted(map(tuple, top_k_inner_product(df, F.col("vec_id") == 0, k=2).collect()))
            assert got == [(0, 1, 1, -327680), (0, 2, 2, -655360)]


def test_forest_prunes_at_its_own_constants(spark, monkeypatch):
    """Calibrated recall and few rows read, with nothing set but the data: clusters with noise, and rows of none."""
    import lumenfold.llm.prefix_forest as m

    seen = {}
    monkeypatch.setattr(m, "materialize", lambda df, label, f=m.materialize: seen.setdefault(label, f(df, label)))
    r = np.random.default_rng(8)
    n, d = 20_000, 32
    x = r.normal(size=(300, d))[r.integers(0, 300, n)] + r.normal(size=(n, d)) * 0.25
    x[::50] = r.normal(size=(n // 50, d)) * 2
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    out = nearest_neighbours(df, F.col("vec_id") % 400 == 7, k=10)
    mine: dict[int, set] = {}
    for g in out.collect():
        mine.setdefault(g["query_id"], set()).add(g["vec_id"])
    hit = 0
    for q in range(7, n, 400):
        s = ((x - x[q]) ** 2).sum(1)
        s[q] = np.inf
        hit += len(set(np.argpartition(s, 10)[:10].tolist()) & mine[q])
    assert hit >= 0.9 * 10 * len(mine) and out.calibration["recall"] >= 0.93
    read = seen["forest-visits"].selectExpr("query", "if(size(lists) = 0, 20000D, aggregate(transform(lists, x -> octet_length(x) / 8), 0D, (a, b) -> a + b)) as n").groupBy("query").sum("n").collect()
    assert np.mean([v[1] for v in read]) < 0.15 * n


def test_ascent_holds_what_calibration_asks_for():
    from lumenfold.llm.prefix_forest import calibrate

    needs = [5, 9, 1, 100, 7, 3, 8, 2, 6, 4]
    assert calibrate(needs, 1, 0.9) == (9, 0.9) and calibrate(needs, 1, 1.0) == (100, 1.0) and calibrate(needs, 50, 0.1) == (50, 0.9) and calibrate([], 11, 0.9) == (11, 1.0)


def test_ascent_beyond_a_run(spark, monkeypatch):
    """Runs of two symbols, and queries that need all strings sharing one."""
    import lumenfold.llm.prefix_forest as m

    monkeypatch.setattr(m, "RUN_ROWS", 1)
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    for parameters in ({}, {"candidates": 60}):
        got = nearest_neighbours(df, F.col("vec_id") % 20 == 0, k=5, trees=10, **parameters).collect()
        hit = 0
        for q in range(0, 300, 20):
            s = ((x - x[q]) ** 2).sum(1)
            s[q] = np.inf
            own = {g["vec_id"] for g in got if g["query_id"] == q}
            assert len(own) == 5
            hit += len(set(np.argsort(s)[:5].tolist()) & own)
        assert hit >= 0.9 * 5 * 15
