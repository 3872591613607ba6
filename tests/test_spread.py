"""Work that stays spread and in order: compaction, dense fields of the sky, and small things that were wrong."""

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenfold.functions.labels import normalize_labels
from lumenfold.operators import matching, relations
from lumenfold.operators.quality import schema_summary
from lumenfold.sources import readers, writers


def test_compaction_keeps_the_order_of_rows(spark, tmp_path):
    src, at = tmp_path / "src", 0
    src.mkdir()
    sizes = [1, 500, 3, 20, 20, 2000, 7, 0, 40]
    for i, n in enumerate(sizes):
        columns = {"id": np.arange(at, at + n), "mag": np.arange(at, at + n) * 0.5} if i != 3 else {"id": np.arange(at, at + n)}
        pq.write_table(pa.table(columns), src / f"part-{i:03d}.parquet", row_group_size=10)
        at += n
    for files in (1, 4):
        out = tmp_path / f"out{files}"
        report = {r["state"]: r.asDict() for r in writers.compact(spark, str(src), str(out), files, rows_per_group=1000).collect()}
        assert report["before"]["n_rows"] == report["after"]["n_rows"] == at and report["after"]["n_files"] == files
        assert report["before"]["n_row_groups"] > 200 and report["after"]["n_row_groups"] <= 3 + files
        parts = [pq.read_table(p) for p in sorted(out.glob("*.parquet"))]
        assert pa.concat_tables(parts).column("id").to_pylist() == list(range(at))
        assert files == 1 or max(map(len, parts)) < 0.5 * at
        assert pa.concat_tables(parts).column("mag").null_count == 20


def test_neighbours_are_packed_evenly():
    r = np.random.default_rng(1)
    for parts in (1, 2, 7, 30):
        for sizes in ([], [5], [1] * 30, r.integers(0, 100, 200).tolist(), [1, 1, 1000, 1, 1]):
            counts = writers.pack_neighbours(sizes, parts)
            assert len(counts) == parts and sum(counts) == len(sizes) and (len(sizes) < parts or min(counts) >= 1)
            if len(sizes) == 200:
                ends = np.cumsum([0, *counts])
                loads = [sum(sizes[a:b]) for a, b in zip(ends, ends[1:], strict=False)]
                assert max(loads) <= sum(sizes) / parts + 100


def test_summaries_are_bounded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(writers, "SUMMARY_ROWS", 5)
    assert writers.markdown(spark.range(5)).count("\n") == 6
    for f in (lambda: writers.markdown(spark.range(6)), lambda: writers.write_summary(spark.range(6), str(tmp_path / "x.csv"))):
        with pytest.raises(ValueError):
            f()


def sky(n, seed):
    """Targets of which a third lie in one dense field, some of them at one place, and probes in and around it."""
    r = np.random.default_rng(seed)
    wide = np.c_[r.random(n) * 360, np.degrees(np.arcsin(r.random(n) * 2 - 1))]
    field = np.c_[120 + r.normal(size=n // 2) * 0.3, 40 + r.normal(size=n // 2) * 0.3]
    field[: n // 8] = [120.0, 40.0]
    targets = np.r_[wide, field]
    probes = np.r_[targets[:: n // 40] + r.normal(size=targets[:: n // 40].shape) * 0.1, [[120.0, 40.0], [359.999, 0.0], [10.0, 89.99]]]
    probes[:, 1] = np.clip(probes[:, 1], -90, 90)
    return probes, targets


@pytest.mark.parametrize(("dense", "k"), [(16, 1), (16, 5), (100, 3)])
def test_dense_fields_match_brute_force(spark, monkeypatch, dense, k):
    monkeypatch.setattr(matching, "DENSE", dense)
    probes, targets = sky(1200, dense + k)
    frame = lambda x: spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, ra double, dec double")
    out = matching.nearest_on_sky(frame(probes), frame(targets), 1.0, ("id", "ra", "dec"), ("id", "ra", "dec"), k)
    got = {}
    for g in out.collect():
        got.setdefault(g["probe_id"], []).append((g["separation"], g["target_id"]))
    a, b = np.radians(probes), np.radians(targets)
    h = np.sin((b[None, :, 1] - a[:, None, 1]) / 2) ** 2 + np.cos(a[:, None, 1]) * np.cos(b[None, :, 1]) * np.sin((b[None, :, 0] - a[:, None, 0]) / 2) ** 2
    s = np.degrees(2 * np.arcsin(np.sqrt(np.minimum(1, h))))
    for i, row in enumerate(s):
        want = sorted((round(x, 9), j) for j, x in enumerate(row) if x <= 1.0)[:k]
        assert sorted((round(x, 9), j) for x, j in got.get(i, [])) == want


def test_dense_cells_are_spread(spark, monkeypatch):
    monkeypatch.setattr(matching, "DENSE", 50)
    _, targets = sky(1200, 3)
    t = spark.createDataFrame([(i, 7, 3, float(a), float(b)) for i, (a, b) in enumerate(targets[1200:])], "target_id long, zone long, cell long, ra2 double, dec2 double")
    p = spark.createDataFrame([(1, 7, 3, 120.0, 40.0)], "probe_id long, zone long, cell long, ra1 double, dec1 double")
    sizes = [r["n"] for r in matching._in_slices(p, t, t.groupBy("zone", "cell").agg(F.count(F.lit(1)).alias("n")), 5.0).groupBy("slice").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert sum(sizes) == 600 and max(sizes) < 100


def test_small_things(spark, tmp_path):
    labels = ["EB", " EB", "delta scuti", "EB ", "delta 　 scuti"]
    rows = normalize_labels(spark.createDataFrame([(x,) for x in labels], "raw string"), "raw", "cls").collect()
    assert {r["raw"]: r["cls"] for r in rows} == dict.fromkeys(labels, "Eclipsing Binary") | {x: "Delta Scuti" for x in labels if "delta" in x}
    one = spark.createDataFrame([(1, "x")], "k int, a string")
    twice = spark.createDataFrame([(1, "q"), (1, "p"), (2, "r")], "k int, v string")
    assert [tuple(r) for r in relations.lookup(one, twice, "k", "v").collect()] == [(1, "x", "p")]
    (tmp_path / "A.csv").write_text('name,hjd,mag\n"a, ""b""",1.5,2.5\n, 3.5 ,\n')
    cat = spark.createDataFrame([("A", "EA")], "source_id string, variable_type string")
    got = readers.read_object_curves(spark, str(tmp_path), cat).collect()
    assert sorted((r["tiempo"], r["magnitud"]) for r in got) == [(1.5, 2.5), (3.5, None)]
    s = {r["column"]: r for r in schema_summary(spark.createDataFrame([(1, None), (2, "x")], "a int, `b.c` string")).collect()}
    assert (s["a"]["type"], s["a"]["n_null"], s["b.c"]["n_null"], s["b.c"]["position"]) == ("int", 0, 1, 2)
