"""Batches of files, resumable writes and damaged files."""

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lumenfold.sources import batches, readers, salvage


def files(spark, path, parts):
    """A folder of files a.parquet, b.parquet, ... with row groups of two rows each."""
    path.mkdir()
    for name, table in parts.items():
        pq.write_table(table, path / f"{name}.parquet", row_group_size=2)
    return str(path)


def table(**columns):
    import pyarrow as pa

    return pa.table(columns)


def test_batches_follow_file_positions(spark, tmp_path):
    at = files(spark, tmp_path / "d", {"a": table(k=[1, 1, 2, None, 1], v=["1", "x", "3", "4", "5"]), "b": table(k=[2, 1, 3], v=["6", "7", None])})
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        df = batches.read_batches(spark, at, rows=2)
        name = F.element_at(F.split("batch_file", "/"), -1)
        assert sorted(map(tuple, df.select(name, "batch", "v").collect()), key=repr) == sorted([("a.parquet", 0, "1"), ("a.parquet", 0, "x"), ("a.parquet", 1, "3"), ("a.parquet", 1, "4"), ("a.parquet", 2, "5"), ("b.parquet", 0, "6"), ("b.parquet", 0, "7"), ("b.parquet", 1, None)], key=repr)
        first = batches.first_batch_only(df, "k")
        assert sorted((r["k"], r["v"]) for r in first.collect()) == [(1, "1"), (1, "x"), (2, "3"), (3, None)]
        cast = batches.cast_by_batch(df, {"v": "double"}).select(name.alias("f"), "batch", "k", "v")
        assert sorted(map(tuple, cast.collect()), key=repr) == sorted([("a.parquet", 0, 1, None), ("a.parquet", 0, 1, None), ("a.parquet", 1, 2, 3.0), ("a.parquet", 1, None, 4.0), ("a.parquet", 2, 1, 5.0), ("b.parquet", 0, 2, 6.0), ("b.parquet", 0, 1, 7.0), ("b.parquet", 1, 3, None)], key=repr)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_a_hot_object_over_many_batches(spark, tmp_path):
    at = files(spark, tmp_path / "d", {"a": table(k=["hot"] * 500 + ["x"], v=list(range(501)))})
    first = batches.first_batch_only(batches.read_batches(spark, at, rows=7), "k")
    assert sorted(r["v"] for r in first.collect()) == [*range(7), 500]


class Killed(Exception):
    pass


def test_a_killed_run_goes_on_without_doubles(spark, tmp_path):
    df = spark.range(100).withColumn("day", (F.col("id") % 10).cast("string"))
    made = []

    def run(kill_at=None, rows=df):
        ledger = batches.Ledger(spark, str(tmp_path / "out"), "day")

        def work(part):
            days = sorted(r[0] for r in part.select("day").distinct().collect())
            made.append(days)
            if kill_at is not None and len(made) > kill_at:
                # rows reach the folder and then the run dies, before the commit
                part.write.mode("append").partitionBy("day").parquet(ledger.data)
                raise Killed
            return part.withColumn("twice", F.col("id") * 2)

        return ledger, ledger.write(rows, work, units_a_job=3)

    with pytest.raises(Killed):
        run(kill_at=2)
    ledger = batches.Ledger(spark, str(tmp_path / "out"), "day")
    assert sorted(r[0] for r in ledger.committed().collect()) == ["0", "1", "2", "3", "4", "5"]
    assert sorted(r["id"] for r in ledger.read().collect()) == [i for i in range(100) if i % 10 < 6]
    made.clear()
    ledger, done = run()
    assert done == 4 and made == [["6", "7", "8"], ["9"]]
    rows = ledger.read().collect()
    assert sorted((r["id"], r["twice"], r["day"]) for r in rows) == [(i, 2 * i, str(i % 10)) for i in range(100)]
    assert run()[1] == 0
    ledger, done = run(rows=df.unionByName(spark.range(100, 103).withColumn("day", F.lit("new"))))
    assert done == 1 and ledger.read().count() == 103 and ledger.committed().count() == 11


def test_a_commit_that_was_not_put_in_place_counts_for_nothing(spark, tmp_path):
    ledger = batches.Ledger(spark, str(tmp_path / "out"), "day")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, day string")
    assert ledger.write(df.filter("day = 'a'")) == 1
    (tmp_path / "out" / "commits" / "_half.json").write_text('{"units": ["b"')
    df.filter("day = 'b'").write.mode("append").partitionBy("day").parquet(ledger.data)
    assert [r["id"] for r in ledger.read().collect()] == [1]
    assert ledger.write(df) == 1 and sorted(r["id"] for r in ledger.read().collect()) == [1, 2]


def test_sound_row_groups_of_a_damaged_file(spark, tmp_path):
    at = files(spark, tmp_path / "d", {"a": table(id=list(range(10)), mag=[float(i) for i in range(10)]), "b": table(oid=["x", "y"], mag=[1, 2])})
    path = tmp_path / "d" / "a.parquet"
    meta = pq.ParquetFile(path).metadata
    column = meta.row_group(2).column(1)
    start = min(p for p in (column.dictionary_page_offset, column.data_page_offset) if p is not None)
    raw = bytearray(path.read_bytes())
    raw[start : start + column.total_compressed_size] = b"\xff" * column.total_compressed_size
    path.write_bytes(bytes(raw))
    (tmp_path / "d" / "cut.parquet").write_bytes(raw[: len(raw) // 2])
    (tmp_path / "d" / "none.parquet").write_bytes(b"")
    got = salvage.read_salvaged(spark, at)
    assert sorted((r["id"], r["mag"]) for r in got.collect()) == sorted([(str(i), float(i)) for i in range(10) if i not in (4, 5)] + [("x", 1.0), ("y", 2.0)])
    report = {(r["path"].rpartition("/")[2], r["row_group"]): r for r in salvage.salvage_report(spark, at).collect()}
    assert [report["a.parquet", g]["state"] for g in range(5)] == ["sound", "sound", "lost", "sound", "sound"]
    assert (report["a.parquet", 2]["first_row"], report["a.parquet", 2]["n_rows"]) == (4, 2) and report["a.parquet", 2]["error"]
    assert report["cut.parquet", None]["state"] == "no footer" and report["none.parquet", None]["state"] == "empty"
    whole = readers.read_parquet(spark, f"{at}/b.parquet")
    assert whole.count() == 2
    (tmp_path / "e").mkdir()
    with pytest.raises(ValueError):
        salvage.read_salvaged(spark, str(tmp_path / "e"))
