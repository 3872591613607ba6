import gzip

import pytest

from lumenfold.plans import prepare
from lumenfold.sources import readers, writers
from lumenfold.streaming.ingest import ingest_new_files


def test_text_sources(spark, tmp_path):
    (tmp_path / "ASASSN-V_J01.dat").write_text("# note\n1.5 ba >14.2 0.1 2 3 4 im1\n\n2.5  bb 14.1 0.1 x 3 4 im2\n")
    rows = readers.read_dat(spark, str(tmp_path / "*.dat")).orderBy("time").collect()
    assert [(r["id"], r["time"], r["mag"], r["flux"]) for r in rows] == [("ASASSN-V J01", 1.5, ">14.2", 2.0), ("ASASSN-V J01", 2.5, "14.1", None)]
    with gzip.open(tmp_path / "s.csv.gz", "wt") as f:
        f.write("7," + ",".join(["x"] * 12) + ",10.5,-3.25\nbad," + ",".join(["x"] * 12) + ",1,2\n")
    assert [tuple(r) for r in readers.read_tic_slices(spark, str(tmp_path / "s.csv.gz"), 2).collect()] == [(7, 10.5, -3.25)]
    (tmp_path / "v.xml").write_text("<CSV><![CDATA[ID;RAJ2000;DEJ2000;Type\nz1;1.5;2.5;EA\n]]></CSV>")
    assert [tuple(r) for r in readers.read_votable_csv(spark, str(tmp_path / "v.xml")).collect()] == [("z1", 1.5, 2.5, "EA")]
    (tmp_path / "k2.csv").write_text("11,RRab,1,2,3,x,4,5\n12,,1,2,3,x,4,5\n")
    assert [tuple(r) for r in readers.read_k2_catalog(spark, str(tmp_path / "k2.csv"), 5).collect()] == [(11, "RRab")]


def test_named_and_joined_curves(spark, tmp_path):
    d = tmp_path / "c" / "m"
    d.mkdir(parents=True)
    (d / "tess_77_a_flux_2020.csv").write_text("time,flux\n1,2\n")
    (d / "short_name.csv").write_text("time,flux\n9,9\n")
    assert [tuple(r) for r in readers.read_named_curves(spark, str(tmp_path / "c")).collect()] == [("tess_77_a", "tess", "77", 1.0, 2.0, None)]
    o = tmp_path / "o"
    o.mkdir()
    (o / "s1.csv").write_text("hjd,mag\n5,6\n")
    cat = spark.createDataFrame([("s1", "EA"), ("s2", "EB")], "source_id string, variable_type string")
    got = readers.read_object_curves(spark, str(o), cat).collect()
    assert [(r["source_id"], r["tiempo"], r["magnitud"], r["error"], r["variable_type"]) for r in got] == [("s1", 5.0, 6.0, None, "EA")]
    (o / "empty.csv").write_text("")
    assert {r["path"].rpartition("/")[2]: r["is_empty"] for r in readers.file_report(spark, str(o)).collect()} == {"s1.csv": False, "empty.csv": True}
    k = tmp_path / "k"
    k.mkdir()
    (k / "x.csv").write_text("id,cls\n1,EA\n2,ZZ\nnope,EA\n")
    good, states = readers.read_checked(spark, str(k), "id int, cls string", "cls", ["EA"])
    assert [tuple(r) for r in good.collect()] == [(1, "EA")] and {r["state"]: r["n"] for r in states.collect()} == {"valid": 1, "corrupt": 1, "other_class": 1}


def test_curve_files_have_headers_of_their_own(spark, tmp_path):
    (tmp_path / "A.csv").write_text('HJD,mag,mag_err,flux,flux_err\n1.5,12.5,0.1,100,2\n')
    (tmp_path / "B.csv").write_text('"hjd", flux,mag\r\n2.5,200,13.5\r\n,1,2\r\n')
    (tmp_path / "C.csv").write_text("")
    (tmp_path / "D.csv").write_text("hjd\nx\n3\n")
    cat = spark.createDataFrame([("A", "EA"), ("B", "EB"), ("B", "EW"), ("D", "RR")], "source_id string, variable_type string")
    got = readers.read_object_curves(spark, str(tmp_path), cat).collect()
    assert sorted((r["source_id"], r["tiempo"], r["magnitud"], r["error"], r["flux"], r["flux_err"], r["variable_type"]) for r in got) == [("A", 1.5, 12.5, 0.1, 100.0, 2.0, "EA"), ("B", 2.5, 13.5, None, 200.0, None, "EB"), ("D", 3.0, None, None, None, None, "RR")]
    d = tmp_path / "n" / "m"
    d.mkdir(parents=True)
    (d / "tess_1_a_flux_2020.csv").write_text("flux,time\n2,1\n")
    (d / "tess_2_a_flux_2020.csv").write_text("time,flux_err,flux\n3,0.5,4\n")
    got = readers.read_named_curves(spark, str(tmp_path / "n")).collect()
    assert sorted((r["id_objeto"], r["tiempo"], r["magnitud"], r["error"]) for r in got) == [("tess_1_a", 1.0, 2.0, None), ("tess_2_a", 3.0, 4.0, 0.5)]


def test_reports_of_files(spark, tmp_path):
    spark.range(100).repartition(2).write.parquet(str(tmp_path / "p"))
    (tmp_path / "p" / "bad.parquet").write_bytes(b"PAR1 nothing")
    (tmp_path / "p" / "none.parquet").write_bytes(b"")
    states = readers.scan_report(spark, str(tmp_path / "p")).groupBy("state").agg(readers.F.count("*").alias("n"), readers.F.sum("n_rows").alias("rows")).collect()
    assert {r["state"]: (r["n"], r["rows"]) for r in states} == {"valid": (2, 100), "corrupt": (1, 0), "empty": (1, 0)}
    assert readers.read_mixed(spark, str(tmp_path / "p")).count() == 100
    (tmp_path / "c.csv").write_text("# made by hand\na,b\n1,x\n")
    assert [tuple(r) for r in readers.read_catalog(spark, str(tmp_path / "c.csv")).collect()] == [("1", "x")]


def test_row_groups_and_row_ranges(spark, tmp_path):
    df = spark.range(1000).coalesce(1)
    frag, out = str(tmp_path / "frag"), str(tmp_path / "out")
    writers.append_parquet(df, frag, rows_per_group=100)
    report = {r["state"]: r.asDict() for r in writers.compact(spark, frag, out, 1, rows_per_group=250).collect()}
    assert report["before"]["n_row_groups"] == 10 and report["after"]["n_row_groups"] == 4 and report["before"]["n_rows"] == report["after"]["n_rows"] == 1000
    assert sorted(r[0] for r in readers.read_row_range(spark, frag, 250, 260).collect()) == list(range(250, 260))


def test_saved_dataset(spark, tmp_path):
    writers.save_dataset(spark.createDataFrame([(1, "train"), (2, "test")], "id int, split string"), {"classes": ["EA"]}, str(tmp_path / "d"))
    assert spark.read.parquet(str(tmp_path / "d" / "samples")).filter("split = 'train'").first()["id"] == 1
    assert "EA" in spark.read.text(str(tmp_path / "d" / "stats")).first()[0]


def test_parquet_round_trips(spark, tmp_path):
    df = spark.range(1000).selectExpr("id", "id * 1.5 AS mag")
    frag, out = str(tmp_path / "frag"), str(tmp_path / "one")
    df.repartition(20).write.parquet(frag)
    writers.compact(spark, frag, out, 1)
    files = [str(p) for p in (tmp_path / "one").glob("*.parquet")]
    assert len(files) == 1 and readers.parquet_footers(spark, files).first()["n_rows"] == 1000
    writers.append_parquet(df, out, df.schema, rows_per_file=300)
    assert readers.read_parquet(spark, out, columns=["id"]).count() == 2000
    assert writers.pending(df, df.filter("id < 990"), ["id"]).count() == 10
    writers.save(df, str(tmp_path / "csv"), "csv")
    with pytest.raises(ValueError):
        writers.save(df, str(tmp_path / "x"), "xls")
    small = df.limit(1)
    assert writers.markdown(small).splitlines()[0] == "| id | mag |"
    for fmt in ("csv", "json", "txt"):
        writers.write_summary(small, str(tmp_path / f"s.{fmt}"), fmt)
        assert (tmp_path / f"s.{fmt}").stat().st_size
    assert writers.with_constant(small, "clase_variable", "EB").first()["clase_variable"] == "EB"


def test_mixed_files_and_preparation(spark, tmp_path):
    spark.createDataFrame([("a", 1.0, "EA")], "id_objeto string, HJD double, clase_variable string").write.parquet(str(tmp_path / "p1"))
    spark.createDataFrame([(2, 3, "GDOR")], "oid int, mjd int, variable_class string").write.parquet(str(tmp_path / "p2"))
    both = readers.read_mixed(spark, str(tmp_path / "p1"), str(tmp_path / "p2"))
    assert both.columns == ["id", "time", "clase_variable"] and both.count() == 2
    one = prepare.unify_observations([both])
    assert [(r["id"], r["clase_variable_normalizada"]) for r in one.collect()] == [("a", "Eclipsing Binary")]
    first = readers.first_source(both, "id", [both.filter("id = 'a'").withColumn("from", readers.F.lit("x")), both.withColumn("from", readers.F.lit("y"))])
    assert dict(first.select("id", "from").collect()) == {"a": "x", "2": "y"}


def test_new_files_arrive_once(spark, tmp_path):
    src, out, state = (str(tmp_path / x) for x in ("src", "out", "state"))
    schema = spark.range(1).schema
    for n in (3, 4):
        spark.range(n).write.mode("append").parquet(src)
        ingest_new_files(spark, src, out, state, schema).awaitTermination()
    assert spark.read.parquet(out).count() == 7
