"""Gzip files by member, and the states of CSV files."""

import gzip
import random

import pytest

from lumenfold.sources import gzip_lines, readers


def catalog(n, seed=0):
    r = random.Random(seed)
    return [f"{i}," + ",".join(["x" * r.randrange(9)] * 12) + f",{r.random() * 360:.6f},{r.random() * 180 - 90:.6f}" for i in range(n)]


def write(path, text, sizes):
    """text as gzip members of so many bytes each, the last size again and again."""
    with open(path, "wb") as f:
        at, i = 0, 0
        while at < len(text) or i == 0:
            n = sizes[min(i, len(sizes) - 1)]
            f.write(gzip.compress(text[at : at + n]))
            at, i = at + n, i + 1


@pytest.mark.parametrize("range_bytes", [1 << 26, 5000])
def test_members_give_the_same_rows(spark, tmp_path, monkeypatch, range_bytes):
    monkeypatch.setattr(gzip_lines, "RANGE", range_bytes)
    monkeypatch.setattr(gzip_lines, "BLOCK", 3000)
    lines = catalog(3000)
    text = ("\n".join(lines) + "\n").encode()
    write(tmp_path / "one.csv.gz", text, [1 << 30])
    write(tmp_path / "many.csv.gz", text, [7, 3, 20_000, 5000])
    write(tmp_path / "tiny.csv.gz", text[:300], [1])
    write(tmp_path / "open.csv.gz", "\r\n".join(lines[:50]).encode(), [500])
    write(tmp_path / "none.csv.gz", b"", [1])
    (tmp_path / "zero.csv.gz").write_bytes(b"")
    want = sorted(map(tuple, readers.read_tic_slices(spark, str(tmp_path / "*.csv.gz")).collect()))
    got = readers.read_tic_members(spark, str(tmp_path), partitions=16)
    assert sorted(map(tuple, got.collect())) == want and len(want) > 6050
    many = readers.read_tic_members(spark, str(tmp_path), "many.csv.gz", partitions=16)
    tasks = many.select(readers.F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 4


def test_chance_headers_and_damage(spark, tmp_path):
    r = random.Random(1)
    noise = b"\n".join(gzip_lines.MAGIC + b"\x00" + bytes(r.randrange(32, 127) for _ in range(50)) for _ in range(2000))
    with open(tmp_path / "stored.gz", "wb") as f:
        f.write(gzip.compress(noise, compresslevel=0))  # stored, so the chance headers stand in the file
        f.write(gzip.compress(b"\nlast line\n"))
    got = sorted(x["value"] for x in gzip_lines.gzip_lines(spark, str(tmp_path)).collect())
    assert len(got) == 2001 and "last line" in got
    raw = bytearray((tmp_path / "stored.gz").read_bytes())
    raw[5000] ^= 255
    (tmp_path / "stored.gz").write_bytes(bytes(raw))
    with pytest.raises(Exception, match="damaged"):
        gzip_lines.gzip_lines(spark, str(tmp_path)).collect()


def test_states_of_csv_files(spark, tmp_path):
    for name, text in (("a.csv", "id,cls\n1,EA\n2,ZZ\n"), ("b.csv", "id,cls\nnope,EA\n3,EA\n"), ("c.csv", "id,cls\n4,ZZ\n"), ("d.csv", ""), ("e.csv", "id,cls\n")):
        (tmp_path / name).write_text(text)
    got = {r["path"].rpartition("/")[2]: (r["n_valid"], r["n_corrupt"], r["n_other_class"], r["state"]) for r in readers.checked_files(spark, str(tmp_path), "id int, cls string", "cls", ["EA"]).collect()}
    assert got == {"a.csv": (1, 0, 1, "valid"), "b.csv": (1, 1, 0, "corrupt"), "c.csv": (0, 0, 1, "other_class"), "d.csv": (0, 0, 0, "empty"), "e.csv": (0, 0, 0, "other_class")}
