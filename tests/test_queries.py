import oracle
import pytest

from lumenfold.plans import queries as q


@pytest.fixture(scope="module")
def con(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", sorted(q.ORACLE_SQL))
def test_same_rows_as_sql(spark, small, con, name):
    assert oracle.same(oracle.spark_rows(q.QUERIES[name](spark, small)), oracle.sql_rows(con, q.ORACLE_SQL[name]))


def test_prepared_curves_keep_their_ids(spark, small):
    rows = q.QUERIES["prepared_curves"](spark, small).collect()
    assert len({r["id"] for r in rows}) == len(rows) and {r["length"] for r in rows} == {64}
    assert {r["split"] for r in rows} <= {"train", "val", "test"}


def test_gaussian_noise_is_small_and_repeats(spark, small):
    f = q.QUERIES["aug_gaussian"]
    a, b = ({(r["vec_id"], r["pos"]): r["x"] for r in f(spark, small).collect()} for _ in range(2))
    raw = {(r["vec_id"], i): x for r in spark.read.parquet(f"{small}/embeddings.parquet").collect() for i, x in enumerate(r["embedding"])}
    d = [a[k] - raw[k] for k in a]
    assert a == b and abs(sum(d) / len(d)) < 1e-3 and 0.008 < (sum(x * x for x in d) / len(d)) ** 0.5 < 0.012
