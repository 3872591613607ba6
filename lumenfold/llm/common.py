"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import contextlib
import ctypes
import functools
import gc
import re
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Let executors import this library even where it is not installed: its source goes to them once a session."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="lumenfold-")) / "lumenfold_source.zip"
        with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(path))
        _shipped.add(sc.applicationId)


def operator(f):
    """An operator on a DataFrame, its first argument: executors get the library's source before it runs."""

    @functools.wraps(f)
    def run(df: DataFrame, *args, **named):
        ship(df.sparkSession)
        return f(df, *args, **named)

    return run


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode alone, where one machine is all there is, a temporary one may stand in."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = "file://" + tempfile.mkdtemp(prefix="lumenfold-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def arrow_folder(spark: SparkSession, folder: str) -> str:
    """A folder as pyarrow names it: with the scheme and host that Spark gives it, s3a and s3n as s3."""
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(folder)
    if path.toUri().getScheme() not in ("s3", "s3a", "s3n"):
        path = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path)
    uri = path.toUri()
    scheme = "s3" if uri.getScheme() in ("s3a", "s3n") else uri.getScheme()
    return f"{scheme}://{uri.getAuthority() or ''}{uri.getPath()}"


#: Settings of the jobs that write intermediate tables: Spark removes an execution's shuffle files when the execution ends
#: (else they stay until the driver's garbage is collected), and long texts reach the Python workers a few at a time.
JOBS = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxBytesPerBatch": "8m"}


@contextlib.contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]):
    """Within it the session has the wanted settings, afterwards its own."""
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write df once as Parquet in the shared folder and read it back: its lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    with settings(spark, JOBS):
        df.write.parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    stored.stored_at = path
    return stored


def release(*frames: DataFrame) -> None:
    """Remove what materialize() wrote for frames; nothing that is still to be computed may read them."""
    for df in frames:
        sc, path = df.sparkSession.sparkContext, getattr(df, "stored_at", None)
        if path:
            folder = sc._jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(sc._jsc.hadoopConfiguration()).delete(folder, True)


def forget_codecs() -> None:
    """Free the tokenizers that a worker holds from a packing it did before: its next work needs the memory."""
    bpe = sys.modules.get("lumenfold.llm.bpe")
    if bpe and bpe.codec.cache_info().currsize:
        bpe.codec.cache_clear()
        gc.collect()
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)  # the C library keeps freed memory otherwise


def fresh(df: DataFrame) -> DataFrame:
    """df with columns of its own, so that it can be grouped together with another frame from the same table."""
    return df.select(*(F.col(c).alias(f"{c}_") for c in df.columns)).select(*(F.col(f"{c}_").alias(c) for c in df.columns))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def with_row_ids(df: DataFrame, id_col: str, text_col: str, name: str) -> DataFrame:
    """df with name, a number of each row that rises with the id (null last): the id itself where every row has its own.

    Rows that share an id, or have none, follow by a hash of the text and then as they are read, in range partitions, so
    one id's rows may lie in several; the result is written once, as the numbers depend on where the ranges are cut.
    """
    several = df.groupBy(id_col).agg(F.count(F.lit(1)).alias("n")).filter(F.col(id_col).isNull() | (F.col("n") > 1))
    if several.limit(1).isEmpty():
        return df.withColumn(name, F.col(id_col).cast("long"))
    order = [F.col(id_col).asc_nulls_last(), F.col("_hash").asc(), F.col("_turn").asc()]
    dealt = df.withColumn("_hash", F.xxhash64(text_col)).withColumn("_turn", F.monotonically_increasing_id())
    dealt = materialize(dealt, "rows-read").repartitionByRange(*order).sortWithinPartitions(*order)
    return materialize(dealt.drop("_hash", "_turn").withColumn(name, F.monotonically_increasing_id()), "rows-numbered")


def finite_vectors(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """id, v (array<double>) and dim of the rows with an id and a non-empty vector of finite components."""
    v = F.col(vector_col)
    ok = v.isNotNull() & F.col(id_col).isNotNull() & (F.size(v) > 0)
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(ok).filter(good).select(F.col(id_col).cast("long").alias("id"), v.cast("array<double>").alias("v"), F.size(v).alias("dim"))


def matrix(t: pa.Table, name: str) -> np.ndarray:
    """A column of equally long lists as a matrix."""
    values = t.column(name).combine_chunks()
    if isinstance(values, pa.ChunkedArray):
        values = pa.concat_arrays(values.chunks) if values.num_chunks else pa.array([], values.type)
    n = len(values)
    return values.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def top_rows(group: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k rows of each group with the smallest score, ties to the smaller ident, sorted by group and score."""
    order = np.lexsort((ident, score, group))
    g = group[order]
    first = np.flatnonzero(np.r_[True, g[1:] != g[:-1]]) if len(g) else np.zeros(0, np.int64)
    rank = np.arange(len(g)) - np.repeat(first, np.diff(np.r_[first, len(g)]))
    return order[rank < k]


def chunk_of(ident: Column, n: int) -> Column:
    """An even part 0..n-1 that the id alone decides."""
    return F.pmod(F.xxhash64(ident), F.lit(n)).cast("int")
