"""Damaged Parquet files: every sound row group is read, every lost range is reported.

The unit of reading is a row group in a task of its own turn, not a file: a footer says which there are, each is decoded
alone, and an error costs that group and no other. Files are opened by pyarrow's file systems (local, HDFS, S3, GCS).
"""

from __future__ import annotations

import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_schema, to_arrow_schema

from .readers import list_files, open_file
from .schema import unify

GROUPS = "path string, row_group int, first_row long, n_rows long, fields string, error string"
#: Rows that a task hands on at a time.
ROWS = 10_000


def _error(e: Exception) -> str:
    return f"{type(e).__name__}: {e}".splitlines()[0][:300]


def _footers(batches):
    """One row a row group; one with an error for a file without a readable footer."""
    for b in batches:
        out = []
        for path in b.column("path").to_pylist():
            try:
                with open_file(path) as f:
                    meta = pq.ParquetFile(f).metadata
                    fields = from_arrow_schema(meta.schema.to_arrow_schema()).json()
                first = 0
                for g in range(meta.num_row_groups):
                    out.append((path, g, first, meta.row_group(g).num_rows, fields, None))
                    first += meta.row_group(g).num_rows
            except Exception as e:  # any damage of a footer is a finding
                out.append((path, None, None, None, None, _error(e)))
        yield _batch(out)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["path", "row_group", "first_row", "n_rows", "fields", "error"])


def _group(path: str, group: int, schema: pa.Schema) -> pa.Table:
    """A row group, decoded as a whole before any of its rows is handed on."""
    with open_file(path) as f:
        return pq.ParquetFile(f).read_row_group(group, columns=schema.names).cast(schema)


def _rows(schema: pa.Schema):
    def run(batches):
        for b in batches:
            for path, group in zip(b.column("path").to_pylist(), b.column("row_group").to_pylist(), strict=True):
                try:
                    yield from _group(path, group, schema).to_batches(max_chunksize=ROWS)
                except Exception:  # reported by salvage_report, which reads the same
                    continue

    return run


def _verdicts(batches):
    for b in batches:
        out = []
        for path, group, first, n, fields, error in zip(*(b.column(i).to_pylist() for i in range(6)), strict=True):
            if error is None:
                try:
                    _group(path, group, to_arrow_schema(T.StructType.fromJson(json.loads(fields))))
                except Exception as e:  # any damage of a group is a finding
                    error = _error(e)
            out.append((path, group, first, n, fields, error))
        yield _batch(out)


def row_groups(spark: SparkSession, root: str, glob: str = "*.parquet", partitions: int | None = None) -> DataFrame:
    """path, row_group, first_row, n_rows, fields (its schema), error of every row group below root; tasks read the footers."""
    files = list_files(spark, root, glob).filter("bytes > 0").select("path")
    tasks = partitions or spark.sparkContext.defaultParallelism
    return files.repartition(tasks).mapInArrow(_footers, GROUPS)


def read_salvaged(spark: SparkSession, root: str, glob: str = "*.parquet", partitions: int | None = None) -> DataFrame:
    """The rows of all sound row groups below root under one resolved schema; a plan branch for each different footer schema.

    Schemas, not files, come to the driver. Files without rows or footer add none."""
    groups = row_groups(spark, root, glob, partitions)
    schemas = [r["fields"] for r in groups.filter("fields IS NOT NULL").select("fields").distinct().orderBy("fields").collect()]
    frames = []
    for fields in schemas:
        schema = T.StructType.fromJson(json.loads(fields))
        own = groups.filter(F.col("fields") == fields).repartition(partitions or spark.sparkContext.defaultParallelism, "path", "row_group")
        frames.append(own.mapInArrow(_rows(to_arrow_schema(schema)), schema))
    if not frames:
        raise ValueError(f"no readable Parquet file below {root}")
    return unify(frames)


def salvage_report(spark: SparkSession, root: str, glob: str = "*.parquet", partitions: int | None = None) -> DataFrame:
    """path, row_group, first_row, n_rows, state, error: sound and lost row groups, lost footers and empty files below root."""
    groups = row_groups(spark, root, glob, partitions).repartition(partitions or spark.sparkContext.defaultParallelism, "path", "row_group")
    state = F.when(F.col("error").isNull(), "sound").when(F.col("row_group").isNull(), "no footer").otherwise("lost")
    found = groups.mapInArrow(_verdicts, GROUPS).select("path", "row_group", "first_row", "n_rows", state.alias("state"), "error")
    none = list_files(spark, root, glob).filter("bytes = 0").select("path", *(F.lit(None).cast(t).alias(c) for c, t in (("row_group", "int"), ("first_row", "long"), ("n_rows", "long"))), F.lit("empty").alias("state"), F.lit(None).cast("string").alias("error"))
    return found.unionByName(none)
