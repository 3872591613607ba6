"""Writing: Parquet with controlled files, compaction, resumable appends, summaries and dataset artefacts."""

from __future__ import annotations

import itertools
import json
from pathlib import Path

import pandas as pd
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .readers import list_files, open_file, parquet_footers
from .schema import conform

#: Rows of a summary, which is written by the driver.
SUMMARY_ROWS = 100_000


def append_parquet(df: DataFrame, path: str, schema: T.StructType | None = None, rows_per_file: int | None = None, partition_by: list[str] | None = None, rows_per_group: int | None = None) -> None:
    """Append under a frozen schema, snappy-compressed, files of at most rows_per_file and row groups of at most rows_per_group rows."""
    w = (conform(df, schema) if schema else df).write.mode("append").option("compression", "snappy")
    if rows_per_file:
        w = w.option("maxRecordsPerFile", rows_per_file)
    if rows_per_group:
        w = w.option("parquet.block.row.count.limit", rows_per_group)
    (w.partitionBy(*partition_by) if partition_by else w).parquet(path)


def _units(path: str, meta: pq.FileMetaData) -> list[tuple]:
    """(path, row group, rows, bytes) of each row group of a footer."""
    groups = (meta.row_group(g) for g in range(meta.num_row_groups))
    return [(path, i, g.num_rows, sum(g.column(c).total_compressed_size for c in range(g.num_columns))) for i, g in enumerate(groups)]


def row_group_sizes(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, row_group, n_rows, bytes of every row group; tasks read the footers alone."""

    def run(parts):
        for part in parts:
            out = []
            for path in part["path"]:
                with open_file(path) as f:
                    out += _units(path, pq.read_metadata(f))
            yield pd.DataFrame(out, columns=["path", "row_group", "n_rows", "bytes"])

    named = spark.createDataFrame([(p,) for p in paths], "path string")
    return named.repartition(max(1, min(len(paths), 200))).mapInPandas(run, "path string, row_group int, n_rows long, bytes long")


def pack_neighbours(sizes: list[int], parts: int) -> list[int]:
    """How many of the sizes, in their order, go to each of parts runs that are as even as the order allows; none of the runs is left out while sizes last."""
    total, counts, at, done = sum(sizes), [], 0, 0
    for part in range(parts):
        limit, n = total * (part + 1) / parts, 0
        later = parts - part - 1
        while at < len(sizes) and (part == parts - 1 or ((n == 0 or done + sizes[at] / 2 <= limit) and len(sizes) - at > later)):
            done, at, n = done + sizes[at], at + 1, n + 1
        counts.append(n)
    return counts


def _to_schema(table: pa.Table, schema: pa.Schema) -> pa.Table:
    """The columns of schema, cast; missing ones null."""
    have = set(table.schema.names)
    return pa.table([table.column(f.name).cast(f.type) if f.name in have else pa.nulls(len(table), f.type) for f in schema], schema=schema)


def compact(spark: SparkSession, source: str, target: str, files: int, block_bytes: int = 128 << 20, rows_per_group: int | None = None) -> DataFrame:
    """Rewrite fragmented files as files files with large row groups; returns the number of files, row groups and rows before and after.

    Row groups that follow each other, within files and from file to file by name, become one file each, so the order of
    rows stays and nothing is shuffled: a task reads its run of row groups, one in memory, and writes a file. Names and
    sizes of row groups come to the driver, as names of files do."""
    names = sorted(r["path"] for r in list_files(spark, source, "*.parquet").filter("bytes > 0").collect())
    units = sorted(map(tuple, row_group_sizes(spark, names).collect()))
    schema = spark.read.option("mergeSchema", "true").parquet(source).schema
    counts = [n for n in pack_neighbours([u[3] for u in units], max(1, files)) if n]
    ends = list(itertools.accumulate(counts))
    runs = spark.sparkContext.broadcast([[u[:2] for u in units[end - n : end]] for n, end in zip(counts, ends, strict=True)])
    arrow = to_arrow_schema(schema)

    def read(batches):
        for b in batches:
            for part in b.column("id").to_pylist():
                for path, own in itertools.groupby(runs.value[part], lambda u: u[0]):
                    with open_file(path) as f:
                        file = pq.ParquetFile(f)
                        for _, group in own:
                            yield from _to_schema(file.read_row_group(group), arrow).to_batches(max_chunksize=10_000)

    rows = spark.range(0, len(counts), 1, max(1, len(counts))).mapInArrow(read, schema)
    w = rows.write.mode("overwrite").option("compression", "snappy").option("parquet.block.size", block_bytes)
    (w.option("parquet.block.row.count.limit", rows_per_group) if rows_per_group else w).parquet(target)
    out = None
    for state, path in (("before", source), ("after", target)):
        names = [r["path"] for r in list_files(spark, path, "*.parquet").filter("bytes > 0").collect()]
        row = parquet_footers(spark, names).agg(F.count(F.lit(1)).alias("n_files"), F.sum("n_row_groups").alias("n_row_groups"), F.sum("n_rows").alias("n_rows")).select(F.lit(state).alias("state"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def with_constant(df: DataFrame, column: str, value) -> DataFrame:
    """A column that the files lack, with one value."""
    return df.withColumn(column, F.lit(value))


def _small(df: DataFrame) -> DataFrame:
    """df, if it has SUMMARY_ROWS rows at most; counted before any row comes to the driver."""
    if df.limit(SUMMARY_ROWS + 1).count() > SUMMARY_ROWS:
        raise ValueError(f"a summary has {SUMMARY_ROWS} rows at most; save() writes tables of any size")
    return df


def write_summary(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """A small summary as one csv, json or txt file."""
    rows = _small(df).toPandas()
    if fmt == "csv":
        rows.to_csv(path, index=False)
    elif fmt == "json":
        rows.to_json(path, orient="records", force_ascii=False)
    elif fmt == "txt":
        Path(path).write_text(rows.to_string(index=False) + "\n", encoding="utf-8")
    else:
        raise ValueError(f"unknown format: {fmt}")


def markdown(df: DataFrame) -> str:
    """A small summary as a Markdown table."""
    rows = [[("" if v is None else str(v)) for v in r] for r in _small(df).collect()]
    line = lambda cells: "| " + " | ".join(cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, rows)])


def save(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown format: {fmt}")
    w = df.write.mode("overwrite")
    w.parquet(path) if fmt == "parquet" else w.option("header", True).csv(path)


def pending(todo: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of todo whose keys are not done yet."""
    return todo.join(done.select(*keys).distinct(), keys, "left_anti")


def save_dataset(samples: DataFrame, stats: dict, path: str) -> None:
    """Samples by split as Parquet and the encoder and scaler figures as JSON beside them."""
    samples.write.mode("overwrite").partitionBy("split").parquet(f"{path}/samples")
    samples.sparkSession.createDataFrame([(json.dumps(stats, ensure_ascii=False),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/stats")
