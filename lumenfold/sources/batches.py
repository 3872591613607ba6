"""Batches: runs of rows of a file, numbered by the file's own row positions, and what is decided or committed by batch.

A batch is a range of at most so many rows of one file, so work grouped by batch is never skewed, and a batch's number
does not depend on how Spark splits files into tasks.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BATCH = ("batch_file", "batch")
#: Units of work that one job writes and one commit records.
UNITS_A_JOB = 64


def read_batches(spark: SparkSession, *paths: str, rows: int) -> DataFrame:
    """The rows of Parquet files with their file and the number of their batch of so many rows in it."""
    at = F.floor(F.col("_metadata.row_index") / F.lit(rows)).cast("long")
    return spark.read.option("mergeSchema", "true").parquet(*paths).select("*", F.col("_metadata.file_path").alias(BATCH[0]), at.alias(BATCH[1]))


def first_batch_only(df: DataFrame, key: str) -> DataFrame:
    """Of each object the rows of the first batch that holds it, by file name and number; rows without key go.

    The merging form needs no function: it groups all rows of an object. Rows meet their verdict by object and batch, so
    an object in many batches is spread over as many groups."""
    first = df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*BATCH)).alias("_first"))
    return df.join(first.select(key, *(F.col("_first")[c].alias(c) for c in BATCH)), [key, *BATCH], "left_semi")


def cast_by_batch(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    """Columns cast to kinds; a batch in which one value of a column does not cast has null in all of that column.

    conform() is the form that nulls the value alone. Only the verdicts of batches with a bad value are joined."""
    bad = {c: F.bool_or(F.col(c).isNotNull() & F.col(c).try_cast(k).isNull()).alias(f"_bad_{c}") for c, k in kinds.items()}
    verdicts = df.groupBy(*BATCH).agg(*bad.values()).filter(reduce(lambda a, b: a | b, (F.col(f"_bad_{c}") for c in kinds)))
    cast = lambda c: F.when(~F.coalesce(F.col(f"_bad_{c}"), F.lit(False)), F.col(c).try_cast(kinds[c])).alias(c)
    return df.join(verdicts, list(BATCH), "left").select(*(cast(c) if c in kinds else F.col(c) for c in df.columns))


class Ledger:
    """A dataset written unit by unit (a unit: a file, a batch, a day), with a record of the units that are complete.

    data/<unit column>=<unit> holds a unit's rows, commits/ one small file for each job, renamed into place after the
    job's rows are there. A run that is killed leaves rows without a commit, which no reader sees and the next run
    overwrites; committed units are not written again.
    """

    def __init__(self, spark: SparkSession, path: str, unit: str):
        self.spark, self.unit, self.data, self.commits = spark, unit, f"{path}/data", f"{path}/commits"
        sc = spark.sparkContext
        self._path = sc._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(path).getFileSystem(sc._jsc.hadoopConfiguration())

    def committed(self) -> DataFrame:
        """The complete units, each once."""
        if not self._fs.exists(self._path(self.commits)):
            return self.spark.createDataFrame([], f"{self.unit} string")
        return self.spark.read.schema("units array<string>").json(self.commits).select(F.explode("units").alias(self.unit)).distinct()

    def pending(self, units: DataFrame) -> DataFrame:
        """The units that are not complete."""
        return units.select(F.col(self.unit).cast("string").alias(self.unit)).distinct().join(self.committed(), self.unit, "left_anti")

    def _commit(self, units: list[str]) -> None:
        name = f"{uuid.uuid4().hex}.json"
        hidden, shown = self._path(f"{self.commits}/_{name}"), self._path(f"{self.commits}/{name}")
        out = self._fs.create(hidden, True)
        out.write(bytearray(json.dumps({"units": units}).encode()))
        out.close()
        if not self._fs.rename(hidden, shown):
            raise OSError(f"commit {name} could not be put in place")

    def write(self, df: DataFrame, transform: Callable[[DataFrame], DataFrame] = lambda rows: rows, units_a_job: int = UNITS_A_JOB) -> int:
        """Write the pending units of df, some a job, and commit each job; returns the number of units written.

        transform gets the rows of a job's units and keeps the unit column. Unit names come to the driver one job at a time."""
        units, done = self.pending(df).orderBy(self.unit), 0
        for names in _chunks(units.toLocalIterator(), units_a_job):
            rows = transform(df.filter(F.col(self.unit).cast("string").isin(names)))
            rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(self.unit).parquet(self.data)
            self._commit(names)
            done += len(names)
        return done

    def read(self, schema: T.StructType | None = None) -> DataFrame:
        """The rows of complete units alone."""
        if not self._fs.exists(self._path(self.data)):
            raise FileNotFoundError(f"nothing is written in {self.data}")
        reader = self.spark.read.schema(schema) if schema else self.spark.read
        rows = reader.parquet(self.data).withColumn(self.unit, F.col(self.unit).cast("string"))
        return rows.join(self.committed(), self.unit, "left_semi")


def _chunks(rows: Iterator, n: int) -> Iterator[list[str]]:
    """Names in lists of n, read ahead by one list alone."""
    out: list[str] = []
    for r in rows:
        out.append(r[0])
        if len(out) == n:
            yield out
            out = []
    if out:
        yield out
