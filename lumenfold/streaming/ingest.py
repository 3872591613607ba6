"""Incremental work: new observation files are conformed, or prepared for training, as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.prepare import Preparation
from ..sources.schema import conform


def ingest_new_files(spark: SparkSession, source: str, target: str, state: str, schema: T.StructType, frozen: T.StructType | None = None) -> StreamingQuery:
    """Append every file of source that has not been read yet to target, then stop; state remembers what was read."""
    rows = spark.readStream.schema(schema).parquet(source)
    return conform(rows, frozen or schema).writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()


def prepare_new_files(spark: SparkSession, source: str, target: str, state: str, fitted: Preparation, schema: T.StructType) -> StreamingQuery:
    """Prepare the whole curves (id, time, value, label) of every new file of source with a fitted preparation, then stop.

    A run's samples and reasons lie in target/samples and target/reasons under run=<number>; a run that was killed is
    written again in the same place, so nothing is there twice. A curve must not be spread over files of several runs."""

    def prepared(rows: DataFrame, run: int) -> None:
        samples, reasons = fitted.apply(rows)
        for name, out in (("samples", samples), ("reasons", reasons)):
            out.write.mode("overwrite").parquet(f"{target}/{name}/run={run}")

    return spark.readStream.schema(schema).parquet(source).writeStream.foreachBatch(prepared).option("checkpointLocation", state).trigger(availableNow=True).start()
