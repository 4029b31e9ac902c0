"""Streaming ingest, beyond the batch verbs: documents that arrive in a folder are appended once each to a store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.codes import content_hash


def arriving(spark: SparkSession, root: str, schema: str = "doc_id long, text string, ts timestamp", per_batch: int = 1000) -> DataFrame:
    """Rows of Parquet files as they arrive, with their content hash."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_batch).parquet(root).withColumn("hash", content_hash(F.col("text")))


def once_each(rows: DataFrame, late: str = "1 hour") -> DataFrame:
    """The first row of each text within the time that late rows are waited for; the state is dropped after it."""
    return rows.withWatermark("ts", late).dropDuplicatesWithinWatermark(["hash"])


def counts(rows: DataFrame, late: str = "1 hour", width: str = "10 minutes") -> DataFrame:
    """Documents and distinct texts by time window; windows close when late rows are no longer waited for."""
    return rows.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count("*").alias("rows"), F.approx_count_distinct("hash").alias("texts"))


def append(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Run until what has arrived is written, exactly once a batch."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
