"""Structured Streaming forms: progress kept while files arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from strandline.operators.state import upsert
from strandline.sources.sinks import read_snapshot, swap_snapshot


def file_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they arrive in ``path``."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(stream: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts per key and tumbling window; rows later than ``late`` are left out."""
    marked = stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late)
    counted = marked.groupBy(F.window("_time", window).alias("w"), *keys).agg(F.count("*").alias("n"))
    return counted.select(*keys, F.col("w.start").alias("window_start"), "n")


def first_deliveries(stream: DataFrame, key: str, time: str, late: str = "2 hours") -> DataFrame:
    """Rows of ids not seen within the watermark before."""
    return stream.withColumn("_time", F.col(time).cast("timestamp")).withWatermark("_time", late).dropDuplicatesWithinWatermark([key]).drop("_time")


def keep_registry(stream: DataFrame, registry: str, keys: list[str], checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch into a Parquet registry: the last change of a key
    in a batch wins, and the registry (read it with ``read_snapshot``) is
    swapped as a whole, so a batch that is run again after a failure gives the
    same registry."""

    def fold(batch: DataFrame, _: int) -> None:
        spark = batch.sparkSession
        latest = batch.groupBy(*keys).agg(*[F.max_by(c, "changed_at").alias(c) for c in batch.columns if c not in keys])
        held = read_snapshot(spark, registry)
        swap_snapshot(latest if held is None else upsert(held, latest, keys), registry)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
