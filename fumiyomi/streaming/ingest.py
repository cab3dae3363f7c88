"""New documents as a stream: the same rules over each micro-batch, findings appended, and drift over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fumiyomi.plans.lint import lint


def incoming(spark: SparkSession, folder: str, files_per_trigger: int = 100) -> DataFrame:
    """Parquet files of documents (doc_id, genre, text) as they come."""
    return spark.readStream.schema("doc_id string, genre string, text string").option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def lint_stream(docs: DataFrame, out: str, checkpoint: str, experimental: bool = False) -> StreamingQuery:
    """Findings of every micro-batch, each batch in a folder of its own, so that a batch run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        lint(batch, experimental).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def drift(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts and means by event time and type; late events within the watermark still count."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
