"""Rules over streams of documents, and event-time views of evidence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import Rule, evaluate


def document_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """Documents of Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def validate_stream(stream: DataFrame, rules: list[Rule], id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """Evidence of a stream: rules keep no state, so this is the batch plan as it is."""
    return evaluate(stream, rules, id_col, text_col, keep=keep)


def windowed_counts(events: DataFrame, ts_col: str = "ts", by: str = "event_type", every: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window; events later than the watermark are left out of a stream."""
    return events.withWatermark(ts_col, late).groupBy(F.window(ts_col, every), by).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), by, "n", "total")


def sessions(events: DataFrame, by: str = "user_id", ts_col: str = "ts", gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Sessions of each key: events closer than the gap belong together."""
    return events.withWatermark(ts_col, late).groupBy(by, F.session_window(ts_col, gap)).agg(F.count("*").alias("n")).select(by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append", partition_by: tuple[str, ...] = ()) -> None:
    """Work off what a stream has now into Parquet, exactly once, and end."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).partitionBy(*partition_by).trigger(availableNow=True).start().awaitTermination()


def update_rollup(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Counts of statuses by rule, a folder for each micro-batch, so that a batch that is run again replaces its own."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("rule_id", "status").agg(F.count("*").alias("n")).write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
