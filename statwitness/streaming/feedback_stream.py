"""Agreement rate over time, as feedback arrives."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def stream_agreement(feedback: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """Tumbling windows of agreement; feedback later than ``delay`` is dropped.

    In append mode a window is emitted once the watermark has passed its end, so windows that may still
    receive feedback are not in the output yet.
    """
    timed = feedback.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", window).alias("w")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("agree").alias("n_agree"), F.avg(F.col("agree").cast("double")).alias("agreement")
    ).select(F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), "n", "n_agree", "agreement")


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process everything that is there and stop; output and progress live in the shared folder."""
    (
        stream.writeStream.format("parquet").outputMode(mode).option("path", path)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    )
