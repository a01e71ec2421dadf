"""Matching a stream of addresses against a static reference, and windowed counts of the outcomes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from waymark.plans.match_text import match_addresses
from waymark.plans.matcher import MatchOptions


def match_stream(stream: DataFrame, ref: DataFrame, out: str, checkpoint: str, options: MatchOptions | None = None, available_now: bool = True) -> StreamingQuery:
    """stream: input_id, input_raw and more. Every micro-batch is matched whole and appended under its batch number, so
    that a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            match_addresses(batch.select("input_id", "input_raw"), ref, options).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def outcome_counts(results: DataFrame, time_col: str = "ts", late: str = "10 minutes", span: str = "5 minutes") -> DataFrame:
    """Tumbling counts by match_status, with a watermark for late rows."""
    return results.withWatermark(time_col, late).groupBy(F.window(time_col, span).alias("window"), "match_status").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "match_status", "n")
