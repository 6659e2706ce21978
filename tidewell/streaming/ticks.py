"""Structured Streaming forms: ticks to bars with late repairs, deduplication, sessions and a stateful event filter."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidewell.sources.upsert import read_table, upsert_table

#: Ticks may come this late and still repair their bar.
LATE = "7 days"


def event_stream(spark: SparkSession, path: str, schema) -> DataFrame:
    """Files of ticks as they land; the path may be a pattern.  Watermarks need an instant, so ts is read as UTC."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream.withColumn("ts", F.col("ts").cast("timestamp"))


def deduplicated(ticks: DataFrame, late: str = LATE) -> DataFrame:
    """Each event id once, remembered for as long as it may come late."""
    return ticks.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])


def bars(ticks: DataFrame) -> DataFrame:
    """Daily bars of each event type; the same on a stream and on a table."""
    at = F.struct("ts", "event_id")
    return ticks.groupBy("event_type", F.window("ts", "1 day").alias("day")).agg(
        F.min_by("value", at).alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", at).alias("close"), F.count(F.lit(1)).alias("n")
    ).select(F.col("event_type").alias("asset_id"), F.col("day.start").cast("date").alias("date"), "open", "high", "low", "close", "n")


def sliding_counts(ticks: DataFrame) -> DataFrame:
    return ticks.groupBy("event_type", F.window("ts", "1 day", "6 hours").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(
        "event_type", F.col("w.start").alias("start"), "n", "total"
    )


def session_counts(ticks: DataFrame, gap: str = "30 minutes") -> DataFrame:
    return ticks.groupBy("user_id", F.session_window("ts", gap).alias("w")).agg(F.count(F.lit(1)).alias("n")).select("user_id", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def write_bars(ticks: DataFrame, table: str, checkpoint: str, late: str | None = LATE):
    """Keep a bar table up to date: each micro-batch upserts the bars that it changed, so a replayed batch changes nothing.

    Live ticks count once each and may come ``late``.  Without ``late`` every row
    counts, in whatever order the files hold them: no watermark drops a row, and
    the state keeps all bars (one row for each event type and day).
    """

    def merge(batch: DataFrame, _: int) -> None:
        upsert_table(table, batch, ["asset_id", "date"])

    stream = bars(deduplicated(ticks, late) if late else ticks).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return stream.foreachBatch(merge).trigger(availableNow=True).start()


def stored_bars(spark: SparkSession, table: str) -> DataFrame:
    return read_table(spark, table)


def cooled(ticks: DataFrame, least: float, gap_seconds: int, late: str = "1 hour") -> DataFrame:
    """Ticks of at least ``least`` that come ``gap_seconds`` or more after the last one taken of their user; state is one time a user."""
    schema = "user_id long, event_id long, ts timestamp, value double"

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        for frame in frames:
            keep = []
            for ts, value in zip(frame["ts"], frame["value"], strict=True):
                now = ts.timestamp()
                take = value >= least and (last is None or now - last >= gap_seconds)
                last = now if take else last
                keep.append(take)
            yield frame.loc[keep, ["user_id", "event_id", "ts", "value"]]
        if last is not None:
            state.update((last,))

    return ticks.withWatermark("ts", late).groupBy("user_id").applyInPandasWithState(run, schema, "last double", "append", GroupStateTimeout.NoTimeout)
