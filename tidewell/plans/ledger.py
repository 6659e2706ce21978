"""An append-only ledger of forecasts: each row's hash covers its payload and the hash before it."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewell.operators.scans import scan

ORIGIN = "0" * 64


def append_ledger(entries: DataFrame, previous: str = ORIGIN) -> DataFrame:
    """Entries (date, payload) in order of date, chained after ``previous``."""

    def step(group: pd.DataFrame) -> dict:
        before, hashes, last = [], [], previous
        for payload in group["payload"]:
            before.append(last)
            last = hashlib.sha256(f"{last}\n{payload}".encode()).hexdigest()
            hashes.append(last)
        return {"previous_hash": before, "row_hash": hashes}

    chained = scan(entries.withColumn("ledger", F.lit("one")), ["ledger"], ["date"], step, "previous_hash string, row_hash string")
    return chained.drop("ledger")


def broken_links(ledger: DataFrame) -> DataFrame:
    """n rows, and how many don't follow from the row before or from their own payload."""
    order = Window.partitionBy(F.lit(1)).orderBy("date")
    before = F.coalesce(F.lag("row_hash").over(order), F.lit(ORIGIN))
    own = F.sha2(F.concat_ws("\n", "previous_hash", "payload"), 256)
    checked = ledger.withColumn("bad", (F.col("previous_hash") != before) | (F.col("row_hash") != own))
    return checked.agg(F.count(F.lit(1)).alias("n"), F.count_if("bad").alias("broken"))


def not_appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of the old ledger that the new one lacks or has changed: an append-only change leaves none."""
    return old.select("date", "row_hash").join(new.select("date", "row_hash"), ["date", "row_hash"], "left_anti")
