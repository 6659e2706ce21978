"""Choosing features with enough complete rows, and the primary one of a family of traces."""

from __future__ import annotations

from math import exp, log

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import finite
from tidewell.operators import scans

#: Features of a model at most, and complete rows at least.
MOST_FEATURES = 24
LEAST_ROWS = 730


def select_features(pool: DataFrame, asked: DataFrame, keys: list[str], names: list[str], most: int = MOST_FEATURES, least: int = LEAST_ROWS) -> DataFrame:
    """keys, rank, feature, n, variance, n_complete, chosen: features in order of rows and variance, and how many of the first ones a model may take.

    ``pool`` has the training rows and ``asked`` the one evaluation row of each
    group of keys; null, NaN and infinite values are missing.  A candidate has a
    value on the evaluation row, ``least`` training rows and some variance.  The
    first k features are complete on a row if its first missing one comes later:
    rows are counted once by the rank of their first missing feature, and sums of
    those counts give the complete rows of every k.  Chosen is the largest k with
    ``least`` complete rows.
    """
    values = F.array(*(F.struct(F.lit(n).alias("feature"), finite(F.col(n).cast("double")).alias("value")) for n in names))
    long = lambda rows: rows.select(*keys, F.explode(values).alias("v")).select(*keys, "v.*").where("value IS NOT NULL")
    stats = long(pool).groupBy(*keys, "feature").agg(F.count("value").alias("n"), F.var_samp("value").alias("variance"))
    usable = stats.join(long(asked).select(*keys, "feature"), [*keys, "feature"], "left_semi").where((F.col("n") >= least) & (F.col("variance") > 0))
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), F.desc("variance"), "feature"))
    ranked = usable.withColumn("rank", place).where(F.col("rank") <= most)

    order = ranked.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "feature"))), lambda x: x["feature"]).alias("order"))  # at most ``most`` names
    by_name = F.map_from_arrays(F.array(*map(F.lit, names)), F.array(*(finite(F.col(n).cast("double")) for n in names)))
    gaps = pool.join(order, keys).withColumn("_values", by_name).withColumn("first_missing", F.array_position(F.transform("order", lambda n: F.col("_values")[n].isNull()), True))
    counted = gaps.groupBy(*keys, "first_missing").agg(F.count(F.lit(1)).alias("rows"))  # most + 1 rows for each group
    complete = F.sum(F.when((F.col("first_missing") == 0) | (F.col("first_missing") > F.col("rank")), F.col("rows")).otherwise(0))
    nested = ranked.join(counted, keys).groupBy(*keys, "rank", "feature", "n", "variance").agg(complete.alias("n_complete"))
    taken = F.max(F.when(F.col("n_complete") >= least, F.col("rank"))).over(Window.partitionBy(*keys))
    return nested.withColumn("chosen", F.coalesce(F.col("rank") <= taken, F.lit(False)))


#: Days over which traces are compared.
SELECTION_DAYS = 14
BREACH_WEIGHT, FIRST_WEIGHT, LAST_WEIGHT = 0.2, 0.8, 0.25
#: A trace keeps this much above its floor, and rebounds by at most BOUNCE.
BUFFER, BOUNCE, RECOVERY = 1.002, 1.04, 0.35


def trace_scores(traces: DataFrame, keys: list[str], days: int = SELECTION_DAYS) -> DataFrame:
    """keys, trace, distance, breach_rate, first, last, score: how far each trace runs from the reference over the first days, and how often below its floor.

    ``traces`` has keys, trace, day, price, reference and floor; rows without all three prices don't count.
    """
    rows = traces.where((F.col("day") <= days) & (F.col("price") > 0) & (F.col("reference") > 0) & F.col("floor").isNotNull())
    rows = rows.withColumn("away", F.abs(F.ln(F.col("price") / F.col("reference"))))
    found = rows.groupBy(*keys, "trace").agg(
        F.avg("away").alias("distance"), F.avg((F.col("price") < F.col("floor")).cast("int")).alias("breach_rate"), F.min_by("away", "day").alias("first"), F.max_by("away", "day").alias("last")
    )
    return found.withColumn("score", F.col("distance") + BREACH_WEIGHT * F.col("breach_rate") + FIRST_WEIGHT * F.col("first") + LAST_WEIGHT * F.col("last"))


def lifted(price: float, floor: float) -> float:
    """The price, or a rebound from its floor where it comes too near; the deeper it fell, the higher the rebound, up to BOUNCE."""
    if np.isnan(floor) or floor <= 0 or price >= floor * BUFFER:
        return price
    return floor * exp(min(log(BOUNCE), log(BUFFER) + RECOVERY * max(0.0, log(floor / price))))


def above_floor(trace: DataFrame, keys: list[str], start: Column) -> DataFrame:
    """The rows of one trace of each group, in order of day, with ``projected``: the trace's returns, carried on from where its floor lifted it.

    ``start`` is the price before the first day; a day without a price keeps the last one.
    """

    def step(group: pd.DataFrame) -> dict[str, np.ndarray]:
        raw = projected = float(group["_start"].iloc[0])
        out = np.empty(len(group))
        for i, (price, floor) in enumerate(zip(group["price"].to_numpy(float), group["floor"].to_numpy(float), strict=True)):
            known = np.isfinite(price) and price > 0 and raw > 0
            projected = out[i] = lifted(projected * (price / raw if known else 1.0), floor)
            raw = price if np.isfinite(price) and price > 0 else raw
        return {"projected": out}

    return scans.scan(trace.withColumn("_start", start), keys, ["day"], step, "projected double").drop("_start")
