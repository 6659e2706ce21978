"""Simulation, resampling and small linear fits.

Work is spread over iterations, paths or fits, not over the one series that all
of them read: a series is a few thousand days, shipped once to each task.
Random streams depend on the seed and the number of the path or iteration
alone, so results don't change with partitions, retries or the number of paths.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Days of one series that are shipped to tasks, at most.
MOST_DAYS = 50_000


def series(rows: DataFrame, column: str) -> np.ndarray:
    """One asset's values in order of date."""
    found = [r[0] for r in rows.where(F.col(column).isNotNull()).orderBy("date").select(column).limit(MOST_DAYS + 1).collect()]
    if len(found) > MOST_DAYS:
        raise ValueError(f"a series of more than {MOST_DAYS} days")
    return np.array(found, float)


def stream(seed: int, number: int) -> np.random.Generator:
    return np.random.default_rng([seed, number])


def per_number(spark: SparkSession, n: int, f: Callable[[int], dict], schema: str, slices: int = 32) -> DataFrame:
    """One or more rows for each number from 0 to n - 1; f returns columns."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for number in frame["id"]:
                yield pd.DataFrame(f(int(number)))

    return spark.range(0, n, 1, min(slices, n)).mapInPandas(run, schema)


def block_sample(values: np.ndarray, size: int, block: int, rng: np.random.Generator, circular: bool = True) -> np.ndarray:
    """Values of consecutive blocks that start anywhere (circular) or where a whole block fits."""
    starts = rng.integers(0, len(values) if circular else max(1, len(values) - block + 1), -(-size // block))
    at = (starts[:, None] + np.arange(block)).ravel()[:size]
    return values[at % len(values)]


def bootstrap_means(spark: SparkSession, values: np.ndarray, block: int, iterations: int, seed: int, circular: bool = True) -> DataFrame:
    """iteration, mean: the mean of a block sample of the values' length."""
    return per_number(
        spark, iterations, lambda i: {"iteration": [i], "mean": [float(block_sample(values, len(values), block, stream(seed, i), circular).mean())]}, "iteration long, mean double"
    )


def lower_bound(means: DataFrame, share: float = 0.05) -> DataFrame:
    """The mean at floor(n * share) in ascending order."""
    n = F.count(F.lit(1)).over(Window.partitionBy())
    placed = means.withColumn("place", F.row_number().over(Window.orderBy("mean", "iteration")) - 1).withColumn("n", n)
    return placed.where(F.col("place") == F.floor(F.col("n") * share)).select(F.col("mean").alias("bound"))


def paths(spark: SparkSession, start: float, returns: np.ndarray, days: int, n: int, seed: int, block: int = 10, decay: float = 1.0, target: np.ndarray | None = None) -> DataFrame:
    """path, day, price: log distances from a target line follow r <- r * decay + a block-sampled return."""
    line = np.full(days + 1, np.log(start)) if target is None else np.log(target)

    def one(number: int) -> dict:
        shocks = block_sample(returns - returns.mean(), days, block, stream(seed, number))
        distance, out = np.log(start) - line[0], np.empty(days)
        for d in range(days):
            distance = distance * decay + shocks[d]
            out[d] = line[d + 1] + distance
        return {"path": np.full(days, number), "day": np.arange(1, days + 1), "price": np.exp(out)}

    return per_number(spark, n, one, "path long, day long, price double")


def heatmap(simulated: DataFrame, bands: int = 40, low: float = 0.005, high: float = 0.995) -> DataFrame:
    """day, band, density: shares of paths in log-price bands, over the largest share of the day."""
    logs = simulated.withColumn("x", F.ln("price"))
    ends = logs.groupBy("day").agg(F.percentile("x", F.lit(low)).alias("lo"), F.percentile("x", F.lit(high)).alias("hi"))
    band = F.floor((F.col("x") - F.col("lo")) / F.nullif(F.col("hi") - F.col("lo"), F.lit(0.0)) * bands).cast("int")
    held = logs.join(F.broadcast(ends), "day").where("x >= lo AND x <= hi").withColumn("band", F.least(band, F.lit(bands - 1)))  # ends: a row for each simulated day
    counted = held.groupBy("day", "band").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("density", F.col("n") / F.max("n").over(Window.partitionBy("day")))


def path_drawdowns(simulated: DataFrame) -> DataFrame:
    """path, drawdown: the largest fall from a peak."""
    along = Window.partitionBy("path").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return simulated.withColumn("fall", F.col("price") / F.max("price").over(along) - 1).groupBy("path").agg(F.min("fall").alias("drawdown"))


def circular_shift_p(events: DataFrame, rows: DataFrame, n: int) -> DataFrame:
    """Share of circular shifts of the events whose mean is at least the observed one.

    rows: idx from 0 to n - 1 and value; events: idx and side.  Exact over all n
    shifts: each event meets each shift once, so the work is events times days.
    """
    shifts = rows.sparkSession.range(n).withColumnRenamed("id", "shift")
    moved = events.crossJoin(F.broadcast(shifts)).select("shift", "side", ((F.col("idx") + F.col("shift")) % n).alias("idx"))  # shifts: a row for each day
    means = moved.join(rows, "idx").groupBy("shift").agg(F.avg(F.col("side") * F.col("value")).alias("mean"))
    observed = F.max(F.when(F.col("shift") == 0, F.col("mean")))
    held = means.withColumn("observed", observed.over(Window.partitionBy()))
    return held.agg(F.max("observed").alias("observed"), (F.count_if(F.col("mean") >= F.col("observed") - 1e-12) / F.count(F.lit(1))).alias("p"))


def gram_rows(rows: DataFrame, columns: list[str], target: str, order: Window) -> DataFrame:
    """Running sums of products of columns and target over the rows before each one: all refits in one pass."""
    sums = {}
    for i, a in enumerate(columns):
        for b in columns[i:]:
            sums[f"g_{a}_{b}"] = F.sum(F.col(a) * F.col(b)).over(order)
        sums[f"t_{a}"] = F.sum(F.col(a) * F.col(target)).over(order)
    return rows.withColumns(sums)


def solve_grams(rows: DataFrame, columns: list[str], ridge: float = 0.0) -> DataFrame:
    """Adds coefficients (an array) that solve each row's normal equations; null where they can't be solved."""
    schema = rows.schema
    names = rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(columns)
        for frame in frames:
            grams = np.zeros((len(frame), k, k))
            right = np.zeros((len(frame), k))
            for i, a in enumerate(columns):
                for j in range(i, k):
                    grams[:, i, j] = grams[:, j, i] = frame[f"g_{a}_{columns[j]}"].fillna(0)
                right[:, i] = frame[f"t_{a}"].fillna(0)
            grams[:, range(1, k), range(1, k)] += ridge  # the first column is the intercept
            out = []
            for g, t in zip(grams, right, strict=True):
                try:
                    out.append(np.linalg.solve(g, t).tolist())
                except np.linalg.LinAlgError:
                    out.append(None)
            yield frame.assign(coefficients=out)

    from pyspark.sql.types import ArrayType, DoubleType, StructField, StructType

    return rows.mapInPandas(run, StructType([*(schema[n] for n in names), StructField("coefficients", ArrayType(DoubleType()))]))
