"""Generic signal studies: a signal adjusts a baseline forecast, tuned before a date and scored after it.

Rows carry close (the baseline median), actual and, for sigma studies, sigma.
The grid is a small array, exploded beside each row and aggregated at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import clamp
from tidewell.operators.metrics import best_of, gaussian_nll


def _split(loss: Column, holdout: str) -> list[Column]:
    late = F.col("date") >= F.lit(holdout).cast("date")
    return [F.avg(F.when(~late, loss)).alias("validation"), F.avg(F.when(late, loss)).alias("holdout"), F.count(F.lit(1)).alias("n")]


def median_shift(rows: DataFrame, signal: Column, grid: list[float], holdout: str, most: float = 4.0) -> DataFrame:
    """The coefficient of the signal with the least absolute log error on validation, the smaller one on a tie."""
    shifted = rows.select("date", "close", "actual", clamp(signal, -most, most).alias("signal"), F.explode(F.array(*map(F.lit, grid))).alias("coefficient"))
    loss = F.abs(F.ln(F.col("actual") / (F.col("close") * F.exp(F.col("coefficient") * F.col("signal")))))
    scored = shifted.groupBy("coefficient").agg(*_split(loss, holdout)).withColumn("study", F.lit(1))
    return best_of(scored, ["study"], F.col("validation"), F.abs("coefficient"), F.col("coefficient")).drop("study")


def sigma_scale(rows: DataFrame, signal: Column, grid: list[float], holdout: str, most: float = 4.0) -> DataFrame:
    """The scale with which the signal widens sigma at the least likelihood loss on validation."""
    wide = rows.select("date", "close", "actual", "sigma", F.least(F.lit(most), signal).alias("signal"), F.explode(F.array(*map(F.lit, grid))).alias("scale"))
    loss = gaussian_nll(F.ln(F.col("actual") / F.col("close")), F.col("sigma") * (1 + F.col("scale") * F.col("signal")))
    scored = wide.groupBy("scale").agg(*_split(loss, holdout)).withColumn("study", F.lit(1))
    return best_of(scored, ["study"], F.col("validation"), F.col("scale")).drop("study")
