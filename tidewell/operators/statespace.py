"""State space of a level (random walk) and a fading residual (AR(1)), seen with noise.

y = level + residual + noise.  A step predicts (the residual shrinks by
``persistence``, the covariance grows by the process variances) and, where there
is an observation, updates by the Kalman gain; a gap only predicts.
"""

from __future__ import annotations

from math import log, pi
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType


class Parameters(NamedTuple):
    level: float
    residual: float
    noise: float
    persistence: float


#: Variances of the level's and the residual's steps and of the noise, and the residual's persistence.
GRID = (Parameters(1e-6, 2.5e-5, 1e-5, 0.85), Parameters(4e-6, 5e-5, 2.5e-5, 0.9), Parameters(1e-5, 1e-4, 5e-5, 0.95))
#: Variance of the first level, and the least variance of an innovation.
FIRST_VARIANCE = 0.01
LEAST_VARIANCE = 1e-15


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _step(p: Parameters, s: Column, y: Column) -> Column:
    """The accumulator after one more day."""
    phi = p.persistence
    ahead = F.struct(
        s["level"].alias("level"), (s["residual"] * phi).alias("residual"), (s["p00"] + p.level).alias("p00"), (s["p01"] * phi).alias("p01"), (s["p11"] * phi * phi + p.residual).alias("p11"),
        F.greatest(F.lit(LEAST_VARIANCE), s["p00"] + p.level + 2 * s["p01"] * phi + s["p11"] * phi * phi + p.residual + p.noise).alias("v"), (y - s["level"] - s["residual"] * phi).alias("e"),
    )

    def update(a: Column) -> Column:
        k0, k1 = (a["p00"] + a["p01"]) / a["v"], (a["p01"] + a["p11"]) / a["v"]
        cross = ((a["p01"] - k0 * (a["p01"] + a["p11"])) + (a["p01"] - k1 * (a["p00"] + a["p01"]))) / 2
        seen = y.isNotNull()
        return F.struct(
            F.when(seen, a["level"] + k0 * a["e"]).otherwise(a["level"]).alias("level"),
            F.when(seen, a["residual"] + k1 * a["e"]).otherwise(a["residual"]).alias("residual"),
            F.when(seen, a["p00"] - k0 * (a["p00"] + a["p01"])).otherwise(a["p00"]).alias("p00"),
            F.when(seen, cross).otherwise(a["p01"]).alias("p01"),
            F.when(seen, a["p11"] - k1 * (a["p01"] + a["p11"])).otherwise(a["p11"]).alias("p11"),
            F.when(seen, s["log_likelihood"] - 0.5 * (log(2 * pi) + F.ln(a["v"]) + a["e"] * a["e"] / a["v"])).otherwise(s["log_likelihood"]).alias("log_likelihood"),
            F.when(seen, s["squares"] + a["e"] * a["e"] / a["v"]).otherwise(s["squares"]).alias("squares"),
            (s["n"] + seen.cast("long")).alias("n"),
            (s["missing"] + (~seen).cast("long")).alias("missing"),
        )

    return _let(ahead, update)


def fit_grid(rows: DataFrame, y: str, grid: tuple[Parameters, ...] = GRID) -> DataFrame:
    """A row for each asset and entry of the grid: grid (from 0), level, residual, p00, p01, p11, log_likelihood, squares (mean square of the standardised innovations), n, missing.

    The days of an asset (asset_id, date; null ``y`` is a gap) are put in one
    ordered array, which is bounded by the calendar, and folded in the JVM.
    """
    listed = F.transform(F.array_sort(F.collect_list(F.struct("date", F.col(y).alias("y")))), lambda x: x["y"])
    series = rows.groupBy("asset_id").agg(listed.alias("ys"))
    series = series.withColumn("first", F.coalesce(F.get(F.filter("ys", lambda v: v.isNotNull()), F.lit(0)), F.lit(0.0)))
    found = []
    for number, p in enumerate(grid):
        start = F.struct(
            F.col("first").alias("level"), F.lit(0.0).alias("residual"), F.lit(FIRST_VARIANCE).alias("p00"), F.lit(0.0).alias("p01"), F.lit(p.residual / (1 - p.persistence**2)).alias("p11"),
            F.lit(0.0).alias("log_likelihood"), F.lit(0.0).alias("squares"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("missing"),
        )
        folded = F.aggregate("ys", start, _folder(p))
        found.append(F.struct(F.lit(number).alias("grid"), F.lit(p.persistence).alias("persistence"), F.lit(p.level).alias("q0"), F.lit(p.residual).alias("q1"), folded.alias("s")))
    long = series.select("asset_id", F.explode(F.array(*found)).alias("f"))
    flat = long.select("asset_id", "f.grid", "f.persistence", "f.q0", "f.q1", "f.s.*")
    return flat.withColumn("squares", F.col("squares") / F.nullif(F.col("n"), F.lit(0)))


def _folder(p: Parameters):
    return lambda s, v: _step(p, s, v)


def forecast(fits: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """Fits with horizon, mean and variance of what is ``horizon`` days after the last one (without noise)."""
    h = F.explode(F.array(*map(F.lit, horizons))).alias("horizon")
    rows = fits.select("*", h)
    fade = F.pow("persistence", "horizon")
    grown = F.col("q1") * (1 - fade * fade) / (1 - F.col("persistence") * F.col("persistence"))
    variance = F.col("p00") + F.col("q0") * F.col("horizon") + 2 * F.col("p01") * fade + F.col("p11") * fade * fade + grown
    return rows.withColumns({"mean": F.col("level") + F.col("residual") * fade, "variance": F.greatest(F.lit(0.0), variance)})


def gains(n: int, p: Parameters) -> np.ndarray:
    """Gains of the first n days of a series without gaps: they don't depend on what is observed."""
    out = np.empty((n, 2))
    phi, p00, p01, p11 = p.persistence, FIRST_VARIANCE, 0.0, p.residual / (1 - p.persistence**2)
    for i in range(n):
        p00, p01, p11 = p00 + p.level, p01 * phi, p11 * phi * phi + p.residual
        k0, k1 = out[i] = np.array([p00 + p01, p01 + p11]) / max(LEAST_VARIANCE, p00 + 2 * p01 + p11 + p.noise)
        cross = ((p01 - k0 * (p01 + p11)) + (p01 - k1 * (p00 + p01))) / 2
        p00, p01, p11 = p00 - k0 * (p00 + p01), cross, p11 - k1 * (p01 + p11)
    return out


def linear_states(rows: DataFrame, columns: list[str], to: str, grid: tuple[Parameters, ...] = GRID) -> DataFrame:
    """Rows with ``to``: an array with level and residual of each column's filter, for each entry of the grid.

    The filter of a sum of series is the sum of their filters, so the states of
    any linear combination of the columns follow from these.  A group is one
    asset's days, without gaps.
    """
    schema = StructType([f for f in rows.schema.fields if f.name not in columns or f.name == "y"]).add(to, ArrayType(DoubleType()))

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values("date", kind="stable").reset_index(drop=True)
        seen = ordered[columns].to_numpy(float)
        states = np.empty((len(seen), len(grid), len(columns), 2))
        for g, p in enumerate(grid):
            level, residual = seen[0].copy() if len(seen) else np.zeros(len(columns)), np.zeros(len(columns))
            for i, (k0, k1) in enumerate(gains(len(seen), p)):
                residual = residual * p.persistence
                e = seen[i] - level - residual
                level, residual = level + k0 * e, residual + k1 * e
                states[i, g, :, 0], states[i, g, :, 1] = level, residual
        ordered[to] = list(states.reshape(len(seen), -1))
        return ordered[schema.names]

    return rows.groupBy("asset_id").applyInPandas(run, schema)
