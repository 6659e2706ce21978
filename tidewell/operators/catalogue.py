"""A catalogue of signal studies as declarations, run together as one grouped plan.

A study says when it is active, what its signal is, and what the signal moves:
the median of a forecast, or its sigma.  Its strength is chosen from a grid on
the validation period and judged on the holdout, both on origins that lie a
horizon apart, so that their targets don't overlap.  All studies, strengths and
horizons are rows of one exploded table; nothing loops over studies.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.operators.metrics import best_of, gaussian_nll

#: Rows of a horizon that count: on validation and on the holdout.
LEAST_VALIDATION, LEAST_HOLDOUT = 10, 3
#: Horizons that must improve for a candidate.
LEAST_HORIZONS = 2
#: Quantile of the normal distribution for a one-sided bound of 95 percent.
BOUND = 1.645
NARROWEST = 0.25


class Study(NamedTuple):
    study: str
    id: str
    #: ``median`` (shift by strength times signal), ``widen`` or ``narrow`` (sigma by 1 + or - strength times signal).
    moves: str
    #: SQL over the features and ``horizon``: when the study is active, and its signal then.
    when: str
    signal: str
    grid: tuple[float, ...]


def _loss(error: Column, sigma: Column) -> Column:
    """Absolute error for a moved median, likelihood loss for a moved sigma."""
    strength = F.col("strength") * F.col("signal")
    scaled = F.when(F.col("moves") == "widen", sigma * (1 + strength)).otherwise(sigma * F.greatest(F.lit(NARROWEST), 1 - strength))
    return F.when(F.col("moves") == "median", F.abs(error - strength)).otherwise(gaussian_nll(error, scaled))


def evaluate(rows: DataFrame, studies: list[Study], validation: tuple[str, str], holdout: str) -> DataFrame:
    """study, id, horizon, strength, n_validation, n_holdout, validation, holdout, bound: the chosen strength, the mean improvements over the unmoved forecast, and the lower bound of the holdout's.

    ``rows`` has an origin's date, horizon, error (log of the target over the
    median), sigma and the columns that the studies name; one row for each origin
    and horizon.  A strength of 0 is taken where validation has too few rows.
    """
    cells = [
        F.when(
            F.expr(s.when),
            F.struct(F.lit(s.study).alias("study"), F.lit(s.id).alias("id"), F.lit(s.moves).alias("moves"), F.expr(s.signal).cast("double").alias("signal"), F.array(*map(F.lit, s.grid)).alias("grid")),
        )
        for s in studies
    ]
    active = rows.select("date", "horizon", "error", "sigma", F.explode(F.filter(F.array(*cells), lambda c: c["signal"].isNotNull())).alias("c")).select("date", "horizon", "error", "sigma", "c.*")
    moved = active.withColumn("strength", F.explode("grid"))
    unmoved = F.when(F.col("moves") == "median", F.abs("error")).otherwise(gaussian_nll(F.col("error"), F.col("sigma")))
    moved = moved.withColumn("gain", unmoved - _loss(F.col("error"), F.col("sigma")))
    day = lambda text: F.lit(text).cast("date")
    early, late = F.col("date").between(day(validation[0]), day(validation[1])), F.col("date") >= day(holdout)
    gain = lambda part: F.when(part, F.col("gain"))
    scored = moved.groupBy("study", "id", "horizon", "strength").agg(
        F.count(gain(early)).alias("n_validation"), F.count(gain(late)).alias("n_holdout"), F.avg(gain(early)).alias("validation"), F.avg(gain(late)).alias("holdout"), F.stddev_samp(gain(late)).alias("_spread")
    )
    known = (F.col("n_validation") >= LEAST_VALIDATION) | (F.col("strength") == 0)
    # gains that are the same to rounding are a tie, which the smaller strength wins
    order = (F.desc(F.floor(F.coalesce("validation", F.lit(0.0)) * 1e9 + 0.5)), F.abs("strength"), F.col("strength"))
    best = best_of(scored.where(known), ["study", "id", "horizon"], *order)
    return best.withColumn("bound", F.col("holdout") - BOUND * F.col("_spread") / F.sqrt("n_holdout")).drop("_spread")


def verdicts(found: DataFrame) -> DataFrame:
    """study, id, n_horizons, n_validation_better, n_holdout_better, verdict."""
    checked, held = F.col("n_validation") >= LEAST_VALIDATION, F.col("n_holdout") >= LEAST_HOLDOUT
    counts = found.groupBy("study", "id").agg(
        F.count_if(checked & held).alias("n_horizons"), F.count_if(checked & (F.col("validation") > 1e-9)).alias("n_validation_better"), F.count_if(held & (F.col("holdout") > 1e-9) & (F.col("bound") > 1e-9)).alias("n_holdout_better"),
        F.max(F.when(held, F.col("holdout"))).alias("_best"),
    )
    both = (F.col("n_validation_better") >= LEAST_HORIZONS) & (F.col("n_holdout_better") >= LEAST_HORIZONS)
    verdict = F.when(F.col("n_horizons") == 0, "needs-more-data").when(both, "candidate").when((F.col("_best") > 1e-9) & (F.col("n_validation_better") >= 1), "context-only").otherwise("reject")
    return counts.withColumn("verdict", verdict).drop("_best")
