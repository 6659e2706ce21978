"""Forecast models: each turns bars with windows into a median and a log sigma for every origin and horizon.

A model is one projection over columns that are computed once for each row, so
all models and horizons of a scoreboard share one pass over the series.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import clamp, lognormal_quantile
from tidewell.operators import windows as w
from tidewell.operators.joins import horizon_rows
from tidewell.operators.metrics import LEVELS

#: Trend per day is held within this.
MOST_DRIFT = 0.006


def model_inputs(bars: DataFrame) -> DataFrame:
    """Bars with ret, drift and volatility columns that the benchmark models read."""
    rows = bars.withColumn("ret", w.log_return("close"))
    return rows.withColumns(
        {
            "vol365": w.deviation("ret", 365, sample=False),
            "vol90": w.deviation("ret", 90, sample=False),
            "mean90": w.full(F.avg("ret").over(w.trailing(90)), F.col("ret"), w.trailing(90), 90),
            "sma20": w.sma("close", 20),
            "sma50": w.sma("close", 50),
            "sma200": w.sma("close", 200),
        }
    )


def benchmark_models() -> dict[str, tuple[Column, Column]]:
    """Median and log sigma of each model, given columns of model_inputs and horizon."""
    h = F.col("horizon")
    root = F.sqrt(h.cast("double"))
    slope = (F.ln(F.col("sma20") / F.col("sma50")) / 30 + F.ln(F.col("sma50") / F.col("sma200")) / 150) / 2
    trend = F.when(slope.isNotNull(), clamp(slope, -MOST_DRIFT, MOST_DRIFT))  # greatest and least skip nulls
    return {
        "naive": (F.col("close"), F.col("vol90") * root),
        "gbm-driftless": (F.col("close"), F.col("vol365") * root),
        "gbm-drift": (F.col("close") * F.exp(F.col("mean90") * h), F.col("vol90") * root),
        "ma-trend": (F.col("close") * F.exp(trend * h), F.col("vol90") * root),
    }


def forecasts(bars: DataFrame, horizons: list[int], models: dict[str, tuple[Column, Column]] | None = None, contiguous: bool = False) -> DataFrame:
    """Long table of forecasts: asset_id, date, horizon, target_date, actual, model, median, sigma; rows with both only."""
    rows = horizon_rows(model_inputs(bars), horizons, contiguous)
    packed = [F.struct(F.lit(name).alias("model"), median.alias("median"), sigma.alias("sigma")) for name, (median, sigma) in (models or benchmark_models()).items()]
    long = rows.withColumn("_all", F.array(*packed)).withColumn("_m", F.explode("_all"))
    return long.select("asset_id", "date", "horizon", "target_date", "actual", "_m.*").where("median > 0 AND sigma > 0")


def with_quantiles(rows: DataFrame) -> DataFrame:
    """The lognormal quantiles of LEVELS."""
    return rows.withColumns({name: lognormal_quantile(F.col("median"), F.col("sigma"), p) for name, p in LEVELS.items()})


def log_error(actual: str = "actual", median: str = "median") -> Column:
    return F.when((F.col(actual) > 0) & (F.col(median) > 0), F.ln(F.col(actual) / F.col(median)))


#: The day from which the power law counts, and its coefficients.
GENESIS = "1990-01-01"
BASE_LAW = (-10.0, 2.75)
FLOOR_LAWS = ((-10.6, 2.75), (-10.9, 2.8))
PEAK_LAW = (-8.6, 2.62)


def power_law(days: Column, law: tuple[float, float] = BASE_LAW) -> Column:
    """exp(a + b ln days), null before the first day."""
    return F.when(days > 0, F.exp(law[0] + law[1] * F.ln(days.cast("double"))))


def floor_price(days: Column) -> Column:
    return F.least(*(power_law(days, law) for law in FLOOR_LAWS))


def mean_reverting(price: Column, days: Column, horizon: Column, tau: float) -> Column:
    """The law at the target times the log distance of the price from it, which decays over tau days."""
    distance = F.ln(price / power_law(days))
    return power_law(days + horizon) * F.exp(distance * F.exp(-horizon / F.lit(tau)))


def residual_variance(sigma: Column, decay: float, horizon: Column) -> Column:
    """sigma^2 times the sum of decay^(2i) over the horizon."""
    return sigma * sigma * (1 - F.pow(F.lit(decay), 2 * horizon)) / (1 - decay * decay)
