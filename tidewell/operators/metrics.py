"""Scores of forecasts and tests: all native aggregates over a long table of forecasts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import normal_cdf

#: Probability levels of a forecast's quantile columns.
LEVELS = {"q025": 0.025, "q05": 0.05, "q10": 0.10, "q25": 0.25, "q50": 0.50, "q75": 0.75, "q90": 0.90, "q95": 0.95, "q975": 0.975}


def pinball(actual: Column, quantile: Column, p: float) -> Column:
    return F.greatest(p * (actual - quantile), (p - 1) * (actual - quantile))


def coverage(actual: Column, low: Column, high: Column) -> Column:
    """Share of actuals within both bounds, of the rows that have them."""
    return F.avg(actual.between(low, high).cast("double"))


def winkler(actual: Column, low: Column, high: Column, alpha: float) -> Column:
    return (high - low) + F.lit(2 / alpha) * (F.greatest(low - actual, F.lit(0.0)) + F.greatest(actual - high, F.lit(0.0)))


def gaussian_nll(error: Column, sigma: Column) -> Column:
    """Negative log likelihood of a log error."""
    return F.when(sigma > 0, 0.5 * F.log(F.lit(6.283185307179586)) + F.log(sigma) + error * error / (2 * sigma * sigma))


def crps_from_quantiles(actual: Column, quantiles: dict[str, float] | None = None) -> Column:
    """Twice the integral of the pinball loss over levels: trapezoids between levels, the end losses held out to 0 and 1; null below three quantiles."""
    levels = list((quantiles or LEVELS).items())
    losses = [(p, pinball(actual, F.col(c), p)) for c, p in levels]
    inner = [(b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(losses, losses[1:], strict=False)]
    ends = [losses[0][0] * losses[0][1], (1 - losses[-1][0]) * losses[-1][1]]
    return 2 * reduce(lambda x, y: x + y, inner + ends) if len(levels) >= 3 else F.lit(None).cast("double")


def scoreboard(forecasts: DataFrame, keys: list[str]) -> DataFrame:
    """Errors of the medians by ``keys``; forecasts have median and actual."""
    error = F.ln(F.col("actual") / F.col("median"))
    usable = forecasts.where((F.col("actual") > 0) & (F.col("median") > 0)).withColumn("error", error)
    return usable.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile(F.abs("error"), F.lit(0.5)).alias("median_abs_log_error"),
        F.avg(F.abs("error")).alias("mean_abs_log_error"),
        (F.exp(F.percentile(F.abs("error"), F.lit(0.5))) - 1).alias("typical_relative_error"),
        F.avg("error").alias("bias"),
    )


def pit_histogram(values: DataFrame, keys: list[str], bins: int = 10) -> DataFrame:
    """Counts of PIT values in equal bins, empty ones included, with each group's chi-square."""
    binned = values.where("pit IS NOT NULL").groupBy(*keys, F.least(F.floor(F.col("pit") * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    spine = binned.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    whole = spine.join(binned, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    group = Window.partitionBy(*keys)
    expected = F.sum("n").over(group) / bins
    chi = F.sum((F.col("n") - F.col("expected")) * (F.col("n") - F.col("expected")) / F.col("expected")).over(group)
    return whole.withColumn("expected", expected).withColumn("chi2", chi)


def two_sided_p(z: Column) -> Column:
    return 2 * (1 - normal_cdf(F.abs(z)))


def welch(rows: DataFrame, keys: list[str], flag: str, value: str) -> DataFrame:
    """Difference of means between flagged and other rows, z and p by the normal approximation."""
    one, two = F.when(F.col(flag), F.col(value)), F.when(~F.col(flag), F.col(value))
    sums = rows.groupBy(*keys).agg(
        F.count(one).alias("n1"), F.count(two).alias("n2"), F.avg(one).alias("m1"), F.avg(two).alias("m2"), F.var_samp(one).alias("v1"), F.var_samp(two).alias("v2")
    )
    error = F.sqrt(F.col("v1") / F.col("n1") + F.col("v2") / F.col("n2"))
    z = F.when((F.col("n1") > 1) & (F.col("n2") > 1) & (error > 0), (F.col("m1") - F.col("m2")) / error)
    return sums.withColumn("difference", F.col("m1") - F.col("m2")).withColumn("z", z).withColumn("p", two_sided_p(F.col("z")))


def holm(rows: DataFrame, keys: list[str], p: str, tie: str) -> DataFrame:
    """Step-down adjusted p values of each family."""
    order = Window.partitionBy(*keys).orderBy(p, tie)
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    raw = F.least(F.lit(1.0), F.col(p) * (n - F.row_number().over(order) + 1))
    return rows.withColumn("_raw", raw).withColumn("p_holm", F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("_raw")


def best_of(rows: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """First row of each group; every order ends in a unique column."""
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_place = 1").drop("_place")


def correlation(a: str, b: str, least: int = 3) -> Column:
    """Pearson's, null for fewer than ``least`` pairs or a constant side."""
    both = F.col(a).isNotNull() & F.col(b).isNotNull()
    x, y = F.when(both, F.col(a)), F.when(both, F.col(b))
    return F.when(F.count(x) >= least, F.covar_pop(x, y) / F.nullif(F.stddev_pop(x) * F.stddev_pop(y), F.lit(0.0)))
