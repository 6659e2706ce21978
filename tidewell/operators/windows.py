"""Window operators over series: rows of an asset in order of date.

Every function takes and returns Columns; a result is null until its window is
full.  ``trailing`` includes the current row, ``prior`` stops before it.
"""

from __future__ import annotations

from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

from tidewell.functions.scalars import finite, log_ratio

def series() -> WindowSpec:
    return Window.partitionBy("asset_id").orderBy("date")


def trailing(n: int) -> WindowSpec:
    return series().rowsBetween(-(n - 1), 0)


def prior(n: int) -> WindowSpec:
    return series().rowsBetween(-n, -1)


def expanding() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, 0)


def all_prior() -> WindowSpec:
    return series().rowsBetween(Window.unboundedPreceding, -1)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def full(value: Column, counted: Column, frame: WindowSpec, least: int) -> Column:
    """The value where the frame holds at least so many values."""
    return F.when(F.count(counted).over(frame) >= least, value)


def sma(c: Column | str, n: int) -> Column:
    return full(F.avg(col(c)).over(trailing(n)), col(c), trailing(n), n)


def log_return(c: Column | str, k: int = 1) -> Column:
    return log_ratio(col(c), F.lag(col(c), k).over(series()))


def deviation(c: Column | str, n: int, sample: bool = True) -> Column:
    spread = (F.stddev_samp if sample else F.stddev_pop)(col(c)).over(trailing(n))
    return full(spread, col(c), trailing(n), n)


def rolling_sum(c: Column | str, n: int, share: float = 0.8) -> Column:
    """Sum of the last n rows where at least that share of them has a value."""
    return F.when(F.count(col(c)).over(trailing(n)) >= share * n, F.sum(col(c)).over(trailing(n)))


def change(c: Column | str, k: int) -> Column:
    before = F.lag(col(c), k).over(series())
    return F.when(before != 0, col(c) / before - 1)


def drawdown(c: Column | str) -> Column:
    """Change from the highest value so far."""
    return col(c) / F.max(col(c)).over(expanding()) - 1


def rebound(c: Column | str, n: int) -> Column:
    """Change from the lowest value of the last n rows."""
    return full(col(c) / F.min(col(c)).over(trailing(n)) - 1, col(c), trailing(n), n)


def zscore_prior(c: Column | str, n: int, least: int) -> Column:
    """Distance from the mean of the rows before, in their population deviations."""
    spread = F.stddev_pop(col(c)).over(prior(n))
    z = (col(c) - F.avg(col(c)).over(prior(n))) / F.nullif(spread, F.lit(0.0))
    return full(z, col(c), prior(n), least)


def zscore_expanding(c: Column | str, least: int) -> Column:
    """Distance from the mean of all rows up to this one."""
    spread = F.stddev_pop(col(c)).over(expanding())
    z = (col(c) - F.avg(col(c)).over(expanding())) / F.nullif(spread, F.lit(0.0))
    return full(z, col(c), expanding(), least)


def bollinger(c: Column | str, n: int = 20, width: float = 2.0) -> dict[str, Column]:
    middle, spread = sma(c, n), deviation(c, n, sample=False)
    return {"middle": middle, "upper": middle + width * spread, "lower": middle - width * spread}


def stochastic_k(high: str, low: str, close: str, n: int = 14) -> Column:
    top, bottom = F.max(high).over(trailing(n)), F.min(low).over(trailing(n))
    k = 100 * (col(close) - bottom) / F.nullif(top - bottom, F.lit(0.0))
    return full(k, col(close), trailing(n), n)


def strict_cross(left: Column, right: Column) -> Column:
    """1 where left rises through right, -1 where it falls through, else 0; 0 where a value is missing."""
    now, before = left - right, F.lag(left - right).over(series())
    return F.coalesce(F.when((before <= 0) & (now > 0), 1).when((before >= 0) & (now < 0), -1), F.lit(0))


def band_state(left: Column, right: Column, band: float) -> Column:
    """1 above the band around right, -1 below it, null inside."""
    return F.when(left > right * (1 + band), 1).when(left < right * (1 - band), -1)


def hysteresis_cross(state: Column) -> Column:
    """The side that is entered where the last side outside the band was the other one, else 0."""
    held = F.last(state, ignorenulls=True).over(all_prior())
    return F.coalesce(F.when(state != held, state), F.lit(0))


def relative_volume(volume: str, n: int = 90) -> Column:
    """log1p of volume over the median of the positive volumes of the last n rows; 0 where that is missing."""
    usual = F.percentile(F.when(col(volume) > 0, col(volume)), F.lit(0.5)).over(trailing(n))
    return F.coalesce(F.when((col(volume) > 0) & (usual > 0), F.log1p(col(volume) / usual)), F.lit(0.0))


def correlation(a: str, b: str, frame: WindowSpec) -> Column:
    """0 where a side is constant."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a)), F.when(both, col(b))
    bottom = F.stddev_pop(x).over(frame) * F.stddev_pop(y).over(frame)
    return F.coalesce(F.covar_pop(x, y).over(frame) / F.nullif(bottom, F.lit(0.0)), F.lit(0.0))


def beta(a: str, b: str, frame: WindowSpec) -> Column:
    """Slope of a on b; 0 where b is constant."""
    both = col(a).isNotNull() & col(b).isNotNull()
    x, y = F.when(both, col(a)), F.when(both, col(b))
    return F.coalesce(F.covar_pop(x, y).over(frame) / F.nullif(F.var_pop(y).over(frame), F.lit(0.0)), F.lit(0.0))


def skew_adjusted(c: Column | str, n: int) -> Column:
    """Adjusted Fisher-Pearson skewness of the last n rows, from raw moments."""
    f, x = trailing(n), col(c)
    m1, m2, m3 = (F.avg(F.pow(x, F.lit(float(p)))).over(f) for p in (1, 2, 3))
    var = m2 - m1 * m1
    g1 = (m3 - 3 * m1 * m2 + 2 * m1 * m1 * m1) / F.nullif(F.pow(var, F.lit(1.5)), F.lit(0.0))
    factor = (n * (n - 1)) ** 0.5 / (n - 2)
    return full(F.when(var > 1e-12, factor * g1), x, f, n)


def ewma_volatility(returns: str, decay: float, most: int = 365) -> Column:
    """Root of the exponentially weighted mean of squared returns, oldest first, over at most ``most`` rows."""
    listed = F.collect_list(col(returns)).over(trailing(most))
    start = F.pow(F.element_at(listed, 1), F.lit(2.0))
    var = F.aggregate(F.slice(listed, 2, most), start, lambda v, r: decay * v + (1 - decay) * r * r)
    return F.when(F.size(listed) > 0, F.sqrt(var))


def channel_bounds(c: str, trend: int, lookback: int, least: int, low: float, high: float) -> dict[str, Column]:
    """Trend, and quantiles of the log distances of earlier rows from their trends; needs a column ``distance`` for those."""
    frame = prior(lookback)
    at = {q: full(F.percentile(finite("distance"), F.lit(q)).over(frame), finite("distance"), frame, least) for q in (low, high)}
    return {"trend": sma(c, trend), "low_distance": at[low], "high_distance": at[high]}
