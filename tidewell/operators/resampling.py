"""Resampling as joins: draws are rows, and what they sum comes from prefix sums or from sums per shift.

A draw is 32 bits of the MD5 of its name (seed, stratum, number), so results
don't depend on partitions or retries, and any engine can repeat them.  The
draws are spread over tasks; the series they read is never shipped whole.
"""

from __future__ import annotations

from math import exp

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import clamp
from tidewell.operators import models
from tidewell.operators import windows as w


def draw(*parts: Column | str) -> Column:
    """A whole number below 2 ** 32, from the text of the parts."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts).cast("binary")), 1, 8), 16, 10).cast("long")


def below(number: Column, n: Column) -> Column:
    """The drawn number scaled to 0 .. n - 1, in whole numbers."""
    return F.shiftright(number * n.cast("long"), 32)


BLOCK = 14
SIMULATIONS = 400
RECENT = 730
#: Rows before the first multiplier, and the range that it is held in.
LEAST_ROWS = 365
RANGE = (0.7, 1.8)
#: Bounds of the strata of volatility, as shares of all rows.
STRATA = (0.33, 0.67)
RECENT_WEIGHT = 0.55
TAU = 210.0
POLICIES = ("full-history", "recent-730d", "vol-regime-stratified")


def law_residuals(bars: DataFrame, tau: float = TAU) -> DataFrame:
    """asset_id, date, close, idx, residual (log of the close over what the law expected from the day before), vol30, vol (blended)."""
    rows = bars.select("asset_id", "date", "close").where("close > 0")
    days = F.datediff("date", F.lit(models.GENESIS).cast("date"))
    rows = rows.withColumns({"idx": F.row_number().over(w.series()) - 1, "days": days, "ret": w.log_return("close")})
    before, gap = F.lag("close").over(w.series()), F.col("days") - F.lag("days").over(w.series())
    expected = models.mean_reverting(before, F.lag("days").over(w.series()), gap, tau)
    deviation = lambda n: F.stddev_samp("ret").over(w.trailing(n))
    blended = F.sqrt(RECENT_WEIGHT * F.pow(deviation(90), 2) + (1 - RECENT_WEIGHT) * F.pow(deviation(365), 2))
    return rows.select("asset_id", "date", "close", "idx", F.ln(F.col("close") / expected).alias("residual"), F.coalesce(deviation(30), F.lit(0.0)).alias("vol30"), blended.alias("vol"))


def pools(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """asset_id, policy, residual, idx: the residuals that each policy draws from, as seen from the asset's last row."""
    held = rows.where("residual IS NOT NULL")
    whole = Window.partitionBy("asset_id")
    current = F.max_by("vol30", "idx").over(whole)
    low, high = (F.percentile("vol30", F.lit(share)).over(whole) for share in STRATA)
    bucket = lambda v: F.when(v <= F.col("low"), "low").when(v >= F.col("high"), "high").otherwise("normal")
    held = held.withColumns({"current": current, "low": low, "high": high, "back": F.row_number().over(whole.orderBy(F.desc("idx")))})
    held = held.withColumn("alike", bucket(F.col("vol30")) == bucket(F.col("current")))
    held = held.withColumn("enough", F.count_if("alike").over(whole) >= 4 * block)
    wanted = (F.lit(True), F.col("back") <= RECENT, F.col("alike") | ~F.col("enough"))
    policy = F.explode(F.filter(F.array(*(F.when(cond, F.lit(name)) for cond, name in zip(wanted, POLICIES, strict=True))), lambda x: x.isNotNull())).alias("policy")
    return held.select("asset_id", policy, "residual", "idx")


def block_totals(pool: DataFrame, horizons: tuple[int, ...], block: int, simulations: int, seed: int) -> DataFrame:
    """asset_id, policy, horizon, simulation, total: sums of ``horizon`` residuals in blocks that start anywhere where a whole block fits.

    A block's sum is the difference of two prefix sums, so a draw meets two rows,
    whatever the block's length.
    """
    keys = ["asset_id", "policy"]
    along = Window.partitionBy(*keys).orderBy("idx")
    placed = pool.select(*keys, F.row_number().over(along).alias("at"), F.sum("residual").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("sum"))
    sizes = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= 4 * block)
    draws = sizes.withColumn("horizon", F.explode(F.array(*map(F.lit, horizons)))).withColumn("simulation", F.explode(F.sequence(F.lit(0), F.lit(simulations - 1))))
    draws = draws.withColumn("k", F.explode(F.sequence(F.lit(0), F.ceil((F.col("horizon") - 1) / block).cast("int")))).where(F.col("k") * block < F.col("horizon"))
    number = draw(F.lit(str(seed)), "policy", "horizon", "simulation", "k")
    draws = draws.withColumns({"start": below(number, F.col("n") - block + 1), "size": F.least(F.lit(block), F.col("horizon") - F.col("k") * block)})
    ends = F.explode(F.array(F.struct((F.col("start") + F.col("size")).alias("at"), F.lit(1.0).alias("sign")), F.struct(F.col("start").alias("at"), F.lit(-1.0).alias("sign")))).alias("e")
    ends = draws.select(*keys, "horizon", "simulation", ends).select(*keys, "horizon", "simulation", "e.*")
    met = ends.join(placed, [*keys, "at"], "left")  # nothing lies before the first row: its sum is 0
    return met.groupBy(*keys, "horizon", "simulation").agg(F.sum(F.col("sign") * F.coalesce("sum", F.lit(0.0))).alias("total"))


def sigma_multipliers(bars: DataFrame, horizons: tuple[int, ...], block: int = BLOCK, simulations: int = SIMULATIONS, seed: int = 7) -> DataFrame:
    """asset_id, policy, horizon, spread, sigma, multiplier: the deviation of resampled residual sums over that of the fading residual process.

    The multiplier is 1 for a series of fewer than LEAST_ROWS rows, a pool of fewer than four blocks, and where a side has no spread.
    """
    rows = law_residuals(bars)
    last = rows.groupBy("asset_id").agg(F.max("idx").alias("idx"), F.max_by("vol", "idx").alias("vol"))
    spread = block_totals(pools(rows, block), horizons, block, simulations, seed).groupBy("asset_id", "policy", "horizon").agg(F.stddev_samp("total").alias("spread"))
    asked = last.withColumn("policy", F.explode(F.array(*map(F.lit, POLICIES)))).withColumn("horizon", F.explode(F.array(*map(F.lit, horizons))))
    met = asked.join(spread, ["asset_id", "policy", "horizon"], "left")
    decay = exp(-1 / TAU)
    sigma = F.sqrt(models.residual_variance(F.col("vol"), decay, F.col("horizon")))
    known = (F.col("idx") >= LEAST_ROWS) & (F.col("spread") > 0) & (F.col("sigma") > 0)
    return met.withColumn("sigma", sigma).select("asset_id", "policy", "horizon", "spread", "sigma", F.when(known, clamp(F.col("spread") / F.col("sigma"), *RANGE)).otherwise(1.0).alias("multiplier"))


COST = 0.002


def joint_shift_test(timeline: DataFrame, signals: list[str], iterations: int = 50_000, seed: int = 11, cost: float = COST) -> DataFrame:
    """asset_id, signal, n_events, observed, p, p_max: shifts within each year, one for all signals, against the observed mean signed excess.

    ``timeline`` has asset_id, date, value (the return of a row) and a column of
    -1, 0 and 1 for each signal.  All signals of a year move by one drawn shift,
    so what they share stays shared.  For every year and shift the sum of signal
    times return is computed once, from the rows with an event; a draw then adds
    one row for each year.  ``p`` counts draws with a statistic of at least the
    observed one; ``p_max`` those whose largest statistic over the signals is.
    """
    year = Window.partitionBy("asset_id", "year")
    rows = timeline.where("value IS NOT NULL").withColumn("year", F.year("date"))
    rows = rows.withColumns({"at": F.row_number().over(year.orderBy("date")) - 1, "n": F.count(F.lit(1)).over(year)})
    events = rows.where(" OR ".join(f"{s} <> 0" for s in signals)).select("asset_id", "year", F.col("at").alias("event_at"), *signals)
    met = events.join(rows.select("asset_id", "year", "at", "n", "value"), ["asset_id", "year"])  # at most the days of a year on both sides
    shift = F.pmod(F.col("event_at") - F.col("at"), F.col("n")).cast("long")
    sums = met.groupBy("asset_id", "year", shift.alias("shift")).agg(*(F.sum(F.col(s) * F.col("value")).alias(s) for s in signals))

    sizes = rows.select("asset_id", "year", "n").distinct()
    draws = timeline.sparkSession.range(iterations).withColumnRenamed("id", "iteration").join(F.broadcast(sizes))  # sizes: a row for each asset and year
    draws = draws.withColumn("shift", below(draw(F.lit(str(seed)), "iteration", "year"), F.col("n")))
    drawn = draws.join(sums, ["asset_id", "year", "shift"]).groupBy("asset_id", "iteration").agg(*(F.sum(s).alias(s) for s in signals))

    count = lambda s: F.count_if(F.col(s) != 0)
    facts = rows.groupBy("asset_id").agg(
        F.avg("value").alias("mean"), *(count(s).alias(f"n_{s}") for s in signals), *(F.sum(s).alias(f"d_{s}") for s in signals), *(F.sum(F.col(s) * F.col("value")).alias(f"o_{s}") for s in signals)
    )

    def statistic(signed: str, s: str) -> Column:
        n = F.nullif(f"n_{s}", F.lit(0))
        return F.col(signed) / n - F.col("mean") * F.col(f"d_{s}") / n - cost

    both = drawn.join(F.broadcast(facts), "asset_id")  # a row for each asset
    both = both.select("asset_id", "iteration", *(x for s in signals for x in (statistic(s, s).alias(f"s_{s}"), statistic(f"o_{s}", s).alias(f"x_{s}"))))
    largest = F.greatest(*(F.col(f"s_{s}") for s in signals)) if len(signals) > 1 else F.col(f"s_{signals[0]}")
    reached = [F.struct(F.lit(s).alias("signal"), (F.col(f"s_{s}") >= F.col(f"x_{s}") - 1e-12).alias("own"), (largest >= F.col(f"x_{s}") - 1e-12).alias("any")) for s in signals]
    counted = both.select("asset_id", F.explode(F.array(*reached)).alias("r")).groupBy("asset_id", "r.signal").agg(F.count_if("r.own").alias("own"), F.count_if("r.any").alias("any"))
    told = facts.select("asset_id", F.explode(F.array(*(F.struct(F.lit(s).alias("signal"), F.col(f"n_{s}").alias("n_events"), statistic(f"o_{s}", s).alias("observed")) for s in signals))).alias("f")).select("asset_id", "f.*")
    share = lambda c: (F.coalesce(c, F.lit(0)) + 1) / (iterations + 1)
    return told.join(counted, ["asset_id", "signal"], "left").where("n_events > 0").select("asset_id", "signal", "n_events", "observed", share("own").alias("p"), share("any").alias("p_max"))


#: Multipliers of sigma at their horizons, in days.
MULTIPLIERS = ((14, 1.01), (30, 0.98), (60, 0.99), (90, 0.87), (180, 0.86), (365, 0.59))


def _between(h: Column, points: list[tuple[float, float]], below_first: Column) -> Column:
    """Log-log interpolation of the points; beyond the last one by the root of the horizon."""
    x = h.cast("double")
    (last_h, last), pieces = points[-1], F.when(x < points[0][0], below_first)
    for (h0, v0), (h1, v1) in zip(points[:-1], points[1:], strict=True):
        share = (F.ln(x) - F.ln(F.lit(float(h0)))) / (F.ln(F.lit(float(h1))) - F.ln(F.lit(float(h0))))
        inside = F.lit(v0) if v0 == v1 else F.exp(F.ln(F.lit(v0)) + share * (F.ln(F.lit(v1)) - F.ln(F.lit(v0))))
        pieces = pieces.when(x == h0, v0).when(x < h1, inside)
    return pieces.when(x == last_h, last).otherwise(last * F.sqrt(x / last_h))


def unit_variance(days: float, tau: float = TAU) -> float:
    fade = exp(-2 / tau)
    return (1 - fade**days) / (1 - fade)


def interval_multiplier(h: Column) -> Column:
    """Multiplier of sigma at a horizon; the first one's below the table."""
    return _between(h, list(MULTIPLIERS), F.lit(MULTIPLIERS[0][1]))


def sigma_scale(h: Column, tau: float = TAU) -> Column:
    """Sigma at a horizon for a daily volatility of 1: the fitted scales, raised to the largest one so far, so that bands never narrow."""
    fitted = [(d, m * unit_variance(d, tau) ** 0.5) for d, m in MULTIPLIERS]
    rising = [(d, max(v for _, v in fitted[: i + 1])) for i, (d, _) in enumerate(fitted)]
    return _between(h, rising, MULTIPLIERS[0][1] * F.sqrt(models.residual_variance(F.lit(1.0), exp(-1 / tau), h)))

