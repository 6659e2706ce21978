"""Queries of forecasts, their scores, and tests on them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import scalars as sc
from tidewell.functions.scalars import log_ratio, rounded
from tidewell.operators import metrics, models
from tidewell.operators import windows as w
from tidewell.plans.common import BARS, MARKET, S, last_rows, query, r
from tidewell.sources.bars import market_bars, order_bars

HORIZONS = [7, 14, 30]


def _quantile_sql(p: float) -> str:
    """The value of the same rational approximation, computed by DuckDB from the coefficients."""
    q = f"({p!r}::DOUBLE - 0.5)"

    def poly(c, x):
        total = f"{c[0]!r}::DOUBLE"
        for v in c[1:]:
            total = f"({total} * {x} + {v!r}::DOUBLE)"
        return total

    if p < sc.QUANTILE_BREAK:
        x = f"sqrt(-2 * ln({p!r}::DOUBLE))"
        return f"({poly(sc.QUANTILE_C, x)} / ({poly(sc.QUANTILE_D, x)} * {x} + 1))"
    if p > 1 - sc.QUANTILE_BREAK:
        x = f"sqrt(-2 * ln(1 - {p!r}::DOUBLE))"
        return f"(-{poly(sc.QUANTILE_C, x)} / ({poly(sc.QUANTILE_D, x)} * {x} + 1))"
    x = f"({q} * {q})"
    return f"({poly(sc.QUANTILE_A, x)} * {q} / ({poly(sc.QUANTILE_B, x)} * {x} + 1))"


def _erf_sql(x: str) -> str:
    t = f"(1.0 / (1.0 + {sc.ERF_P!r} * abs({x})))"
    total = repr(sc.ERF_COEFFICIENTS[-1])
    for c in reversed(sc.ERF_COEFFICIENTS[:-1]):
        total = f"({total} * {t} + {c!r})"
    tail = f"{total} * {t} * exp(-({x}) * ({x}))"
    return f"(CASE WHEN {x} < 0 THEN {tail} - 1.0 ELSE 1.0 - {tail} END)"


def _cdf_sql(z: str) -> str:
    return f"((1.0 + {_erf_sql(f'({z} / sqrt(2.0))')}) / 2)"


def _full(f: str, n: int, of: str = "ret") -> str:
    return f"CASE WHEN count({of}) {last_rows(n)} = {n} THEN {f} {last_rows(n)} END"


FORECASTS = f"""rets AS (SELECT *, CASE WHEN lag(close) OVER ({S}) > 0 AND close > 0 THEN ln(close / lag(close) OVER ({S})) END AS ret FROM bars),
  inp AS (SELECT *, {_full('stddev_pop(ret)', 365)} AS vol365, {_full('stddev_pop(ret)', 90)} AS vol90, {_full('avg(ret)', 90)} AS mean90,
  {_full('avg(close)', 20, 'close')} AS sma20, {_full('avg(close)', 50, 'close')} AS sma50, {_full('avg(close)', 200, 'close')} AS sma200, row_number() OVER ({S}) AS idx FROM rets),
  hz AS (SELECT a.*, h.horizon, b.date AS target_date, b.close AS actual FROM inp a CROSS JOIN (SELECT unnest([7, 14, 30])::INT AS horizon) h JOIN inp b ON b.asset_id = a.asset_id AND b.idx = a.idx + h.horizon),
  fc AS (SELECT asset_id, date, horizon, target_date, actual, model, median, sigma FROM (
    SELECT *, 'naive' AS model, close AS median, vol90 * sqrt(horizon) AS sigma FROM hz UNION ALL
    SELECT *, 'gbm-driftless', close, vol365 * sqrt(horizon) FROM hz UNION ALL
    SELECT *, 'gbm-drift', close * exp(mean90 * horizon), vol90 * sqrt(horizon) FROM hz UNION ALL
    SELECT *, 'ma-trend', close * exp(greatest(-{models.MOST_DRIFT}, least({models.MOST_DRIFT}, (ln(sma20 / sma50) / 30 + ln(sma50 / sma200) / 150) / 2)) * horizon), vol90 * sqrt(horizon) FROM hz
    WHERE sma200 IS NOT NULL) WHERE median > 0 AND sigma > 0)"""
WITH = f"WITH {MARKET}, {FORECASTS}"
QCOLS = ", ".join(f"median * exp(sigma * {_quantile_sql(p)}) AS {n}" for n, p in metrics.LEVELS.items())
QUANT = f"{WITH}, q AS (SELECT *, {QCOLS} FROM fc)"
MH = "model, horizon"


def _fc(spark, sf_dir, every: bool = False):
    return models.forecasts(order_bars(spark, sf_dir) if every else market_bars(spark, sf_dir), HORIZONS)


@query("n22_scoreboard", f"WITH {BARS}, {FORECASTS}, e AS (SELECT *, ln(actual / median) AS error FROM fc WHERE actual > 0) SELECT model, horizon, count(*) AS n, {r('quantile_cont(abs(error), 0.5)')} AS median_abs_log_error, {r('avg(abs(error))')} AS mean_abs_log_error, {r('exp(quantile_cont(abs(error), 0.5)) - 1')} AS typical_relative_error, {r('avg(error)')} AS bias FROM e GROUP BY ALL")
def n22_scoreboard(spark, sf_dir):
    """Which benchmark model has the least median absolute log error at each horizon, over all assets?"""
    found = metrics.scoreboard(_fc(spark, sf_dir, every=True), ["model", "horizon"])
    return found.select("model", "horizon", "n", *(rounded(c).alias(c) for c in ("median_abs_log_error", "mean_abs_log_error", "typical_relative_error", "bias")))


@query("forecast_naive_vs_ma", f"{WITH} SELECT a.date, a.horizon, {r('abs(ln(a.actual / a.median)) - abs(ln(b.actual / b.median))')} AS improvement FROM fc a JOIN fc b USING (date, horizon) WHERE a.model = 'naive' AND b.model = 'ma-trend'")
def forecast_naive_vs_ma(spark, sf_dir):
    """Two models at the same origins, paired by a pivot instead of a self join."""
    rows = _fc(spark, sf_dir).withColumn("e", F.abs(models.log_error()))
    paired = rows.groupBy("date", "horizon").pivot("model", ["naive", "ma-trend"]).agg(F.max("e"))
    return paired.where("`naive` IS NOT NULL AND `ma-trend` IS NOT NULL").select("date", "horizon", rounded(F.col("naive") - F.col("ma-trend")).alias("improvement"))


@query("lognormal_quantiles", f"{QUANT} SELECT date, horizon, model, " + ", ".join(f"{r(n, '1e1')} AS {n}" for n in metrics.LEVELS) + " FROM q WHERE model = 'naive'")
def lognormal_quantiles(spark, sf_dir):
    rows = models.with_quantiles(_fc(spark, sf_dir).where("model = 'naive'"))
    return rows.select("date", "horizon", "model", *(rounded(n, 1e1).alias(n) for n in metrics.LEVELS))


def _pin(q: str, p: float) -> str:
    return f"greatest({p!r} * (actual - {q}), ({p!r} - 1) * (actual - {q}))"


@query("pinball", f"{QUANT} SELECT {MH}, " + ", ".join(f"{r(f'avg({_pin(n, p)})', '1e1')} AS {n}" for n, p in metrics.LEVELS.items()) + " FROM q GROUP BY ALL")
def pinball(spark, sf_dir):
    rows = models.with_quantiles(_fc(spark, sf_dir))
    return rows.groupBy("model", "horizon").agg(*(rounded(F.avg(metrics.pinball(F.col("actual"), F.col(n), p)), 1e1).alias(n) for n, p in metrics.LEVELS.items()))


@query("coverage_width", f"{QUANT} SELECT {MH}, {r('avg((actual BETWEEN q10 AND q90)::INT)')} AS cov80, {r('avg((actual BETWEEN q05 AND q95)::INT)')} AS cov90, {r('avg((actual BETWEEN q025 AND q975)::INT)')} AS cov95, {r('avg((q90 - q10) / median)')} AS width80 FROM q GROUP BY ALL")
def coverage_width(spark, sf_dir):
    rows = models.with_quantiles(_fc(spark, sf_dir))
    c = {n: F.col(n) for n in metrics.LEVELS}
    a = F.col("actual")
    return rows.groupBy("model", "horizon").agg(
        rounded(metrics.coverage(a, c["q10"], c["q90"])).alias("cov80"),
        rounded(metrics.coverage(a, c["q05"], c["q95"])).alias("cov90"),
        rounded(metrics.coverage(a, c["q025"], c["q975"])).alias("cov95"),
        rounded(F.avg((c["q90"] - c["q10"]) / F.col("median"))).alias("width80"),
    )


@query("nll", f"{WITH} SELECT {MH}, {r('avg(0.5 * ln(6.283185307179586) + ln(sigma) + ln(actual / median) * ln(actual / median) / (2 * sigma * sigma))')} AS nll FROM fc GROUP BY ALL")
def nll(spark, sf_dir):
    return _fc(spark, sf_dir).groupBy("model", "horizon").agg(rounded(F.avg(metrics.gaussian_nll(models.log_error(), F.col("sigma")))).alias("nll"))


def _crps_sql() -> str:
    levels = list(metrics.LEVELS.items())
    inner = [f"({(b[1] - a[1])!r}) * ({_pin(*a)} + {_pin(*b)}) / 2" for a, b in zip(levels, levels[1:], strict=False)]
    ends = [f"{levels[0][1]!r} * {_pin(*levels[0])}", f"{1 - levels[-1][1]!r} * {_pin(*levels[-1])}"]
    return "2 * (" + " + ".join(inner + ends) + ")"


@query("crps_grid", f"{QUANT} SELECT {MH}, {r(f'avg({_crps_sql()})', '1e1')} AS crps FROM q GROUP BY ALL")
def crps_grid(spark, sf_dir):
    rows = models.with_quantiles(_fc(spark, sf_dir))
    return rows.groupBy("model", "horizon").agg(rounded(F.avg(metrics.crps_from_quantiles(F.col("actual"))), 1e1).alias("crps"))


@query("winkler", f"{QUANT} SELECT {MH}, {r('avg((q95 - q05) + 2 / 0.1 * (greatest(q05 - actual, 0) + greatest(actual - q95, 0)))', '1e1')} AS winkler90 FROM q GROUP BY ALL")
def winkler(spark, sf_dir):
    rows = models.with_quantiles(_fc(spark, sf_dir))
    return rows.groupBy("model", "horizon").agg(rounded(F.avg(metrics.winkler(F.col("actual"), F.col("q05"), F.col("q95"), 0.1)), 1e1).alias("winkler90"))


@query("pit_histogram_chi2", f"""{WITH}, p AS (SELECT {MH}, least(floor({_cdf_sql('(ln(actual / median) / sigma)')} * 10), 9)::INT AS bin FROM fc),
  n AS (SELECT {MH}, bin, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT DISTINCT {MH}, unnest(range(10))::INT AS bin FROM n),
  j AS (SELECT s.*, coalesce(n, 0) AS n, sum(coalesce(n, 0)) OVER (PARTITION BY {', '.join('s.' + x for x in MH.split(', '))}) / 10 AS expected FROM s LEFT JOIN n USING (model, horizon, bin))
  SELECT model, horizon, bin, n::BIGINT AS n, {r('expected')} AS expected, {r('sum((n - expected) * (n - expected) / expected) OVER (PARTITION BY model, horizon)')} AS chi2 FROM j""")
def pit_histogram_chi2(spark, sf_dir):
    rows = _fc(spark, sf_dir).withColumn("pit", sc.normal_cdf(models.log_error() / F.col("sigma")))
    found = metrics.pit_histogram(rows, ["model", "horizon"])
    return found.select("model", "horizon", "bin", F.col("n").cast("long").alias("n"), rounded("expected").alias("expected"), rounded("chi2").alias("chi2"))


@query("welch_by_group", f"""WITH {BARS}, t AS (SELECT asset_id, month(date) <= 6 AS flag, ln(close) AS v FROM bars),
  s AS (SELECT asset_id, count(v) FILTER (flag) AS n1, count(v) FILTER (NOT flag) AS n2, avg(v) FILTER (flag) AS m1, avg(v) FILTER (NOT flag) AS m2, var_samp(v) FILTER (flag) AS v1, var_samp(v) FILTER (NOT flag) AS v2 FROM t GROUP BY 1),
  z AS (SELECT *, (m1 - m2) / sqrt(v1 / n1 + v2 / n2) AS z FROM s)
  SELECT asset_id, n1, n2, {r('m1 - m2')} AS difference, {r('z')} AS z, {r(f"2 * (1 - {_cdf_sql('abs(z)')})")} AS p FROM z""")
def welch_by_group(spark, sf_dir):
    rows = order_bars(spark, sf_dir).select("asset_id", (F.month("date") <= 6).alias("flag"), F.ln("close").alias("v"))
    found = metrics.welch(rows, ["asset_id"], "flag", "v")
    return found.select("asset_id", "n1", "n2", rounded("difference").alias("difference"), rounded("z").alias("z"), rounded("p").alias("p"))


@query("holm_adjust", f"""WITH {BARS}, t AS (SELECT asset_id, month(date) <= 6 AS flag, ln(close) AS v FROM bars),
  s AS (SELECT asset_id, (avg(v) FILTER (flag) - avg(v) FILTER (NOT flag)) / sqrt(var_samp(v) FILTER (flag) / count(v) FILTER (flag) + var_samp(v) FILTER (NOT flag) / count(v) FILTER (NOT flag)) AS z FROM t GROUP BY 1),
  p AS (SELECT asset_id, 2 * (1 - {_cdf_sql('abs(z)')}) AS p FROM s),
  o AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, asset_id) + 1)) AS raw FROM p)
  SELECT asset_id, {r('p')} AS p, {r('max(raw) OVER (ORDER BY p, asset_id ROWS UNBOUNDED PRECEDING)')} AS p_holm FROM o""")
def holm_adjust(spark, sf_dir):
    rows = order_bars(spark, sf_dir).select("asset_id", (F.month("date") <= 6).alias("flag"), F.ln("close").alias("v"))
    tests = metrics.welch(rows, ["asset_id"], "flag", "v").withColumn("family", F.lit("halves"))
    found = metrics.holm(tests, ["family"], "p", "asset_id")
    return found.select("asset_id", rounded("p").alias("p"), rounded("p_holm").alias("p_holm"))


@query("ols_by_group", f"WITH {BARS} SELECT asset_id, count(*) AS n, {r('regr_slope(close, date - DATE ' + chr(39) + '1995-01-01' + chr(39) + ')', '1e3')} AS slope, {r('regr_intercept(close, date - DATE ' + chr(39) + '1995-01-01' + chr(39) + ')', '1e1')} AS intercept, {r('regr_r2(close, date - DATE ' + chr(39) + '1995-01-01' + chr(39) + ')')} AS r2 FROM bars GROUP BY 1")
def ols_by_group(spark, sf_dir):
    rows = order_bars(spark, sf_dir).withColumn("x", F.datediff("date", F.lit("1995-01-01").cast("date")).cast("double"))
    return rows.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n"), rounded(F.regr_slope("close", "x"), 1e3).alias("slope"), rounded(F.regr_intercept("close", "x"), 1e1).alias("intercept"), rounded(F.regr_r2("close", "x")).alias("r2")
    )


@query("argmin_grid", f"""{WITH}, g AS (SELECT unnest(range(8)) * 0.25 + 0.25 AS scale),
  s AS (SELECT horizon, scale, avg(0.5 * ln(6.283185307179586) + ln(sigma * scale) + ln(actual / median) * ln(actual / median) / (2 * sigma * scale * sigma * scale)) AS score FROM fc CROSS JOIN g WHERE model = 'naive' GROUP BY ALL)
  SELECT horizon, scale, {r('score')} AS score FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY score, abs(scale), scale) AS n FROM s) WHERE n = 1""")
def argmin_grid(spark, sf_dir):
    """The scale of sigma with the least likelihood loss at each horizon: the grid is a small dimension."""
    grid = F.explode(F.array(*(F.lit(0.25 + 0.25 * i) for i in range(8)))).alias("scale")
    rows = _fc(spark, sf_dir).where("model = 'naive'").select("horizon", "sigma", models.log_error().alias("e"), grid)
    scored = rows.groupBy("horizon", "scale").agg(F.avg(metrics.gaussian_nll(F.col("e"), F.col("sigma") * F.col("scale"))).alias("score"))
    return metrics.best_of(scored, ["horizon"], F.col("score"), F.abs("scale"), F.col("scale")).select("horizon", "scale", rounded("score").alias("score"))


@query("calibrate_multiplier", f"""{WITH}, g AS (SELECT (unnest(range(20)) + 1) * 0.1 AS k),
  s AS (SELECT horizon, k, avg((abs(ln(actual / median)) <= 1.28 * sigma * k)::INT) AS c80, avg((abs(ln(actual / median)) <= 1.64 * sigma * k)::INT) AS c90, avg((abs(ln(actual / median)) <= 1.96 * sigma * k)::INT) AS c95 FROM fc CROSS JOIN g WHERE model = 'naive' AND date < DATE '2000-01-01' GROUP BY ALL)
  SELECT horizon, {r('k')} AS multiplier, {r('c80')} AS cov80, {r('c90')} AS cov90, {r('c95')} AS cov95 FROM (SELECT *, row_number() OVER (PARTITION BY horizon ORDER BY {r('abs(c80 - 0.8) + abs(c90 - 0.9) + abs(c95 - 0.95)', '1e9')}, k) AS n FROM s) WHERE n = 1""")
def calibrate_multiplier(spark, sf_dir):
    """The multiplier of sigma whose coverages lie nearest to what they promise, on the fit period."""
    grid = F.explode(F.array(*((F.lit(i) * F.lit(0.1)) for i in range(1, 21)))).alias("k")
    rows = _fc(spark, sf_dir).where((F.col("model") == "naive") & (F.col("date") < F.lit("2000-01-01").cast("date")))
    rows = rows.select("horizon", "sigma", F.abs(models.log_error()).alias("e"), grid)
    inside = lambda z: F.avg((F.col("e") <= F.lit(z) * F.col("sigma") * F.col("k")).cast("int"))
    scored = rows.groupBy("horizon", "k").agg(inside(1.28).alias("c80"), inside(1.64).alias("c90"), inside(1.96).alias("c95"))
    off = rounded(F.abs(F.col("c80") - 0.8) + F.abs(F.col("c90") - 0.9) + F.abs(F.col("c95") - 0.95), 1e9)
    best = metrics.best_of(scored, ["horizon"], off, F.col("k"))
    return best.select("horizon", rounded("k").alias("multiplier"), rounded("c80").alias("cov80"), rounded("c90").alias("cov90"), rounded("c95").alias("cov95"))


@query("inverse_loss_weights", f"{WITH}, e AS (SELECT {MH}, avg(abs(ln(actual / median))) AS loss FROM fc GROUP BY ALL) SELECT {MH}, {r('(1 / greatest(loss, 1e-6)) / sum(1 / greatest(loss, 1e-6)) OVER (PARTITION BY horizon)')} AS weight FROM e")
def inverse_loss_weights(spark, sf_dir):
    losses = _fc(spark, sf_dir).groupBy("model", "horizon").agg(F.avg(F.abs(models.log_error())).alias("loss"))
    inverse = 1 / F.greatest("loss", F.lit(1e-6))
    return losses.select("model", "horizon", rounded(inverse / F.sum(inverse).over(Window.partitionBy("horizon"))).alias("weight"))


@query("ensemble_blend", f"""{WITH}, l AS (SELECT {MH}, 1 / greatest(avg(abs(ln(actual / median))), 1e-6) AS w FROM fc WHERE date < DATE '1999-01-01' GROUP BY ALL)
  SELECT date, horizon, {r('exp(sum(w * ln(median)) / sum(w))', '1e2')} AS median, {r('sum(w * sigma) / sum(w)')} AS sigma, count(*) AS n_models FROM fc JOIN l USING (model, horizon) WHERE date >= DATE '1999-01-01' GROUP BY ALL""")
def ensemble_blend(spark, sf_dir):
    """Medians blended with weights that were learned before the cut."""
    rows = _fc(spark, sf_dir)
    cut = F.lit("1999-01-01").cast("date")
    weights = rows.where(F.col("date") < cut).groupBy("model", "horizon").agg((1 / F.greatest(F.avg(F.abs(models.log_error())), F.lit(1e-6))).alias("w"))
    joined = rows.where(F.col("date") >= cut).join(F.broadcast(weights), ["model", "horizon"])  # one row for a model and horizon
    total = F.sum("w")
    return joined.groupBy("date", "horizon").agg(
        rounded(F.exp(F.sum(F.col("w") * F.ln("median")) / total), 1e2).alias("median"), rounded(F.sum(F.col("w") * F.col("sigma")) / total).alias("sigma"), F.count(F.lit(1)).alias("n_models")
    )


@query("gate_verdicts", f"""{WITH}, e AS (SELECT {MH}, median(abs(ln(actual / median))) AS mae, avg((abs(ln(actual / median)) <= 1.64 * sigma)::INT) AS cov, count(*) AS n FROM fc GROUP BY ALL),
  b AS (SELECT horizon, mae AS base FROM e WHERE model = 'naive')
  SELECT {MH}, n, CASE WHEN n < 100 THEN 'needs-more-data' WHEN mae < base * 0.99 AND cov BETWEEN 0.85 AND 0.95 THEN 'promote' WHEN mae <= base * 1.005 THEN 'watch' ELSE 'reject' END AS verdict FROM e JOIN b USING (horizon) WHERE model <> 'naive'""")
def gate_verdicts(spark, sf_dir):
    rows = _fc(spark, sf_dir).withColumn("e", F.abs(models.log_error()))
    scored = rows.groupBy("model", "horizon").agg(
        F.percentile("e", F.lit(0.5)).alias("mae"), F.avg((F.col("e") <= 1.64 * F.col("sigma")).cast("int")).alias("cov"), F.count(F.lit(1)).alias("n")
    )
    base = F.max(F.when(F.col("model") == "naive", F.col("mae"))).over(Window.partitionBy("horizon"))
    verdict = (
        F.when(F.col("n") < 100, "needs-more-data").when((F.col("mae") < F.col("base") * 0.99) & F.col("cov").between(0.85, 0.95), "promote")
        .when(F.col("mae") <= F.col("base") * 1.005, "watch").otherwise("reject")
    )
    return scored.withColumn("base", base).where("model <> 'naive'").select("model", "horizon", "n", verdict.alias("verdict"))


@query("scoreboard_rollup", f"{WITH} SELECT model, horizon, count(*) AS n, {r('avg(abs(ln(actual / median)))')} AS mae FROM fc GROUP BY ROLLUP (model, horizon)")
def scoreboard_rollup(spark, sf_dir):
    return _fc(spark, sf_dir).withColumn("e", F.abs(models.log_error())).rollup("model", "horizon").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg("e")).alias("mae"))


@query("regime_scores", f"""{WITH}, v AS (SELECT date, horizon, ln(actual / median) AS e, sigma, ntile(3) OVER (ORDER BY sigma, date) AS tercile FROM fc WHERE model = 'naive' AND horizon = 7)
  SELECT tercile, count(*) AS n, {r('avg(abs(e))')} AS mae, {r('avg(sigma)')} AS sigma FROM v GROUP BY tercile""")
def regime_scores(spark, sf_dir):
    """Errors by tercile of volatility."""
    rows = _fc(spark, sf_dir).where("model = 'naive' AND horizon = 7").withColumn("tercile", F.ntile(3).over(Window.orderBy("sigma", "date")))
    return rows.groupBy("tercile").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(F.abs(models.log_error()))).alias("mae"), rounded(F.avg("sigma")).alias("sigma"))


@query("probability_forecast", f"""{WITH}, l AS (SELECT * FROM fc WHERE date = (SELECT max(date) FROM fc) OR true),
  p AS (SELECT model, horizon, date, median, sigma, greatest(0.01, least(0.99, {_cdf_sql('(ln(median / c.close) / sigma)')})) AS p_up FROM l JOIN (SELECT date, close FROM bars) c USING (date))
  SELECT model, horizon, date, {r('median', '1e2')} AS median, {r('p_up')} AS p_up, CASE WHEN p_up >= 0.6 THEN 'bullish' WHEN p_up <= 0.4 THEN 'bearish' ELSE 'neutral' END AS label FROM p""")
def probability_forecast(spark, sf_dir):
    bars = market_bars(spark, sf_dir).select("date", F.col("close").alias("now"))
    up = sc.clamp(sc.normal_cdf(F.ln(F.col("median") / F.col("now")) / F.col("sigma")), 0.01, 0.99)
    rows = _fc(spark, sf_dir).join(bars, "date").withColumn("p_up", up)
    label = F.when(F.col("p_up") >= 0.6, "bullish").when(F.col("p_up") <= 0.4, "bearish").otherwise("neutral")
    return rows.select("model", "horizon", "date", rounded("median", 1e2).alias("median"), rounded("p_up").alias("p_up"), label.alias("label"))


_LAW = lambda days, law: f"exp({law[0]!r} + {law[1]!r} * ln({days}))"
_DAYS = f"(date - DATE '{models.GENESIS}')"


@query("powerlaw_curve", f"WITH {MARKET} SELECT date, {r(_LAW(_DAYS, models.BASE_LAW))} AS base, {r(_LAW(_DAYS, models.PEAK_LAW))} AS peak, {r('least(' + ', '.join(_LAW(_DAYS, x) for x in models.FLOOR_LAWS) + ')')} AS floor FROM bars")
def powerlaw_curve(spark, sf_dir):
    days = F.datediff("date", F.lit(models.GENESIS).cast("date"))
    return market_bars(spark, sf_dir).select("date", rounded(models.power_law(days)).alias("base"), rounded(models.power_law(days, models.PEAK_LAW)).alias("peak"), rounded(models.floor_price(days)).alias("floor"))


@query("meanrevert_forecast", f"WITH {MARKET} SELECT date, h.horizon, {r(_LAW(f'({_DAYS} + h.horizon)', models.BASE_LAW) + f' * exp(ln(close / {_LAW(_DAYS, models.BASE_LAW)}) * exp(-h.horizon / 210.0))', '1e1')} AS median FROM bars CROSS JOIN (SELECT unnest([7, 14, 30])::INT AS horizon) h")
def meanrevert_forecast(spark, sf_dir):
    days = F.datediff("date", F.lit(models.GENESIS).cast("date"))
    rows = market_bars(spark, sf_dir).withColumn("days", days).withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    return rows.select("date", "horizon", rounded(models.mean_reverting(F.col("close"), F.col("days"), F.col("horizon"), 210.0), 1e1).alias("median"))


@query("interval_sigma", f"""WITH {MARKET}, rets AS (SELECT *, ln(close / lag(close) OVER ({S})) AS ret FROM bars), v AS (SELECT date, stddev_samp(ret) {last_rows(90)} AS s, count(ret) {last_rows(90)} AS n FROM rets)
  SELECT date, h.horizon, {r('sqrt(s * s * (1 - pow(0.98, 2 * h.horizon)) / (1 - 0.98 * 0.98))')} AS sigma FROM v CROSS JOIN (SELECT unnest([7, 14, 30])::INT AS horizon) h WHERE n = 90""")
def interval_sigma(spark, sf_dir):
    rows = market_bars(spark, sf_dir).withColumn("ret", w.log_return("close"))
    rows = rows.withColumn("s", w.deviation("ret", 90)).where("s IS NOT NULL").withColumn("horizon", F.explode(F.array(*map(F.lit, HORIZONS))))
    return rows.select("date", "horizon", rounded(F.sqrt(models.residual_variance(F.col("s"), 0.98, F.col("horizon")))).alias("sigma"))


_ZS = "(1.0 / (1.0 + 0.2316419 * abs(z)))"


def _zs_sql(z: str) -> str:
    t = f"(1.0 / (1.0 + {sc.ZS_P!r} * abs({z})))"
    total = repr(sc.ZS_COEFFICIENTS[-1])
    for c in reversed(sc.ZS_COEFFICIENTS[:-1]):
        total = f"({total} * {t} + {c!r})"
    tail = f"exp(-({z}) * ({z}) / 2) / sqrt(2 * pi()) * {total} * {t}"
    return f"(CASE WHEN {z} < 0 THEN {tail} ELSE 1.0 - {tail} END)"


@query("normal_cdfs", f"SELECT z, {r(_cdf_sql('z'), '1e9')} AS by_erf, {r(_zs_sql('z'), '1e9')} AS by_polynomial FROM (SELECT (unnest(range(81)) - 40) / 10.0 AS z)")
def normal_cdfs(spark, sf_dir):
    rows = spark.range(81).select(((F.col("id") - 40) / 10.0).alias("z"))
    return rows.select("z", rounded(sc.normal_cdf(F.col("z")), 1e9).alias("by_erf"), rounded(sc.normal_cdf_polynomial(F.col("z")), 1e9).alias("by_polynomial"))


@query("normal_quantile", "SELECT * FROM (VALUES " + ", ".join(f"({p!r}::DOUBLE, {r(_quantile_sql(p), '1e9')})" for p in (0.001, 0.01, 0.025, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975, 0.999)) + ") v(p, q)")
def normal_quantile(spark, sf_dir):
    levels = [(p,) for p in (0.001, 0.01, 0.025, 0.1, 0.25, 0.5, 0.75, 0.9, 0.975, 0.999)]
    return spark.createDataFrame(levels, "p double").select("p", rounded(sc.normal_quantile(F.col("p")), 1e9).alias("q"))


@query("phase_regressions", f"""WITH {MARKET}, f AS (SELECT date, ln(close / lag(close, 30) OVER ({S})) AS x, ln(lead(close, 30) OVER ({S}) / close) AS y, CASE WHEN year(date) < 1998 THEN 'early' ELSE 'late' END AS phase FROM bars)
  SELECT phase, x > 0 AS rising, count(*) AS n, {r('avg(y)')} AS mean_forward, {r('avg((y > 0)::INT)')} AS hit_rate, {r('regr_slope(y, x)')} AS slope FROM f WHERE x IS NOT NULL AND y IS NOT NULL GROUP BY ALL""")
def phase_regressions(spark, sf_dir):
    rows = market_bars(spark, sf_dir).withColumns({"x": w.log_return("close", 30), "y": log_ratio(F.lead("close", 30).over(w.series()), F.col("close"))})
    rows = rows.where("x IS NOT NULL AND y IS NOT NULL").withColumn("phase", F.when(F.year("date") < 1998, "early").otherwise("late"))
    return rows.groupBy("phase", (F.col("x") > 0).alias("rising")).agg(
        F.count(F.lit(1)).alias("n"), rounded(F.avg("y")).alias("mean_forward"), rounded(F.avg((F.col("y") > 0).cast("int"))).alias("hit_rate"), rounded(F.regr_slope("y", "x")).alias("slope")
    )


@query("nearest_analogs_topk", f"""WITH {MARKET}, f AS (SELECT date, ln(close / lag(close, 7) OVER ({S})) AS a, ln(close / lag(close, 30) OVER ({S})) AS b FROM bars),
  s AS (SELECT stddev_pop(a) AS sa, stddev_pop(b) AS sb FROM f), l AS (SELECT arg_max(a, date) AS a0, arg_max(b, date) AS b0, max(date) AS d0 FROM f WHERE b IS NOT NULL)
  SELECT date, {r('pow((a - a0) / sa, 2) + pow((b - b0) / sb, 2)')} AS distance FROM f, s, l WHERE b IS NOT NULL AND date < d0 - INTERVAL 60 DAY ORDER BY pow((a - a0) / sa, 2) + pow((b - b0) / sb, 2), date LIMIT 8""")
def nearest_analogs_topk(spark, sf_dir):
    rows = market_bars(spark, sf_dir).select("date", w.log_return("close", 7).alias("a"), w.log_return("close", 30).alias("b"), "asset_id")
    spread = rows.agg(F.stddev_pop("a").alias("sa"), F.stddev_pop("b").alias("sb"), F.max_by(F.struct("date", "a", "b"), F.when(F.col("b").isNotNull(), F.col("date"))).alias("now"))
    near = rows.where("b IS NOT NULL").crossJoin(F.broadcast(spread)).where(F.col("date") < F.date_sub("now.date", 60))  # spread is one row
    distance = F.pow((F.col("a") - F.col("now.a")) / F.col("sa"), F.lit(2.0)) + F.pow((F.col("b") - F.col("now.b")) / F.col("sb"), F.lit(2.0))
    return near.select("date", distance.alias("d")).orderBy("d", "date").limit(8).select("date", rounded("d").alias("distance"))
