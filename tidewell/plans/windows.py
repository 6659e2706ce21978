"""Queries of the window operators over daily bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewell.functions.scalars import clamp, log_ratio, rounded
from tidewell.operators import scans
from tidewell.operators import windows as w
from tidewell.plans.common import BARS, MACRO, MARKET, S, last_rows, over, query, r, rows_before
from tidewell.sources.bars import market_bars, monthly_macro, order_bars

KEY = "asset_id, date"
RET = f"rets AS (SELECT *, CASE WHEN lag(close) OVER ({S}) > 0 AND close > 0 THEN ln(close / lag(close) OVER ({S})) END AS ret FROM bars)"


def _out(df: DataFrame, **columns) -> DataFrame:
    return df.select("asset_id", "date", *(rounded(c).alias(n) for n, c in columns.items()))


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return order_bars(spark, sf_dir).withColumn("ret", w.log_return("close"))


@query("bars_daily", f"WITH {BARS} SELECT asset_id, date, open, high, low, close, {r('volume', '1e2')} AS volume FROM bars")
def bars_daily(spark, sf_dir):
    return order_bars(spark, sf_dir).select("asset_id", "date", "open", "high", "low", "close", rounded("volume", 1e2).alias("volume"))


@query("returns_log", f"WITH {BARS}, {RET} SELECT {KEY}, {r('ret')} AS ret FROM rets")
def returns_log(spark, sf_dir):
    return _out(_returns(spark, sf_dir), ret=F.col("ret"))


@query("sma_20_50", f"WITH {BARS} SELECT {KEY}, " + ", ".join(f"CASE WHEN count(close) {last_rows(n)} = {n} THEN {r(f'avg(close) {last_rows(n)}')} END AS sma{n}" for n in (20, 50)) + " FROM bars")
def sma_20_50(spark, sf_dir):
    return order_bars(spark, sf_dir).select("asset_id", "date", *(rounded(w.sma("close", n)).alias(f"sma{n}") for n in (20, 50)))


@query("vol_realized", f"WITH {BARS}, {RET} SELECT {KEY}, CASE WHEN count(ret) {last_rows(90)} = 90 THEN {r(f'stddev_samp(ret) {last_rows(90)}')} END AS vol90, CASE WHEN count(ret) {last_rows(90)} = 90 THEN {r(f'stddev_pop(ret) {last_rows(90)} * sqrt(365.0)')} END AS annual90 FROM rets")
def vol_realized(spark, sf_dir):
    return _out(_returns(spark, sf_dir), vol90=w.deviation("ret", 90), annual90=w.deviation("ret", 90, sample=False) * F.sqrt(F.lit(365.0)))


_V = {n: f"CASE WHEN count(ret) {last_rows(n)} = {n} THEN stddev_samp(ret) {last_rows(n)} END" for n in (7, 30, 90, 252, 365)}


@query("vol_blend", f"WITH {BARS}, {RET}, v AS (SELECT {KEY}, {_V[90]} AS a, {_V[365]} AS b, {_V[252]} AS c FROM rets) SELECT {KEY}, {r('sqrt(0.55 * a * a + 0.45 * b * b)')} AS blended, {r('greatest(0.65 * a + 0.35 * c, 1e-4)')} AS mixed FROM v WHERE a IS NOT NULL AND b IS NOT NULL")
def vol_blend(spark, sf_dir):
    v = _returns(spark, sf_dir).select("asset_id", "date", *(w.deviation("ret", n).alias(f"v{n}") for n in (90, 252, 365)))
    v = v.where("v90 IS NOT NULL AND v365 IS NOT NULL")
    a, b, c = F.col("v90"), F.col("v365"), F.col("v252")
    return _out(v, blended=F.sqrt(0.55 * a * a + 0.45 * b * b), mixed=F.greatest(0.65 * a + 0.35 * c, F.lit(1e-4)))


@query("vol_har", f"WITH {BARS}, {RET}, v AS (SELECT {KEY}, {_V[7]} AS a, {_V[30]} AS b, {_V[90]} AS c FROM rets) SELECT {KEY}, {r('sqrt(0.5 * a * a + 0.3 * b * b + 0.2 * c * c)')} AS har FROM v")
def vol_har(spark, sf_dir):
    a, b, c = (w.deviation("ret", n) for n in (7, 30, 90))
    return _out(_returns(spark, sf_dir), har=F.sqrt(0.5 * a * a + 0.3 * b * b + 0.2 * c * c))


@query("vol_of_vol", f"""WITH {BARS}, {RET}, v AS (SELECT {KEY}, stddev_samp(abs(ret)) {last_rows(30)} AS now, count(ret) {last_rows(30)} AS n,
  stddev_samp(abs(ret)) {over('ROWS BETWEEN 119 PRECEDING AND 30 PRECEDING')} AS before, count(ret) {over('ROWS BETWEEN 119 PRECEDING AND 30 PRECEDING')} AS m FROM rets)
  SELECT {KEY}, {r('now / nullif(before, 0)')} AS ratio FROM v WHERE n = 30 AND m = 90""")
def vol_of_vol(spark, sf_dir):
    now, before = w.trailing(30), w.series().rowsBetween(-119, -30)
    size = F.abs("ret")
    v = _returns(spark, sf_dir).select(
        "asset_id", "date", F.stddev_samp(size).over(now).alias("now"), F.count("ret").over(now).alias("n"), F.stddev_samp(size).over(before).alias("before"), F.count("ret").over(before).alias("m")
    )
    return _out(v.where("n = 30 AND m = 90"), ratio=F.col("now") / F.nullif("before", F.lit(0.0)))


@query("vol_ewma", f"""WITH {BARS}, {RET}, l AS (SELECT {KEY}, list(ret) FILTER (ret IS NOT NULL) {last_rows(365)} AS rs FROM rets)
  SELECT {KEY}, {r('sqrt(list_reduce([rs[1] * rs[1]] || list_transform(rs[2:], lambda x: x), lambda v, x: 0.94 * v + 0.06 * x * x))')} AS ewma FROM l WHERE len(rs) > 0""")
def vol_ewma(spark, sf_dir):
    v = _returns(spark, sf_dir).withColumn("ewma", w.ewma_volatility("ret", 0.94))
    return _out(v.where("ewma IS NOT NULL"), ewma=F.col("ewma"))


@query("bollinger_20_2", f"WITH {BARS}, b AS (SELECT {KEY}, avg(close) {last_rows(20)} AS m, stddev_pop(close) {last_rows(20)} AS s, count(close) {last_rows(20)} AS n FROM bars) SELECT {KEY}, {r('m', '1e2')} AS middle, {r('m + 2 * s', '1e2')} AS upper, {r('m - 2 * s', '1e2')} AS lower FROM b WHERE n = 20")
def bollinger_20_2(spark, sf_dir):
    bands = w.bollinger("close")
    rows = order_bars(spark, sf_dir).select("asset_id", "date", *(c.alias(n) for n, c in bands.items())).where("middle IS NOT NULL")
    return rows.select("asset_id", "date", *(rounded(n, 1e2).alias(n) for n in bands))


_K = f"k AS (SELECT {KEY}, CASE WHEN count(close) {last_rows(14)} = 14 THEN 100 * (close - min(low) {last_rows(14)}) / nullif(max(high) {last_rows(14)} - min(low) {last_rows(14)}, 0) END AS k FROM bars)"


@query("stochastic_14_3", f"WITH {BARS}, {_K} SELECT {KEY}, {r('k')} AS k, CASE WHEN count(k) {last_rows(3)} = 3 THEN {r(f'avg(k) {last_rows(3)}')} END AS d FROM k")
def stochastic_14_3(spark, sf_dir):
    rows = order_bars(spark, sf_dir).withColumn("k", w.stochastic_k("high", "low", "close"))
    return _out(rows, k=F.col("k"), d=w.sma("k", 3))


_AB = f"ab AS (SELECT {KEY}, close, CASE WHEN count(close) {last_rows(20)} = 20 THEN avg(close) {last_rows(20)} END AS a, CASE WHEN count(close) {last_rows(50)} = 50 THEN avg(close) {last_rows(50)} END AS b FROM bars)"


@query("cross_strict", f"WITH {BARS}, {_AB}, d AS (SELECT {KEY}, a - b AS d, lag(a - b) OVER ({S}) AS p FROM ab) SELECT {KEY}, coalesce(CASE WHEN p <= 0 AND d > 0 THEN 1 WHEN p >= 0 AND d < 0 THEN -1 END, 0) AS crossed FROM d")
def cross_strict(spark, sf_dir):
    rows = order_bars(spark, sf_dir).withColumns({"a": w.sma("close", 20), "b": w.sma("close", 50)})
    return rows.select("asset_id", "date", w.strict_cross(F.col("a"), F.col("b")).alias("crossed"))


@query("cross_hysteresis", f"WITH {BARS}, {_AB}, s AS (SELECT {KEY}, CASE WHEN a > b * 1.02 THEN 1 WHEN a < b * 0.98 THEN -1 END AS s FROM ab), h AS (SELECT {KEY}, s, last_value(s IGNORE NULLS) OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS held FROM s) SELECT {KEY}, coalesce(CASE WHEN s <> held THEN s END, 0) AS crossed FROM h")
def cross_hysteresis(spark, sf_dir):
    rows = order_bars(spark, sf_dir).withColumns({"a": w.sma("close", 20), "b": w.sma("close", 50)})
    rows = rows.withColumn("s", w.band_state(F.col("a"), F.col("b"), 0.02))
    return rows.select("asset_id", "date", w.hysteresis_cross(F.col("s")).alias("crossed"))


@query("zscore_prior_90", f"WITH {BARS} SELECT {KEY}, CASE WHEN count(close) {rows_before(90)} >= 60 THEN {r(f'(close - avg(close) {rows_before(90)}) / nullif(stddev_pop(close) {rows_before(90)}, 0)')} END AS z FROM bars")
def zscore_prior_90(spark, sf_dir):
    return _out(order_bars(spark, sf_dir), z=w.zscore_prior("close", 90, 60))


_EXP = "ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"


@query("zscore_expanding", f"WITH {BARS} SELECT {KEY}, CASE WHEN count(close) {over(_EXP)} >= 30 THEN {r(f'(close - avg(close) {over(_EXP)}) / nullif(stddev_pop(close) {over(_EXP)}, 0)')} END AS z FROM bars")
def zscore_expanding(spark, sf_dir):
    return _out(order_bars(spark, sf_dir), z=w.zscore_expanding("close", 30))


@query("pctrank_prior", f"""WITH {MARKET}, n AS (SELECT asset_id, date, close, row_number() OVER ({S}) AS i FROM bars)
  SELECT a.asset_id, a.date, CASE WHEN a.i > 52 THEN {r('sum((b.close <= a.close)::INT) / nullif(a.i - 1, 0)')} END AS rank
  FROM n a LEFT JOIN n b ON b.i < a.i GROUP BY a.asset_id, a.date, a.i""")
def pctrank_prior(spark, sf_dir):
    return _out(scans.with_ranks(market_bars(spark, sf_dir).select("asset_id", "date", "close"), {"close": "_rank"}, 52), rank=F.col("_rank"))


@query("rolling_sum_guarded", f"WITH {BARS}, v AS (SELECT *, CASE WHEN close > 200000 THEN volume END AS big FROM bars) SELECT {KEY}, CASE WHEN count(big) {last_rows(10)} >= 8 THEN {r(f'sum(big) {last_rows(10)}', '1e1')} END AS total FROM v")
def rolling_sum_guarded(spark, sf_dir):
    rows = order_bars(spark, sf_dir).withColumn("big", F.when(F.col("close") > 200000, F.col("volume")))
    return rows.select("asset_id", "date", rounded(w.rolling_sum("big", 10), 1e1).alias("total"))


@query("change_k_rows", f"WITH {BARS} SELECT {KEY}, {r(f'close / nullif(lag(close, 30) OVER ({S}), 0) - 1')} AS change30, {r(f'close - lag(close, 7) OVER ({S})', '1e2')} AS difference7 FROM bars")
def change_k_rows(spark, sf_dir):
    rows = order_bars(spark, sf_dir)
    return rows.select("asset_id", "date", rounded(w.change("close", 30)).alias("change30"), rounded(F.col("close") - F.lag("close", 7).over(w.series()), 1e2).alias("difference7"))


@query("drawdown_running", f"WITH {BARS} SELECT {KEY}, {r(f'close / max(close) {over(_EXP)} - 1')} AS drawdown, CASE WHEN count(close) {last_rows(60)} = 60 THEN {r(f'close / min(close) {last_rows(60)} - 1')} END AS rebound60 FROM bars")
def drawdown_running(spark, sf_dir):
    return _out(order_bars(spark, sf_dir), drawdown=w.drawdown("close"), rebound60=w.rebound("close", 60))


@query("channel_residual_quantile", f"""WITH {MARKET}, t AS (SELECT {KEY}, close, CASE WHEN count(close) {last_rows(126)} = 126 THEN avg(close) {last_rows(126)} END AS trend FROM bars),
  d AS (SELECT *, CASE WHEN trend > 0 AND close > 0 THEN ln(close / trend) END AS distance FROM t),
  q AS (SELECT *, count(distance) {rows_before(1260)} AS n, quantile_cont(distance, 0.025) {rows_before(1260)} AS lo, quantile_cont(distance, 0.99) {rows_before(1260)} AS hi FROM d)
  SELECT {KEY}, {r('trend', '1e2')} AS trend, {r('trend * exp(lo)', '1e2')} AS lower, {r('trend * exp(hi)', '1e2')} AS upper FROM q WHERE n >= 756""")
def channel_residual_quantile(spark, sf_dir):
    rows = market_bars(spark, sf_dir).withColumn("trend", w.sma("close", 126))
    rows = rows.withColumn("distance", log_ratio(F.col("close"), F.col("trend")))
    bounds = w.channel_bounds("close", 126, 1260, 756, 0.025, 0.99)
    rows = rows.withColumns({"lo": bounds["low_distance"], "hi": bounds["high_distance"]}).where("lo IS NOT NULL")
    trend = F.col("trend")
    return rows.select("asset_id", "date", rounded(trend, 1e2).alias("trend"), rounded(trend * F.exp("lo"), 1e2).alias("lower"), rounded(trend * F.exp("hi"), 1e2).alias("upper"))


@query("rel_volume", f"WITH {BARS}, m AS (SELECT {KEY}, volume, quantile_cont(CASE WHEN volume > 0 THEN volume END, 0.5) {last_rows(90)} AS usual FROM bars) SELECT {KEY}, {r('coalesce(CASE WHEN volume > 0 AND usual > 0 THEN ln(1 + volume / usual) END, 0)')} AS rel FROM m")
def rel_volume(spark, sf_dir):
    return _out(order_bars(spark, sf_dir), rel=w.relative_volume("volume"))


_PAIR = f"""pair AS (SELECT date, ln(a.close / lag(a.close) OVER (ORDER BY date)) AS ra, ln(b.close / lag(b.close) OVER (ORDER BY date)) AS rb
  FROM (SELECT * FROM bars WHERE asset_id = '1-URGENT') a JOIN (SELECT * FROM bars WHERE asset_id = '5-LOW') b USING (date))"""


def aligned_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Returns of two assets over the days that both have."""
    bars = order_bars(spark, sf_dir)
    one = bars.where("asset_id = '1-URGENT'").select("date", F.col("close").alias("close_a"))
    two = bars.where("asset_id = '5-LOW'").select("date", F.col("close").alias("close_b"))
    both = one.join(two, "date").withColumn("asset_id", F.lit("pair"))
    return both.withColumns({"ra": w.log_return("close_a"), "rb": w.log_return("close_b")})


@query("join_aligned_pair", f"WITH {BARS}, {_PAIR} SELECT date, {r('ra')} AS ra, {r('rb')} AS rb FROM pair")
def join_aligned_pair(spark, sf_dir):
    return aligned_pair(spark, sf_dir).select("date", rounded("ra").alias("ra"), rounded("rb").alias("rb"))


_F90 = "OVER (ORDER BY date ROWS BETWEEN 89 PRECEDING AND CURRENT ROW)"


@query("corr_beta_rolling", f"""WITH {BARS}, {_PAIR}, p AS (SELECT date, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN ra END AS x, CASE WHEN ra IS NOT NULL AND rb IS NOT NULL THEN rb END AS y FROM pair)
  SELECT date, {r(f'coalesce(covar_pop(x, y) {_F90} / nullif(stddev_pop(x) {_F90} * stddev_pop(y) {_F90}, 0), 0)')} AS corr, {r(f'coalesce(covar_pop(x, y) {_F90} / nullif(var_pop(y) {_F90}, 0), 0)')} AS beta FROM p""")
def corr_beta_rolling(spark, sf_dir):
    rows = aligned_pair(spark, sf_dir)
    frame = w.trailing(90)
    return rows.select("date", rounded(w.correlation("ra", "rb", frame)).alias("corr"), rounded(w.beta("ra", "rb", frame)).alias("beta"))


@query("skew_g1", f"WITH {BARS}, {RET}, k AS (SELECT {KEY}, skewness(ret) {last_rows(60)} AS g, count(ret) {last_rows(60)} AS n FROM rets) SELECT {KEY}, {r('g', '1e3')} AS skew FROM k WHERE n = 60")
def skew_g1(spark, sf_dir):
    rows = _returns(spark, sf_dir).withColumn("g", w.skew_adjusted("ret", 60)).where("g IS NOT NULL")
    return rows.select("asset_id", "date", rounded("g", 1e3).alias("skew"))


def _ema_sql(n: int, source: str = "s", value: str = "v", out: str = "e") -> str:
    a = 2.0 / (n + 1)
    return f"""{out}(asset_id, i, x) AS (SELECT asset_id, i, {value} FROM {source} WHERE i = 1
  UNION ALL SELECT s.asset_id, s.i, {a!r} * s.{value} + (1 - {a!r}) * e.x FROM {out} e JOIN {source} s ON s.asset_id = e.asset_id AND s.i = e.i + 1)"""


_NUM = f"s AS (SELECT asset_id, date, close AS v, row_number() OVER ({S}) AS i FROM bars)"


@query("ema_12", f"WITH RECURSIVE {MARKET}, {_NUM}, {_ema_sql(12)} SELECT s.asset_id, s.date, {r('x', '1e2')} AS ema FROM s JOIN e USING (asset_id, i)")
def ema_12(spark, sf_dir):
    rows = scans.scan(market_bars(spark, sf_dir), ["asset_id"], ["date"], lambda g: {"ema": scans.ema(g["close"].to_numpy(), 12)}, "ema double")
    return rows.select("asset_id", "date", rounded("ema", 1e2).alias("ema"))


@query("macd_12_26_9", f"""WITH RECURSIVE {MARKET}, {_NUM}, {_ema_sql(12, out='e')}, {_ema_sql(26, out='f')},
  l AS (SELECT asset_id, i, e.x - f.x AS v FROM e JOIN f USING (asset_id, i)), {_ema_sql(9, source='l', out='g').replace('FROM l WHERE', 'FROM l WHERE').replace(' s.', ' s.')}
  SELECT s.asset_id, s.date, {r('l.v', '1e2')} AS line, {r('g.x', '1e2')} AS signal FROM s JOIN l USING (asset_id, i) JOIN g USING (asset_id, i)""")
def macd_12_26_9(spark, sf_dir):
    def step(g):
        line, signal = scans.macd(g["close"].to_numpy())
        return {"line": line, "signal": signal}

    rows = scans.scan(market_bars(spark, sf_dir), ["asset_id"], ["date"], step, "line double, signal double")
    return rows.select("asset_id", "date", rounded("line", 1e2).alias("line"), rounded("signal", 1e2).alias("signal"))


@query("rsi_14", f"""WITH RECURSIVE {MARKET}, m AS (SELECT asset_id, date, close - lag(close) OVER ({S}) AS d, row_number() OVER ({S}) AS i FROM bars),
  seed AS (SELECT asset_id, avg(greatest(d, 0)) AS up, avg(greatest(-d, 0)) AS down FROM m WHERE i BETWEEN 2 AND 15 GROUP BY 1 HAVING count(*) = 14),
  w(asset_id, i, up, down) AS (SELECT asset_id, 15::BIGINT, up, down FROM seed
  UNION ALL SELECT m.asset_id, m.i, (w.up * 13 + greatest(m.d, 0)) / 14, (w.down * 13 + greatest(-m.d, 0)) / 14 FROM w JOIN m ON m.asset_id = w.asset_id AND m.i = w.i + 1)
  SELECT m.asset_id, m.date, {r('CASE WHEN up = 0 AND down = 0 THEN 50 WHEN down = 0 THEN 100 ELSE 100 - 100 / (1 + up / down) END')} AS rsi FROM m LEFT JOIN w USING (asset_id, i)""")
def rsi_14(spark, sf_dir):
    rows = scans.scan(market_bars(spark, sf_dir), ["asset_id"], ["date"], lambda g: {"rsi": scans.wilder_rsi(g["close"].to_numpy())}, "rsi double")
    return rows.select("asset_id", "date", rounded(F.nanvl("rsi", F.lit(None).cast("double"))).alias("rsi"))


@query("expanding_premium", f"WITH {BARS}, {RET} SELECT {KEY}, {r(f'avg(greatest(-0.05, least(0.05, ret))) {over(_EXP)}')} AS premium FROM rets")
def expanding_premium(spark, sf_dir):
    return _out(_returns(spark, sf_dir), premium=F.avg(clamp(F.col("ret"), -0.05, 0.05)).over(w.expanding()))


@query("indicator_events", f"""WITH {BARS}, b AS (SELECT {KEY}, close, avg(close) {last_rows(20)} AS m, stddev_pop(close) {last_rows(20)} AS s, count(close) {last_rows(20)} AS n FROM bars),
  e AS (SELECT {KEY}, close, CASE WHEN n = 20 THEN m - 2 * s END AS lo, CASE WHEN n = 20 THEN m + 2 * s END AS hi FROM b),
  p AS (SELECT *, lag(close) OVER ({S}) AS pc, lag(lo) OVER ({S}) AS plo, lag(hi) OVER ({S}) AS phi FROM e)
  SELECT {KEY}, CASE WHEN pc < plo AND close >= lo THEN 1 ELSE -1 END AS signal FROM p WHERE (pc < plo AND close >= lo) OR (pc > phi AND close <= hi)""")
def indicator_events(spark, sf_dir):
    """Days on which the close comes back inside its bands."""
    bands = w.bollinger("close")
    rows = order_bars(spark, sf_dir).withColumns({"lo": bands["lower"], "hi": bands["upper"]})
    before = lambda c: F.lag(c).over(w.series())
    signal = F.when((before("close") < before("lo")) & (F.col("close") >= F.col("lo")), 1).when((before("close") > before("hi")) & (F.col("close") <= F.col("hi")), -1)
    return rows.withColumn("signal", signal).where("signal IS NOT NULL").select("asset_id", "date", "signal")


@query("change_k_days", f"""WITH {MACRO} SELECT a.date, {r('a.revenue / nullif(b.revenue, 0) - 1')} AS change90
  FROM macro a ASOF LEFT JOIN macro b ON (a.date - INTERVAL 90 DAY)::DATE >= b.date""")
def change_k_days(spark, sf_dir):
    """Change against the value on or before 90 days earlier, on an irregular series."""
    from tidewell.operators.joins import asof_join

    macro = monthly_macro(spark, sf_dir)
    found = asof_join(macro.select("date", "revenue"), macro.select("date", F.col("revenue").alias("before")), ["before"], lag_days=90)
    return found.select("date", rounded(F.col("revenue") / F.nullif("before", F.lit(0.0)) - 1).alias("change90"))
