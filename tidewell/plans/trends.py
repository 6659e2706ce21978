"""Queries of momentum, expanding scores, whole-series signals, hit tests and anchors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import fnv1a, rounded
from tidewell.operators import scans
from tidewell.operators import windows as w
from tidewell.plans.common import BARS, MARKET, S, last_rows, over, query, r
from tidewell.plans.forecasting import _cdf_sql
from tidewell.functions import scalars as sc
from tidewell.sources.bars import market_bars, order_bars

_PRIOR = over("ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING")
_RETS = f"rets AS (SELECT *, ln(close / lag(close) OVER ({S})) AS ret FROM bars)"


def _full(expression: str, counted: str, n: int) -> str:
    return f"CASE WHEN count({counted}) {last_rows(n)} = {n} THEN {expression} END"


@query("momentum_drift", f"WITH {BARS} SELECT asset_id, date, {r(f'ln(close / lag(close, 63) OVER ({S})) / 63', '1e8')} AS drift FROM bars")
def momentum_drift(spark, sf_dir):
    """Drift of a day over the last 63 bars."""
    return order_bars(spark, sf_dir).select("asset_id", "date", rounded(w.log_return("close", 63) / 63, 1e8).alias("drift"))


@query("pctrank_expanding", f"""WITH {MARKET}, n AS (SELECT asset_id, date, close, row_number() OVER ({S}) AS i FROM bars)
  SELECT a.asset_id, a.date, CASE WHEN a.i >= 30 THEN {r('sum((b.close <= a.close)::INT) / a.i')} END AS rank FROM n a JOIN n b ON b.i <= a.i GROUP BY a.asset_id, a.date, a.i""")
def pctrank_expanding(spark, sf_dir):
    """Share of the rows up to this one, itself included, that are not above it."""
    rows = scans.with_ranks(market_bars(spark, sf_dir).select("asset_id", "date", "close"), {"close": "_rank"}, 30, inclusive=True)
    return rows.select("asset_id", "date", rounded("_rank").alias("rank"))


@query("momentum_features", f"""WITH {BARS}, {_RETS}
  SELECT asset_id, date, {r(_full(f'avg((ret > 0)::INT) {last_rows(30)}', 'ret', 30))} AS up_share, {r(_full(f'close / avg(close) {last_rows(50)} - 1', 'close', 50))} AS sma_gap,
  {r(f"({_full(f'stddev_samp(ret) {last_rows(30)}', 'ret', 30)}) / nullif({_full(f'stddev_samp(ret) {last_rows(90)}', 'ret', 90)}, 0)")} AS vol_ratio FROM rets""")
def momentum_features(spark, sf_dir):
    """Share of rising days in 30, distance from the 50-day mean, and volatility of 30 days to that of 90."""
    rows = order_bars(spark, sf_dir).withColumn("ret", w.log_return("close"))
    rising = w.full(F.avg((F.col("ret") > 0).cast("int")).over(w.trailing(30)), F.col("ret"), w.trailing(30), 30)
    ratio = w.deviation("ret", 30) / F.nullif(w.deviation("ret", 90), F.lit(0.0))
    return rows.select("asset_id", "date", rounded(rising).alias("up_share"), rounded(F.col("close") / w.sma("close", 50) - 1).alias("sma_gap"), rounded(ratio).alias("vol_ratio"))


@query("feature_trends", f"""WITH {BARS}, t AS (SELECT asset_id, date, ln(close / lag(close, 30) OVER ({S})) AS close_trend, ln(volume / lag(volume, 30) OVER ({S})) AS volume_trend,
  ln((high - low) / nullif(lag(high - low, 30) OVER ({S}), 0)) AS range_trend FROM (SELECT asset_id, date, close, volume, nullif(high, low) AS high, low FROM bars))
  SELECT asset_id, date, {r('close_trend')} AS close_trend, {r('volume_trend')} AS volume_trend, {r('list_avg([close_trend, volume_trend, range_trend])')} AS mean_trend FROM t""")
def feature_trends(spark, sf_dir):
    """Log change of features over 30 bars, and the mean of those that are there; a day without a range has no range trend."""
    rows = order_bars(spark, sf_dir).withColumn("range", F.nullif(F.col("high") - F.col("low"), F.lit(0.0)))
    trends = [w.log_return(c, 30) for c in ("close", "volume", "range")]
    there = F.filter(F.array(*trends), lambda t: t.isNotNull())
    mean = F.when(F.size(there) > 0, F.aggregate(there, F.lit(0.0), lambda a, t: a + t) / F.size(there))
    return rows.select("asset_id", "date", rounded(trends[0]).alias("close_trend"), rounded(trends[1]).alias("volume_trend"), rounded(mean).alias("mean_trend"))


@query("zscore_prior_clamped", f"""WITH {BARS} SELECT asset_id, date, CASE WHEN count(close) {_PRIOR} >= 365
  THEN {r(f'greatest(-4, least(4, (close - avg(close) {_PRIOR}) / nullif(stddev_pop(close) {_PRIOR}, 0)))')} END AS z FROM bars""")
def zscore_prior_clamped(spark, sf_dir):
    """Distance from all earlier rows, once there are 365, held to four deviations."""
    before = w.all_prior()
    z = (F.col("close") - F.avg("close").over(before)) / F.nullif(F.stddev_pop("close").over(before), F.lit(0.0))
    held = F.greatest(F.lit(-4.0), F.least(F.lit(4.0), z))
    return order_bars(spark, sf_dir).select("asset_id", "date", rounded(F.when(F.count("close").over(before) >= 365, held)).alias("z"))


#: Upper bounds of the signals of a valuation score.
SIGNALS = ((0, "Deep Value"), (2, "Undervalued"), (3.5, "Fair Value"), (7, "Overvalued"))
_SIGNAL = "CASE " + " ".join(f"WHEN z < {bound} THEN '{name}'" for bound, name in SIGNALS) + " ELSE 'Extreme' END"


def signal_of(z: Column) -> Column:
    out = F.when(z < SIGNALS[0][0], SIGNALS[0][1])
    for bound, name in SIGNALS[1:]:
        out = out.when(z < bound, name)
    return out.otherwise("Extreme")


@query("series_z_signal", f"""WITH {BARS}, z AS (SELECT asset_id, date, (close - avg(close) OVER (PARTITION BY asset_id)) / nullif(stddev_pop(close) OVER (PARTITION BY asset_id), 0) AS z FROM bars)
  SELECT asset_id, date, {r('z', '1e3')} AS z, {_SIGNAL} AS signal FROM z WHERE z IS NOT NULL""")
def series_z_signal(spark, sf_dir):
    """Distance of each row from the mean of its whole series, in deviations, and the signal of its range."""
    stats = order_bars(spark, sf_dir).groupBy("asset_id").agg(F.avg("close").alias("mean"), F.stddev_pop("close").alias("spread"))
    rows = order_bars(spark, sf_dir).join(F.broadcast(stats), "asset_id")  # a row for each asset
    rows = rows.withColumn("z", (F.col("close") - F.col("mean")) / F.nullif("spread", F.lit(0.0))).where("z IS NOT NULL")
    return rows.select("asset_id", "date", rounded("z", 1e3).alias("z"), signal_of(F.col("z")).alias("signal"))


def binomial_two_sided(rows: DataFrame, keys: list[str], hits: str, trials: str) -> DataFrame:
    """keys, hits, trials, p: twice the tail of a fair coin from the larger count on, 1 at most.

    Logarithms of the combinations are running sums of ln((n - k + 1) / k).
    """
    k = F.explode(F.sequence(F.lit(1), F.col(trials).cast("int"))).alias("k")
    along = Window.partitionBy(*keys).orderBy("k")
    steps = rows.where(F.col(trials) > 0).select(*keys, hits, trials, k)
    log_c = F.sum(F.ln((F.col(trials) - F.col("k") + 1) / F.col("k"))).over(along)
    tail = steps.withColumn("log_c", log_c).where(F.col("k") >= F.greatest(F.col(hits), F.col(trials) - F.col(hits)))
    whole = F.sum(F.exp(F.col("log_c") - F.col(trials) * F.ln(F.lit(2.0))))
    return tail.groupBy(*keys, hits, trials).agg(F.least(F.lit(1.0), 2 * whole).alias("p"))


@query("binomial_hits", f"""WITH {BARS}, {_RETS}, h AS (SELECT asset_id, count(*) FILTER (ret > 0) AS hits, count(ret) AS trials FROM rets WHERE date < DATE '1996-01-01' GROUP BY 1),
  k AS (SELECT *, unnest(range(greatest(hits, trials - hits), trials + 1)) AS k FROM h)
  SELECT asset_id, hits, trials, {r('least(1.0, 2 * sum(exp(lgamma(trials + 1) - lgamma(k + 1) - lgamma(trials - k + 1) - trials * ln(2))))', '1e7')} AS p FROM k GROUP BY ALL""")
def binomial_hits(spark, sf_dir):
    """Whether the days of the first years rise more or less often than a fair coin."""
    rets = order_bars(spark, sf_dir).withColumn("ret", w.log_return("close")).where("date < DATE'1996-01-01' AND ret IS NOT NULL")
    counts = rets.groupBy("asset_id").agg(F.count_if(F.col("ret") > 0).alias("hits"), F.count("ret").alias("trials"))
    return binomial_two_sided(counts, ["asset_id"], "hits", "trials").select("asset_id", "hits", "trials", rounded("p", 1e7).alias("p"))


@query("paired_t", f"""WITH {BARS}, f AS (SELECT asset_id, abs(ln(close / lag(close, 1) OVER ({S}))) - abs(ln(close / avg(close) OVER ({S} ROWS BETWEEN 5 PRECEDING AND 1 PRECEDING))) AS d FROM bars),
  s AS (SELECT asset_id, count(d) AS n, avg(d) AS mean, avg(d) / nullif(stddev_samp(d) / sqrt(count(d)), 0) AS t FROM f WHERE d IS NOT NULL GROUP BY 1)
  SELECT asset_id, n, {r('mean')} AS mean, {r('t')} AS t, {r(f"2 * (1 - {_cdf_sql('abs(t)')})")} AS p FROM s""")
def paired_t(spark, sf_dir):
    """Absolute log errors of the last close less those of the mean of five, paired by day; p by the normal distribution."""
    before = F.avg("close").over(w.prior(5))
    rows = order_bars(spark, sf_dir).select("asset_id", (F.abs(w.log_return("close")) - F.abs(F.ln(F.col("close") / before))).alias("d")).where("d IS NOT NULL")
    found = rows.groupBy("asset_id").agg(F.count("d").alias("n"), F.avg("d").alias("mean"), F.stddev_samp("d").alias("spread"))
    t = F.col("mean") / F.nullif(F.col("spread") / F.sqrt("n"), F.lit(0.0))
    return found.withColumn("t", t).select("asset_id", "n", rounded("mean").alias("mean"), rounded("t").alias("t"), rounded(2 * (1 - sc.normal_cdf(F.abs("t")))).alias("p"))


@query("max_drawdown_compounded", f"""WITH {BARS}, {_RETS}, e AS (SELECT asset_id, date, exp(sum(ret / 20) OVER ({S} ROWS UNBOUNDED PRECEDING)) AS wealth FROM rets WHERE ret IS NOT NULL),
  p AS (SELECT asset_id, wealth / greatest(1.0, max(wealth) OVER ({S} ROWS UNBOUNDED PRECEDING)) - 1 AS fall FROM e)
  SELECT asset_id, {r('least(0.0, min(fall))')} AS drawdown FROM p GROUP BY 1""")
def max_drawdown_compounded(spark, sf_dir):
    """Deepest fall of compounded returns (a twentieth of the log returns) from their peak, which is 1 at least."""
    rows = order_bars(spark, sf_dir).withColumn("ret", w.log_return("close") / 20).where("ret IS NOT NULL")
    rows = rows.withColumn("wealth", F.exp(F.sum("ret").over(w.expanding())))
    rows = rows.withColumn("fall", F.col("wealth") / F.greatest(F.lit(1.0), F.max("wealth").over(w.expanding())) - 1)
    return rows.groupBy("asset_id").agg(rounded(F.least(F.lit(0.0), F.min("fall"))).alias("drawdown"))


#: Rows of the ranges of a chart.
RANGES = (("1M", 30), ("3M", 90), ("6M", 180), ("1Y", 365))


@query("range_slices", f"""WITH {BARS}, n AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY date DESC) AS i FROM bars),
  g(name, days) AS (VALUES {", ".join(f"('{name}', {days})" for name, days in RANGES)}, ('ALL', 2147483647))
  SELECT asset_id, name, count(*) AS n, min(date) AS first_date, {r('arg_max(close, date) / arg_min(close, date) - 1')} AS change FROM n JOIN g ON i <= days GROUP BY 1, 2""")
def range_slices(spark, sf_dir):
    """The last rows of each chart range: how many, since when, and the change over them."""
    last = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("date")))
    names = F.filter(F.array(*(F.when(F.col("i") <= days, F.lit(name)) for name, days in RANGES), F.lit("ALL")), lambda x: x.isNotNull())
    rows = order_bars(spark, sf_dir).withColumn("i", last).withColumn("name", F.explode(names))
    change = F.max_by("close", "date") / F.min_by("close", "date") - 1
    return rows.groupBy("asset_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min("date").alias("first_date"), rounded(change).alias("change"))


def interpolate(points: DataFrame, anchors: DataFrame, at: str, values: list[str]) -> DataFrame:
    """The points with each value, linear between the anchors (a short table, broadcast) before and after; the last anchor's beyond it, the first one's up to 0.

    ``anchors`` has the column ``at`` too; of values, variances interpolate so, deviations don't.
    """
    along = Window.orderBy(at)  # a row for each anchor
    spans = anchors.select(F.lag(at).over(along).alias("from"), F.col(at).alias("to"), *(x for c in values for x in (F.lag(c).over(along).alias(f"{c}_from"), F.col(c).alias(f"{c}_to"))))
    ends = anchors.agg(*(x for c in [at, *values] for x in (F.min_by(c, at).alias(f"{c}_first"), F.max_by(c, at).alias(f"{c}_last"))))
    place = F.greatest(F.col(at), F.lit(0))
    met = points.join(F.broadcast(spans.where("`from` IS NOT NULL")), (place > F.col("from")) & (place <= F.col("to")), "left").join(F.broadcast(ends), F.lit(True), "left")
    share = (place - F.col("from")) / (F.col("to") - F.col("from"))
    between = lambda c: F.col(f"{c}_from") + share * (F.col(f"{c}_to") - F.col(f"{c}_from"))
    outside = lambda c: F.when(place <= F.col(f"{at}_first"), F.col(f"{c}_first")).otherwise(F.col(f"{c}_last"))
    return met.select(*points.columns, *(F.when(F.col("from").isNotNull(), between(c)).otherwise(outside(c)).alias(c) for c in values))


_ANCHORS = ((0, 0.0, 0.0), (5, 0.004, 0.0016), (19, 0.012, 0.0061), (60, 0.03, 0.02), (250, 0.11, 0.09))


@query("anchor_interpolate", f"""WITH a(s, m, v) AS (VALUES {", ".join(map(str, _ANCHORS))}), b AS (SELECT s, m, v, lag(s) OVER (ORDER BY s) AS s0, lag(m) OVER (ORDER BY s) AS m0, lag(v) OVER (ORDER BY s) AS v0 FROM a),
  p AS (SELECT unnest(range(-2, 300))::INT AS sessions)
  SELECT sessions, {r('CASE WHEN sessions > 250 THEN 0.11 WHEN sessions <= 0 THEN 0 ELSE m0 + (sessions - s0) / (s - s0) * (m - m0) END', '1e9')} AS median,
  {r('CASE WHEN sessions > 250 THEN 0.09 WHEN sessions <= 0 THEN 0 ELSE v0 + (sessions - s0) / (s - s0) * (v - v0) END', '1e9')} AS variance FROM p LEFT JOIN b ON sessions > s0 AND sessions <= s""")
def anchor_interpolate(spark, sf_dir):
    """Median and variance of a horizon in sessions between those of the anchor horizons."""
    anchors = spark.createDataFrame(_ANCHORS, "sessions int, median double, variance double")
    points = spark.range(-2, 300).select(F.col("id").cast("int").alias("sessions"))
    found = interpolate(points, anchors, "sessions", ["median", "variance"])
    return found.select("sessions", rounded("median", 1e9).alias("median"), rounded("variance", 1e9).alias("variance"))


@query("fnv_seeds", f"""WITH {BARS}, a AS (SELECT DISTINCT asset_id FROM bars)
  SELECT asset_id, list_reduce(list_prepend(2166136261::HUGEINT, list_transform(string_split(asset_id || '|30', ''), lambda c: ascii(c)::HUGEINT)),
    lambda h, c: (xor(h, c) * 16777619) % 4294967296)::BIGINT AS seed FROM a""")
def fnv_seeds(spark, sf_dir):
    """Seeds of paths from their identities."""
    assets = order_bars(spark, sf_dir).select("asset_id").distinct()
    return assets.select("asset_id", fnv1a(F.concat(F.col("asset_id"), F.lit("|30"))).alias("seed"))
