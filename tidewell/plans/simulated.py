"""Queries of simulation, resampling, refits and streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import rounded
from tidewell.operators import models
from tidewell.operators import simulation as sim
from tidewell.operators import windows as w
from tidewell.plans.common import MARKET, S, last_rows, query, r
from tidewell.sources.bars import market_bars, table
from tidewell.streaming import ticks


def _returns(spark, sf_dir):
    return market_bars(spark, sf_dir).withColumn("ret", w.log_return("close"))


@query("block_bootstrap")
def block_bootstrap(spark, sf_dir):
    """The 5 % bound of the mean return in 400 circular block samples."""
    means = sim.bootstrap_means(spark, sim.series(_returns(spark, sf_dir), "ret"), 30, 400, 17)
    return sim.lower_bound(means).select(rounded("bound", 1e6).alias("bound"))


@query("mc_traces")
def mc_traces(spark, sf_dir):
    rows = _returns(spark, sf_dir)
    closes = sim.series(rows, "close")
    return sim.paths(spark, float(closes[-1]), sim.series(rows, "ret") / 20, 90, 12, 5)


@query("mc_heatmap")
def mc_heatmap(spark, sf_dir):
    rows = _returns(spark, sf_dir)
    closes = sim.series(rows, "close")
    simulated = sim.paths(spark, float(closes[-1]), sim.series(rows, "ret") / 20, 60, 500, 9, decay=0.98)
    return sim.heatmap(simulated).select("day", "band", "n", rounded("density").alias("density"))


@query("mc_drawdown")
def mc_drawdown(spark, sf_dir):
    rows = _returns(spark, sf_dir)
    closes = sim.series(rows, "close")
    falls = sim.path_drawdowns(sim.paths(spark, float(closes[-1]), sim.series(rows, "ret") / 20, 180, 500, 3))
    return falls.agg(rounded(F.avg("drawdown")).alias("mean_drawdown"), rounded(F.percentile("drawdown", F.lit(0.05))).alias("p95_drawdown"))


@query("circular_shift_p", f"""WITH {MARKET}, v AS (SELECT row_number() OVER (ORDER BY date) - 1 AS idx, ln(lead(close, 7) OVER ({S}) / close) AS value, CASE WHEN count(close) {last_rows(20)} = 20 THEN close - avg(close) {last_rows(20)} END AS d FROM bars),
  x AS (SELECT *, lag(d) OVER (ORDER BY idx) AS p FROM v), k AS (SELECT * FROM x WHERE value IS NOT NULL), n AS (SELECT count(*) AS n FROM k),
  e AS (SELECT idx, CASE WHEN p <= 0 AND d > 0 THEN 1 WHEN p >= 0 AND d < 0 THEN -1 END AS side FROM k), s AS (SELECT unnest(range((SELECT n FROM n))) AS shift),
  m AS (SELECT shift, avg(side * k.value) AS mean FROM e CROSS JOIN s JOIN k ON k.idx = (e.idx + shift) % (SELECT n FROM n) WHERE side IS NOT NULL GROUP BY 1), o AS (SELECT mean AS observed FROM m WHERE shift = 0)
  SELECT {r('max(observed)')} AS observed, {r('count(*) FILTER (mean >= observed - 1e-12) / count(*)')} AS p FROM m, o""")
def circular_shift_p(spark, sf_dir):
    rows = market_bars(spark, sf_dir).withColumns({"a": w.sma("close", 20), "value": F.ln(F.lead("close", 7).over(w.series()) / F.col("close"))})
    rows = rows.withColumns({"side": w.strict_cross(F.col("close"), F.col("a")), "idx": F.row_number().over(w.series()) - 1}).where("value IS NOT NULL")
    n = rows.count()
    found = sim.circular_shift_p(rows.where("side <> 0").select("idx", "side"), rows.select("idx", "value"), n)
    return found.select(rounded("observed").alias("observed"), rounded("p").alias("p"))


@query("powerlaw_refit", f"""WITH {MARKET}, n AS (SELECT date, close, ln(date - DATE '{models.GENESIS}') AS x, ln(close) AS y, row_number() OVER (ORDER BY date) - 1 AS i FROM bars),
  f AS (SELECT date, i, x, y, regr_slope(y, x) OVER w AS b, regr_intercept(y, x) OVER w AS a FROM n WINDOW w AS (ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
  SELECT date, {r('b', '1e3')} AS exponent, {r('a + b * x', '1e3')} AS fitted FROM f WHERE i >= 365 AND (i - 365) % 30 = 0""")
def powerlaw_refit(spark, sf_dir):
    """The law fitted to all rows before every 30th day: one pass of running sums, then small solves."""
    rows = market_bars(spark, sf_dir).select("asset_id", "date", "close").withColumn("i", F.row_number().over(w.series()) - 1)
    x = F.ln(F.datediff("date", F.lit(models.GENESIS).cast("date")).cast("double")) - 8.0  # centred: the sums stay well conditioned
    rows = rows.withColumns({"one": F.lit(1.0), "x": x, "y": F.ln("close")})
    grams = sim.gram_rows(rows, ["one", "x"], "y", w.all_prior()).where("i >= 365 AND (i - 365) % 30 = 0")
    solved = sim.solve_grams(grams, ["one", "x"])
    a, b = F.col("coefficients")[0], F.col("coefficients")[1]
    return solved.select("date", rounded(b, 1e3).alias("exponent"), rounded(a + b * F.col("x"), 1e3).alias("fitted"))


@query("ridge_walkforward")
def ridge_walkforward(spark, sf_dir):
    """A ridge of the 30-day return on three features, refitted every 14 rows on rows whose target is known by then."""
    rows = _returns(spark, sf_dir).withColumns({"m7": w.log_return("close", 7), "m30": w.log_return("close", 30), "v": w.deviation("ret", 30), "y": F.ln(F.lead("close", 30).over(w.series()) / F.col("close"))})
    rows = rows.where("m30 IS NOT NULL AND v IS NOT NULL").withColumns({"one": F.lit(1.0), "i": F.row_number().over(w.series()) - 1})
    resolved = w.series().rowsBetween(Window.unboundedPreceding, -31)
    grams = sim.gram_rows(rows.select("asset_id", "date", "i", "one", "m7", "m30", "v", "y"), ["one", "m7", "m30", "v"], "y", resolved)
    due = grams.where("i >= 400 AND i % 14 = 0 AND y IS NOT NULL")
    solved = sim.solve_grams(due, ["one", "m7", "m30", "v"], ridge=5.0)
    c = F.col("coefficients")
    predicted = c[0] + c[1] * F.col("m7") + c[2] * F.col("m30") + c[3] * F.col("v")
    return solved.select("date", rounded(predicted).alias("predicted"), rounded("y").alias("actual"))


@query("stump_score", f"""WITH {MARKET}, f AS (SELECT date, ln(close / lag(close, 7) OVER ({S})) AS m7, ln(close / lag(close, 30) OVER ({S})) AS m30 FROM bars),
  s(feature, threshold, low, high) AS (VALUES ('m7', 0.1::DOUBLE, -0.02::DOUBLE, 0.03::DOUBLE), ('m30', -0.2, 0.01, -0.01), ('m7', -0.5, 0.05, 0.0)),
  l AS (SELECT date, 'm7' AS feature, coalesce(m7, 0) AS x FROM f UNION ALL SELECT date, 'm30', coalesce(m30, 0) FROM f)
  SELECT date, {r('sum(CASE WHEN x > threshold THEN high ELSE low END)')} AS residual FROM l JOIN s USING (feature) GROUP BY date""")
def stump_score(spark, sf_dir):
    """A sum of stumps over features: the stumps are a small table."""
    stumps = spark.createDataFrame([("m7", 0.1, -0.02, 0.03), ("m30", -0.2, 0.01, -0.01), ("m7", -0.5, 0.05, 0.0)], "feature string, threshold double, low double, high double")
    rows = market_bars(spark, sf_dir).withColumns({"m7": w.log_return("close", 7), "m30": w.log_return("close", 30)}).select("date", "m7", "m30")
    long = rows.unpivot("date", ["m7", "m30"], "feature", "x").withColumn("x", F.coalesce("x", F.lit(0.0)))
    value = F.when(F.col("x") > F.col("threshold"), F.col("high")).otherwise(F.col("low"))
    return long.join(F.broadcast(stumps), "feature").groupBy("date").agg(rounded(F.sum(value)).alias("residual"))


@query("ridge_score", f"""WITH {MARKET}, f AS (SELECT date, [ln(close / lag(close, 7) OVER ({S})), ln(close / lag(close, 30) OVER ({S}))] AS x FROM bars)
  SELECT date, {r('greatest(-0.5, least(0.5, 0.01 + (x[1] - 0.02) / 0.9 * 0.05 + (x[2] + 0.01) / 1.1 * -0.03)) * 0.5')} AS predicted FROM f WHERE x[1] IS NOT NULL AND x[2] IS NOT NULL""")
def ridge_score(spark, sf_dir):
    """A frozen ridge: standardise, weigh, clip, shrink; null where a feature is missing."""
    model = [(0.02, 0.9, 0.05), (-0.01, 1.1, -0.03)]
    rows = market_bars(spark, sf_dir).withColumns({"m7": w.log_return("close", 7), "m30": w.log_return("close", 30)}).where("m7 IS NOT NULL AND m30 IS NOT NULL")
    parts = F.arrays_zip(F.array("m7", "m30").alias("x"), F.array(*(F.struct(*(F.lit(v).alias(n) for n, v in zip(("mean", "scale", "weight"), m, strict=True))) for m in model)).alias("m"))
    rows = rows.withColumn("parts", parts)
    total = F.aggregate("parts", F.lit(0.01), lambda acc, p: acc + (p["x"] - p["m"]["mean"]) / p["m"]["scale"] * p["m"]["weight"])
    return rows.select("date", rounded(F.greatest(F.lit(-0.5), F.least(F.lit(0.5), total)) * 0.5).alias("predicted"))


@query("tick_to_bar", "SELECT event_type AS asset_id, ts::DATE AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2")
def tick_to_bar(spark, sf_dir):
    return ticks.bars(table(spark, sf_dir, "events"))


@query("sliding_counts", f"SELECT event_type, start, count(*) AS n, {r('sum(value)', '1e2')} AS total FROM (SELECT event_type, value, unnest([time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01'), time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 6 HOUR, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 12 HOUR, time_bucket(INTERVAL 6 HOUR, ts, TIMESTAMP '2000-01-01') - INTERVAL 18 HOUR]) AS start FROM events) GROUP BY 1, 2")
def sliding_counts(spark, sf_dir):
    return ticks.sliding_counts(table(spark, sf_dir, "events")).withColumn("total", rounded("total", 1e2))


@query("session_counts", """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
  s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM o)
  SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 30 MINUTE AS "end", count(*) AS n FROM s GROUP BY user_id, k""")
def session_counts(spark, sf_dir):
    return ticks.session_counts(table(spark, sf_dir, "events"))


@query("stream_equals_batch", "SELECT event_type AS asset_id, ts::DATE AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, count(*) AS n FROM events GROUP BY 1, 2")
def stream_equals_batch(spark, sf_dir):
    """The bar table that the stream keeps, after it has read all events."""
    root = f"{(spark.conf.get('spark.checkpoint.dir', None) or spark.conf.get('spark.sql.warehouse.dir')).rstrip('/')}/stream-{uuid.uuid4().hex}"
    source = table(spark, sf_dir, "events")
    stream = ticks.event_stream(spark, f"{sf_dir}/[e]vents.parquet", source.schema)
    ticks.write_bars(stream, f"{root}/bars", f"{root}/checkpoint", late=None).awaitTermination()
    return ticks.stored_bars(spark, f"{root}/bars")
