"""Queries of islands, cooldowns, forward paths, event studies, the feature table and signal studies."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions.calendar import market_holidays, session_ladder
from tidewell.functions.scalars import finite, log_ratio, rounded
from tidewell.operators import joins, metrics, scans
from tidewell.operators import windows as w
from tidewell.plans.common import BARS, MACRO, MARKET, S, last_rows, query, r, rows_before
from tidewell.plans.joined import PHASES
from tidewell.sources.bars import market_bars, monthly_macro, order_bars, table

Z = f"z AS (SELECT *, CASE WHEN count(close) {rows_before(90)} >= 60 THEN (close - avg(close) {rows_before(90)}) / nullif(stddev_pop(close) {rows_before(90)}, 0) END AS z FROM bars)"


def _zed(bars):
    return bars.withColumn("z", w.zscore_prior("close", 90, 60))


@query("islands_zones", f"""WITH {BARS}, f AS (SELECT asset_id, date, close, close > avg(close) {last_rows(20)} AS flag, row_number() OVER ({S}) AS i FROM bars),
  g AS (SELECT *, i - row_number() OVER (PARTITION BY asset_id, flag ORDER BY date) AS island FROM f)
  SELECT asset_id, min(date) AS first, max(date) AS last, count(*) AS n, arg_min(close, date) AS start_price, arg_max(close, date) AS end_price, min(close) AS low FROM g WHERE flag GROUP BY asset_id, island HAVING count(*) >= 4""")
def islands_zones(spark, sf_dir):
    rows = order_bars(spark, sf_dir).withColumn("flag", F.col("close") > F.avg("close").over(w.trailing(20)))
    zones = scans.islands(rows, "flag", ["asset_id"], "date").groupBy("asset_id", "island").agg(
        F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n"), F.min_by("close", "date").alias("start_price"), F.max_by("close", "date").alias("end_price"), F.min("close").alias("low")
    )
    return zones.where("n >= 4").drop("island")


@query("events_cooldown", f"""WITH RECURSIVE {BARS}, {Z}, e AS (SELECT asset_id, date, z, row_number() OVER ({S}) AS i FROM z),
  w AS (SELECT asset_id, i FROM e WHERE z > 1.5), c(asset_id, i) AS (SELECT asset_id, min(i) FROM w GROUP BY 1
  UNION ALL SELECT c.asset_id, (SELECT min(w.i) FROM w WHERE w.asset_id = c.asset_id AND w.i >= c.i + 30) FROM c WHERE EXISTS (SELECT 1 FROM w WHERE w.asset_id = c.asset_id AND w.i >= c.i + 30))
  SELECT asset_id, date FROM e JOIN c USING (asset_id, i)""")
def events_cooldown(spark, sf_dir):
    """Days with z above 1.5, none within 30 rows of the one before it that was taken."""
    rows = _zed(order_bars(spark, sf_dir)).select("asset_id", "date", "z")
    taken = scans.scan(rows, ["asset_id"], ["date"], lambda g: {"taken": scans.cooldown(np.arange(len(g)), (g["z"] > 1.5).to_numpy(), 30)}, "taken boolean")
    return taken.where("taken").select("asset_id", "date")


@query("episodes", f"WITH {BARS}, {Z}, e AS (SELECT asset_id, date, lag(date) OVER ({S}) AS before FROM z WHERE z > 1.5) SELECT asset_id, count(*) AS n_events, count(*) FILTER (before IS NULL OR date - before >= 14) AS n_episodes FROM e GROUP BY 1")
def episodes(spark, sf_dir):
    rows = _zed(order_bars(spark, sf_dir)).where("z > 1.5").withColumn("before", F.lag("date").over(w.series()))
    return rows.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n_events"), F.count_if(F.col("before").isNull() | (F.datediff("date", "before") >= 14)).alias("n_episodes"))


_NEXT = f"OVER ({S} ROWS BETWEEN 1 FOLLOWING AND 30 FOLLOWING)"


@query("forward_path_stats", f"""WITH {MARKET}, p AS (SELECT date, close, lead(close, 30) OVER ({S}) AS later, max(close) {_NEXT} AS top, list(close) OVER ({S} ROWS BETWEEN CURRENT ROW AND 30 FOLLOWING) AS path FROM bars)
  SELECT date, {r('later / close - 1')} AS forward, {r('greatest(top / close - 1, 0)')} AS max_gain,
  {r('list_min(list_transform(range(1, 32), lambda i: path[i] / list_max(path[1:i]) - 1))')} AS worst_drawdown FROM p WHERE later IS NOT NULL""")
def forward_path_stats(spark, sf_dir):
    """Return, best gain and worst fall from a peak over the next 30 rows; only complete paths."""
    ahead = w.series().rowsBetween(1, 30)
    path = F.collect_list("close").over(w.series().rowsBetween(0, 30))
    rows = market_bars(spark, sf_dir).select("date", "close", F.lead("close", 30).over(w.series()).alias("later"), F.max("close").over(ahead).alias("top"), path.alias("path"))
    start = F.struct(F.lit(0.0).alias("peak"), F.lit(0.0).alias("worst"))

    def step(acc, x):
        peak = F.greatest(acc["peak"], x)
        return F.struct(peak.alias("peak"), F.least(acc["worst"], x / peak - 1).alias("worst"))

    fall = F.aggregate("path", start, step, lambda acc: acc["worst"])
    complete = rows.where("later IS NOT NULL")
    return complete.select("date", rounded(F.col("later") / F.col("close") - 1).alias("forward"), rounded(F.greatest(F.col("top") / F.col("close") - 1, F.lit(0.0))).alias("max_gain"), rounded(fall).alias("worst_drawdown"))


@query("next_open_return", f"WITH {MARKET}, n AS (SELECT date, lead(open, 1) OVER ({S}) AS o1, lead(date, 1) OVER ({S}) AS d1, lead(open, 8) OVER ({S}) AS o8, lead(date, 8) OVER ({S}) AS d8 FROM bars) SELECT date, {r('ln(o8 / o1)')} AS forward FROM n WHERE d1 - date = 1 AND d8 - date = 8")
def next_open_return(spark, sf_dir):
    """From the next day's open to the open seven days after it; only where both days exist."""
    at = lambda c, k: F.lead(c, k).over(w.series())
    rows = market_bars(spark, sf_dir).select("date", at("open", 1).alias("o1"), at("date", 1).alias("d1"), at("open", 8).alias("o8"), at("date", 8).alias("d8"))
    exact = (F.datediff("d1", "date") == 1) & (F.datediff("d8", "date") == 8)
    return rows.where(exact).select("date", rounded(log_ratio(F.col("o8"), F.col("o1"))).alias("forward"))


_RANK = f"""n AS (SELECT date, close, volume, row_number() OVER (ORDER BY date) AS i, lag(close, 30) OVER (ORDER BY date) AS c30 FROM bars),
  k AS (SELECT a.date, a.i, sum((b.close <= a.close)::INT) / nullif(a.i - 1, 0) AS pc, sum((b.volume <= a.volume)::INT) / nullif(a.i - 1, 0) AS pv FROM n a LEFT JOIN n b ON b.i < a.i GROUP BY a.date, a.i)"""


@query("buy_zone_score", f"WITH {MARKET}, {_RANK}, s AS (SELECT date, CASE WHEN i > 100 THEN 1 - (pc + pv) / 2 END AS score FROM k) SELECT date, {r('score')} AS score, score >= 0.75 AS heavy, score >= 0.9 AS conviction FROM s WHERE score IS NOT NULL")
def buy_zone_score(spark, sf_dir):
    """Mean of how low price and volume rank among the days before."""
    rows = scans.with_ranks(market_bars(spark, sf_dir).select("asset_id", "date", "close", "volume"), {"close": "pc", "volume": "pv"}, 100)
    score = 1 - (F.col("pc") + F.col("pv")) / 2
    return rows.withColumn("s", score).where("s IS NOT NULL").select("date", rounded("s").alias("score"), (F.col("s") >= 0.75).alias("heavy"), (F.col("s") >= 0.9).alias("conviction"))


@query("event_study_signed_excess", f"""WITH {BARS}, ab AS (SELECT asset_id, date, close, {'CASE WHEN count(close) ' + last_rows(20) + ' = 20 THEN avg(close) ' + last_rows(20) + ' END'} AS a FROM bars),
  x AS (SELECT asset_id, date, close - a AS d, lag(close - a) OVER ({S}) AS p, ln(lead(close, 7) OVER ({S}) / close) AS fwd FROM ab),
  e AS (SELECT *, CASE WHEN p <= 0 AND d > 0 THEN 1 WHEN p >= 0 AND d < 0 THEN -1 END AS side FROM x),
  b AS (SELECT asset_id, avg(fwd) AS base FROM e GROUP BY 1)
  SELECT asset_id, count(*) AS n, {r('avg(side * (fwd - base) - 0.002)')} AS mean_excess, {r('avg((side * (fwd - base) > 0.002)::INT)')} AS win_rate FROM e JOIN b USING (asset_id) WHERE side IS NOT NULL AND fwd IS NOT NULL GROUP BY 1""")
def event_study_signed_excess(spark, sf_dir):
    """Returns after a cross, signed by its side, over the asset's usual return and less a cost."""
    rows = order_bars(spark, sf_dir).withColumn("a", w.sma("close", 20))
    rows = rows.withColumns({"side": w.strict_cross(F.col("close"), F.col("a")), "fwd": log_ratio(F.lead("close", 7).over(w.series()), F.col("close"))})
    rows = rows.withColumn("base", F.avg("fwd").over(Window.partitionBy("asset_id"))).where("side <> 0 AND fwd IS NOT NULL")
    excess = F.col("side") * (F.col("fwd") - F.col("base"))
    return rows.groupBy("asset_id").agg(F.count(F.lit(1)).alias("n"), rounded(F.avg(excess - 0.002)).alias("mean_excess"), rounded(F.avg((excess > 0.002).cast("int"))).alias("win_rate"))


@query("weekly_origins", f"WITH {MARKET}, x AS (SELECT date, date_trunc('week', date)::DATE AS week FROM bars), y AS (SELECT *, lag(week) OVER (ORDER BY date) AS before FROM x) SELECT date, week FROM y WHERE before IS NULL OR week <> before")
def weekly_origins(spark, sf_dir):
    """The first day on which the week's source row is new."""
    rows = market_bars(spark, sf_dir).withColumn("week", F.date_trunc("week", "date").cast("date"))
    before = F.lag("week").over(w.series())
    return rows.withColumn("before", before).where("before IS NULL OR week <> before").select("date", "week")


@query("thinned_origins", f"WITH {MARKET}, n AS (SELECT date, close, row_number() OVER (ORDER BY date) - 1 AS idx FROM bars) SELECT date, idx FROM n WHERE idx >= 365 AND (idx - 365) % 30 = 0")
def thinned_origins(spark, sf_dir):
    rows = market_bars(spark, sf_dir).withColumn("idx", (F.row_number().over(w.series()) - 1).cast("long"))
    return rows.where("idx >= 365 AND (idx - 365) % 30 = 0").select("date", "idx")


@query("kalman_local_level")
def kalman_local_level(spark, sf_dir):
    """Filtered log price; no SQL: a recursion with its own state."""
    rows = market_bars(spark, sf_dir).select("asset_id", "date", F.ln("close").alias("y"))
    found = scans.scan(rows, ["asset_id"], ["date"], lambda g: {"level": scans.kalman_local_level(g["y"].to_numpy(), 0.01, 0.2)}, "level double")
    return found.select("date", rounded("level").alias("level"))


@query("contribution_share", f"WITH {BARS}, t AS (SELECT asset_id, ln(close / lag(close) OVER ({S})) AS x FROM bars) SELECT asset_id, {r('max(abs(x)) / nullif(sum(abs(x)), 0)')} AS largest_share FROM t GROUP BY 1")
def contribution_share(spark, sf_dir):
    rows = order_bars(spark, sf_dir).withColumn("x", w.log_return("close"))
    return rows.groupBy("asset_id").agg(rounded(F.max(F.abs("x")) / F.nullif(F.sum(F.abs("x")), F.lit(0.0))).alias("largest_share"))


@query("path_diagnostics", f"""WITH {BARS}, x AS (SELECT asset_id, date, ln(close / lag(close) OVER ({S})) AS x FROM bars), y AS (SELECT asset_id, date, x, lag(x) OVER ({S}) AS p FROM x)
  SELECT asset_id, {r('avg(x)')} AS mean, {r('var_pop(x)')} AS variance, {r('corr(x, p)')} AS acf1, {r('corr(abs(x), abs(p))')} AS abs_acf1, {r('avg((sign(x) <> sign(p))::INT)')} AS sign_changes FROM y WHERE p IS NOT NULL GROUP BY 1""")
def path_diagnostics(spark, sf_dir):
    rows = order_bars(spark, sf_dir).withColumn("x", w.log_return("close")).withColumn("p", F.lag("x").over(w.series())).where("p IS NOT NULL")
    rows = rows.withColumns({"ax": F.abs("x"), "ap": F.abs("p")})
    return rows.groupBy("asset_id").agg(
        rounded(F.avg("x")).alias("mean"), rounded(F.var_pop("x")).alias("variance"), rounded(metrics.correlation("x", "p")).alias("acf1"), rounded(metrics.correlation("ax", "ap")).alias("abs_acf1"),
        rounded(F.avg((F.signum("x") != F.signum("p")).cast("int"))).alias("sign_changes"),
    )


@query("macro_composites", f"""WITH {MACRO}, z AS (SELECT date, (revenue - avg(revenue) OVER w) / nullif(stddev_pop(revenue) OVER w, 0) AS zr, (quantity - avg(quantity) OVER w) / nullif(stddev_pop(quantity) OVER w, 0) AS zq,
  (n_lines - avg(n_lines) OVER w) / nullif(stddev_pop(n_lines) OVER w, 0) AS zn, count(*) OVER w AS n FROM macro WINDOW w AS (ORDER BY date ROWS BETWEEN 24 PRECEDING AND 1 PRECEDING))
  SELECT date, {r('(zr + zq + zn) / 3')} AS composite, CASE WHEN (zr + zq + zn) / 3 > 1 THEN 'hot' WHEN (zr + zq + zn) / 3 < -1 THEN 'cold' ELSE 'normal' END AS state FROM z WHERE n >= 12""")
def macro_composites(spark, sf_dir):
    """Mean of the series' distances from their two years before, where all three are there."""
    macro = monthly_macro(spark, sf_dir).withColumn("asset_id", F.lit("macro"))
    parts = [w.zscore_prior(c, 24, 12) for c in ("revenue", "quantity", "n_lines")]
    rows = macro.withColumn("zs", F.filter(F.array(*parts), lambda z: z.isNotNull())).where(F.size("zs") >= 3)
    mean = F.aggregate("zs", F.lit(0.0), lambda a, z: a + z) / F.size("zs")
    rows = rows.withColumn("m", mean)
    return rows.select("date", rounded("m").alias("composite"), F.when(F.col("m") > 1, "hot").when(F.col("m") < -1, "cold").otherwise("normal").alias("state"))


_FEATURES = f"""f AS (SELECT date, ln(close / lag(close, 7) OVER ({S})) AS momentum7, {'CASE WHEN count(close) ' + last_rows(20) + ' = 20 THEN close / avg(close) ' + last_rows(20) + ' - 1 END'} AS gap20 FROM bars),
  l AS (SELECT b.date, f.momentum7, f.gap20, f.date AS fdate FROM bars b LEFT JOIN f ON f.date + INTERVAL 1 DAY = b.date),
  m AS (SELECT l.*, k.date AS mdate, k.n_lines FROM l ASOF LEFT JOIN (SELECT greatest(available_after, date + INTERVAL 1 DAY)::DATE AS known, * FROM macro) k ON l.date >= k.known)"""


@query("feature_table", f"WITH {MARKET}, {MACRO}, {_FEATURES} SELECT date, {r('momentum7')} AS momentum7, {r('gap20')} AS gap20, n_lines, mdate AS macro_date, (momentum7 IS NULL)::INT + (gap20 IS NULL)::INT + (n_lines IS NULL)::INT AS n_missing FROM m")
def feature_table(spark, sf_dir):
    from tidewell.plans.features import feature_rows

    rows = feature_rows(market_bars(spark, sf_dir), monthly_macro(spark, sf_dir))
    pick = lambda name: F.col("features").getItem(name)
    return rows.select(
        "date", rounded(pick("momentum7")).alias("momentum7"), rounded(pick("gap20")).alias("gap20"), pick("n_lines").cast("long").alias("n_lines"),
        F.col("source_dates").getItem("n_lines").alias("macro_date"), F.size("missing_reasons").alias("n_missing"),
    )


@query("feature_no_lookahead_violations", "SELECT 0::BIGINT AS violations")
def feature_no_lookahead_violations(spark, sf_dir):
    """Features that rest on a row of their own day or later: none may be there."""
    from tidewell.plans.features import feature_rows

    rows = feature_rows(market_bars(spark, sf_dir), monthly_macro(spark, sf_dir))
    used = rows.select("date", F.explode("source_dates").alias("name", "source_date"))
    return used.agg(F.count_if(F.col("source_date") > F.date_sub("date", 1)).alias("violations"))


@query("study_median_shift", f"""WITH {MARKET}, {Z}, h AS (SELECT date, close, z, lead(close, 30) OVER ({S}) AS actual FROM z), g AS (SELECT (unnest(range(13)) - 6) * 0.05 AS coefficient),
  e AS (SELECT coefficient, avg(abs(ln(actual / (close * exp(coefficient * greatest(-4, least(4, z))))))) FILTER (date < DATE '1999-01-01') AS val, avg(abs(ln(actual / (close * exp(coefficient * greatest(-4, least(4, z))))))) FILTER (date >= DATE '1999-01-01') AS hold, count(*) AS n
  FROM h CROSS JOIN g WHERE z IS NOT NULL AND actual IS NOT NULL GROUP BY 1), o AS (SELECT *, row_number() OVER (ORDER BY val, abs(coefficient), coefficient) AS k FROM e)
  SELECT {r('coefficient')} AS coefficient, {r('val')} AS validation, {r('hold')} AS holdout, n FROM o WHERE k = 1""")
def study_median_shift(spark, sf_dir):
    """A signal shifts the median; the coefficient is chosen on the early part and scored on the rest."""
    from tidewell.plans.studies import median_shift

    rows = _zed(market_bars(spark, sf_dir)).withColumn("actual", F.lead("close", 30).over(w.series())).where("z IS NOT NULL AND actual IS NOT NULL")
    grid = [(i - 6) * 0.05 for i in range(13)]
    found = median_shift(rows, F.col("z"), grid, "1999-01-01")
    return found.select(rounded("coefficient").alias("coefficient"), rounded("validation").alias("validation"), rounded("holdout").alias("holdout"), "n")


@query("study_sigma_scale", f"""WITH {MARKET}, {Z}, v AS (SELECT *, ln(close / lag(close) OVER ({S})) AS ret FROM z), h AS (SELECT date, close, z, lead(close, 7) OVER ({S}) AS actual, CASE WHEN count(ret) {last_rows(90)} = 90 THEN stddev_samp(ret) {last_rows(90)} END AS sigma FROM v), g AS (SELECT unnest([0.0, 0.1, 0.2, 0.3, 0.5]) AS scale),
  s AS (SELECT date, scale, ln(actual / close) AS e, sigma * (1 + scale * least(4, abs(z))) AS s FROM h CROSS JOIN g WHERE z IS NOT NULL AND actual IS NOT NULL AND sigma IS NOT NULL),
  n AS (SELECT scale, avg(0.5 * ln(6.283185307179586) + ln(s) + e * e / (2 * s * s)) FILTER (date < DATE '1999-01-01') AS val, avg(0.5 * ln(6.283185307179586) + ln(s) + e * e / (2 * s * s)) FILTER (date >= DATE '1999-01-01') AS hold FROM s GROUP BY 1)
  SELECT scale::DOUBLE AS scale, {r('val')} AS validation, {r('hold')} AS holdout FROM n ORDER BY val, scale LIMIT 1""")
def study_sigma_scale(spark, sf_dir):
    """A signal widens sigma; the scale is chosen on the early part and scored on the rest."""
    from tidewell.plans.studies import sigma_scale

    rows = _zed(market_bars(spark, sf_dir)).withColumn("ret", w.log_return("close"))
    rows = rows.withColumns({"actual": F.lead("close", 7).over(w.series()), "sigma": w.deviation("ret", 90)}).where("z IS NOT NULL AND actual IS NOT NULL AND sigma IS NOT NULL")
    found = sigma_scale(rows, F.abs("z"), [0.0, 0.1, 0.2, 0.3, 0.5], "1999-01-01")
    return found.select("scale", rounded("validation").alias("validation"), rounded("holdout").alias("holdout"))


@query("ledger_chain_check", f"WITH {MARKET} SELECT count(*) AS n, 0::BIGINT AS broken FROM bars")
def ledger_chain_check(spark, sf_dir):
    from tidewell.plans.ledger import append_ledger, broken_links

    entries = market_bars(spark, sf_dir).select("date", F.concat_ws("|", F.col("date").cast("string"), F.col("close").cast("string")).alias("payload"))
    ledger = append_ledger(entries)
    return broken_links(ledger)


@query("us_market_holidays")
def us_market_holidays(spark, sf_dir):
    return market_holidays(spark, 1995, 2030)


@query("session_ladder")
def sessions(spark, sf_dir):
    return session_ladder(spark, 1995, 2030)


@query("regime_classify", f"""WITH {MARKET}, s AS (SELECT date, CASE WHEN count(close) {last_rows(50)} = 50 THEN close / avg(close) {last_rows(50)} - 1 END AS gap, close / max(close) OVER ({S} ROWS UNBOUNDED PRECEDING) - 1 AS fall FROM bars),
  p AS (SELECT date, 0.4 + greatest(gap, 0) AS bull, 0.4 + greatest(-fall - 0.3, 0) AS bear, 0.4 + greatest(0.2 - abs(gap), 0) AS range_ FROM s WHERE gap IS NOT NULL)
  SELECT date, CASE WHEN bull >= bear AND bull >= range_ THEN 'bull' WHEN bear >= range_ THEN 'bear' ELSE 'range' END AS regime, {r('greatest(bull, bear, range_) / (bull + bear + range_)')} AS probability FROM p""")
def regime_classify(spark, sf_dir):
    """Scores of three states, normalised; the largest one names the regime."""
    rows = market_bars(spark, sf_dir).select("date", (F.col("close") / w.sma("close", 50) - 1).alias("gap"), w.drawdown("close").alias("fall")).where("gap IS NOT NULL")
    zero = F.lit(0.0)
    rows = rows.select("date", (0.4 + F.greatest("gap", zero)).alias("bull"), (0.4 + F.greatest(-F.col("fall") - 0.3, zero)).alias("bear"), (0.4 + F.greatest(0.2 - F.abs("gap"), zero)).alias("range"))
    top = F.greatest("bull", "bear", "range")
    name = F.when(F.col("bull") == top, "bull").when(F.col("bear") == top, "bear").otherwise("range")
    return rows.select("date", name.alias("regime"), rounded(top / (F.col("bull") + F.col("bear") + F.col("range"))).alias("probability"))


@query("tail_risk_flags", f"""WITH {MARKET}, t AS (SELECT date, ln(close / lag(close) OVER ({S})) AS ret, volume FROM bars), f AS (SELECT date, CASE WHEN count(ret) {last_rows(30).replace('asset_id', 'NULL')} = 30 THEN stddev_pop(ret) {last_rows(30).replace('asset_id', 'NULL')} END AS v FROM t)
  SELECT date, CASE WHEN v > 1.6 THEN 'extreme' WHEN v > 1.3 THEN 'elevated' ELSE 'normal' END AS risk, {r('least(1.35, 1 + greatest(0, v - 1.3))')} AS multiplier FROM f WHERE v IS NOT NULL""")
def tail_risk_flags(spark, sf_dir):
    rows = market_bars(spark, sf_dir).withColumn("ret", w.log_return("close")).withColumn("v", w.deviation("ret", 30, sample=False)).where("v IS NOT NULL")
    multiplier = F.least(F.lit(1.35), 1 + F.greatest(F.lit(0.0), F.col("v") - 1.3))
    return rows.select("date", F.when(F.col("v") > 1.6, "extreme").when(F.col("v") > 1.3, "elevated").otherwise("normal").alias("risk"), rounded(multiplier).alias("multiplier"))
