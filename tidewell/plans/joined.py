"""Queries of the join operators, set operations, sources and validation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import rounded
from tidewell.operators import joins, scans
from tidewell.operators import windows as w
from tidewell.plans.common import BARS, MACRO, MARKET, S, query, r
from tidewell.sources.bars import complete_days, event_bars, market_bars, merge_rows, monthly_macro, order_bars, table


@query("join_lag1", f"WITH {BARS} SELECT a.asset_id, a.date, b.close AS close_before FROM bars a LEFT JOIN bars b ON b.asset_id = a.asset_id AND b.date + INTERVAL 1 DAY = a.date")
def join_lag1(spark, sf_dir):
    bars = order_bars(spark, sf_dir)
    return joins.lagged_join(bars.select("asset_id", "date"), bars.select("asset_id", "date", F.col("close").alias("close_before")))


@query("residual_momentum", f"WITH {MARKET} SELECT a.date, " + ", ".join(f"{r(f'ln(a.close / b{k}.close)')} AS momentum{k}" for k in (7, 30, 90)) + " FROM bars a " + " ".join(f"LEFT JOIN bars b{k} ON b{k}.date + INTERVAL {k} DAY = a.date" for k in (7, 30, 90)))
def residual_momentum(spark, sf_dir):
    """Log change over calendar days, by equi joins on shifted dates."""
    bars = market_bars(spark, sf_dir)
    rows = bars.select("asset_id", "date", "close")
    for k in (7, 30, 90):
        rows = joins.lagged_join(rows, bars.select("asset_id", "date", F.col("close").alias(f"c{k}")), k)
    return rows.select("date", *(rounded(F.ln(F.col("close") / F.col(f"c{k}"))).alias(f"momentum{k}") for k in (7, 30, 90)))


@query("join_asof", f"WITH {MARKET}, {MACRO} SELECT b.date, m.date AS asof_date, {r('m.revenue', '1e1')} AS revenue FROM bars b ASOF LEFT JOIN macro m ON b.date >= m.date")
def join_asof(spark, sf_dir):
    found = joins.asof_join(market_bars(spark, sf_dir).select("date"), monthly_macro(spark, sf_dir), ["revenue"])
    return found.select("date", "asof_date", rounded("revenue", 1e1).alias("revenue"))


@query("join_asof_bitemporal", f"""WITH {MARKET}, {MACRO}, k AS (SELECT *, CASE WHEN month(date) % 3 = 0 THEN available_after + INTERVAL 45 DAY ELSE available_after END AS known FROM macro)
  SELECT b.date, max(m.date) AS asof_date, {r('arg_max(m.revenue, m.date)', '1e1')} AS revenue FROM bars b LEFT JOIN k m ON m.known <= b.date AND m.date <= b.date - INTERVAL 1 DAY GROUP BY b.date""")
def join_asof_bitemporal(spark, sf_dir):
    """Quarter ends are known later than the month after them: the latest date known is not the date known last."""
    macro = monthly_macro(spark, sf_dir).withColumn("known", F.when(F.month("date") % 3 == 0, F.date_add("available_after", 45)).otherwise(F.col("available_after")))
    found = joins.asof_join(market_bars(spark, sf_dir).select("date"), macro, ["revenue"], known=F.col("known"), lag_days=1)
    return found.select("date", "asof_date", rounded("revenue", 1e1).alias("revenue"))


_H = (7, 14, 30)


@query("join_horizon_self", f"WITH {MARKET}, h AS (SELECT unnest([7, 14, 30])::INT AS horizon), n AS (SELECT *, row_number() OVER ({S}) - 1 AS idx FROM bars) SELECT a.asset_id, a.date, h.horizon, b.date AS target_date, b.close AS actual FROM n a CROSS JOIN h JOIN n b ON b.asset_id = a.asset_id AND b.idx = a.idx + h.horizon WHERE b.date - a.date = h.horizon")
def join_horizon_self(spark, sf_dir):
    rows = joins.horizon_rows(market_bars(spark, sf_dir).select("asset_id", "date", "close"), list(_H), contiguous=True)
    return rows.select("asset_id", "date", "horizon", "target_date", "actual")


@query("join_full_outer_dates", f"WITH {BARS}, a AS (SELECT date, close AS urgent FROM bars WHERE asset_id = '1-URGENT'), b AS (SELECT date, close AS low FROM bars WHERE asset_id = '5-LOW') SELECT date, urgent, low FROM a FULL JOIN b USING (date)")
def join_full_outer_dates(spark, sf_dir):
    bars = order_bars(spark, sf_dir)
    one = bars.where("asset_id = '1-URGENT'").select("date", F.col("close").alias("urgent"))
    return one.join(bars.where("asset_id = '5-LOW'").select("date", F.col("close").alias("low")), "date", "full")


#: A fixed calendar of phases, standing for a cycle's.
PHASES = (("1995-01-01", "1996-07-01", "accumulation"), ("1996-07-01", "1998-03-01", "expansion"), ("1998-03-01", "1999-06-01", "distribution"), ("1999-06-01", "2001-07-01", "decline"))


def phase_spans(spark):
    spans = spark.createDataFrame(list(PHASES), "start_date string, end_date string, phase string")
    return spans.withColumns({c: F.col(c).cast("date") for c in ("start_date", "end_date")})


@query("join_phase_range", f"WITH {MARKET}, z(start_date, end_date, phase) AS (VALUES " + ", ".join(f"(DATE '{a}', DATE '{b}', '{p}')" for a, b, p in PHASES) + f") SELECT date, phase, {r('(date - start_date) / (end_date - start_date)')} AS progress FROM bars LEFT JOIN z ON date >= start_date AND date < end_date")
def join_phase_range(spark, sf_dir):
    rows = joins.range_join(market_bars(spark, sf_dir), phase_spans(spark))
    progress = F.datediff("date", "start_date") / F.datediff("end_date", "start_date")
    return rows.select("date", "phase", rounded(progress).alias("progress"))


@query("join_anti_missing_days", f"WITH {BARS}, s AS (SELECT asset_id, unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM bars GROUP BY asset_id) SELECT asset_id, date FROM s ANTI JOIN bars USING (asset_id, date)")
def join_anti_missing_days(spark, sf_dir):
    bars = order_bars(spark, sf_dir)
    ends = bars.groupBy("asset_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    spine = ends.select("asset_id", F.explode(F.sequence("first", "last")).alias("date"))
    return spine.join(bars, ["asset_id", "date"], "left_anti")


@query("join_semi_observed", f"WITH {BARS} SELECT a.asset_id, a.date, a.close FROM bars a SEMI JOIN bars b ON b.asset_id = a.asset_id AND b.date = a.date + INTERVAL 30 DAY")
def join_semi_observed(spark, sf_dir):
    bars = order_bars(spark, sf_dir)
    observed = bars.select("asset_id", F.date_sub("date", 30).alias("date"))
    return bars.select("asset_id", "date", "close").join(observed, ["asset_id", "date"], "left_semi")


@query("join_purge_embargo", f"""WITH {MARKET}, e AS (SELECT date AS eval_date FROM bars WHERE day(date) = 15),
  n AS (SELECT date AS origin_date, lead(date, 30) OVER ({S}) AS target_date FROM bars)
  SELECT eval_date, count(*) FILTER (target_date < eval_date AND origin_date < eval_date - INTERVAL 14 DAY) AS n_eligible,
  count(*) FILTER (target_date < eval_date AND NOT origin_date < eval_date - INTERVAL 14 DAY) AS n_embargoed,
  count(*) FILTER (target_date >= eval_date) AS n_unresolved FROM e CROSS JOIN (SELECT * FROM n WHERE target_date IS NOT NULL) GROUP BY eval_date""")
def join_purge_embargo(spark, sf_dir):
    bars = market_bars(spark, sf_dir)
    rows = joins.horizon_rows(bars.select("asset_id", "date", "close"), [30]).select(F.col("date").alias("origin_date"), "target_date")
    return joins.purge_counts(bars.where(F.dayofmonth("date") == 15).select(F.col("date").alias("eval_date")), rows, 14)


@query("union_dates", f"WITH {MARKET}, {MACRO} SELECT date FROM bars UNION SELECT date FROM macro")
def union_dates(spark, sf_dir):
    return market_bars(spark, sf_dir).select("date").union(monthly_macro(spark, sf_dir).select("date")).distinct()


@query("intersect_dates", f"WITH {BARS} SELECT date FROM bars WHERE asset_id = '1-URGENT' INTERSECT SELECT date FROM bars WHERE asset_id = '5-LOW'")
def intersect_dates(spark, sf_dir):
    bars = order_bars(spark, sf_dir)
    return bars.where("asset_id = '1-URGENT'").select("date").intersect(bars.where("asset_id = '5-LOW'").select("date"))


@query("except_dates", f"WITH {BARS} SELECT date FROM bars WHERE asset_id = 'market' EXCEPT SELECT date FROM bars WHERE asset_id = '5-LOW'")
def except_dates(spark, sf_dir):
    bars = order_bars(spark, sf_dir)
    return bars.where("asset_id = 'market'").select("date").subtract(bars.where("asset_id = '5-LOW'").select("date"))


@query("dedupe_last_wins", "SELECT o_orderdate::DATE AS date, o_orderpriority AS asset_id, max(o_orderkey) AS o_orderkey, arg_max(o_totalprice, o_orderkey) AS price FROM orders GROUP BY 1, 2")
def dedupe_last_wins(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderdate").cast("date").alias("date"), F.col("o_orderpriority").alias("asset_id"), "o_orderkey", F.col("o_totalprice").alias("price"))
    last = F.row_number().over(Window.partitionBy("date", "asset_id").orderBy(F.desc("o_orderkey")))
    return orders.withColumn("place", last).where("place = 1").drop("place")


@query("merge_bundle_remote", f"WITH {MARKET}, remote AS (SELECT asset_id, date, close + 1 AS close FROM bars WHERE date >= DATE '2001-06-01') SELECT coalesce(x.asset_id, b.asset_id) AS asset_id, coalesce(x.date, b.date) AS date, coalesce(x.close, b.close) AS close FROM bars b FULL JOIN remote x USING (asset_id, date)")
def merge_bundle_remote(spark, sf_dir):
    bars = market_bars(spark, sf_dir).select("asset_id", "date", "close")
    remote = bars.where(F.col("date") >= F.lit("2001-06-01").cast("date")).withColumn("close", F.col("close") + 1)
    return merge_rows(bars, remote, ["asset_id", "date"])


@query("ticks_complete_days", "SELECT event_type AS asset_id, ts::DATE AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close FROM events WHERE ts::DATE < DATE '2024-01-28' GROUP BY 1, 2")
def ticks_complete_days(spark, sf_dir):
    events = complete_days(table(spark, sf_dir, "events"), "ts", "2024-01-28")
    ticks = events.select(F.col("event_type").alias("asset_id"), F.col("ts").cast("date").alias("date"), "value", F.struct("ts", "event_id").alias("at"))
    from tidewell.sources.bars import bars_from_ticks

    return bars_from_ticks(ticks, ["asset_id", "date"], "value", "at").drop("volume")


@query("latest_rows", f"WITH {BARS} SELECT asset_id, date, close FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY date DESC) AS n FROM bars WHERE date >= DATE '2001-01-01') WHERE n <= 8")
def latest_rows(spark, sf_dir):
    bars = order_bars(spark, sf_dir).where(F.col("date") >= F.lit("2001-01-01").cast("date"))
    newest = F.row_number().over(Window.partitionBy("asset_id").orderBy(F.desc("date")))
    return bars.withColumn("n", newest).where("n <= 8").select("asset_id", "date", "close")


@query("market_snapshot", f"WITH {BARS}, p AS (SELECT *, lag(close) OVER ({S}) AS before FROM bars) SELECT asset_id, max(date) AS date, arg_max(close, date) AS price, {r('100 * (arg_max(close, date) / arg_max(before, date) - 1)')} AS change_24h, {r('arg_max(volume, date)', '1e2')} AS volume_24h FROM p GROUP BY asset_id")
def market_snapshot(spark, sf_dir):
    rows = order_bars(spark, sf_dir).withColumn("before", F.lag("close").over(w.series()))
    last = rows.groupBy("asset_id").agg(F.max_by(F.struct("date", "close", "before", "volume"), "date").alias("l"))
    return last.select("asset_id", "l.date", F.col("l.close").alias("price"), rounded(100 * (F.col("l.close") / F.col("l.before") - 1)).alias("change_24h"), rounded("l.volume", 1e2).alias("volume_24h"))


@query("macro_calendar", f"WITH {MACRO}, s AS (SELECT unnest(generate_series(min(date), max(date), INTERVAL 1 DAY))::DATE AS date FROM macro) SELECT s.date, m.date AS observed, m.n_lines FROM s ASOF LEFT JOIN macro m ON s.date >= m.date")
def macro_calendar(spark, sf_dir):
    """A row for every day with the last value observed."""
    macro = monthly_macro(spark, sf_dir)
    spine = macro.agg(F.min("date").alias("first"), F.max("date").alias("last")).select(F.explode(F.sequence("first", "last")).alias("date"))
    return joins.asof_join(spine, macro, ["n_lines"]).select("date", F.col("asof_date").alias("observed"), "n_lines")


@query("ohlc_violations", f"WITH {BARS}, v AS (SELECT *, lag(date) OVER ({S}) AS before FROM bars) SELECT asset_id, count(*) AS n, count(*) FILTER (high < greatest(open, close, low)) AS high_low, count(*) FILTER (low > least(open, close, high)) AS low_high, count(*) FILTER (volume < 0 OR close <= 0) AS not_positive, count(*) FILTER (before >= date) AS unordered FROM v GROUP BY asset_id")
def ohlc_violations(spark, sf_dir):
    rows = order_bars(spark, sf_dir).withColumn("before", F.lag("date").over(w.series()))
    return rows.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("high") < F.greatest("open", "close", "low")).alias("high_low"),
        F.count_if(F.col("low") > F.least("open", "close", "high")).alias("low_high"),
        F.count_if((F.col("volume") < 0) | (F.col("close") <= 0)).alias("not_positive"),
        F.count_if(F.col("before") >= F.col("date")).alias("unordered"),
    )


@query("freshness_lag", f"WITH {BARS}, m AS (SELECT asset_id, max(date) AS latest FROM bars GROUP BY 1) SELECT asset_id, latest, (DATE '2001-08-06' - latest)::INT AS lag_days, CASE WHEN DATE '2001-08-06' - latest <= 3 THEN 'fresh' WHEN DATE '2001-08-06' - latest <= 7 THEN 'late' ELSE 'stale' END AS status FROM m")
def freshness_lag(spark, sf_dir):
    latest = order_bars(spark, sf_dir).groupBy("asset_id").agg(F.max("date").alias("latest"))
    lag = F.datediff(F.lit("2001-08-06").cast("date"), "latest")
    return latest.select("asset_id", "latest", lag.alias("lag_days"), F.when(lag <= 3, "fresh").when(lag <= 7, "late").otherwise("stale").alias("status"))


@query("availability_violations", f"WITH {MACRO} SELECT count(*) AS n, count(*) FILTER (available_after <= date) AS early, count(*) FILTER (revenue <= 0) AS not_positive FROM macro")
def availability_violations(spark, sf_dir):
    return monthly_macro(spark, sf_dir).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("available_after") <= F.col("date")).alias("early"), F.count_if(F.col("revenue") <= 0).alias("not_positive"))


@query("source_audit", f"""WITH {BARS}, a AS (SELECT date, close, volume FROM bars WHERE asset_id = 'market'), b AS (SELECT date, close AS c2, volume AS v2 FROM bars WHERE asset_id = '3-MEDIUM'),
  j AS (SELECT *, abs(c2 / close - 1) AS diff FROM a JOIN b USING (date))
  SELECT count(*) AS overlap, {r('quantile_cont(diff, 0.5)')} AS median_diff, {r('list_sort(list(diff))[floor((count(*) - 1) * 0.95)::INT + 1]')} AS p95_diff, count(*) FILTER (diff > 0.01) AS above_one_percent,
  {r('covar_pop(volume, v2) / nullif(stddev_pop(volume) * stddev_pop(v2), 0)')} AS volume_corr, (SELECT count(*) FROM a ANTI JOIN b USING (date)) AS missing FROM j""")
def source_audit(spark, sf_dir):
    from tidewell.operators.metrics import correlation

    bars = order_bars(spark, sf_dir)
    one = bars.where("asset_id = 'market'").select("date", "close", "volume")
    two = bars.where("asset_id = '3-MEDIUM'").select("date", F.col("close").alias("c2"), F.col("volume").alias("v2"))
    joined = one.join(two, "date").withColumn("diff", F.abs(F.col("c2") / F.col("close") - 1))
    listed = F.array_sort(F.collect_list("diff"))  # one value a day
    found = joined.agg(
        F.count(F.lit(1)).alias("overlap"), rounded(F.percentile("diff", F.lit(0.5))).alias("median_diff"),
        rounded(F.get(listed, F.floor((F.size(listed) - 1) * 0.95).cast("int"))).alias("p95_diff"),
        F.count_if(F.col("diff") > 0.01).alias("above_one_percent"), rounded(correlation("volume", "v2")).alias("volume_corr"),
    )
    return found.crossJoin(one.join(two, "date", "left_anti").agg(F.count(F.lit(1)).alias("missing")))


@query("upsert_changed_rows", f"WITH {MARKET}, new AS (SELECT asset_id, date, CASE WHEN day(date) = 1 THEN close + 5 ELSE close END AS close FROM bars WHERE date >= DATE '2001-05-01' UNION ALL SELECT 'market', DATE '2002-01-01', 1.0) SELECT coalesce(n.asset_id, b.asset_id) AS asset_id, coalesce(n.date, b.date) AS date, coalesce(n.close, b.close) AS close, b.date IS NULL AS inserted, b.date IS NOT NULL AND n.date IS NOT NULL AND n.close <> b.close AS updated FROM bars b FULL JOIN new n USING (asset_id, date)")
def upsert_changed_rows(spark, sf_dir):
    from tidewell.sources.upsert import upsert

    bars = market_bars(spark, sf_dir).select("asset_id", "date", "close")
    late = bars.where(F.col("date") >= F.lit("2001-05-01").cast("date")).withColumn("close", F.when(F.dayofmonth("date") == 1, F.col("close") + 5).otherwise(F.col("close")))
    extra = spark.createDataFrame([("market", "2002-01-01", 1.0)], "asset_id string, date string, close double").withColumn("date", F.col("date").cast("date"))
    return upsert(bars, late.unionByName(extra), ["asset_id", "date"])


@query("gap_segments", f"WITH {BARS}, g AS (SELECT asset_id, date, CASE WHEN date - lag(date) OVER ({S}) > 3 THEN 1 ELSE 0 END AS far FROM bars), s AS (SELECT *, sum(far) OVER ({S} ROWS UNBOUNDED PRECEDING) AS segment FROM g) SELECT asset_id, segment::BIGINT AS segment, min(date) AS first, max(date) AS last, count(*) AS n FROM s GROUP BY asset_id, segment")
def gap_segments(spark, sf_dir):
    rows = scans.gap_segments(order_bars(spark, sf_dir), ["asset_id"], "date", 3)
    return rows.groupBy("asset_id", "segment").agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count(F.lit(1)).alias("n"))


@query("event_bars_daily", f"SELECT event_type AS asset_id, ts::DATE AS date, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, {r('sum(value)', '1e2')} AS volume FROM events GROUP BY 1, 2")
def event_bars_daily(spark, sf_dir):
    return event_bars(spark, sf_dir).withColumn("volume", rounded("volume", 1e2))


@query("json_props_extract", "SELECT event_type, (props->>'k')::INT % 10 AS bucket, count(*) AS n FROM events GROUP BY 1, 2")
def json_props_extract(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    k = F.from_json("props", "k int").getField("k")
    return events.groupBy("event_type", (k % 10).alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


@query("html_rows_extract", r"SELECT page_id, len(regexp_extract_all(html, '<p[^>]*>')) AS n_paragraphs, len(regexp_extract_all(html, '<a [^>]*href')) AS n_links, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title FROM pages")
def html_rows_extract(spark, sf_dir):
    count = lambda pattern: F.size(F.regexp_extract_all("html", F.lit(pattern), F.lit(0))).cast("long")
    return table(spark, sf_dir, "pages").select("page_id", count("<p[^>]*>").alias("n_paragraphs"), count("<a [^>]*href").alias("n_links"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
