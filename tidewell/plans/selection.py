"""Queries of feature selection and of the primary trace."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import rounded
from tidewell.operators import models, selection
from tidewell.operators import windows as w
from tidewell.operators.metrics import best_of
from tidewell.plans.common import BARS, S, last_rows, query, r
from tidewell.sources.bars import order_bars

_LAG = lambda k: f"ln(close / lag(close, {k}) OVER ({S}))"
_FULL = lambda f, n: f"CASE WHEN count(close) {last_rows(n)} = {n} THEN {f} {last_rows(n)} END"
_FEATURES = {
    **{f"momentum{k}": _LAG(k) for k in (7, 30, 90, 365, 1200)},
    **{f"gap{n}": f"close / ({_FULL('avg(close)', n)}) - 1" for n in (20, 200)},
    "spread": "CASE WHEN high > low THEN ln(high / low) END",
    "surge": f"CASE WHEN volume > avg(volume) {last_rows(20)} THEN ln(volume / avg(volume) {last_rows(20)}) END",
    "monday": "CASE WHEN isodow(date) = 1 THEN close END",
    "still": "CASE WHEN close > 0 THEN 1.0 END",
}
_MOST, _GAP = 8, 30


@query("feature_selection", f"""WITH {BARS}, x AS (SELECT asset_id, date, {", ".join(f"{sql} AS {n}" for n, sql in _FEATURES.items())}, max(date) OVER (PARTITION BY asset_id) AS last FROM bars),
  p AS (SELECT * FROM x WHERE date < last - {_GAP}), e AS (SELECT * FROM x WHERE date = last),
  long AS (SELECT asset_id, date, feature, value FROM p UNPIVOT (value FOR feature IN ({", ".join(_FEATURES)}))), there AS (SELECT asset_id, feature FROM e UNPIVOT (value FOR feature IN ({", ".join(_FEATURES)}))),
  s AS (SELECT asset_id, feature, count(*) AS n, var_samp(value) AS variance FROM long JOIN there USING (asset_id, feature) GROUP BY 1, 2 HAVING count(*) >= {selection.LEAST_ROWS} AND var_samp(value) > 0),
  k AS (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY n DESC, variance DESC, feature) AS rank FROM s QUALIFY rank <= {_MOST}),
  days AS (SELECT k.asset_id, k.rank, l.date, count(*) AS had FROM k JOIN k j ON j.asset_id = k.asset_id AND j.rank <= k.rank JOIN long l ON l.asset_id = j.asset_id AND l.feature = j.feature GROUP BY ALL),
  c AS (SELECT asset_id, rank, count(*) FILTER (had = rank) AS n_complete FROM days GROUP BY ALL)
  SELECT asset_id, rank::INT AS rank, feature, n, {r("variance")} AS variance, n_complete, coalesce(rank <= max(rank) FILTER (n_complete >= {selection.LEAST_ROWS}) OVER (PARTITION BY asset_id), false) AS chosen FROM k JOIN c USING (asset_id, rank)""")
def feature_selection(spark, sf_dir):
    """The features that a model of each asset's last day may take: most rows first, as many as leave enough complete rows."""
    rows = order_bars(spark, sf_dir)
    mean = lambda c, n: F.avg(c).over(w.trailing(n))
    columns = {f"momentum{k}": w.log_return("close", k) for k in (7, 30, 90, 365, 1200)} | {f"gap{n}": F.col("close") / w.sma("close", n) - 1 for n in (20, 200)}
    columns |= {
        "spread": F.when(F.col("high") > F.col("low"), F.ln(F.col("high") / F.col("low"))), "surge": F.when(F.col("volume") > mean("volume", 20), F.ln(F.col("volume") / mean("volume", 20))),
        "monday": F.when(F.weekday("date") == 0, F.col("close")), "still": F.when(F.col("close") > 0, F.lit(1.0)), "last": F.max("date").over(Window.partitionBy("asset_id")),
    }
    rows = rows.withColumns(columns)
    found = selection.select_features(rows.where(F.col("date") < F.date_sub("last", _GAP)), rows.where("date = last"), ["asset_id"], list(_FEATURES), _MOST)
    return found.select("asset_id", "rank", "feature", "n", rounded("variance").alias("variance"), "n_complete", "chosen")


_TRACES, _DAYS = 12, 60
_T = f"(last_date - DATE '{models.GENESIS}' + d)"
_FLOOR = "least(" + ", ".join(f"exp({a!r} + {b!r} * ln({_T}))" for a, b in models.FLOOR_LAWS) + ")"


@query("primary_trace", f"""WITH RECURSIVE {BARS}, x AS (SELECT asset_id, date, close, row_number() OVER ({S}) - 1 AS i, ln(close / lag(close) OVER ({S})) / 20 AS ret FROM bars),
  l AS (SELECT asset_id, max(i) AS last_i, max(date) AS last_date, arg_max(close, i) AS now, avg(ret) AS drift FROM x GROUP BY 1),
  t AS (SELECT asset_id, last_date, now, drift, trace, d, now * exp(sum(ret) OVER (PARTITION BY asset_id, trace ORDER BY d)) AS price FROM (SELECT l.*, trace, unnest(range(1, {_DAYS + 1})) AS d FROM l CROSS JOIN (SELECT unnest(range({_TRACES})) AS trace)) q JOIN x USING (asset_id) WHERE x.i = last_i - (trace + 1) * {_DAYS} + d),
  f AS MATERIALIZED (SELECT *, now * exp(drift * d) AS reference, {_FLOOR} AS floor, price / lag(price, 1, now) OVER (PARTITION BY asset_id, trace ORDER BY d) AS step FROM t),
  s AS (SELECT asset_id, trace, avg(abs(ln(price / reference))) + {selection.BREACH_WEIGHT} * avg((price < floor)::INT) + {selection.FIRST_WEIGHT} * arg_min(abs(ln(price / reference)), d) + {selection.LAST_WEIGHT} * arg_max(abs(ln(price / reference)), d) AS score,
    avg((price < floor)::INT) AS breach_rate FROM f WHERE d <= {selection.SELECTION_DAYS} GROUP BY 1, 2),
  b AS MATERIALIZED (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY score, trace) = 1),
  p(asset_id, d, projected) AS (SELECT asset_id, 0::BIGINT, now FROM l UNION ALL SELECT asset_id, d, CASE WHEN v >= floor * {selection.BUFFER} THEN v ELSE floor * exp(least(ln({selection.BOUNCE}), ln({selection.BUFFER}) + {selection.RECOVERY} * greatest(0, ln(floor / v)))) END
    FROM (SELECT p.asset_id, f.d, p.projected * f.step AS v, f.floor FROM p JOIN b USING (asset_id) JOIN f ON f.asset_id = p.asset_id AND f.trace = b.trace AND f.d = p.d + 1))
  SELECT asset_id, f.trace, f.d AS day, {r("ln(price)")} AS price, {r("ln(floor)")} AS floor, {r("ln(projected)")} AS projected, {r("score")} AS score, {r("breach_rate")} AS breach_rate FROM p JOIN b USING (asset_id) JOIN f USING (asset_id, trace, d)""")
def primary_trace(spark, sf_dir):
    """Of traces that replay past stretches of returns, the one nearest to the drift path; its logarithm, and that of its path above the floor."""
    along = w.series()
    rows = order_bars(spark, sf_dir).withColumns({"i": F.row_number().over(along) - 1, "ret": w.log_return("close") / 20})
    last = rows.groupBy("asset_id").agg(F.max("i").alias("last_i"), F.max("date").alias("last_date"), F.max_by("close", "i").alias("now"), F.avg("ret").alias("drift"))
    back = F.col("last_i") - F.col("i")
    moved = rows.select("asset_id", "i", "ret").join(last, "asset_id").where(back < _TRACES * _DAYS)
    moved = moved.withColumns({"trace": F.floor(back / _DAYS), "day": F.col("i") - F.col("last_i") + (F.floor(back / _DAYS) + 1) * _DAYS})
    path = F.col("now") * F.exp(F.sum("ret").over(Window.partitionBy("asset_id", "trace").orderBy("day")))
    days = F.datediff("last_date", F.lit(models.GENESIS).cast("date")) + F.col("day")
    traces = moved.select("asset_id", "trace", "day", "now", path.alias("price"), (F.col("now") * F.exp(F.col("drift") * F.col("day"))).alias("reference"), models.floor_price(days).alias("floor"))
    best = best_of(selection.trace_scores(traces, ["asset_id"]), ["asset_id"], F.col("score"), F.col("trace")).select("asset_id", "trace", "score", "breach_rate")
    chosen = traces.join(best, ["asset_id", "trace"])
    found = selection.above_floor(chosen, ["asset_id"], F.col("now"))
    log = lambda c: rounded(F.ln(c)).alias(c)
    return found.select("asset_id", "trace", F.col("day").cast("long").alias("day"), log("price"), log("floor"), log("projected"), rounded("score").alias("score"), rounded("breach_rate").alias("breach_rate"))
