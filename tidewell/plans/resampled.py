"""Queries of resampled residuals, interval scales and joint shift tests."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidewell.functions.scalars import rounded
from tidewell.operators import models, resampling
from tidewell.operators import windows as w
from tidewell.plans.common import BARS, S, last_rows, query, r
from tidewell.sources.bars import order_bars

_D = f"(date - DATE '{models.GENESIS}')"
_LAW = lambda days: f"exp({models.BASE_LAW[0]!r} + {models.BASE_LAW[1]!r} * ln({days}))"
_RS = resampling


def _draw_sql(name: str) -> str:
    return f"('0x' || substr(md5({name}), 1, 8))::BIGINT"


_RESIDUALS = f"""x AS (SELECT asset_id, date, close, {_D} AS t, row_number() OVER ({S}) - 1 AS idx, lag(close) OVER ({S}) AS c0, lag({_D}) OVER ({S}) AS t0, ln(close / lag(close) OVER ({S})) AS ret FROM bars),
rs AS (SELECT asset_id, date, close, idx, ln(close / ({_LAW("t")} * exp(ln(c0 / {_LAW("t0")}) * exp(-(t - t0) / {_RS.TAU})))) AS residual, coalesce(stddev_samp(ret) {last_rows(30)}, 0) AS vol30,
  sqrt({_RS.RECENT_WEIGHT} * stddev_samp(ret) {last_rows(90)} ** 2 + {1 - _RS.RECENT_WEIGHT} * stddev_samp(ret) {last_rows(365)} ** 2) AS vol FROM x)"""
HORIZONS = (30, 90, 180, 365)


@query("residual_sigma_multiplier", f"""WITH {BARS}, {_RESIDUALS},
h AS (SELECT * FROM rs WHERE residual IS NOT NULL),
c AS (SELECT asset_id, arg_max(vol30, idx) AS now, quantile_cont(vol30, {_RS.STRATA[0]}) AS low, quantile_cont(vol30, {_RS.STRATA[1]}) AS high FROM h GROUP BY 1),
b AS (SELECT h.*, (CASE WHEN vol30 <= low THEN 0 WHEN vol30 >= high THEN 2 ELSE 1 END) = (CASE WHEN now <= low THEN 0 WHEN now >= high THEN 2 ELSE 1 END) AS alike, row_number() OVER (PARTITION BY asset_id ORDER BY idx DESC) AS back FROM h JOIN c USING (asset_id)),
e AS (SELECT *, count(*) FILTER (alike) OVER (PARTITION BY asset_id) >= {4 * _RS.BLOCK} AS enough FROM b),
pool AS (SELECT asset_id, 'full-history' AS policy, idx, residual FROM e UNION ALL SELECT asset_id, 'recent-730d', idx, residual FROM e WHERE back <= {_RS.RECENT} UNION ALL SELECT asset_id, 'vol-regime-stratified', idx, residual FROM e WHERE alike OR NOT enough),
pl AS (SELECT asset_id, policy, list(residual ORDER BY idx) AS rs, count(*) AS n FROM pool GROUP BY 1, 2 HAVING count(*) >= {4 * _RS.BLOCK}),
d AS (SELECT asset_id, policy, n, horizon, s, unnest(range((horizon + {_RS.BLOCK - 1}) // {_RS.BLOCK})) AS k FROM (SELECT *, unnest(range({_RS.SIMULATIONS})) AS s FROM (SELECT asset_id, policy, n, unnest({list(HORIZONS)}) AS horizon FROM pl))),
st AS (SELECT *, ({_draw_sql("concat_ws(':', '7', policy, horizon, s, k)")} * (n - {_RS.BLOCK} + 1)) // 4294967296 AS start_ FROM d),
tot AS (SELECT asset_id, policy, horizon, s, sum(list_sum(rs[start_ + 1 : start_ + least({_RS.BLOCK}, horizon - k * {_RS.BLOCK})])) AS total FROM st JOIN pl USING (asset_id, policy) GROUP BY ALL),
sp AS (SELECT asset_id, policy, horizon, stddev_samp(total) AS spread FROM tot GROUP BY ALL),
l AS (SELECT asset_id, max(idx) AS idx, arg_max(vol, idx) AS vol FROM rs GROUP BY 1),
a AS (SELECT asset_id, idx, policy, horizon, vol * sqrt((1 - exp(-2.0 * horizon / {_RS.TAU})) / (1 - exp(-2.0 / {_RS.TAU}))) AS sigma FROM l CROSS JOIN (SELECT unnest({list(_RS.POLICIES)}) AS policy) CROSS JOIN (SELECT unnest({list(HORIZONS)}) AS horizon))
SELECT asset_id, policy, horizon::INT AS horizon, {r("spread")} AS spread, {r("sigma")} AS sigma, {r(f"CASE WHEN idx >= {_RS.LEAST_ROWS} AND spread > 0 AND sigma > 0 THEN greatest({_RS.RANGE[0]}, least({_RS.RANGE[1]}, spread / sigma)) ELSE 1 END")} AS multiplier FROM a LEFT JOIN sp USING (asset_id, policy, horizon)""")
def residual_sigma_multiplier(spark, sf_dir):
    """How much wider resampled residuals spread than the residual process says, by three policies of what is resampled."""
    found = resampling.sigma_multipliers(order_bars(spark, sf_dir), HORIZONS)
    return found.select("asset_id", "policy", "horizon", *(rounded(c).alias(c) for c in ("spread", "sigma", "multiplier")))


_ASKED = (7, 14, 20, 45, 90, 120, 200, 365, 500)


@query("interval_scales", f"""WITH {BARS}, {_RESIDUALS}, m(h, m) AS (VALUES {", ".join(map(str, _RS.MULTIPLIERS))}),
v AS (SELECT h, m, m * sqrt((1 - exp(-2.0 * h / {_RS.TAU})) / (1 - exp(-2.0 / {_RS.TAU}))) AS s FROM m), w AS (SELECT h, m, max(s) OVER (ORDER BY h) AS s FROM v),
p AS (SELECT h AS h0, m AS m0, s AS s0, lead(h) OVER (ORDER BY h) AS h1, lead(m) OVER (ORDER BY h) AS m1, lead(s) OVER (ORDER BY h) AS s1 FROM w),
q AS (SELECT unnest({list(_ASKED)}) AS horizon),
z AS (SELECT horizon, CASE WHEN h0 IS NULL THEN {_RS.MULTIPLIERS[0][1]} WHEN h1 IS NULL THEN m0 * sqrt(horizon / h0) ELSE m0 * pow(m1 / m0, ln(horizon / h0) / ln(h1 / h0)) END AS multiplier,
  CASE WHEN h0 IS NULL THEN {_RS.MULTIPLIERS[0][1]} * sqrt((1 - exp(-2.0 * horizon / {_RS.TAU})) / (1 - exp(-2.0 / {_RS.TAU}))) WHEN h1 IS NULL THEN s0 * sqrt(horizon / h0) ELSE s0 * pow(s1 / s0, ln(horizon / h0) / ln(h1 / h0)) END AS scale
  FROM q LEFT JOIN p ON horizon >= h0 AND (h1 IS NULL OR horizon < h1)),
l AS (SELECT asset_id, arg_max(close, idx) AS close, arg_max(vol, idx) AS vol FROM rs GROUP BY 1)
SELECT asset_id, horizon::INT AS horizon, {r("multiplier")} AS multiplier, {r("scale")} AS scale, {r("ln(close) - 1.28 * scale * vol")} AS low80, {r("ln(close) + 1.28 * scale * vol")} AS high80 FROM l CROSS JOIN z""")
def interval_scales(spark, sf_dir):
    """Multiplier and rising scale of sigma at a horizon, and the log band that they give around the last close."""
    rows = resampling.law_residuals(order_bars(spark, sf_dir))
    last = rows.groupBy("asset_id").agg(F.max_by("close", "idx").alias("close"), F.max_by("vol", "idx").alias("vol")).withColumn("horizon", F.explode(F.array(*map(F.lit, _ASKED))))
    last = last.withColumns({"multiplier": resampling.interval_multiplier(F.col("horizon")), "scale": resampling.sigma_scale(F.col("horizon"))})
    half = 1.28 * F.col("scale") * F.col("vol")
    return last.select("asset_id", "horizon", rounded("multiplier").alias("multiplier"), rounded("scale").alias("scale"), rounded(F.ln("close") - half).alias("low80"), rounded(F.ln("close") + half).alias("high80"))


SIGNALS = {"close20": ("close", 20), "close50": ("close", 50), "sma20": (20, 50), "sma50": (50, 200)}
_AVG = lambda n: "close" if n == "close" else f"CASE WHEN count(close) {last_rows(n)} = {n} THEN avg(close) {last_rows(n)} END"
_CROSSES = ", ".join(f"{_AVG(a)} - {_AVG(b)} AS g_{name}" for name, (a, b) in SIGNALS.items())
_SIDES = ", ".join(f"CASE WHEN lag(g_{n}) OVER ({S}) <= 0 AND g_{n} > 0 THEN 1 WHEN lag(g_{n}) OVER ({S}) >= 0 AND g_{n} < 0 THEN -1 ELSE 0 END AS {n}" for n in SIGNALS)
_EACH = " UNION ALL ".join(
    f"SELECT d.asset_id, '{n}' AS signal, any_value(n_{n}) AS n_events, any_value(x_{n}) AS observed, (count(*) FILTER (s_{n} >= x_{n} - 1e-12) + 1) / (50001) AS p, (count(*) FILTER (top >= x_{n} - 1e-12) + 1) / (50001) AS p_max FROM top d WHERE n_{n} > 0 GROUP BY 1" for n in SIGNALS
)


@query("joint_shift_p", f"""WITH {BARS}, g AS (SELECT asset_id, date, ln(lead(close, 7) OVER ({S}) / close) AS value, {_CROSSES} FROM bars), tl AS (SELECT asset_id, date, value, {_SIDES} FROM g),
y AS (SELECT *, year(date) AS y, row_number() OVER (PARTITION BY asset_id, year(date) ORDER BY date) - 1 AS at_, count(*) OVER (PARTITION BY asset_id, year(date)) AS n FROM tl WHERE value IS NOT NULL),
c AS (SELECT e.asset_id, e.y, ((e.at_ - v.at_) % v.n + v.n) % v.n AS shift, {", ".join(f"sum(e.{n} * v.value) AS {n}" for n in SIGNALS)} FROM y e JOIN y v ON v.asset_id = e.asset_id AND v.y = e.y WHERE {" OR ".join(f"e.{n} <> 0" for n in SIGNALS)} GROUP BY 1, 2, 3),
z AS (SELECT DISTINCT asset_id, y, n FROM y), u AS (SELECT asset_id, y, i, ({_draw_sql("concat_ws(':', '11', i, y)")} * n) // 4294967296 AS shift FROM z CROSS JOIN (SELECT unnest(range(50000)) AS i)),
a AS (SELECT asset_id, i, {", ".join(f"sum({n}) AS {n}" for n in SIGNALS)} FROM u JOIN c USING (asset_id, y, shift) GROUP BY 1, 2),
f AS (SELECT asset_id, avg(value) AS mean, {", ".join(f"count(*) FILTER ({n} <> 0) AS n_{n}, sum({n}) AS d_{n}, sum({n} * value) AS o_{n}" for n in SIGNALS)} FROM y GROUP BY 1),
s AS (SELECT a.asset_id, {", ".join(f"n_{n}, {n} / nullif(n_{n}, 0) - mean * d_{n} / nullif(n_{n}, 0) - {_RS.COST} AS s_{n}, o_{n} / nullif(n_{n}, 0) - mean * d_{n} / nullif(n_{n}, 0) - {_RS.COST} AS x_{n}" for n in SIGNALS)} FROM a JOIN f USING (asset_id)),
top AS (SELECT *, greatest({", ".join(f"s_{n}" for n in SIGNALS)}) AS top FROM s)
SELECT asset_id, signal, n_events, {r("observed")} AS observed, {r("p", "1e6")} AS p, {r("p_max", "1e6")} AS p_max FROM ({_EACH})""")
def joint_shift_p(spark, sf_dir):
    """Whether returns after a cross of averages beat those of 50,000 shifts within each year, for every signal and for the best of them."""
    rows = order_bars(spark, sf_dir)
    line = lambda x: F.col("close") if x == "close" else w.sma("close", x)
    rows = rows.withColumns({"value": F.ln(F.lead("close", 7).over(w.series()) / F.col("close"))} | {f"_{n}{i}": line(x) for n, pair in SIGNALS.items() for i, x in enumerate(pair)})
    rows = rows.withColumns({n: F.coalesce(w.strict_cross(F.col(f"_{n}0"), F.col(f"_{n}1")), F.lit(0)) for n in SIGNALS})
    found = resampling.joint_shift_test(rows, list(SIGNALS))
    return found.select("asset_id", "signal", "n_events", rounded("observed").alias("observed"), rounded("p", 1e6).alias("p"), rounded("p_max", 1e6).alias("p_max"))
