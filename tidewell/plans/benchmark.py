"""Queries of the point-in-time benchmark, refits and the state space."""

from __future__ import annotations

from math import pi


from pyspark.sql import functions as F

from tidewell.functions.scalars import rounded
from tidewell.operators import pointintime as pit
from tidewell.operators import statespace
from tidewell.operators import windows as w
from tidewell.operators.metrics import best_of
from tidewell.operators.models import GENESIS
from tidewell.plans.common import BARS, S, query, r
from tidewell.sources.bars import order_bars

_K = 4
_OMEGA = 2 * pi / pit.CYCLE


def _basis_sql(t: str) -> list[str]:
    return ["1.0", f"(ln({t}) - {pit.CENTRE})", f"sin({t} * {_OMEGA!r})", f"cos({t} * {_OMEGA!r})"]


def _law_sql(b: str, t: str) -> str:
    return "(" + " + ".join(f"{b}[{i + 1}] * {x}" for i, x in enumerate(_basis_sql(t))) + ")"


def _forecast_sql(b: str, at: str, then: str) -> str:
    fade = f"exp(-({then}.date - {at}.date) / {pit.TAU})"
    return f"({_law_sql(b, f'{then}.t')} + ({at}.y - {_law_sql(b, f'{at}.t')}) * {fade})"


def _eliminated(frame: str) -> str:
    """CTEs up to ``fits``: the normal equations of each row, solved by elimination column by column."""
    entries = [(i, j) for i in range(_K) for j in range(_K + 1)]
    first = ", ".join(f"sum(x{i} * {f'x{j}' if j < _K else 'y'}) {frame} AS a{i}{j}" for i, j in entries)
    steps = [f"e0 AS (SELECT asset_id, date, idx, t, y, {first} FROM basis)"]
    for p in range(_K):
        cells = ", ".join(f"a{i}{j}" + (f" - a{i}{p} / a{p}{p} * a{p}{j}" if i != p else "") + f" AS a{i}{j}" for i, j in entries)
        steps.append(f"e{p + 1} AS (SELECT asset_id, date, idx, t, y, {cells} FROM e{p})")
    solution = ", ".join(f"a{i}{_K} / a{i}{i}" for i in range(_K))
    return f"""placed AS (SELECT asset_id, date, row_number() OVER ({S}) - 1 AS idx, (date - DATE '{GENESIS}')::DOUBLE AS t, ln(close) AS y FROM bars),
basis AS (SELECT *, {", ".join(f"{x} AS x{i}" for i, x in enumerate(_basis_sql("t")))} FROM placed),
{", ".join(steps)},
fits AS (SELECT asset_id, date, idx, t, y, CASE WHEN idx + 1 >= {pit.LEAST_ROWS} THEN [{solution}] END AS b FROM e{_K})"""


_FITS = _eliminated(f"OVER ({S} ROWS UNBOUNDED PRECEDING)")


@query("powerlaw_coefficients", f"""WITH {BARS}, {_FITS}, r AS (SELECT *, {_law_sql("b", "t")} AS fitted FROM fits WHERE b IS NOT NULL AND idx % 30 = 0)
SELECT asset_id, date, {", ".join(f"{r(f'b[{i + 1}]', '1e3')} AS b{i}" for i in range(_K))}, {r("y - fitted")} AS residual FROM r""")
def powerlaw_coefficients(spark, sf_dir):
    """The law with its cycle, refitted to all rows up to every thirtieth one, and the last row's distance from it."""
    rows = pit.origins(pit.refits(order_bars(spark, sf_dir)))
    residual = F.col("y") - pit.regression.dot(F.col("b"), pit.basis(F.col("t")))
    return rows.select("asset_id", "date", *(rounded(F.col("b")[i], 1e3).alias(f"b{i}") for i in range(_K)), rounded(residual).alias("residual"))


_WINDOW = 3 * pit.LEAST_ROWS // 2
_SLOPES = f"""s AS (SELECT asset_id, date, b[2] AS v FROM fits WHERE b IS NOT NULL AND idx % 30 = 0),
j AS (SELECT *, abs(v - lag(v) OVER ({S})) / abs(lag(v) OVER ({S})) AS jump FROM s)"""
_STABILITY = f"""SELECT asset_id, count(*) AS n, {r("avg(v)", "1e3")} AS mean, {r("quantile_cont(v, 0.5)", "1e3")} AS median, {r("stddev_samp(v)", "1e3")} AS deviation,
  {r("quantile_cont(v, 0.05)", "1e3")} AS p05, {r("quantile_cont(v, 0.25)", "1e3")} AS p25, {r("quantile_cont(v, 0.75)", "1e3")} AS p75, {r("quantile_cont(v, 0.95)", "1e3")} AS p95,
  {r("(avg(v) - arg_max(v, date)) / abs(arg_max(v, date))", "1e3")} AS drift, {r("max(jump)", "1e3")} AS largest_jump,
  CASE WHEN abs((avg(v) - arg_max(v, date)) / arg_max(v, date)) >= 0.25 OR max(jump) >= 0.18 THEN 'unstable'
    WHEN abs((avg(v) - arg_max(v, date)) / arg_max(v, date)) >= 0.12 OR max(jump) >= 0.08 THEN 'watch' ELSE 'stable' END AS verdict FROM j GROUP BY asset_id"""


@query("coefficient_stability", f"WITH {BARS}, {_eliminated(f'OVER ({S} ROWS BETWEEN {_WINDOW - 1} PRECEDING AND CURRENT ROW)')}, {_SLOPES} {_STABILITY}")
def coefficient_stability(spark, sf_dir):
    """Distribution of the slope over refits of a rolling window, how far its mean lies from the last one, and how far it jumps between neighbours."""
    rows = pit.origins(pit.rolling_refits(order_bars(spark, sf_dir), _WINDOW)).withColumn("v", F.col("b")[1])
    before = F.lag("v").over(w.series())
    rows = rows.withColumn("jump", F.abs(F.col("v") - before) / F.abs(before))
    at = lambda p: rounded(F.percentile("v", F.lit(p)), 1e3)
    found = rows.groupBy("asset_id").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("_mean"), at(0.5).alias("median"), rounded(F.stddev_samp("v"), 1e3).alias("deviation"), at(0.05).alias("p05"), at(0.25).alias("p25"), at(0.75).alias("p75"), at(0.95).alias("p95"),
        F.max_by("v", "date").alias("_last"), F.max("jump").alias("_jump"),
    )
    drift = (F.col("_mean") - F.col("_last")) / F.abs("_last")
    jump = F.coalesce("_jump", F.lit(0.0))
    verdict = F.when((F.abs(drift) >= 0.25) | (jump >= 0.18), "unstable").when((F.abs(drift) >= 0.12) | (jump >= 0.08), "watch").otherwise("stable")
    return found.select("asset_id", "n", rounded("_mean", 1e3).alias("mean"), "median", "deviation", "p05", "p25", "p75", "p95", rounded(drift, 1e3).alias("drift"), rounded("_jump", 1e3).alias("largest_jump"), verdict.alias("verdict"))


_OUTER = f"""h(horizon) AS (VALUES {", ".join(f"({x})" for x in pit.HORIZONS)}),
o AS (SELECT f.*, horizon, p.b AS before, g.date AS target_date, g.y AS target_y, g.t AS target_t FROM fits f CROSS JOIN h
  JOIN fits g ON g.asset_id = f.asset_id AND g.idx = f.idx + horizon LEFT JOIN fits p ON p.asset_id = f.asset_id AND p.idx = f.idx - {pit.SPACING} WHERE f.idx % {pit.SPACING} = 0 AND f.b IS NOT NULL),
folds AS (SELECT asset_id, idx AS origin, horizon, unnest(range(greatest({pit.LEAST_ROWS}, idx - horizon - 1 - {pit.FOLDS - 1} * horizon), idx - horizon, horizon)) AS idx FROM o)"""
_PIT = f"""WITH {BARS}, {_FITS}, {_OUTER},
grid(weight) AS (VALUES {", ".join(f"({x})" for x in pit.WEIGHTS)}),
losses AS (SELECT d.asset_id, d.origin, d.horizon, weight, count(*) AS n_folds, avg(abs((1 - weight) * {_forecast_sql("a.b", "f", "g")} + weight * {_forecast_sql("f.b", "f", "g")} - g.y)) AS loss
  FROM folds d CROSS JOIN grid JOIN fits f ON f.asset_id = d.asset_id AND f.idx = d.idx JOIN fits g ON g.asset_id = d.asset_id AND g.idx = d.idx + d.horizon
  JOIN fits a ON a.asset_id = d.asset_id AND a.idx = greatest({pit.LEAST_ROWS}, d.idx - d.horizon) GROUP BY ALL),
best AS (SELECT * FROM losses QUALIFY row_number() OVER (PARTITION BY asset_id, origin, horizon ORDER BY loss, weight) = 1),
means AS (SELECT asset_id, date, avg(close) OVER ({S} ROWS 19 PRECEDING) AS m20, avg(close) OVER ({S} ROWS 49 PRECEDING) AS m50, avg(close) OVER ({S} ROWS 199 PRECEDING) AS m200,
  coalesce(lag(ln(close), 90) OVER ({S}), first_value(ln(close)) OVER ({S})) AS back FROM bars),
met AS (SELECT f.*, coalesce(n_folds, 0) AS n_folds, coalesce(weight, {pit.WEIGHTS[0]}) AS weight, {_forecast_sql("coalesce(f.before, f.b)", "f", "g")} AS anchor, {_forecast_sql("f.b", "f", "g")} AS refit, m20, m50, m200, back
  FROM o f JOIN fits g ON g.asset_id = f.asset_id AND g.idx = f.idx + f.horizon JOIN means m ON m.asset_id = f.asset_id AND m.date = f.date
  LEFT JOIN best ON best.asset_id = f.asset_id AND best.origin = f.idx AND best.horizon = f.horizon),
e AS (SELECT *, abs(refit - target_y) AS err FROM met),
past AS (SELECT n.asset_id, n.idx, n.horizon, count(*) FILTER (p.target_date >= n.date) AS n_unresolved, count(*) FILTER (p.target_date < n.date AND p.date >= n.date - n.horizon::INT) AS n_embargoed,
  list_sort(list(p.err) FILTER (p.target_date < n.date AND p.date < n.date - n.horizon::INT)) AS matured FROM e n JOIN e p ON p.asset_id = n.asset_id AND p.horizon = n.horizon AND p.idx < n.idx GROUP BY ALL)
SELECT e.asset_id, e.date, e.horizon, target_date, n_folds, weight::DOUBLE AS weight, {r("exp((1 - weight) * anchor + weight * refit)", "1e1")} AS median,
  {", ".join(f"{r(f'abs({1 - x} * anchor + {x} * refit - target_y)')} AS err_{round(100 * x):03d}" for x in pit.WEIGHTS)},
  {r("abs((1 - weight) * anchor + weight * refit - target_y)")} AS err_chosen, {r("err")} AS err_refit, {r("abs(y - target_y)")} AS err_naive,
  {r("abs(y + (y - back) / greatest(1, least(90, e.idx)) * e.horizon - target_y)")} AS err_drift,
  {r("abs(y + greatest(-0.006, least(0.006, 0.55 * ln(m20 / m50) / 30 + 0.45 * ln(m50 / m200) / 150)) * e.horizon - target_y)")} AS err_trend,
  coalesce(len(matured), 0)::BIGINT AS n_eligible, coalesce(n_unresolved, 0) AS n_unresolved, coalesce(n_embargoed, 0) AS n_embargoed,
  {", ".join(f"CASE WHEN len(matured) >= {pit.LEAST_ERRORS} THEN {r(f'matured[floor((len(matured) - 1) * {p})::INT + 1]')} END AS {name}" for name, p in pit.INTERVALS.items())}
FROM e LEFT JOIN past USING (asset_id, idx, horizon)"""


@query("pit_benchmark", _PIT)
def pit_benchmark(spark, sf_dir):
    """Errors of the structural forecast whose weight was chosen on inner folds, and of its benchmarks, at every origin and horizon."""
    found = pit.structural_benchmark(order_bars(spark, sf_dir))
    errors = [c for c in found.columns if c.startswith("err_")]
    return found.select(
        "asset_id", "date", "horizon", "target_date", F.col("n_folds").cast("long").alias("n_folds"), "weight", rounded(F.exp("log_median"), 1e1).alias("median"), *(rounded(c).alias(c) for c in errors),
        "n_eligible", "n_unresolved", "n_embargoed", *(rounded(c).alias(c) for c in pit.INTERVALS),
    )


def _filter_sql(columns: list[str], source: str) -> str:
    """CTEs up to ``filtered``: levels and residuals of each column's filter for every row and entry of the grid (recursive)."""
    grid = ", ".join(f"({g}, {p.level!r}, {p.residual!r}, {p.noise!r}, {p.persistence!r})" for g, p in enumerate(statespace.GRID))
    pack = "[" + ", ".join(f"({c})::DOUBLE" for c in columns) + "]"
    n = len(columns)
    e = [f"(s.xs[{i + 1}] - f.level[{i + 1}] - f.residual[{i + 1}] * q.phi)" for i in range(n)]
    return f"""q(grid, q0, q1, noise, phi) AS (VALUES {grid}),
seen AS MATERIALIZED (SELECT asset_id, idx, {pack} AS xs FROM {source}),
gains(grid, idx, k0, k1, p00, p01, p11) AS (SELECT grid, -1::BIGINT AS idx, 0.0::DOUBLE AS k0, 0.0::DOUBLE AS k1, {statespace.FIRST_VARIANCE}::DOUBLE AS p00, 0.0::DOUBLE AS p01, q1::DOUBLE / (1 - phi * phi) AS p11 FROM q
  UNION ALL SELECT grid, idx + 1, k0, k1, c00 - k0 * (c00 + c01), ((c01 - k0 * (c01 + c11)) + (c01 - k1 * (c00 + c01))) / 2, c11 - k1 * (c01 + c11)
  FROM (SELECT grid, idx, c00, c01, c11, (c00 + c01) / (c00 + 2 * c01 + c11 + noise) AS k0, (c01 + c11) / (c00 + 2 * c01 + c11 + noise) AS k1
    FROM (SELECT g.grid, idx, p00 + q0 AS c00, p01 * phi AS c01, p11 * phi * phi + q1 AS c11, noise FROM gains g JOIN q USING (grid) WHERE idx < (SELECT max(idx) FROM seen)))),
steps AS MATERIALIZED (SELECT * FROM gains),
filtered(asset_id, grid, idx, level, residual) AS (SELECT asset_id, grid, -1::BIGINT AS idx, xs AS level, list_transform(xs, lambda x: 0.0::DOUBLE) AS residual FROM seen CROSS JOIN q WHERE idx = 0
  UNION ALL SELECT f.asset_id, f.grid, s.idx, [{", ".join(f"f.level[{i + 1}] + g.k0 * {e[i]}" for i in range(n))}], [{", ".join(f"f.residual[{i + 1}] * q.phi + g.k1 * {e[i]}" for i in range(n))}]
  FROM filtered f JOIN q USING (grid) JOIN seen s ON s.asset_id = f.asset_id AND s.idx = f.idx + 1 JOIN steps g ON g.grid = f.grid AND g.idx = s.idx)"""


def _state_sql(b: str, state: str, then: str) -> str:
    rest = lambda part: f"({state}.{part}[1] - ({' + '.join(f'{b}[{j + 1}] * {state}.{part}[{j + 2}]' for j in range(_K))}))"
    return f"({_law_sql(b, f'{then}.t')} + {rest('level')} + {rest('residual')} * pow(q.phi, d.horizon))"


_PIT_STATE = f"""WITH RECURSIVE {BARS}, {_FITS}, {_OUTER}, {_filter_sql(["y", "x0", "x1", "x2", "x3"], "basis")},
losses AS (SELECT d.asset_id, d.origin, d.horizon, s.grid, count(*) AS n_folds, avg(abs({_state_sql("f.b", "s", "g")} - g.y)) AS loss FROM folds d JOIN fits f ON f.asset_id = d.asset_id AND f.idx = d.idx
  JOIN fits g ON g.asset_id = d.asset_id AND g.idx = d.idx + d.horizon JOIN filtered s ON s.asset_id = d.asset_id AND s.idx = d.idx JOIN q ON q.grid = s.grid GROUP BY ALL),
best AS (SELECT * FROM losses QUALIFY row_number() OVER (PARTITION BY asset_id, origin, horizon ORDER BY loss, grid) = 1),
m AS (SELECT d.asset_id, d.idx, d.date, d.horizon, d.target_date, s.grid, {_state_sql("d.b", "s", "g")} AS m, g.y FROM o d JOIN fits g ON g.asset_id = d.asset_id AND g.idx = d.idx + d.horizon
  JOIN filtered s ON s.asset_id = d.asset_id AND s.idx = d.idx JOIN q ON q.grid = s.grid)
SELECT m.asset_id, date, m.horizon, target_date, coalesce(any_value(n_folds), 0)::BIGINT AS n_folds, coalesce(any_value(best.grid), 0)::INT AS grid, {r("exp(max(m) FILTER (m.grid = coalesce(best.grid, 0)))", "1e1")} AS median,
  {", ".join(f"{r(f'max(abs(m - y)) FILTER (m.grid = {g})')} AS err_{g}" for g in range(len(statespace.GRID)))}, {r("max(abs(m - y)) FILTER (m.grid = coalesce(best.grid, 0))")} AS err_chosen
FROM m LEFT JOIN best ON best.asset_id = m.asset_id AND best.origin = m.idx AND best.horizon = m.horizon GROUP BY m.asset_id, date, m.horizon, target_date"""


@query("pit_state_space", _PIT_STATE)
def pit_state_space(spark, sf_dir):
    """Errors of state-space forecasts around the law, with parameters chosen on inner folds."""
    found = pit.state_space_benchmark(order_bars(spark, sf_dir))
    errors = [c for c in found.columns if c.startswith("err_")]
    return found.select("asset_id", "date", "horizon", "target_date", F.col("n_folds").cast("long").alias("n_folds"), "grid", rounded(F.exp("log_median"), 1e1).alias("median"), *(rounded(c).alias(c) for c in errors))


_SPINE = f"""ends AS (SELECT asset_id, min(date) AS first_date, max(date) AS last_date FROM bars GROUP BY 1),
days AS (SELECT asset_id, unnest(generate_series(first_date, last_date, INTERVAL 1 DAY))::DATE AS date FROM ends),
spine AS MATERIALIZED (SELECT d.asset_id, d.date, row_number() OVER (PARTITION BY d.asset_id ORDER BY d.date) - 1 AS idx, ln(close) - 11.5 AS y FROM days d LEFT JOIN bars b ON b.asset_id = d.asset_id AND b.date = d.date)"""
_STATE_SPACE = f"""WITH RECURSIVE {BARS}, {_SPINE},
q(grid, q0, q1, noise, phi) AS (VALUES {", ".join(f"({g}, {p.level!r}::DOUBLE, {p.residual!r}::DOUBLE, {p.noise!r}::DOUBLE, {p.persistence!r}::DOUBLE)" for g, p in enumerate(statespace.GRID))}),
k AS (SELECT s.asset_id, grid, -1::BIGINT AS idx, y AS level, 0.0::DOUBLE AS residual, {statespace.FIRST_VARIANCE}::DOUBLE AS p00, 0.0::DOUBLE AS p01, q1 / (1 - phi * phi) AS p11, 0.0::DOUBLE AS ll, 0.0::DOUBLE AS squares, 0::BIGINT AS n, 0::BIGINT AS missing
  FROM spine s CROSS JOIN q WHERE idx = 0
  UNION ALL SELECT asset_id, grid, idx, CASE WHEN y IS NULL THEN level ELSE level + (c00 + c01) / v * (y - level - residual) END, CASE WHEN y IS NULL THEN residual ELSE residual + (c01 + c11) / v * (y - level - residual) END,
    CASE WHEN y IS NULL THEN c00 ELSE c00 - (c00 + c01) * (c00 + c01) / v END, CASE WHEN y IS NULL THEN c01 ELSE c01 - (c00 + c01) * (c01 + c11) / v END, CASE WHEN y IS NULL THEN c11 ELSE c11 - (c01 + c11) * (c01 + c11) / v END,
    CASE WHEN y IS NULL THEN ll ELSE ll - 0.5 * (ln(2 * pi() * v) + (y - level - residual) * (y - level - residual) / v) END, CASE WHEN y IS NULL THEN squares ELSE squares + (y - level - residual) * (y - level - residual) / v END, n + (y IS NOT NULL)::INT, missing + (y IS NULL)::INT
  FROM (SELECT k.asset_id, k.grid, s.idx, s.y, level, residual * phi AS residual, p00 + q0 AS c00, p01 * phi AS c01, p11 * phi * phi + q1 AS c11, p00 + q0 + 2 * p01 * phi + p11 * phi * phi + q1 + noise AS v, ll, squares, n, missing
    FROM k JOIN q USING (grid) JOIN spine s ON s.asset_id = k.asset_id AND s.idx = k.idx + 1)),
fitted AS (SELECT k.* FROM k JOIN (SELECT asset_id, max(idx) AS idx FROM spine GROUP BY 1) USING (asset_id, idx)),
best AS (SELECT * FROM fitted QUALIFY row_number() OVER (PARTITION BY asset_id ORDER BY ll DESC, grid) = 1)
SELECT asset_id, grid::INT AS grid, n, missing, {r("ll", "1e2")} AS log_likelihood, {r("squares / n", "1e3")} AS mean_square, {r("level")} AS level, {r("residual")} AS residual, horizon::INT AS horizon, {r("level + residual * pow(phi, horizon)")} AS mean,
  {r("p00 + q0 * horizon + 2 * p01 * pow(phi, horizon) + p11 * pow(phi, 2 * horizon) + q1 * (1 - pow(phi, 2 * horizon)) / (1 - phi * phi)", "1e7")} AS variance
FROM best JOIN q USING (grid) CROSS JOIN (VALUES (1), (14), (90)) v(horizon)"""


@query("state_space_fit", _STATE_SPACE)
def state_space_fit(spark, sf_dir):
    """Level and fading residual of the log price on all calendar days, where days without trade only predict: the likeliest parameters of the grid, and their forecast."""
    bars = order_bars(spark, sf_dir)
    ends = bars.groupBy("asset_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    days = ends.select("asset_id", F.explode(F.sequence("first", "last")).alias("date"))
    rows = days.join(bars.select("asset_id", "date", (F.ln("close") - 11.5).alias("y")), ["asset_id", "date"], "left")
    best = best_of(statespace.fit_grid(rows, "y"), ["asset_id"], F.desc("log_likelihood"), F.col("grid"))
    found = statespace.forecast(best, (1, 14, 90))
    return found.select(
        "asset_id", "grid", "n", "missing", rounded("log_likelihood", 1e2).alias("log_likelihood"), rounded("squares", 1e3).alias("mean_square"), rounded("level").alias("level"), rounded("residual").alias("residual"), "horizon",
        rounded("mean").alias("mean"), rounded("variance", 1e7).alias("variance"),
    )


@query("pit_scores", f"""WITH b AS ({_PIT}) SELECT asset_id, horizon, count(*) AS n, {r("quantile_cont(err_chosen, 0.5)", "1e3")} AS chosen, {r("quantile_cont(err_refit, 0.5)", "1e3")} AS refit, {r("quantile_cont(err_naive, 0.5)", "1e3")} AS naive,
  {r("avg((err_refit <= q90)::INT)", "1e3")} AS cov90, count(q90) AS n_intervals,
  CASE WHEN count(q90) < 30 THEN 'needs-more-data' WHEN quantile_cont(err_chosen, 0.5) < 0.99 * quantile_cont(err_naive, 0.5) AND avg((err_refit <= q90)::INT) BETWEEN 0.85 AND 0.95 THEN 'promote' ELSE 'reject' END AS verdict FROM b GROUP BY ALL""")
def pit_scores(spark, sf_dir):
    """Median errors at each horizon, how often the matured quantile held, and the verdict."""
    rows = pit_benchmark(spark, sf_dir)
    median = lambda c: F.percentile(c, F.lit(0.5))
    held = F.avg((F.col("err_refit") <= F.col("q90")).cast("int"))
    good = (median("err_chosen") < 0.99 * median("err_naive")) & held.between(0.85, 0.95)
    return rows.groupBy("asset_id", "horizon").agg(
        F.count(F.lit(1)).alias("n"), rounded(median("err_chosen"), 1e3).alias("chosen"), rounded(median("err_refit"), 1e3).alias("refit"), rounded(median("err_naive"), 1e3).alias("naive"), rounded(held, 1e3).alias("cov90"),
        F.count("q90").alias("n_intervals"), F.when(F.count("q90") < 30, "needs-more-data").when(good, "promote").otherwise("reject").alias("verdict"),
    )
