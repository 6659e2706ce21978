"""The catalogue of studies over the registered features, and its verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import rounded
from tidewell.operators import catalogue, models, pointintime
from tidewell.operators import windows as w
from tidewell.operators.catalogue import Study
from tidewell.plans.common import S, last_rows, query, r, rows_before
from tidewell.plans.registry_features import FEATURES, _registry_sql, _values, _z
from tidewell.sources.bars import MARKET, market_bars

HORIZONS = (14, 30, 60, 90)
VALIDATION, HOLDOUT = ("1996-06-01", "1998-12-31"), "1999-01-01"
FIRST = 365
TAU = 210.0

# Strengths that are tried.
SHIFTS = tuple(round(0.05 * i, 2) for i in range(-6, 7))
FLOWS = tuple(round(0.4 / 7 * i, 4) for i in range(-7, 8))
STATES = tuple(round(0.35 / 6 * i, 4) for i in range(-6, 7))
SCALES = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5)
TAILS = (0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.75)
RULE = (0.0, 1.0)

#: Scores against all earlier days, held to four deviations: column, feature.
_SCORED = (
    "stablecoinSupplyChange30d", "stablecoinSupplyChange90d", "stablecoinLiquidityImpulse30dVsAnnual", "futuresPremiumRange", "spotEtfFlow5dToBtcMarketCap", "spotEtfFlow20dToBtcMarketCap", "spotEtfCumulativeFlowUSD",
)
_PRIOR = f"OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_HELD = lambda x: f"greatest(-4e0, least(4e0, {x}))"
_DERIVED = {f"z_{n}": f"CASE WHEN {n} IS NOT NULL AND ({_z(n, _PRIOR, FIRST)}) IS NOT NULL THEN {_HELD(_z(n, _PRIOR, FIRST))} END" for n in _SCORED} | {
    "activity": f"(ln(activeAddresses / lag(activeAddresses, 30) OVER ({S})) + ln(transactionCount / lag(transactionCount, 30) OVER ({S}))) / 2",
    "miner": _z("minerStressProxy", rows_before(365), 300),
}
_CHEAP = "(coalesce(mvrvPercentile, 1) <= 0.3 OR coalesce(priceResidualLog, 0) <= -0.25)"
_FALL, _MOMENTUM = "coalesce(drawdownFromCycleHigh, 0)", "coalesce(residualMomentum30d, 0)"
_COT = lambda c, low: f"coalesce(cmeCot{c}PctRank, {1 if low else 0}) {'<= 0.1' if low else '>= 0.9'}"


def _signal(study: str, name: str, x: str, grid: tuple[float, ...]) -> Study:
    return Study(study, name, "median", f"{x} IS NOT NULL", x, grid)


def _event(study: str, name: str, when: str, grid: tuple[float, ...], moves: str = "median") -> Study:
    return Study(study, name, moves, when, "1e0", grid)


#: What each study looks at, in order of the studies.
STUDIES = [
    Study("liquidity", "stablecoin-supply-z365", "median", "stablecoinSupplyZ365d IS NOT NULL", _HELD("stablecoinSupplyZ365d"), SHIFTS),
    _signal("liquidity", "stablecoin-30d-impulse", "z_stablecoinSupplyChange30d", SHIFTS),
    _signal("liquidity", "stablecoin-90d-impulse", "z_stablecoinSupplyChange90d", SHIFTS),
    _signal("liquidity", "stablecoin-liquidity-impulse", "z_stablecoinLiquidityImpulse30dVsAnnual", SHIFTS),
    _signal("liquidity", "derivatives-funding-z90", "futuresFundingRateSumZ90d", SHIFTS),
    _signal("liquidity", "derivatives-premium-z90", "futuresPremiumCloseZ90d", SHIFTS),
    _signal("liquidity", "derivatives-premium-range", "z_futuresPremiumRange", SHIFTS),
    _signal("liquidity", "derivatives-crowding-composite", "(futuresFundingRateSumZ90d + futuresPremiumCloseZ90d) / 2", SHIFTS),
    _signal("etf-demand", "etf-flow-5d-marketcap", "z_spotEtfFlow5dToBtcMarketCap", FLOWS),
    _signal("etf-demand", "etf-flow-20d-marketcap", "z_spotEtfFlow20dToBtcMarketCap", FLOWS),
    _signal("etf-demand", "etf-flow-shock", "spotEtfFlowShockZ90d", FLOWS),
    _signal("etf-demand", "etf-cumulative-trend", "z_spotEtfCumulativeFlowUSD", FLOWS),
    _event("sentiment", "extreme-fear", "coalesce(fearGreedIndex, 101) <= 25", SHIFTS),
    _event("sentiment", "extreme-greed", "coalesce(fearGreedIndex, -1) >= 75", SHIFTS),
    _event("sentiment", "fear-after-drawdown", f"coalesce(fearGreedIndex, 101) <= 25 AND {_FALL} <= -0.2", SHIFTS),
    _event("sentiment", "greed-after-rally", f"coalesce(fearGreedIndex, -1) >= 75 AND {_MOMENTUM} > 0", SHIFTS),
    _event("sentiment", "sentiment-price-divergence", "coalesce(fearGreedIndex, 101) <= 35 AND priceResidualLog >= 0", SHIFTS),
    _event("on-chain", "cheap-and-active", f"{_CHEAP} AND activity >= 0.08", STATES),
    _event("on-chain", "cheap-and-dead", f"{_CHEAP} AND activity <= -0.08", STATES),
    _event("on-chain", "miner-stress", f"coalesce(miner, 0) <= -1 AND {_FALL} <= -0.45", STATES),
    _event("on-chain", "network-expansion", f"activity >= 0.1 AND {_MOMENTUM} > 0", STATES),
    _event("on-chain", "valuation-activity-divergence", f"{_CHEAP} AND activity <= 0", STATES),
    _event("macro", "macro-stress", "macroRiskScore >= 1 OR macroHighYieldSpreadZ252d >= 1", SCALES, "widen"),
    _event("macro", "credit-stress", "macroHighYieldSpreadZ252d >= 1", SCALES, "widen"),
    _event("macro", "liquidity-easing", "macroFedBalanceSheetChange13w > 0 AND macroRiskScore <= -0.25", SCALES, "narrow"),
    _event("macro", "tightening-pressure", "(coalesce(macroFedBalanceSheetChange26w, 0) < -0.02 OR coalesce(macroFedFundsChange13w, 0) > 0.25) AND macroRiskScore > 0", SCALES, "widen"),
    _event("cme-cot", "leveraged-money-crowded-short", _COT("LeveragedMoneyNet", True), TAILS, "widen"),
    _event("cme-cot", "leveraged-money-crowded-long", _COT("LeveragedMoneyNet", False), TAILS, "widen"),
    _event("cme-cot", "asset-manager-crowded-long", _COT("AssetManagerNet", False), TAILS, "widen"),
    _event("cme-cot", "dealer-short-pressure", _COT("DealerNet", True), TAILS, "widen"),
    _event("cme-cot", "open-interest-expansion", f"{_COT('OpenInterest', False)} AND cmeCotOpenInterestChange4w > 0.05", TAILS, "widen"),
    Study("tail-risk", "crowding", "widen", "futuresFundingRateSumZ90d IS NOT NULL AND futuresPremiumCloseZ90d IS NOT NULL", "greatest(0e0, (least(4e0, abs(futuresFundingRateSumZ90d)) + least(4e0, abs(futuresPremiumCloseZ90d))) / 2 - 1)", TAILS),
    Study("hand-rules", "momentum", "median", "residualMomentum30d IS NOT NULL", "greatest(-0.08e0, least(0.08e0, 0.15e0 * residualMomentum30d)) * least(1e0, horizon / 30e0)", RULE),
    Study("hand-rules", "value-reversion", "median", "priceResidualLog IS NOT NULL", "greatest(-0.1e0, least(0.1e0, -0.1e0 * priceResidualLog)) * least(1e0, horizon / 90e0)", RULE),
    Study("hand-rules", "valuation-percentile", "median", "mvrvPercentile < 0.25 OR mvrvPercentile > 0.85", "CASE WHEN mvrvPercentile < 0.25 THEN 0.04e0 ELSE -0.04e0 END * least(1e0, horizon / 90e0)", RULE),
    Study("hand-rules", "bear-penalty", "median", "drawdownFromCycleHigh < -0.35 AND residualMomentum30d < 0", "-0.04e0 * least(1e0, horizon / 60e0)", RULE),
]


def _named() -> list[str]:
    text = " ".join([*(s.when + " " + s.signal for s in STUDIES), *_DERIVED.values()])
    return [f.name for f in FEATURES if f.name in text]


NAMED = _named()


def study_rows(spark, sf_dir) -> DataFrame:
    """Origins a horizon apart, with the error of the law's forecast, sigma, and the features that studies name."""
    wide = _values(spark, sf_dir, only=MARKET).groupBy("asset_id", "date").pivot("name", NAMED).agg(F.max("value"))
    wide = wide.withColumns({n: F.expr(x) for n, x in _DERIVED.items()})
    rows = market_bars(spark, sf_dir).select("asset_id", "date", "close").withColumns({"idx": F.row_number().over(w.series()) - 1, "ret": w.log_return("close"), "t": pointintime.days_since("date"), "y": F.ln("close")})
    rows = rows.withColumn("vol", F.when(F.count("ret").over(w.trailing(90)) == 90, F.stddev_samp("ret").over(w.trailing(90))))
    rows = pointintime.ahead(rows, HORIZONS).where((F.col("idx") >= FIRST) & ((F.col("idx") - FIRST) % F.col("horizon") == 0) & (F.col("vol") > 0))
    law = lambda t: F.lit(models.BASE_LAW[0]) + models.BASE_LAW[1] * F.ln(t)
    median = law(F.col("target_t")) + (F.col("y") - law(F.col("t"))) * F.col("fade")
    rows = rows.select("asset_id", "date", "horizon", (F.col("target_y") - median).alias("error"), (F.col("vol") * F.sqrt("horizon")).alias("sigma"))
    return rows.join(wide, ["asset_id", "date"])


_LAW = lambda t: f"({models.BASE_LAW[0]} + {models.BASE_LAW[1]} * ln({t}))"
_CELLS = ", ".join(f"{{'study': '{s.study}', 'id': '{s.id}', 'moves': '{s.moves}', 'signal': CASE WHEN {s.when} THEN ({s.signal})::DOUBLE END, 'grid': {[float(g) for g in s.grid]}}}" for s in STUDIES)
_NLL = lambda sigma: f"(0.5 * ln(2 * pi()) + ln({sigma}) + error * error / (2 * {sigma} * {sigma}))"
_STUDIED = f"""{_registry_sql()},
wide0 AS (SELECT asset_id, date, {", ".join(f"max(value) FILTER (name = '{n}') AS {n}" for n in NAMED)} FROM cells WHERE asset_id = '{MARKET}' GROUP BY 1, 2),
wide AS (SELECT *, {", ".join(f"{x} AS {n}" for n, x in _DERIVED.items())} FROM wide0),
p AS (SELECT asset_id, date, t, ln(close) AS y, row_number() OVER ({S}) - 1 AS idx, ln(close / lag(close) OVER ({S})) AS ret FROM days WHERE asset_id = '{MARKET}'),
pv AS (SELECT *, CASE WHEN count(ret) {last_rows(90)} = 90 THEN stddev_samp(ret) {last_rows(90)} END AS vol FROM p),
err AS (SELECT a.asset_id, a.date, h.horizon, b.y - ({_LAW("b.t")} + (a.y - {_LAW("a.t")}) * exp(-(b.date - a.date) / {TAU})) AS error, a.vol * sqrt(h.horizon) AS sigma FROM pv a CROSS JOIN (SELECT unnest({list(HORIZONS)})::INT AS horizon) h
  JOIN p b ON b.idx = a.idx + h.horizon WHERE a.idx >= {FIRST} AND (a.idx - {FIRST}) % h.horizon = 0 AND a.vol > 0),
act AS (SELECT date, horizon, error, sigma, unnest([{_CELLS}]) AS c FROM err JOIN wide USING (asset_id, date)),
mv AS (SELECT date, horizon, error, sigma, c.study AS study, c.id AS id, c.moves AS moves, c.signal AS signal, unnest(c.grid) AS strength FROM act WHERE c.signal IS NOT NULL),
gn AS (SELECT *, CASE moves WHEN 'median' THEN abs(error) - abs(error - strength * signal) WHEN 'widen' THEN {_NLL("sigma")} - {_NLL("(sigma * (1 + strength * signal))")} ELSE {_NLL("sigma")} - {_NLL(f"(sigma * greatest({catalogue.NARROWEST}, 1 - strength * signal))")} END AS gain FROM mv),
sc AS (SELECT study, id, horizon, strength, count(*) FILTER (early) AS n_validation, count(*) FILTER (late) AS n_holdout, avg(gain) FILTER (early) AS validation, avg(gain) FILTER (late) AS holdout, stddev_samp(gain) FILTER (late) AS spread
  FROM (SELECT *, date BETWEEN DATE '{VALIDATION[0]}' AND DATE '{VALIDATION[1]}' AS early, date >= DATE '{HOLDOUT}' AS late FROM gn) GROUP BY ALL),
studied AS (SELECT *, holdout - {catalogue.BOUND} * spread / sqrt(n_holdout) AS bound FROM sc WHERE n_validation >= {catalogue.LEAST_VALIDATION} OR strength = 0
  QUALIFY row_number() OVER (PARTITION BY study, id, horizon ORDER BY floor(coalesce(validation, 0) * 1e9 + 0.5) DESC, abs(strength), strength) = 1)"""


def _found(spark, sf_dir) -> DataFrame:
    return catalogue.evaluate(study_rows(spark, sf_dir), STUDIES, VALIDATION, HOLDOUT)


@query("study_catalogue", f"""WITH {_STUDIED} SELECT study, id, horizon, {r("strength")} AS strength, n_validation, n_holdout, {r("validation")} AS validation, {r("holdout")} AS holdout, {r("bound")} AS bound FROM studied""")
def study_catalogue(spark, sf_dir):
    """Every study at every horizon: the strength that validation chose, and what it was worth afterwards."""
    return _found(spark, sf_dir).select("study", "id", "horizon", rounded("strength").alias("strength"), "n_validation", "n_holdout", *(rounded(c).alias(c) for c in ("validation", "holdout", "bound")))


@query("study_verdicts", f"""WITH {_STUDIED},
v AS (SELECT study, id, count(*) FILTER (n_validation >= {catalogue.LEAST_VALIDATION} AND n_holdout >= {catalogue.LEAST_HOLDOUT}) AS n_horizons, count(*) FILTER (n_validation >= {catalogue.LEAST_VALIDATION} AND validation > 1e-9) AS n_validation_better,
  count(*) FILTER (n_holdout >= {catalogue.LEAST_HOLDOUT} AND holdout > 1e-9 AND bound > 1e-9) AS n_holdout_better, max(holdout) FILTER (n_holdout >= {catalogue.LEAST_HOLDOUT}) AS best FROM studied GROUP BY 1, 2)
SELECT study, id, n_horizons, n_validation_better, n_holdout_better, CASE WHEN n_horizons = 0 THEN 'needs-more-data' WHEN n_validation_better >= {catalogue.LEAST_HORIZONS} AND n_holdout_better >= {catalogue.LEAST_HORIZONS} THEN 'candidate'
  WHEN best > 1e-9 AND n_validation_better >= 1 THEN 'context-only' ELSE 'reject' END AS verdict FROM v""")
def study_verdicts(spark, sf_dir):
    """Which studies improved on validation and stayed better on the holdout, at how many horizons."""
    return catalogue.verdicts(_found(spark, sf_dir))
