"""The register of features, and queries over the table that is compiled from it.

The given tables have no chain, futures, sentiment or macro series, so daily
counts and sums of the orders stand in for them: a source is a list of stages
over the days of an asset, each a set of columns or a condition.  Stages and
feature values are written in the SQL that Spark and DuckDB share; how they are
joined, lagged and told missing is not.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewell.functions.scalars import rounded
from tidewell.operators import models, scans
from tidewell.operators.features import Feature, Source, feature_values, look_ahead, packed
from tidewell.plans.common import BARS, S, last_rows, query, r, rows_before
from tidewell.sources.bars import MARKET, order_bars, table

_ALL = f"OVER ({S} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
_ON = f"OVER ({S})"


def _z(x: str, frame: str, least: float) -> str:
    return f"CASE WHEN count({x}) {frame} >= {least} THEN ({x} - avg({x}) {frame}) / nullif(stddev_pop({x}) {frame}, 0) END"


def _sum(x: str, n: int, share: float) -> str:
    return f"CASE WHEN count({x}) {last_rows(n)} >= {share * n} THEN sum({x}) {last_rows(n)} END"


def _change(x: str, k: int) -> str:
    return f"{x} / nullif(lag({x}, {k}) {_ON}, 0) - 1"


_RET = {"ret": f"ln(close / lag(close) {_ON})"}
_STAGES: dict[str, list] = {
    "price": [_RET, {"vol30": f"CASE WHEN count(ret) {last_rows(30)} = 30 THEN stddev_pop(ret) {last_rows(30)} * sqrt(365) END", "fall": f"close / max(close) {_ALL} - 1", "law": f"{models.BASE_LAW[0]} + {models.BASE_LAW[1]} * ln(t)"}],
    "mvrv": [{"marketCap": f"close * sum(n) {_ALL}", "mean_close": f"avg(close) {_ALL}"}, {"mvrv": "close / mean_close"}, {"z": _z("mvrv", _ALL, 30)}],
    "onchain": [
        {
            "realizedPriceUSD": f"avg(close) {_ALL}", "activeAddresses": "customers", "transactionCount": "n", "transferCount": "n + n_f", "addressBalanceCount": f"sum(customers) {_ALL}", "hashRate": "volume / 1000",
            "minerRevenueUSD": "v_f", "marketCapUSD": f"close * sum(n) {_ALL}",
        }
    ],
    "derivatives": [
        "n_o > 0",
        {"rate": "(v_o / volume - 0.5) / 100", "premiumClose": f"close / avg(close) {last_rows(20)} - 1", "premiumRange": "(high - low) / close", "openInterestUSD": "v_o"},
        {"rate_avg": "rate / n"},
        {"sum7": _sum("rate", 7, 0.8), "sum30": _sum("rate", 30, 0.8), "rateZ": _z("rate", last_rows(90), 72), "avgZ": _z("rate_avg", last_rows(90), 72), "premiumZ": _z("premiumClose", last_rows(90), 72)},
    ],
    "stablecoin": [
        {"total": f"sum(volume) {_ALL}"},
        {**{f"change{k}": _change("total", k) for k in (7, 30, 90, 365)}, "totalZ": _z("total", rows_before(365), 292)},
        {"impulse": "change30 - change365 * 30 / 365"},
    ],
    "sentiment": [
        _RET,
        {"gauge": f"CASE WHEN count(ret) {last_rows(14)} = 14 THEN 100 * avg(CASE WHEN ret > 0 THEN 1e0 ELSE 0e0 END) {last_rows(14)} END"},
        {"change7": f"gauge - lag(gauge, 7) {_ON}", "change30": f"gauge - lag(gauge, 30) {_ON}", "fear": "CASE WHEN gauge <= 25 THEN 1 WHEN gauge > 25 THEN 0 END", "greed": "CASE WHEN gauge >= 75 THEN 1 WHEN gauge < 75 THEN 0 END"},
    ],
    "cot": [
        {"week_before": f"lag(week) {_ON}"},
        "week_before IS NULL OR week <> week_before",
        {"oi": "volume", "leveraged": "floor((v_f - v_o) / volume * 1e9 + 0.5) / 1e9", "manager": "(n_f - n_o) / (n * 1e0)", "dealer": "(close - open) / close"},
        {"oi4": _change("oi", 4)},
    ],
    "macro": [
        {"month_before": f"lag(month) {_ON}"},
        "month_before IS NULL OR month <> month_before",
        {"balance": f"sum(volume) {_ALL}", "funds": "v_f / volume * 10", "yield10": "n_f / (n * 1e0) * 5", "spread": "(high - low) / close", "m2": f"sum(n) {_ALL}"},
        {
            "balance13": _change("balance", 3), "balance26": _change("balance", 6), "funds13": f"funds - lag(funds, 3) {_ON}", "yield1": f"yield10 - lag(yield10, 1) {_ON}", "yield3": f"yield10 - lag(yield10, 3) {_ON}",
            "spreadZ": _z("spread", rows_before(12), 6), "m26": _change("m2", 6),
        },
        {"impulseZ": _z("balance13", rows_before(12), 6)},
        {"risk": "spreadZ - impulseZ"},
    ],
    "etf": [
        "date >= DATE '1997-01-01' AND n_f > 0",
        {"flow": "v_f - v_o"},
        {"flow5": _sum("flow", 5, 1), "flow20": _sum("flow", 20, 1), "flows": f"sum(flow) {_ALL}", "flowZ": _z("flow", rows_before(90), 90)},
    ],
}
#: Days after its date from which a row may be used, where that is later than the next day.
_DELAY = {"derivatives": 1, "stablecoin": 1, "sentiment": 1, "cot": 4, "macro": 30, "etf": 1}
#: Running ranks: source, columns, values needed, whether a row counts itself.
_RANKS = {
    "mvrv": ({"mvrv": "percentile"}, 30, True),
    "cot": ({"oi": "oiRank", "leveraged": "leveragedRank", "manager": "managerRank", "dealer": "dealerRank"}, 52, False),
}
SOURCES = [
    Source("price"), *(Source(f"price{k}", lag=1 + k) for k in (7, 30, 90)), Source("mvrv"), Source("onchain"), Source("derivatives", silent=True), Source("stablecoin", silent=True), Source("sentiment", silent=True),
    Source("cot", daily=False, silent=True), Source("macro", daily=False, silent=True), Source("etf", daily=False, silent=True),
]
_RESIDUAL = "ln(price.close) - price.law"
_CAP = "nullif(mvrv.marketCap, 0)"

# The names of the features, in their order, with what they rest on and why they may be missing.
FEATURES = [
    Feature("priceResidualLog", _RESIDUAL, "price", "source value unavailable"),
    *(Feature(f"residualMomentum{k}d", f"({_RESIDUAL}) - (ln(price{k}.close) - price{k}.law)", "price", f"missing {k}d prior row") for k in (7, 30, 90)),
    Feature("mvrvLevel", "mvrv.mvrv", "mvrv", "missing MVRV row"),
    Feature("mvrvPercentile", "mvrv.percentile", "mvrv", "missing MVRV row"),
    Feature("mvrvZScore", "mvrv.z", "mvrv", "missing MVRV row"),
    Feature("realizedPriceDistance", "price.close / nullif(onchain.realizedPriceUSD, 0) - 1", "onchain", "missing realized price"),
    Feature("activeAddresses", "onchain.activeAddresses", "onchain", "missing active addresses"),
    Feature("transactionCount", "onchain.transactionCount", "onchain", "missing transaction count"),
    Feature("transferCount", "onchain.transferCount", "onchain", "missing transfer count"),
    Feature("addressBalanceCount", "onchain.addressBalanceCount", "onchain", "missing funded address count"),
    Feature("transfersPerTransaction", "nullif(onchain.transferCount, 0) / (1e0 * nullif(onchain.transactionCount, 0))", "onchain", "missing transfer or transaction count"),
    Feature("activeAddressShare", "nullif(onchain.activeAddresses, 0) / (1e0 * nullif(onchain.addressBalanceCount, 0))", "onchain", "missing active or funded address count"),
    Feature("hashRate", "onchain.hashRate", "onchain", "missing hash rate"),
    Feature("minerStressProxy", "nullif(onchain.minerRevenueUSD, 0) / nullif(onchain.marketCapUSD, 0)", "onchain", "missing miner revenue"),
    Feature("volatilityRegime30d", "price.vol30", "price", "insufficient volatility lookback"),
    Feature("drawdownFromCycleHigh", "price.fall", "price", "missing history"),
    Feature("futuresFundingRateDailyAvg", "derivatives.rate_avg", "derivatives", "missing derivatives funding"),
    Feature("futuresFundingRateDailySum", "derivatives.rate", "derivatives", "missing derivatives funding"),
    Feature("futuresFundingRateSum7d", "derivatives.sum7", "derivatives", "missing derivatives funding lookback"),
    Feature("futuresFundingRateSum30d", "derivatives.sum30", "derivatives", "missing derivatives funding lookback"),
    Feature("futuresFundingRateSumZ90d", "derivatives.rateZ", "derivatives", "missing derivatives funding z-score"),
    Feature("futuresFundingRateAvgZ90d", "derivatives.avgZ", "derivatives", "missing derivatives funding z-score"),
    Feature("futuresPremiumClose", "derivatives.premiumClose", "derivatives", "missing derivatives premium"),
    Feature("futuresPremiumCloseZ90d", "derivatives.premiumZ", "derivatives", "missing derivatives premium z-score"),
    Feature("futuresPremiumRange", "derivatives.premiumRange", "derivatives", "missing derivatives premium range"),
    Feature("futuresOpenInterestUSD", "derivatives.openInterestUSD", "derivatives", "missing derivatives open interest"),
    Feature("futuresOpenInterestToMarketCap", f"nullif(derivatives.openInterestUSD, 0) / {_CAP}", "derivatives", "missing derivatives open interest or market cap"),
    Feature("stablecoinSupplyUSD", "stablecoin.total", "stablecoin", "missing stablecoin supply"),
    *(Feature(f"stablecoinSupplyChange{k}d", f"stablecoin.change{k}", "stablecoin", f"missing stablecoin {k}d change") for k in (7, 30, 90, 365)),
    Feature("stablecoinSupplyZ365d", "stablecoin.totalZ", "stablecoin", "missing stablecoin z-score"),
    Feature("stablecoinLiquidityImpulse30dVsAnnual", "stablecoin.impulse", "stablecoin", "missing stablecoin liquidity impulse"),
    Feature("stablecoinSupplyToBtcMarketCap", f"nullif(stablecoin.total, 0) / {_CAP}", "stablecoin", "missing stablecoin supply or BTC market cap"),
    Feature("fearGreedIndex", "sentiment.gauge", "sentiment", "missing sentiment index"),
    Feature("fearGreedChange7d", "sentiment.change7", "sentiment", "missing sentiment 7d change"),
    Feature("fearGreedChange30d", "sentiment.change30", "sentiment", "missing sentiment 30d change"),
    Feature("extremeFearEvent", "sentiment.fear", "sentiment", "missing sentiment extreme fear flag"),
    Feature("extremeGreedEvent", "sentiment.greed", "sentiment", "missing sentiment extreme greed flag"),
    Feature("fearGreedResidualDivergence", f"(sentiment.gauge - 50) / 50 - ({_RESIDUAL})", "sentiment", "missing sentiment index or price residual"),
    Feature("cmeCotOpenInterestBtc", "cot.oi", "cot", "missing COT open interest"),
    Feature("cmeCotLeveragedMoneyNetPctOi", "cot.leveraged", "cot", "missing COT leveraged-money net"),
    Feature("cmeCotLeveragedMoneyNetPctRank", "cot.leveragedRank", "cot", "missing COT leveraged-money percentile"),
    Feature("cmeCotAssetManagerNetPctOi", "cot.manager", "cot", "missing COT asset-manager net"),
    Feature("cmeCotAssetManagerNetPctRank", "cot.managerRank", "cot", "missing COT asset-manager percentile"),
    Feature("cmeCotDealerNetPctOi", "cot.dealer", "cot", "missing COT dealer net"),
    Feature("cmeCotDealerNetPctRank", "cot.dealerRank", "cot", "missing COT dealer percentile"),
    Feature("cmeCotOpenInterestChange4w", "cot.oi4", "cot", "missing COT OI change"),
    Feature("cmeCotOpenInterestPctRank", "cot.oiRank", "cot", "missing COT OI percentile"),
    Feature("macroFedBalanceSheetChange13w", "macro.balance13", "macro", "missing macro Fed balance sheet 13w change"),
    Feature("macroFedBalanceSheetChange26w", "macro.balance26", "macro", "missing macro Fed balance sheet 26w change"),
    Feature("macroFedFundsRate", "macro.funds", "macro", "missing macro Fed funds"),
    Feature("macroFedFundsChange13w", "macro.funds13", "macro", "missing macro Fed funds change"),
    Feature("macroTreasury10yYield", "macro.yield10", "macro", "missing macro 10y yield"),
    Feature("macroTreasury10yChange30d", "macro.yield1", "macro", "missing macro 10y 30d change"),
    Feature("macroTreasury10yChange90d", "macro.yield3", "macro", "missing macro 10y 90d change"),
    Feature("macroHighYieldSpread", "macro.spread", "macro", "missing macro high-yield spread"),
    Feature("macroHighYieldSpreadZ252d", "macro.spreadZ", "macro", "missing macro high-yield spread z-score"),
    Feature("macroM2Change26w", "macro.m26", "macro", "missing macro M2 change"),
    Feature("macroLiquidityImpulseZ252d", "macro.impulseZ", "macro", "missing macro liquidity impulse"),
    Feature("macroRiskScore", "macro.risk", "macro", "missing macro risk score"),
    Feature("spotEtfFlowUSD", "etf.flow", "etf", "missing spot ETF daily flow"),
    Feature("spotEtfFlow5dUSD", "etf.flow5", "etf", "missing spot ETF 5d flow"),
    Feature("spotEtfFlow20dUSD", "etf.flow20", "etf", "missing spot ETF 20d flow"),
    Feature("spotEtfCumulativeFlowUSD", "etf.flows", "etf", "missing spot ETF cumulative flow"),
    Feature("spotEtfFlowToBtcMarketCap", f"etf.flow / {_CAP}", "etf", "missing spot ETF daily flow or BTC market cap"),
    Feature("spotEtfFlow20dToBtcMarketCap", f"etf.flow20 / {_CAP}", "etf", "missing spot ETF 20d flow or BTC market cap"),
    Feature("spotEtfFlow5dToBtcMarketCap", f"etf.flow5 / {_CAP}", "etf", "missing spot ETF 5d flow or BTC market cap"),
    Feature("spotEtfFlowShockZ90d", "etf.flowZ", "etf", "missing spot ETF flow z-score"),
]


def days_of(spark, sf_dir) -> DataFrame:
    """The days of each asset: its bar, and counts and sums of the day's orders by status."""
    status = lambda s, x: F.coalesce(F.sum(F.when(F.col("o_orderstatus") == s, x)), F.lit(0))
    orders = table(spark, sf_dir, "orders").withColumn("asset_id", F.explode(F.array(F.lit(MARKET), F.col("o_orderpriority")))).withColumn("date", F.col("o_orderdate").cast("date"))
    counts = orders.groupBy("asset_id", "date").agg(
        F.count(F.lit(1)).alias("n"), status("F", F.lit(1)).alias("n_f"), status("O", F.lit(1)).alias("n_o"), status("F", F.col("o_totalprice")).alias("v_f"), status("O", F.col("o_totalprice")).alias("v_o"),
        F.count_distinct("o_custkey").alias("customers"),
    )
    t = F.datediff("date", F.lit(models.GENESIS).cast("date")).cast("double")
    return order_bars(spark, sf_dir).join(counts, ["asset_id", "date"]).withColumns({"t": t, "week": F.floor(t / 7), "month": F.year("date") * 12 + F.month("date")})


def source_rows(days: DataFrame) -> dict[str, DataFrame]:
    found = {}
    for name, stages in _STAGES.items():
        rows = days
        for stage in stages:
            rows = rows.where(stage) if isinstance(stage, str) else rows.withColumns({c: F.expr(x) for c, x in stage.items()})
        if name in _RANKS:
            columns, least, inclusive = _RANKS[name]
            rows = scans.with_ranks(rows, columns, least, inclusive)
        found[name] = rows.withColumn("available_after", F.date_add("date", _DELAY[name])) if name in _DELAY else rows
    return found | {f"price{k}": found["price"] for k in (7, 30, 90)}


def _values(spark, sf_dir, sources: list[Source] = SOURCES, only: str | None = None) -> DataFrame:
    """Values of every feature, for all assets or ``only`` one."""
    days = days_of(spark, sf_dir)
    if only is not None:
        days = days.where(F.col("asset_id") == only)
    spine = days.select("asset_id", "date")
    spine = spine.join(spine.withColumn("date", F.date_add("date", 1)), ["asset_id", "date"], "left_semi")
    return feature_values(spine, sources, source_rows(days), FEATURES)


def _sources_sql() -> str:
    parts = []
    for name, stages in _STAGES.items():
        body = "days"
        for n, stage in enumerate(stages):
            step = f"{name}_{n}"
            parts.append(f"{step} AS (SELECT * FROM {body} WHERE {stage})" if isinstance(stage, str) else f"{step} AS (SELECT *, {', '.join(f'{x} AS {c}' for c, x in stage.items())} FROM {body})")
            body = step
        ranks = ""
        if name in _RANKS:
            columns, least, inclusive = _RANKS[name]
            for c, to in columns.items():
                seen = f"SELECT count(*) FILTER (b.{c} <= a.{c}) AS below, count(*) AS n FROM {body} b WHERE b.asset_id = a.asset_id AND b.date {'<=' if inclusive else '<'} a.date"
                ranks += f", (SELECT CASE WHEN n >= {least} THEN below / n END FROM ({seen})) AS {to}"
        delay = f", (date + INTERVAL {_DELAY[name]} DAY)::DATE AS available_after" if name in _DELAY else ""
        parts.append(f"{name}_rows AS MATERIALIZED (SELECT a.*{delay}{ranks} FROM {body} a)")
    return ",\n".join(parts)


def _registry_sql(sources: list[Source] = SOURCES) -> str:
    """CTEs up to ``cells``: asset_id, date, name, value, source_date, reason."""
    joins, parts = [], []
    for s in sources:
        rows = f"{'price' if s.name.startswith('price') else s.name}_rows"
        known = f" AND {s.name}.available_after <= x.date" if s.name in _DELAY else ""
        if s.daily:
            joins.append(f"LEFT JOIN {rows} {s.name} ON {s.name}.asset_id = x.asset_id AND {s.name}.date = x.date - {s.lag}{known}")
        else:
            parts.append(f"{s.name}_at AS (SELECT x.date AS x_date, {s.name}.* FROM x JOIN {rows} {s.name} ON {s.name}.asset_id = x.asset_id AND {s.name}.date <= x.date - {s.lag}{known} QUALIFY row_number() OVER (PARTITION BY x.asset_id, x.date ORDER BY {s.name}.date DESC) = 1)")
            joins.append(f"LEFT JOIN {s.name}_at {s.name} ON {s.name}.asset_id = x.asset_id AND {s.name}.x_date = x.date")
    silent = {s.name: s.silent for s in sources}
    cells = ", ".join(
        f"{{'name': '{f.name}', 'value': ({f.value})::DOUBLE, 'source_date': {f.source}.date, 'told': {f'{f.source}.date IS NOT NULL' if silent[f.source] else 'true'}, 'reason': '{f.reason}'}}" for f in FEATURES
    )
    sums = ", ".join(f"count(*) FILTER (o_orderstatus = '{s.upper()}') AS n_{s}, coalesce(sum(o_totalprice) FILTER (o_orderstatus = '{s.upper()}'), 0) AS v_{s}" for s in "fo")
    return f"""{BARS},
counts AS (SELECT asset_id, o_orderdate::DATE AS date, count(*) AS n, {sums}, count(DISTINCT o_custkey) AS customers FROM (SELECT *, unnest(['{MARKET}', o_orderpriority]) AS asset_id FROM orders) GROUP BY ALL),
dated AS (SELECT *, (date - DATE '{models.GENESIS}')::DOUBLE AS t FROM bars JOIN counts USING (asset_id, date)), days AS MATERIALIZED (SELECT *, floor(t / 7) AS week, year(date) * 12 + month(date) AS month FROM dated),
{_sources_sql()},
x AS MATERIALIZED (SELECT b.asset_id, b.date FROM days b JOIN days p ON p.asset_id = b.asset_id AND p.date = b.date - 1),
{"".join(f"{p},{chr(10)}" for p in parts)}raw AS (SELECT x.asset_id, x.date, unnest([{cells}]) AS c FROM x {" ".join(joins)}),
cells AS (SELECT asset_id, date, c.name AS name, CASE WHEN isfinite(c.value) THEN c.value END AS value, CASE WHEN isfinite(c.value) THEN c.source_date END AS source_date, CASE WHEN isfinite(c.value) IS NOT TRUE THEN c.reason END AS reason FROM raw WHERE c.told)"""


_DAMPED = "sign(value) * ln(1 + abs(value))"


@query("feature_registry", f"""WITH {_registry_sql()}
SELECT asset_id, name, count(value) AS n_present, count(reason) AS n_missing, {r(f"avg({_DAMPED})", "1e5")} AS level, min(date) FILTER (value IS NOT NULL) AS first_date, max(source_date) AS last_source_date, max(date - source_date)::INT AS oldest, max(reason) AS reason FROM cells GROUP BY 1, 2""")
def feature_registry(spark, sf_dir):
    """Every feature of the register: on how many days of each asset it is there, at what level, since when, and how old its source gets."""
    damped = F.signum("value") * F.ln(1 + F.abs("value"))
    return _values(spark, sf_dir).groupBy("asset_id", "name").agg(
        F.count("value").alias("n_present"), F.count("reason").alias("n_missing"), rounded(F.avg(damped), 1e5).alias("level"), F.min(F.when(F.col("value").isNotNull(), F.col("date"))).alias("first_date"),
        F.max("source_date").alias("last_source_date"), F.max(F.datediff("date", "source_date")).alias("oldest"), F.max("reason").alias("reason"),
    )


@query("feature_days", f"""WITH {_registry_sql()}
SELECT asset_id, date, count(value) AS n_features, count(reason) AS n_missing, {r("max(value) FILTER (name = 'priceResidualLog')")} AS residual, {r("max(value) FILTER (name = 'macroRiskScore')")} AS risk,
  max(source_date) FILTER (name = 'cmeCotOpenInterestBtc') AS cot_date, max(reason) FILTER (name = 'residualMomentum90d') AS momentum_reason FROM cells GROUP BY 1, 2""")
def feature_days(spark, sf_dir):
    """The table's rows: maps of features, of the dates they rest on and of why others are missing, seen through their sizes and some entries."""
    rows = packed(_values(spark, sf_dir))
    at = lambda maps, name: F.col(maps).getItem(name)
    return rows.select(
        "asset_id", "date", F.size("features").cast("long").alias("n_features"), F.size("missing_reasons").cast("long").alias("n_missing"), rounded(at("features", "priceResidualLog")).alias("residual"),
        rounded(at("features", "macroRiskScore")).alias("risk"), at("source_dates", "cmeCotOpenInterestBtc").alias("cot_date"), at("missing_reasons", "residualMomentum90d").alias("momentum_reason"),
    )


#: A register with a mistake: two sources are read on their own day.
_EAGER = [s._replace(lag=0) if s.name in ("mvrv", "macro") else s for s in SOURCES]


@query("feature_look_ahead", f"""WITH {_registry_sql(_EAGER)}
SELECT name, count(*) AS violations, min(date) AS first_date FROM cells WHERE source_date > date - 1 GROUP BY 1""")
def feature_look_ahead(spark, sf_dir):
    """What the check of lags finds in a register in which two sources lack theirs."""
    return look_ahead(_values(spark, sf_dir, _EAGER)).groupBy("name").agg(F.count(F.lit(1)).alias("violations"), F.min("date").alias("first_date"))
