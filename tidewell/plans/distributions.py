"""Queries of Student's t: tails, price bands, and the choice of a distribution family."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidewell.functions import student
from tidewell.functions.scalars import normal_cdf, rounded
from tidewell.operators import metrics, models
from tidewell.operators import windows as w
from tidewell.plans.common import MARKET, S, query, r
from tidewell.plans.forecasting import WITH, _cdf_sql, _fc
from tidewell.sources.bars import market_bars

NUS = (3.0, 5.0, 10.0, 30.0)


def _t_cdf_sql(t: str, nu: str) -> str:
    """For whole degrees of freedom, by the finite series of the angle: another way than the continued fraction."""
    angle = f"atan({t} / sqrt({nu}))"
    odd = f"list_sum(list_transform(range((({nu})::INT - 1) // 2), lambda j: exp(2 * j * ln(2) + 2 * lgamma(j + 1) - lgamma(2 * j + 2)) * pow(cos({angle}), 2 * j + 1)))"
    even = f"list_sum(list_transform(range(({nu})::INT // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos({angle}), 2 * j)))"
    return f"(0.5 + CASE WHEN ({nu})::INT % 2 = 1 THEN ({angle} + sin({angle}) * coalesce({odd}, 0)) / pi() ELSE sin({angle}) * {even} / 2 END)"


_Z = f"""z AS (SELECT date, ret / nullif(stddev_samp(ret) OVER ({S} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING), 0) AS z FROM (SELECT *, ln(close / lag(close) OVER ({S})) AS ret FROM bars)
  QUALIFY count(ret) OVER ({S} ROWS BETWEEN 90 PRECEDING AND 1 PRECEDING) = 90)"""


@query("student_t_tail", f"""WITH {MARKET}, {_Z}, n(nu) AS (VALUES {", ".join(f"({x})" for x in NUS)})
  SELECT date, nu::DOUBLE AS nu, {r("z")} AS z, {r(_t_cdf_sql("(z * sqrt(nu / (nu - 2)))", "nu"), "1e6")} AS p FROM z CROSS JOIN n""")
def student_t_tail(spark, sf_dir):
    """Where each return lies in t distributions with the variance of the 90 returns before it."""
    rows = market_bars(spark, sf_dir).withColumn("ret", w.log_return("close"))
    z = w.full(F.col("ret") / F.nullif(F.stddev_samp("ret").over(w.prior(90)), F.lit(0.0)), F.col("ret"), w.prior(90), 90)
    rows = rows.withColumn("z", z).where("z IS NOT NULL").select("date", "z", F.explode(F.array(*map(F.lit, NUS))).alias("nu"))
    return rows.select("date", "nu", rounded("z").alias("z"), rounded(student.t_cdf(F.col("z") / student.unit_scale(F.col("nu")), F.col("nu")), 1e6).alias("p"))


# Published quantiles of Student's t at 0.025, 0.05 and 0.1.
PUBLISHED = {
    3: (-3.18244630528, -2.3533634348, -1.6377443537),
    5: (-2.57058183564, -2.01504837333, -1.47588404882),
    10: (-2.22813885199, -1.81246112281, -1.37218364111),
    30: (-2.0422724563, -1.69726088659, -1.31041502539),
}


@query("student_t_bands", f"""{WITH}, n(nu, t025, t05, t10) AS (VALUES {", ".join(f"({nu}, {', '.join(map(str, ts))})" for nu, ts in PUBLISHED.items())}),
  s AS (SELECT *, sigma * sqrt((nu - 2) / nu) AS scale FROM fc CROSS JOIN n WHERE model = 'gbm-drift')
  SELECT date, horizon, nu::DOUBLE AS nu, {", ".join(f"{r(f'ln(median) {sign} scale * {t}', '1e6')} AS {name}" for name, sign, t in (("q025", "+", "t025"), ("q05", "+", "t05"), ("q10", "+", "t10"), ("q90", "-", "t10"), ("q95", "-", "t05"), ("q975", "-", "t025")))} FROM s""")
def student_t_bands(spark, sf_dir):
    """Logarithms of the price quantiles of a forecast with t tails: the variates are computed once for each probability and degree of freedom."""
    levels = {"q025": 0.025, "q05": 0.05, "q10": 0.1, "q90": 0.9, "q95": 0.95, "q975": 0.975}
    pairs = spark.createDataFrame([(float(nu), name, p) for nu in PUBLISHED for name, p in levels.items()], "nu double, name string, p double")
    table = pairs.withColumn("t", student.t_quantile(F.col("p"), F.col("nu"))).groupBy("nu").agg(*(F.max(F.when(F.col("name") == name, F.col("t"))).alias(f"t_{name}") for name in levels))
    rows = _fc(spark, sf_dir).where("model = 'gbm-drift'").join(F.broadcast(table), F.lit(True))  # a row for each degree of freedom
    price = lambda name: student.price_quantile(F.col("median"), F.col("sigma"), F.col(f"t_{name}"), F.col("nu"))
    return rows.select("date", "horizon", "nu", *(rounded(F.ln(price(name)), 1e6).alias(name) for name in levels))


#: Degrees of freedom of the families that are compared; infinity is the normal distribution.
FAMILIES = (3.0, 4.0, 5.0, 6.0, 8.0, 10.0, 15.0, 20.0, 30.0, float("inf"))
_CUT = "1999-01-01"
_LOSS = "CASE WHEN nu IS NULL THEN 0.5 * ln(2 * pi()) + z * z / 2 ELSE lgamma(nu / 2) - lgamma((nu + 1) / 2) + 0.5 * ln(pi() * (nu - 2)) + (nu + 1) / 2 * ln(1 + z * z / (nu - 2)) END"
_P = f"CASE WHEN nu IS NULL THEN {_cdf_sql('z')} ELSE {_t_cdf_sql('(z * sqrt(nu / (nu - 2)))', 'coalesce(nu, 3)')} END"
_MH = "model, horizon"


@query("distribution_family", f"""{WITH}, n(nu) AS (VALUES {", ".join("(NULL)" if x == float("inf") else f"({x}::DOUBLE)" for x in FAMILIES)}),
  e AS (SELECT {_MH}, date, ln(actual / median) / sigma AS z FROM fc), l AS (SELECT *, {_LOSS} AS loss FROM e CROSS JOIN n),
  fit AS (SELECT {_MH}, nu, avg(loss) AS loss FROM l WHERE date < DATE '{_CUT}' GROUP BY ALL),
  best AS (SELECT {_MH}, nu FROM fit QUALIFY row_number() OVER (PARTITION BY {_MH} ORDER BY loss, coalesce(nu, 1e9)) = 1),
  held AS (SELECT l.*, {_P.replace("nu", "l.nu")} AS p, 0.5 * ln(2 * pi()) + z * z / 2 - loss AS gain FROM l JOIN best b ON b.model = l.model AND b.horizon = l.horizon AND b.nu IS NOT DISTINCT FROM l.nu WHERE date >= DATE '{_CUT}'),
  thin AS (SELECT *, row_number() OVER (PARTITION BY {_MH} ORDER BY date) - 1 AS i FROM held),
  t AS (SELECT {_MH}, avg(gain) / nullif(stddev_samp(gain) / sqrt(count(*)), 0) AS t FROM thin WHERE i % horizon = 0 GROUP BY ALL),
  s AS (SELECT {_MH}, any_value(nu) AS nu, count(*) AS n, avg(gain) AS gain, avg((abs(2 * p - 1) <= 0.8)::INT) AS cov80, avg((abs(2 * p - 1) <= 0.9)::INT) AS cov90 FROM held GROUP BY ALL),
  v AS (SELECT s.*, t, CASE WHEN t IS NULL THEN 1.0 ELSE 1 - {_cdf_sql("t")} END AS p FROM s JOIN t USING ({_MH})),
  o AS (SELECT *, least(1.0, p * (count(*) OVER () - row_number() OVER (ORDER BY p, model, horizon) + 1)) AS raw FROM v),
  h AS (SELECT *, max(raw) OVER (ORDER BY p, model, horizon ROWS UNBOUNDED PRECEDING) AS p_holm FROM o)
  SELECT {_MH}, coalesce(nu, 'inf'::DOUBLE) AS nu, n, {r("gain")} AS gain, {r("cov80")} AS cov80, {r("cov90")} AS cov90, {r("p_holm")} AS p_holm,
  CASE WHEN nu IS NULL THEN 'normal' WHEN n < 30 THEN 'needs-more-data' WHEN gain > 0 AND p_holm < 0.05 AND abs(cov90 - 0.9) <= 0.05 AND abs(cov80 - 0.8) <= 0.05 THEN 'promote' ELSE 'reject' END AS verdict FROM h""")
def distribution_family(spark, sf_dir):
    """The tails that fit best before the cut, and whether they beat the normal distribution after it.

    Gain is the mean log score over the normal's; its t is taken from every
    horizon-th row, whose targets don't overlap, and Holm's step-down runs over
    all models and horizons.
    """
    cut = F.lit(_CUT).cast("date")
    z = models.log_error() / F.col("sigma")
    scored = _fc(spark, sf_dir).select("model", "horizon", "date", z.alias("z"), F.explode(F.array(*map(F.lit, FAMILIES))).alias("nu"))
    scored = scored.withColumn("loss", -student.t_log_density(F.col("z"), F.col("nu")))
    fit = scored.where(F.col("date") < cut).groupBy("model", "horizon", "nu").agg(F.avg("loss").alias("fit_loss"))
    best = metrics.best_of(fit, ["model", "horizon"], F.col("fit_loss"), F.col("nu")).select("model", "horizon", "nu")
    held = scored.where(F.col("date") >= cut).join(F.broadcast(best), ["model", "horizon", "nu"])  # a row for each model and horizon
    normal = -student.t_log_density(F.col("z"), F.lit(float("inf")))
    held = held.withColumns({"gain": normal - F.col("loss"), "p": student.t_cdf(F.col("z") / student.unit_scale(F.col("nu")), F.col("nu"))})
    held = held.withColumn("i", F.row_number().over(Window.partitionBy("model", "horizon").orderBy("date")) - 1)
    apart = F.when(F.col("i") % F.col("horizon") == 0, F.col("gain"))
    within = lambda share: F.avg((F.abs(2 * F.col("p") - 1) <= share).cast("int"))
    found = held.groupBy("model", "horizon", "nu").agg(
        F.count(F.lit(1)).alias("n"), F.avg("gain").alias("gain"), within(0.8).alias("cov80"), within(0.9).alias("cov90"), (F.avg(apart) / F.nullif(F.stddev_samp(apart) / F.sqrt(F.count(apart)), F.lit(0.0))).alias("t")
    )
    tests = found.withColumns({"p": F.coalesce(1 - normal_cdf(F.col("t")), F.lit(1.0)), "family": F.lit("all"), "name": F.struct("model", "horizon")})
    held_to = metrics.holm(tests, ["family"], "p", "name")
    good = (F.col("gain") > 0) & (F.col("p_holm") < 0.05) & (F.abs(F.col("cov90") - 0.9) <= 0.05) & (F.abs(F.col("cov80") - 0.8) <= 0.05)
    verdict = F.when(F.col("nu") == float("inf"), "normal").when(F.col("n") < 30, "needs-more-data").when(good, "promote").otherwise("reject")
    return held_to.select("model", "horizon", "nu", "n", rounded("gain").alias("gain"), rounded("cov80").alias("cov80"), rounded("cov90").alias("cov90"), rounded("p_holm").alias("p_holm"), verdict.alias("verdict"))
