"""Small golden series for the window, scan and join operators."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import scalars as sc
from tidewell.functions.calendar import market_holidays, session_ladder
from tidewell.operators import joins, metrics, scans
from tidewell.operators import simulation as sim
from tidewell.operators import windows as w

DAY = dt.date(2024, 1, 1)


def bars(spark, values, **more):
    rows = [("a", DAY + dt.timedelta(i), v if v is None else float(v), *(None if m[i] is None else float(m[i]) for m in more.values())) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "asset_id string, date date, close double" + "".join(f", {n} double" for n in more))


def column(df, c):
    return [r[0] for r in df.withColumn("_out", c).orderBy("date").select("_out").collect()]


def test_sma_waits_until_full(spark):
    assert column(bars(spark, [1, 2, 3, 4]), w.sma("close", 3)) == [None, None, 2, 3]


def test_ema_starts_with_the_first_value():
    assert scans.ema(np.array([10.0, 13, 13]), 2) == pytest.approx([10, 12, 38 / 3])


def test_rsi_edges():
    up, flat = np.arange(15.0), np.ones(15)
    assert [scans.wilder_rsi(x)[-1] for x in (up, up[::-1], flat)] == [100, 0, 50]
    assert np.isnan(scans.wilder_rsi(up)[:14]).all()


def test_crosses(spark):
    df = bars(spark, [1, 2, 1, 3], right=[2, 2, 2, 2])
    assert column(df, w.strict_cross(F.col("close"), F.col("right"))) == [0, 0, -1, 1]
    df = bars(spark, [98, 100, 102, 100, 98]).withColumn("s", w.band_state(F.col("close"), F.lit(100.0), 0.01))
    assert column(df, w.hysteresis_cross(F.col("s"))) == [0, 0, 1, 0, -1]


def test_bollinger_and_stochastic(spark):
    df = bars(spark, [1, 2, 3, 4])
    band = w.bollinger("close", 4)
    assert column(df, band["upper"])[-1] == pytest.approx(2.5 + 2 * math.sqrt(1.25))
    flat = bars(spark, [5] * 20, high=[5] * 20, low=[5] * 20)
    assert column(flat, w.stochastic_k("high", "low", "close")) == [None] * 20


def test_prior_z_leaves_the_row_out(spark):
    assert column(bars(spark, [1, 2, 100]), w.zscore_prior("close", 10, 2))[-1] == pytest.approx(197)


def test_running_ranks(spark):
    def ranks(values, least, inclusive=False):
        found = scans.with_ranks(bars(spark, values).repartition(3), {"close": "rank"}, least, inclusive)
        return [r["rank"] for r in found.orderBy("date").collect()]

    assert ranks([3, 1, 2, 5], 2) == [None, None, 0.5, 1.0]
    assert ranks([3, None, 1, 1, 5], 2) == [None, None, None, 0.5, 1.0]
    assert ranks([3, None, 1, 1, 5], 1, inclusive=True) == pytest.approx([1.0, None, 0.5, 2 / 3, 1.0])


def test_ewma_and_skew(spark):
    assert column(bars(spark, [1, 2]), w.ewma_volatility("close", 0.5)) == pytest.approx([1, math.sqrt(2.5)])
    assert column(bars(spark, [1, 1, 1]), w.skew_adjusted("close", 3)) == [None, None, None]


def test_finite_and_rounding(spark):
    df = bars(spark, [1.00005, float("nan"), float("inf"), None])
    assert column(df, sc.finite("close")) == [1.00005, None, None, None]
    assert column(df, sc.rounded("close"))[0] == 1.0001


def test_normal_functions(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(sc.normal_cdf(F.lit(1.96))) == pytest.approx(0.9750021, abs=2e-7)
    assert value(sc.normal_cdf_polynomial(F.lit(-1.0))) == pytest.approx(0.1586553, abs=1e-7)
    assert value(sc.normal_quantile(F.lit(0.975))) == pytest.approx(1.959964, abs=1e-6)
    assert value(sc.fnv1a(F.lit("a"))) == 0xE40C292C
    assert value(sc.add_months_overflowing(F.lit("2024-01-31").cast("date"), 1)) == dt.date(2024, 3, 2)


def test_bitemporal_asof_takes_what_was_known(spark):
    date = lambda s: dt.date.fromisoformat(s)
    rows = spark.createDataFrame([(date("2020-01-01"), date("2020-01-31"), 1.0), (date("2020-01-15"), date("2020-02-14"), 2.0)], "date date, available_after date, v double")
    asked = spark.createDataFrame([(date("2020-02-01"),), (date("2020-02-14"),), (date("2020-01-30"),)], "date date")
    got = {r.date: r.asof_date for r in joins.asof_join(asked, rows, ["v"], known=F.col("available_after"), lag_days=1).collect()}
    assert got == {date("2020-02-01"): date("2020-01-01"), date("2020-02-14"): date("2020-01-15"), date("2020-01-30"): None}


def test_purge_counts(spark):
    date = dt.date.fromisoformat
    rows = spark.createDataFrame([(date("2023-12-25"), date("2024-01-01")), (date("2023-12-29"), date("2024-01-05")), (date("2024-01-04"), date("2024-01-04"))], "origin_date date, target_date date")
    got = joins.purge_counts(spark.createDataFrame([(date("2024-01-05"),)], "eval_date date"), rows, 2).first()
    assert (got.n_eligible, got.n_embargoed, got.n_unresolved) == (1, 1, 1)


def test_cooldown_and_islands(spark):
    assert scans.cooldown(np.arange(6), np.array([1, 1, 0, 1, 1, 1], bool), 3).tolist() == [True, False, False, True, False, False]
    df = bars(spark, [1, 1, 0, 1]).withColumn("flag", F.col("close") > 0)
    assert sorted(r["count"] for r in scans.islands(df, "flag", ["asset_id"], "date").groupBy("island").count().collect()) == [1, 2]


def test_kalman_predicts_over_gaps():
    level = scans.kalman_local_level(np.array([1.0, np.nan, 1.0]), 0.1, 1.0)
    assert level == pytest.approx([1, 1, 1])


def test_scores(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(metrics.winkler(F.lit(120.0), F.lit(100.0), F.lit(110.0), 0.1)) == pytest.approx(210)
    df = one.select(F.lit(0.0).alias("y"), *(F.lit(1.0).alias(f"q{i}") for i in range(3)))
    assert df.select(metrics.crps_from_quantiles(F.col("y"), {"q0": 0.25, "q1": 0.5, "q2": 0.75})).first()[0] == pytest.approx(1)


def test_holm(spark):
    df = spark.createDataFrame([("f", "a", 0.04), ("f", "b", 0.01), ("f", "c", 0.03)], "f string, name string, p double")
    got = {r.name: r.p_holm for r in metrics.holm(df, ["f"], "p", "name").collect()}
    assert got == pytest.approx({"a": 0.06, "b": 0.03, "c": 0.06})


def test_pit_histogram_has_empty_bins(spark):
    df = spark.createDataFrame([("m", 1.0), ("m", 0.05)], "model string, pit double")
    got = {r.bin: r.n for r in metrics.pit_histogram(df, ["model"]).collect()}
    assert len(got) == 10 and got[9] == 1 and got[0] == 1 and got[4] == 0


def test_holidays_and_sessions(spark):
    holidays = {(r.date, r.holiday) for r in market_holidays(spark, 2021, 2026).collect()}
    for day, name in (("2024-03-29", "good friday"), ("2025-04-18", "good friday"), ("2022-06-20", "juneteenth"), ("2026-07-03", "independence"), ("2023-11-23", "thanksgiving"), ("2024-05-27", "memorial")):
        assert (dt.date.fromisoformat(day), name) in holidays
    assert not any(n == "new year" and d.year == 2021 and d.month == 12 for d, n in holidays)
    assert not any(n == "juneteenth" and d.year < 2022 for d, n in holidays)
    ladder = {r.date: r.n_sessions for r in session_ladder(spark, 2026, 2027).collect()}
    start = dt.date(2026, 8, 14)
    assert [ladder[start + dt.timedelta(k)] - ladder[start] for k in (7, 14, 30, 365)] == [5, 10, 19, 250]


def test_simulated_paths_do_not_depend_on_their_number(spark):
    returns = np.array([0.01, -0.02, 0.03, 0.0])
    few = {(r.path, r.day): r.price for r in sim.paths(spark, 100.0, returns, 5, 3, 1).collect()}
    many = {(r.path, r.day): r.price for r in sim.paths(spark, 100.0, returns, 5, 6, 1).collect()}
    assert all(many[k] == v for k, v in few.items())


def test_gram_solves_are_least_squares(spark):
    rng = np.random.default_rng(0)
    x, e = rng.random(40), rng.random(40)
    df = bars(spark, x, y=1 + 2 * x + e).withColumn("one", F.lit(1.0))
    rows = sim.solve_grams(sim.gram_rows(df, ["one", "close"], "y", w.expanding()), ["one", "close"]).orderBy("date").collect()
    want = np.polyfit(x, 1 + 2 * x + e, 1)
    assert rows[-1].coefficients == pytest.approx([want[1], want[0]])
