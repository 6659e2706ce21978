"""The compiled feature table: lags, what is known when, reasons and silence, against rows worked out by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidewell.operators.features import Feature, Source, feature_values, look_ahead, packed
from tidewell.plans.registry_features import FEATURES, SOURCES

D = dt.date
SPINE = [("a", D(2024, 1, d)) for d in range(1, 9)] + [("b", D(2024, 1, 3))]
FEATS = [
    Feature("level", "daily.v", "daily", "no row of the day before"),
    Feature("step", "daily.v - old.v", "daily", "no earlier row"),
    Feature("slow", "slow.v", "slow", "never told"),
    Feature("both", "slow.v / nullif(daily.v, 0)", "slow", "a part is missing"),
    Feature("odd", "slow.w", "slow", "w is missing"),
]


def table(spark, sources):
    spine = spark.createDataFrame(SPINE, "asset_id string, date date")
    daily = spark.createDataFrame([("a", D(2024, 1, d), v) for d, v in ((1, 10.0), (2, 0.0), (3, float("nan")), (4, 40.0), (6, 60.0))], "asset_id string, date date, v double")
    slow = spark.createDataFrame(
        [("a", D(2024, 1, 1), D(2024, 1, 5), 1.0, None), ("a", D(2024, 1, 3), D(2024, 1, 7), 3.0, 0.5), ("a", D(2024, 1, 2), D(2024, 1, 8), 2.0, 0.1), ("b", D(2024, 1, 3), D(2024, 1, 1), 9.0, 0.1)],
        "asset_id string, date date, available_after date, v double, w double",
    )
    return feature_values(spine, sources, {"daily": daily, "old": daily, "slow": slow}, FEATS)


RIGHT = [Source("daily"), Source("old", lag=3), Source("slow", daily=False, silent=True)]


def test_values_dates_and_reasons(spark):
    rows = {(r.asset_id, r.date.day, r.name): (r.value, r.source_date, r.reason) for r in table(spark, RIGHT).collect()}
    why = "no row of the day before"
    assert [rows["a", d, "level"][0] for d in range(1, 9)] == [None, 10.0, 0.0, None, 40.0, None, 60.0, None]
    assert rows["a", 2, "level"] == (10.0, D(2024, 1, 1), None) and rows["a", 1, "level"] == (None, None, why) and rows["b", 3, "level"] == (None, None, why)
    assert rows["a", 5, "step"] == (40.0, D(2024, 1, 4), None) and rows["a", 7, "step"] == (20.0, D(2024, 1, 6), None)
    # of what is known by then, the latest date counts; before anything is known, the source is silent
    assert ("a", 4, "slow") not in rows and ("b", 3, "slow") not in rows
    assert [rows["a", d, "slow"][:2] for d in (5, 6, 7, 8)] == [(1.0, D(2024, 1, 1))] * 2 + [(3.0, D(2024, 1, 3))] * 2
    assert rows["a", 5, "both"][0] == pytest.approx(1 / 40) and rows["a", 6, "both"] == (None, None, "a part is missing")
    assert rows["a", 5, "odd"] == (None, None, "w is missing") and rows["a", 7, "odd"][0] == 0.5


def test_packed_maps(spark):
    rows = {(r.asset_id, r.date.day): r for r in packed(table(spark, RIGHT)).collect()}
    assert len(rows) == len(SPINE)
    assert rows["a", 5].features == {"level": 40.0, "step": 40.0, "slow": 1.0, "both": 1 / 40}
    assert rows["a", 5].missing_reasons == {"odd": "w is missing"} and rows["a", 5].source_dates["slow"] == D(2024, 1, 1)
    assert rows["b", 3].features == {} and set(rows["b", 3].missing_reasons) == {"level", "step"}


def test_look_ahead_is_found(spark):
    assert look_ahead(table(spark, RIGHT)).count() == 0
    eager = [RIGHT[0]._replace(lag=0), *RIGHT[1:2], RIGHT[2]._replace(lag=0)]
    found = {(r.asset_id, r.date.day, r.name) for r in look_ahead(table(spark, eager)).collect()}
    assert ("b", 3, "slow") in found and ("a", 4, "level") in found and ("a", 7, "slow") not in found


def test_the_register_is_whole():
    names = [f.name for f in FEATURES]
    assert len(names) == len(set(names)) == 72
    assert {f.source for f in FEATURES} <= {s.name for s in SOURCES}
    assert all(s.lag >= 1 for s in SOURCES)


def test_no_sources_rows_no_features(spark):
    empty = table(spark, RIGHT).where("false")
    assert packed(empty).collect() == [] and empty.select(F.col("value")).count() == 0
