"""Feature selection and primary traces against plain loops."""

import datetime as dt
import math
import random

import pytest
from pyspark.sql import functions as F

from tidewell.operators import selection as sel

DAY = dt.date(2020, 1, 1)


def plain_selection(pool, asked, names, most, least):
    ok = lambda v: v is not None and math.isfinite(v)
    found = []
    for n in names:
        values = [r[n] for r in pool if ok(r[n])]
        if ok(asked[n]) and len(values) >= least and len(values) > 1:
            mean = sum(values) / len(values)
            variance = sum((v - mean) ** 2 for v in values) / (len(values) - 1)
            if variance > 0:
                found.append((-len(values), -variance, n))
    order = [n for *_, n in sorted(found)][:most]
    complete = [sum(all(ok(r[n]) for n in order[:k]) for r in pool) for k in range(1, len(order) + 1)]
    k = len(order)
    while k and complete[k - 1] < least:
        k -= 1
    return [(i + 1, n, complete[i], i < k) for i, n in enumerate(order)]


@pytest.mark.parametrize("most, least", [(8, 30), (3, 30), (8, 90), (8, 200)])
def test_selection_backs_off_like_a_loop(spark, most, least):
    rnd, names = random.Random(3), [f"f{i}" for i in range(8)]
    value = lambda i: rnd.choice([None, float("nan"), float("inf")]) if rnd.random() < 0.09 * i else rnd.gauss(0, 1 + i % 3)
    rows = [{"asset_id": a, "date": DAY + dt.timedelta(days=d), **{n: (1.0 if n == "f2" else value(i)) for i, n in enumerate(names)}} for a in "ab" for d in range(160)]
    asked = [{"asset_id": a, "date": DAY, **{n: (None if (a, n) == ("b", "f1") else 1.0) for n in names}} for a in "ab"]
    schema = "asset_id string, date date, " + ", ".join(f"{n} double" for n in names)
    pool, last = (spark.createDataFrame([tuple(r[c] for c in ("asset_id", "date", *names)) for r in x], schema) for x in (rows, asked))
    got = sel.select_features(pool.repartition(3), last, ["asset_id"], names, most, least).orderBy("asset_id", "rank").collect()
    for a, e in zip("ab", asked):
        want = plain_selection([r for r in rows if r["asset_id"] == a], e, names, most, least)
        assert [(r["rank"], r.feature, r.n_complete, r.chosen) for r in got if r.asset_id == a] == want
    assert not any(r.feature == "f2" for r in got)


def test_selection_of_nothing(spark):
    rows = spark.createDataFrame([], "asset_id string, x double")
    assert sel.select_features(rows, rows, ["asset_id"], ["x"]).collect() == []


def plain_lift(price, floor):
    if floor is None or floor <= 0 or price >= floor * 1.002:
        return price
    return floor * math.exp(min(math.log(1.04), math.log(1.002) + 0.35 * max(0, math.log(floor / price))))


def test_primary_trace_is_chosen_and_lifted_like_a_loop(spark):
    rnd, rows, days = random.Random(9), [], 40
    for t in range(6):
        price = 100.0
        for d in range(1, days + 1):
            price *= math.exp(rnd.gauss(-0.004, 0.03))
            rows.append(("a", t, d, None if rnd.random() < 0.05 else price, 100.0 * math.exp(0.001 * d), None if d == 20 else 92.0 + 0.1 * d))
    df = spark.createDataFrame(rows, "asset_id string, trace int, day int, price double, reference double, floor double")
    scores = {r.trace: r for r in sel.trace_scores(df.repartition(4), ["asset_id"]).collect()}
    for t in range(6):
        valid = [r for r in rows if r[1] == t and r[2] <= 14 and r[3] is not None and r[5] is not None]
        away = [abs(math.log(r[3] / r[4])) for r in valid]
        want = sum(away) / len(away) + 0.2 * sum(r[3] < r[5] for r in valid) / len(valid) + 0.8 * away[0] + 0.25 * away[-1]
        assert scores[t].score == pytest.approx(want)
    best = min(scores, key=lambda t: (scores[t].score, t))
    got = {r.day: r.projected for r in sel.above_floor(df.where(F.col("trace") == best), ["asset_id"], F.lit(100.0)).collect()}
    raw = projected = 100.0
    for _, t, d, price, _, floor in rows:
        if t == best:
            projected = plain_lift(projected * (price / raw if price else 1.0), floor)
            raw = price or raw
            assert got[d] == pytest.approx(projected)
            assert floor is None or projected >= floor * 1.0019
    assert set(got) == set(range(1, days + 1))


def test_a_later_horizon_does_not_change_the_choice(spark):
    rows = [("a", t, d, 100.0 + t * (20 - d), 100.0, 50.0) for t in range(3) for d in range(1, 40)]
    df = spark.createDataFrame(rows, "asset_id string, trace int, day int, price double, reference double, floor double")
    one, two = ({r.trace: r.score for r in sel.trace_scores(x, ["asset_id"]).collect()} for x in (df, df.where("day <= 14")))
    assert one == two and min(one, key=one.get) == 0
