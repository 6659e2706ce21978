"""Resampled residual sums, interval scales and joint shift tests against plain loops."""

import datetime as dt
import hashlib
import math
import random
import statistics

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import models
from tidewell.operators import resampling as rs

START = dt.date(1995, 1, 1)


def number(*parts):
    return int(hashlib.md5(":".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def walk(n, seed=1):
    rnd, y, out = random.Random(seed), 10.0, []
    for i in range(n):
        y += rnd.gauss(0, 0.01 * (1 + (i // 100) % 3))
        out.append(math.exp(y))
    return out


def bars(spark, closes, asset="a"):
    return spark.createDataFrame([(asset, START + dt.timedelta(days=i), c) for i, c in enumerate(closes)], "asset_id string, date date, close double")


def test_draws_are_the_named_bits(spark):
    got = spark.range(50).select(rs.draw(F.lit("7"), "id").alias("u")).withColumn("k", rs.below(F.col("u"), F.lit(13))).collect()
    for i, r in enumerate(got):
        assert r.u == number(7, i) and r.k == number(7, i) * 13 >> 32 and 0 <= r.k < 13


def plain_pools(closes):
    law = lambda i: math.exp(models.BASE_LAW[0] + models.BASE_LAW[1] * math.log((START - dt.date(1990, 1, 1)).days + i))
    rets = [None] + [math.log(b / a) for a, b in zip(closes, closes[1:])]
    rows = []
    for i in range(1, len(closes)):
        expected = law(i) * math.exp(math.log(closes[i - 1] / law(i - 1)) * math.exp(-1 / rs.TAU))
        near = [x for x in rets[max(1, i - 29) : i + 1]]
        rows.append((math.log(closes[i] / expected), statistics.stdev(near) if len(near) > 1 else 0.0))
    low, high = np.quantile([v for _, v in rows], rs.STRATA)
    bucket = lambda v: "low" if v <= low else "high" if v >= high else "normal"
    alike = [x for x, v in rows if bucket(v) == bucket(rows[-1][1])]
    every = [x for x, _ in rows]
    return {"full-history": every, "recent-730d": every[-730:], "vol-regime-stratified": alike if len(alike) >= 4 * rs.BLOCK else every}, rets


def test_multipliers_match_loops_for_all_policies(spark):
    closes = walk(900)
    pools, rets = plain_pools(closes)
    found = {(r.policy, r.horizon): r for r in rs.sigma_multipliers(bars(spark, closes), (20, 45), simulations=60).collect()}
    assert set(found) == {(p, h) for p in rs.POLICIES for h in (20, 45)}
    vol = math.sqrt(0.55 * statistics.stdev(rets[-90:]) ** 2 + 0.45 * statistics.stdev(rets[-365:]) ** 2)
    for (policy, h), row in found.items():
        pool, totals = pools[policy], []
        for s in range(60):
            total, taken = 0.0, 0
            for k in range(math.ceil(h / rs.BLOCK)):
                start = number(7, policy, h, s, k) * (len(pool) - rs.BLOCK + 1) >> 32
                size = min(rs.BLOCK, h - taken)
                total, taken = total + sum(pool[start : start + size]), taken + size
            assert taken == h
            totals.append(total)
        sigma = vol * math.sqrt(sum(math.exp(-2 * i / rs.TAU) for i in range(h)))
        assert (row.spread, row.sigma) == pytest.approx((statistics.stdev(totals), sigma))
        assert row.multiplier == pytest.approx(min(1.8, max(0.7, row.spread / row.sigma)))
    assert len({r.spread for r in found.values()}) == 6


def test_short_and_still_series_have_no_multiplier(spark):
    assert {r.multiplier for r in rs.sigma_multipliers(bars(spark, walk(200)), (30,), simulations=5).collect()} == {1.0}
    assert {r.multiplier for r in rs.sigma_multipliers(bars(spark, walk(30)), (30,), simulations=5).collect()} == {1.0}
    assert rs.sigma_multipliers(bars(spark, walk(3)).where("false"), (30,)).collect() == []


def test_interval_scales_rise_and_meet_the_table(spark):
    hs = [1, 14, 20, 30, 60, 75, 90, 180, 300, 365, 366, 1460]
    rows = {r.h: r for r in spark.createDataFrame([(h,) for h in hs], "h int").select("h", rs.interval_multiplier(F.col("h")).alias("m"), rs.sigma_scale(F.col("h")).alias("s")).collect()}
    table = dict(rs.MULTIPLIERS)
    for h, m in table.items():
        assert rows[h].m == pytest.approx(m)
    assert rows[1].m == table[14] and rows[1460].m == pytest.approx(table[365] * 2)
    assert rows[20].m == pytest.approx(math.exp(math.log(1.01) + math.log(20 / 14) / math.log(30 / 14) * math.log(0.98 / 1.01)))
    scales = [rows[h].s for h in hs]
    assert scales == sorted(scales)
    raw = {h: m * math.sqrt(sum(math.exp(-2 * i / rs.TAU) for i in range(h))) for h, m in table.items()}
    assert rows[365].s == pytest.approx(max(raw.values())) and rows[365].s > raw[365]
    assert rows[1].s == pytest.approx(table[14]) and rows[1460].s == pytest.approx(2 * rows[365].s)


def test_joint_shifts_match_loops(spark):
    rnd, n, iterations = random.Random(5), 800, 300
    dates = [START + dt.timedelta(days=i) for i in range(n)]
    value = [None if i >= n - 7 else rnd.gauss(0, 0.02) for i in range(n)]
    sides = {"one": [rnd.choice([0, 0, 0, 0, 1, -1]) for _ in range(n)], "two": [rnd.choice([0, 0, 0, 0, 0, 1]) for _ in range(n)], "none": [0] * n}
    sides["two"] = [1 if v is not None and v > 0.03 else s for v, s in zip(value, sides["two"])]
    rows = spark.createDataFrame([("a", d, v, *(sides[s][i] for s in sides)) for i, (d, v) in enumerate(zip(dates, value))], "asset_id string, date date, value double, one int, two int, none int")
    got = {r.signal: r for r in rs.joint_shift_test(rows, list(sides), iterations, seed=3).collect()}
    assert set(got) == {"one", "two"}
    live = [i for i in range(n) if value[i] is not None]
    mean = statistics.mean(value[i] for i in live)
    years = {}
    for i in live:
        years.setdefault(dates[i].year, []).append(i)

    def statistic(s, signed):
        count, total = sum(sides[s][i] != 0 for i in live), sum(sides[s][i] for i in live)
        return signed / count - mean * total / count - rs.COST

    observed = {s: statistic(s, sum(sides[s][i] * value[i] for i in live)) for s in got}
    own, largest = dict.fromkeys(got, 0), dict.fromkeys(got, 0)
    for it in range(iterations):
        signed = dict.fromkeys(got, 0.0)
        for year, at in years.items():
            shift = number(3, it, year) * len(at) >> 32
            for p in range(len(at)):
                for s in got:
                    signed[s] += sides[s][at[(p + shift) % len(at)]] * value[at[p]]
        drawn = {s: statistic(s, signed[s]) for s in got}
        for s in got:
            own[s] += drawn[s] >= observed[s] - 1e-12
            largest[s] += max(drawn.values()) >= observed[s] - 1e-12
    for s, r in got.items():
        assert r.observed == pytest.approx(observed[s])
        assert (r.p, r.p_max) == pytest.approx(((own[s] + 1) / (iterations + 1), (largest[s] + 1) / (iterations + 1)))
    assert got["two"].p < 0.05 <= got["one"].p_max
