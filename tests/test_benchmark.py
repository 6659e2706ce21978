"""The point-in-time benchmark, refits and the state space against plain refits of every training set."""

import datetime as dt
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.operators import pointintime as pit
from tidewell.operators import regression, statespace
from tidewell.operators import windows as w

START = dt.date(1995, 1, 1)


def walk(n, seed=1):
    rnd, y, out = random.Random(seed), 10.0, []
    for i in range(n):
        y += rnd.gauss(0.0003, 0.02) + 0.001 * math.sin(i / 60)
        out.append(math.exp(y))
    return out


def bars(spark, closes, asset="a", step=1):
    rows = [(asset, START + dt.timedelta(days=i * step), float(c)) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "asset_id string, date date, close double")


def basis(t):
    t = np.asarray(t, float)
    return np.stack([np.ones_like(t), np.log(t) - pit.CENTRE, np.sin(2 * np.pi * t / pit.CYCLE), np.cos(2 * np.pi * t / pit.CYCLE)], -1)


T0 = (START - dt.date(1990, 1, 1)).days


def fitted(y, i):
    t = T0 + np.arange(i + 1)
    return np.linalg.lstsq(basis(t), y[: i + 1], rcond=None)[0]


def law(b, y, i, h):
    now, then = basis(T0 + i) @ b, basis(T0 + i + h) @ b
    return then + (y[i] - now) * math.exp(-h / pit.TAU)


def folds(o, h, least):
    last = o - h - 1
    return [] if last < least else [*range(max(least, last - 5 * h), last + 1, h)][-6:]


def test_refits_match_least_squares(spark):
    closes = walk(320)
    y = np.log(closes)
    rows = {r.idx: r.b for r in pit.refits(bars(spark, closes), 300).collect()}
    assert rows[298] is None
    for i in (299, 310, 319):
        assert np.allclose(basis(T0 + np.arange(i + 1)) @ rows[i], basis(T0 + np.arange(i + 1)) @ fitted(y, i), atol=1e-6)
    rolling = {r.idx: r.b for r in pit.rolling_refits(bars(spark, closes), 250, 200).collect()}
    t = T0 + np.arange(70, 320)
    assert np.allclose(basis(t) @ rolling[319], basis(t) @ np.linalg.lstsq(basis(t), y[70:], rcond=None)[0], atol=1e-6)


def test_systems_without_a_single_solution_give_null(spark):
    rows = spark.createDataFrame([("a", START + dt.timedelta(days=i), 1.0, float(i)) for i in range(5)], "asset_id string, date date, x double, y double")
    sums = regression.product_sums(rows, [F.lit(1.0), F.col("x")], F.col("y"), w.expanding(), "_")
    assert {r.b for r in regression.solved(sums, 2, "_", "b", F.lit(True)).collect()} == {None}
    kept = regression.solved(sums, 2, "_", "b", F.lit(True), ridge=1.0).collect()
    assert all(r.b is None or len(r.b) == 2 for r in kept) and kept[0].asDict().keys() == {"asset_id", "date", "x", "y", "b"}


def test_structural_benchmark_matches_refits_at_every_origin(spark):
    least, closes = 220, walk(520)
    y = np.log(closes)
    rows = pit.structural_benchmark(bars(spark, closes), (14, 30), 30, least).collect()
    assert {(r.idx, r.horizon) for r in rows} == {(i, h) for i in range(240, 520, 30) for h in (14, 30) if i + h < 520}
    for r in rows:
        o, h = r.idx, r.horizon
        before = fitted(y, o - 30) if o - 30 + 1 >= least else fitted(y, o)
        variants = {x: (1 - x) * law(before, y, o, h) + x * law(fitted(y, o), y, o, h) for x in pit.WEIGHTS}
        inner = folds(o, h, least)
        losses = {}
        for x in pit.WEIGHTS:
            each = [abs((1 - x) * law(fitted(y, max(least, i - h)), y, i, h) + x * law(fitted(y, i), y, i, h) - y[i + h]) for i in inner]
            losses[x] = np.mean(each) if each else math.inf
        best = min(pit.WEIGHTS, key=lambda x: (losses[x], x))
        assert r.n_folds == len(inner) and r.weight == best
        assert r.log_median == pytest.approx(variants[best], abs=1e-7)
        assert [r.err_025, r.err_050, r.err_075] == pytest.approx([abs(variants[x] - y[o + h]) for x in pit.WEIGHTS], abs=1e-7)
        assert r.err_refit == pytest.approx(abs(law(fitted(y, o), y, o, h) - y[o + h]), abs=1e-7)
        assert r.err_naive == pytest.approx(abs(y[o] - y[o + h]))
        assert r.err_drift == pytest.approx(abs(y[o] + (y[o] - y[o - 90]) / 90 * h - y[o + h]))


def test_state_space_benchmark_matches_a_filter_of_each_refit(spark):
    least, closes = 220, walk(430, seed=3)
    y = np.log(closes)

    def median(b, i, h, p):
        level, residual = plain_filter(list(y[: i + 1] - basis(T0 + np.arange(i + 1)) @ b), p)[:2]
        return basis(T0 + i + h) @ b + level + residual * p.persistence**h

    for r in pit.state_space_benchmark(bars(spark, closes), (14,), 30, least).collect():
        o, h = r.idx, r.horizon
        inner = folds(o, h, least)
        losses = [np.mean([abs(median(fitted(y, i), i, h, p) - y[i + h]) for i in inner]) if inner else math.inf for p in statespace.GRID]
        best = min(range(3), key=lambda g: (losses[g], g))
        assert (r.n_folds, r.grid) == (len(inner), best)
        assert [r.err_0, r.err_1, r.err_2] == pytest.approx([abs(median(fitted(y, o), o, h, p) - y[o + h]) for p in statespace.GRID], abs=1e-6)
        assert r.log_median == pytest.approx(median(fitted(y, o), o, h, statespace.GRID[best]), abs=1e-6)


def test_a_later_price_changes_nothing_known_before(spark):
    closes = walk(420)
    changed = closes[:400] + [c * 9 for c in closes[400:]]
    known = [
        {(r.idx, r.horizon): (r.weight, r.log_median, r.n_eligible, r.q90) for r in pit.structural_benchmark(bars(spark, c), (14,), 10, 150).collect() if r.idx < 400} for c in (closes, changed)
    ]
    assert known[0].keys() == known[1].keys() and len(known[0]) > 20
    for key, values in known[0].items():
        assert values == pytest.approx(known[1][key])
    assert any(v[3] is None for v in known[0].values())


def test_matured_errors_are_purged_and_embargoed(spark):
    """45 daily errors; at the last day's horizon of 7 days, 7 are embargoed and the quantile is that of 38."""
    days = [START + dt.timedelta(days=i) for i in range(46)]
    errors = [0.0 if 38 <= i < 45 else i + 1.0 for i in range(46)]
    rows = spark.createDataFrame([("a", d, d, 7, e) for d, e in zip(days, errors)], "asset_id string, date date, target_date date, horizon int, err_refit double")
    last = pit.interval_of(rows).orderBy(F.desc("date")).first()
    assert (last.n_eligible, last.n_unresolved, last.n_embargoed, last.q90) == (38, 0, 7, 34.0)
    late = spark.createDataFrame([("a", d, d + dt.timedelta(days=7), 7, e) for d, e in zip(days, errors)], "asset_id string, date date, target_date date, horizon int, err_refit double")
    last = pit.interval_of(late).orderBy(F.desc("date")).first()
    assert (last.n_eligible, last.n_unresolved, last.n_embargoed, last.q80) == (38, 7, 0, 30.0)


def plain_filter(values, p):
    seen = [v for v in values if v is not None]
    x, cov = np.array([seen[0] if seen else 0.0, 0.0]), np.array([[0.01, 0.0], [0.0, p.residual / (1 - p.persistence**2)]])
    move, likelihood, squares = np.diag([1.0, p.persistence]), 0.0, 0.0
    for v in values:
        x, cov = move @ x, move @ cov @ move.T + np.diag([p.level, p.residual])
        if v is not None:
            s = cov.sum() + p.noise
            gain, e = cov.sum(1) / s, v - x.sum()
            x, cov = x + gain * e, cov - np.outer(gain, cov.sum(0))
            likelihood -= 0.5 * (math.log(2 * math.pi * s) + e * e / s)
            squares += e * e / s
    return x[0], x[1], cov, likelihood, squares / max(1, len(seen))


def test_state_space_fit_matches_matrices_and_only_predicts_over_gaps(spark):
    rnd = random.Random(4)
    values = [None, None] + [math.log(c) - 10 if rnd.random() < 0.8 else None for c in walk(150)] + [None] * 3
    rows = spark.createDataFrame([("a", START + dt.timedelta(days=i), v) for i, v in enumerate(values)] + [("empty", START, None)], "asset_id string, date date, y double")
    found = {(r.asset_id, r.grid): r for r in statespace.fit_grid(rows.repartition(3), "y").collect()}
    for g, p in enumerate(statespace.GRID):
        level, residual, cov, likelihood, squares = plain_filter(values, p)
        r = found["a", g]
        assert (r.level, r.residual, r.log_likelihood, r.squares) == pytest.approx((level, residual, likelihood, squares))
        assert (r.p00, r.p01, r.p11) == pytest.approx((cov[0, 0], cov[0, 1], cov[1, 1]))
        assert (r.n, r.missing) == (sum(v is not None for v in values), sum(v is None for v in values))
    assert found["empty", 0].n == 0 and found["empty", 0].level == 0.0
    p = statespace.GRID[1]
    *_, cov, _, _ = plain_filter(values, p)
    move = np.diag([1.0, p.persistence])
    for _ in range(9):
        cov = move @ cov @ move.T + np.diag([p.level, p.residual])
    ahead = statespace.forecast(statespace.fit_grid(rows, "y").where("asset_id = 'a' AND grid = 1"), (9,)).first()
    assert ahead.variance == pytest.approx(cov.sum())
    assert ahead["mean"] == pytest.approx(ahead.level + ahead.residual * p.persistence**9)


def test_filters_of_columns_add_up(spark):
    rnd = random.Random(2)
    rows = [("a", START + dt.timedelta(days=i), rnd.random(), rnd.random()) for i in range(60)]
    df = spark.createDataFrame(rows, "asset_id string, date date, y double, u double")
    last = statespace.linear_states(df, ["y", "u"], "states").orderBy(F.desc("date")).first().states
    for g, p in enumerate(statespace.GRID):
        want = plain_filter([r[2] - 3 * r[3] for r in rows], p)
        got = [last[(g * 2 + 0) * 2 + part] - 3 * last[(g * 2 + 1) * 2 + part] for part in (0, 1)]
        assert got == pytest.approx(want[:2])
