"""The study catalogue against loops over studies, horizons and strengths."""

import datetime as dt
import math
import random
import statistics

import pytest

from tidewell.operators import catalogue
from tidewell.operators.catalogue import Study
from tidewell.plans.study_catalogue import NAMED, STUDIES

START = dt.date(1997, 1, 1)
CUT = dt.date(1999, 1, 1)
GRID = (-0.2, -0.1, 0.0, 0.1, 0.2)
TRIED = [
    Study("s", "leads", "median", "x IS NOT NULL", "x", GRID),
    Study("s", "noise", "median", "x > 0 AND e > 1", "e * least(1e0, horizon / 20e0)", GRID),
    Study("s", "loud", "widen", "e >= 1", "1e0", (0.0, 0.25, 0.5, 1.0)),
    Study("s", "calm", "narrow", "e < -1", "1e0", (0.0, 0.5, 0.9)),
    Study("s", "never", "median", "x > 99", "1e0", GRID),
    Study("s", "rare", "median", "x > 1.9", "1e0", GRID),
]


def made(seed=3, days=1300):
    rnd, rows = random.Random(seed), []
    for h in (10, 20):
        for i in range(0, days, h):
            x = None if rnd.random() < 0.1 else rnd.gauss(0, 1)
            e = rnd.gauss(0, 1)
            scale = 0.1 if e >= 1 else 0.02 if e < -1 else 0.05
            rows.append((START + dt.timedelta(days=i), h, (0.1 * x if x is not None else 0.0) + rnd.gauss(0, scale), 0.05, x, e))
    return rows


def nll(error, sigma):
    return 0.5 * math.log(2 * math.pi) + math.log(sigma) + error**2 / (2 * sigma**2)


def plain(rows):
    signals = {
        "leads": lambda h, x, e: x, "noise": lambda h, x, e: e * min(1, h / 20) if x is not None and x > 0 and e > 1 else None, "loud": lambda h, x, e: 1.0 if e >= 1 else None,
        "calm": lambda h, x, e: 1.0 if e < -1 else None, "never": lambda h, x, e: None, "rare": lambda h, x, e: 1.0 if x is not None and x > 1.9 else None,
    }
    out = {}
    for s in TRIED:
        for h in (10, 20):
            used = [(d, error, sigma, z) for d, hh, error, sigma, x, e in rows if hh == h and (z := signals[s.id](h, x, e)) is not None]
            if not used:
                continue
            best = None
            for c in s.grid:
                gains = []
                for d, error, sigma, z in used:
                    if s.moves == "median":
                        gains.append((d, abs(error) - abs(error - c * z)))
                    else:
                        moved = sigma * (1 + c * z) if s.moves == "widen" else sigma * max(0.25, 1 - c * z)
                        gains.append((d, nll(error, sigma) - nll(error, moved)))
                early, late = [g for d, g in gains if d < CUT], [g for d, g in gains if d >= CUT]
                if len(early) < 10 and c != 0:
                    continue
                key = (-(statistics.mean(early) if early else 0.0), abs(c), c)
                if best is None or (round(key[0], 9), *key[1:]) < (round(best[0][0], 9), *best[0][1:]):
                    best = (key, c, early, late)
            out[s.id, h] = best[1:]
    return out


def test_studies_match_loops(spark):
    rows = made()
    df = spark.createDataFrame(rows, "date date, horizon int, error double, sigma double, x double, e double").repartition(4)
    found = catalogue.evaluate(df, TRIED, ("1997-01-01", "1998-12-31"), "1999-01-01")
    got = {(r.id, r.horizon): r for r in found.collect()}
    want = plain(rows)
    assert set(got) == set(want)
    for key, (strength, early, late) in want.items():
        r = got[key]
        assert (r.strength, r.n_validation, r.n_holdout) == (strength, len(early), len(late)), key
        assert r.validation == (pytest.approx(statistics.mean(early)) if early else None)
        if len(late) > 1:
            assert r.holdout == pytest.approx(statistics.mean(late))
            assert r.bound == pytest.approx(statistics.mean(late) - 1.645 * statistics.stdev(late) / math.sqrt(len(late)))
    assert got["leads", 10].strength == 0.1 and got["loud", 10].strength > 0 and got["rare", 20].strength == 0

    told = {r.id: r for r in catalogue.verdicts(found).collect()}
    assert told["leads"].verdict == "candidate" and told["rare"].verdict in ("needs-more-data", "reject")
    for name, r in told.items():
        checked = [(s, e, late) for (i, _), (s, e, late) in want.items() if i == name and len(e) >= 10]
        assert r.n_horizons == sum(len(late) >= 3 for *_, late in checked)
        assert r.n_validation_better == sum(statistics.mean(e) > 1e-9 for _, e, _ in checked)


def test_the_catalogue_is_whole():
    assert len({(s.study, s.id) for s in STUDIES}) == len(STUDIES) == 36
    assert {s.study for s in STUDIES} == {"liquidity", "etf-demand", "sentiment", "on-chain", "macro", "cme-cot", "tail-risk", "hand-rules"}
    assert all(0.0 in s.grid for s in STUDIES) and len(NAMED) > 25


def test_no_rows_no_studies(spark):
    df = spark.createDataFrame([], "date date, horizon int, error double, sigma double, x double, e double")
    found = catalogue.evaluate(df, TRIED, ("1997-01-01", "1998-12-31"), "1999-01-01")
    assert found.collect() == [] and catalogue.verdicts(found).collect() == []
