"""Point-in-time walk-forward benchmark: every choice at an origin comes from what was known then.

The structural law is ln price = b . (1, ln t - CENTRE, sin, cos), t in days since
GENESIS, and a forecast returns to it over TAU days.  Three things keep all
origins, inner folds and parameters in one plan over one pass of each series:

* coefficients of every refit are solved from running sums (regression);
* a forecast's logarithm is linear in the coefficients, so a blend of two fits
  forecasts the same blend of their forecasts;
* a Kalman filter is linear in what it observes, so filtering the log price and
  each basis column once gives the filtered residuals of any refit.

The inner folds of an origin are rows whose targets were known before it, so a
fold's loss does not depend on the origin that asks for it: losses are computed
once for each row, horizon and parameter, and an origin meets its six by an equi
join.  Series are days of an asset, bounded by the calendar.
"""

from __future__ import annotations

from bisect import insort
from math import floor, pi

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewell.functions.scalars import clamp
from tidewell.operators import regression, scans, statespace
from tidewell.operators import windows as w
from tidewell.operators.metrics import best_of
from tidewell.operators.models import GENESIS

HORIZONS = (14, 30, 60, 90)
SPACING = 30
FOLDS = 6
#: Rows of the shortest training series, and days of a cycle.
LEAST_ROWS = 1460
CYCLE = 1460
TAU = 210.0
#: ln t is taken from here, so that the intercept and the slope are told apart well.
CENTRE = 8.0
#: Weights of the newest fit against the one before it.
WEIGHTS = (0.25, 0.5, 0.75)
#: Matured errors that an interval needs at least.
LEAST_ERRORS = 30
INTERVALS = {"q80": 0.8, "q90": 0.9, "q95": 0.95}
MOST_DRIFT = 0.006


def days_since(date: str | Column) -> Column:
    return F.datediff(date, F.lit(GENESIS).cast("date")).cast("double")


def basis(t: Column) -> list[Column]:
    return [F.lit(1.0), F.ln(t) - CENTRE, F.sin(t * (2 * pi / CYCLE)), F.cos(t * (2 * pi / CYCLE))]


def refits(bars: DataFrame, least: int = LEAST_ROWS) -> DataFrame:
    """asset_id, date, close, idx (from 0), t, y and b: the law fitted to the rows up to this one, once there are ``least``."""
    rows = bars.select("asset_id", "date", "close").where("close > 0")
    rows = rows.withColumns({"idx": F.row_number().over(w.series()) - 1, "t": days_since("date"), "y": F.ln("close")})
    sums = regression.product_sums(rows, basis(F.col("t")), F.col("y"), w.expanding(), "_")
    return regression.solved(sums, 4, "_", "b", F.col("idx") + 1 >= least)


def rolling_refits(bars: DataFrame, window: int = 3 * LEAST_ROWS, least: int = LEAST_ROWS) -> DataFrame:
    """As refits, from the last ``window`` rows alone."""
    rows = bars.select("asset_id", "date", "close").where("close > 0")
    rows = rows.withColumns({"idx": F.row_number().over(w.series()) - 1, "t": days_since("date"), "y": F.ln("close")})
    sums = regression.product_sums(rows, basis(F.col("t")), F.col("y"), w.trailing(window), "_")
    return regression.solved(sums, 4, "_", "b", F.col("idx") + 1 >= least)


def ahead(rows: DataFrame, horizons: tuple[int, ...]) -> DataFrame:
    """A row for each horizon with its target: horizon, target_date, target_t, target_y, fade."""
    along = w.series()
    targets = [F.struct(F.lit(h).alias("horizon"), F.lead("date", h).over(along).alias("target_date"), F.lead("y", h).over(along).alias("target_y")) for h in horizons]
    long = rows.withColumn("_all", F.array(*targets)).withColumn("_one", F.explode("_all")).select(*rows.columns, "_one.*").where("target_date IS NOT NULL")
    return long.withColumns({"target_t": days_since("target_date"), "fade": F.exp(-F.datediff("target_date", "date") / F.lit(TAU))})


def law_forecast(b: Column) -> Column:
    """Logarithm of the forecast: the law at the target, and what is left of the distance from it."""
    now, then = basis(F.col("t")), basis(F.col("target_t"))
    return regression.dot(b, then) + (F.col("y") - regression.dot(b, now)) * F.col("fade")


def origins(rows: DataFrame, spacing: int = SPACING) -> DataFrame:
    return rows.where((F.col("idx") % spacing == 0) & F.col("b").isNotNull())


def inner_losses(outer: DataFrame, losses: DataFrame, parameter: str, least: int = LEAST_ROWS, folds: int = FOLDS) -> DataFrame:
    """asset_id, idx, horizon, ``parameter``, n_folds, loss: the mean loss over an origin's inner folds.

    Folds lie a horizon apart; the last one's target is the row before the
    origin's, the first one has ``least`` rows before it.  ``losses`` has the
    columns asset_id, idx (of the fold), horizon, ``parameter`` and loss.
    """
    last = F.col("idx") - F.col("horizon") - 1
    first = F.greatest(F.lit(least), last - (folds - 1) * F.col("horizon"))
    fold = F.explode(F.when(last >= least, F.sequence(first, last, F.col("horizon"))))
    asked = outer.select("asset_id", F.col("idx").alias("origin"), "horizon", fold.alias("idx"))
    met = asked.join(losses, ["asset_id", "idx", "horizon"])
    return met.groupBy("asset_id", F.col("origin").alias("idx"), "horizon", parameter).agg(F.count("loss").alias("n_folds"), F.avg("loss").alias("loss"))


def interval_of(rows: DataFrame) -> DataFrame:
    """Adds n_eligible, n_unresolved, n_embargoed and the quantiles of INTERVALS over the errors (column err_refit) that had matured at each origin.

    An error is unresolved until its target lies before the origin, and then
    embargoed until its own origin lies more than the horizon's days back.  Both
    hold for a growing part of the rows in order, so one scan keeps the matured
    errors sorted; a quantile is the value at floor((n - 1) p).
    """

    def step(group: pd.DataFrame) -> dict[str, np.ndarray]:
        dates = pd.to_datetime(group["date"]).to_numpy().astype("datetime64[D]").astype(np.int64)
        targets = pd.to_datetime(group["target_date"]).to_numpy().astype("datetime64[D]").astype(np.int64)
        errors, horizon = group["err_refit"].to_numpy(), int(group["horizon"].iloc[0])
        matured: list[float] = []
        out = {name: np.full(len(group), np.nan) for name in INTERVALS} | {name: np.zeros(len(group), np.int64) for name in ("n_eligible", "n_unresolved", "n_embargoed")}
        for i in range(len(group)):
            resolved = int(np.searchsorted(targets[:i], dates[i]))
            free = min(resolved, int(np.searchsorted(dates[:i], dates[i] - horizon)))
            for j in range(len(matured), free):
                insort(matured, errors[j])
            out["n_eligible"][i], out["n_unresolved"][i], out["n_embargoed"][i] = free, i - resolved, resolved - free
            if free >= LEAST_ERRORS:
                for name, p in INTERVALS.items():
                    out[name][i] = matured[floor((free - 1) * p)]
        return out

    added = "n_eligible long, n_unresolved long, n_embargoed long, " + ", ".join(f"{name} double" for name in INTERVALS)
    found = scans.scan(rows, ["asset_id", "horizon"], ["date"], step, added)
    return found.withColumns({name: F.when(~F.isnan(name), F.col(name)) for name in INTERVALS})


def structural_benchmark(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS, spacing: int = SPACING, least: int = LEAST_ROWS) -> DataFrame:
    """A row for each origin and horizon: the errors of the benchmarks, the weight chosen on the inner folds, and its error.

    Columns: asset_id, idx, date, horizon, target_date, n_folds, weight, log_median,
    err_{025, 050, 075}, err_chosen, err_refit, err_naive, err_drift, err_trend,
    and those of interval_of.
    """
    along = w.series()
    fits = refits(bars, least)
    first_fit = F.max(F.when(F.col("idx") == least, F.col("b"))).over(Window.partitionBy("asset_id"))
    lagged = F.coalesce(*(F.when((F.col("idx") - h >= least) & (F.col("horizon") == h), F.col(f"b_{h}")) for h in horizons), F.col("b_first"))
    sma = {f"sma{n}": w.sma("close", n) for n in (20, 50, 200)}
    back = F.when(F.col("idx") >= 90, F.lag("y", 90).over(along)).otherwise(F.first("y").over(w.expanding()))
    prepared = fits.withColumns(
        {f"b_{h}": F.lag("b", h).over(along) for h in horizons}
        | sma
        | {"b_first": first_fit, "b_before": F.coalesce(F.lag("b", spacing).over(along), F.col("b")), "pace": (F.col("y") - back) / F.greatest(F.lit(1), F.least(F.lit(90), F.col("idx")))}
    )
    rows = ahead(prepared.where("b IS NOT NULL"), horizons)
    rows = rows.withColumn("refit", law_forecast(F.col("b")))

    inner = rows.where(F.col("idx") >= least).withColumn("anchor", law_forecast(lagged))
    each = F.explode(F.array(*(F.struct(F.lit(x).alias("weight"), F.abs((1 - x) * F.col("anchor") + x * F.col("refit") - F.col("target_y")).alias("loss")) for x in WEIGHTS))).alias("_one")
    losses = inner.select("asset_id", "idx", "horizon", each).select("asset_id", "idx", "horizon", "_one.*")

    outer = origins(rows, spacing).withColumn("anchor", law_forecast(F.col("b_before")))
    chosen = best_of(inner_losses(outer, losses, "weight", least), ["asset_id", "idx", "horizon"], F.col("loss"), F.col("weight"))
    trend = clamp(0.55 * F.ln(F.col("sma20") / F.col("sma50")) / 30 + 0.45 * F.ln(F.col("sma50") / F.col("sma200")) / 150, -MOST_DRIFT, MOST_DRIFT)
    miss = lambda forecast: F.abs(forecast - F.col("target_y"))
    blend = lambda x: (1 - x) * F.col("anchor") + x * F.col("refit")
    met = outer.join(chosen.select("asset_id", "idx", "horizon", "n_folds", "weight"), ["asset_id", "idx", "horizon"], "left")
    met = met.withColumns({"n_folds": F.coalesce("n_folds", F.lit(0)), "weight": F.coalesce("weight", F.lit(WEIGHTS[0]))})
    met = met.withColumn("log_median", blend(F.col("weight")))
    scored = met.select(
        "asset_id", "idx", "date", "horizon", "target_date", "n_folds", "weight", "log_median",
        *(miss(blend(F.lit(x))).alias(f"err_{round(100 * x):03d}") for x in WEIGHTS),
        miss(F.col("log_median")).alias("err_chosen"), miss(F.col("refit")).alias("err_refit"), miss(F.col("y")).alias("err_naive"),
        miss(F.col("y") + F.col("pace") * F.col("horizon")).alias("err_drift"),
        F.when(F.col("idx") >= 220, miss(F.col("y") + trend * F.col("horizon"))).alias("err_trend"),
    )
    return interval_of(scored)


def state_space_benchmark(bars: DataFrame, horizons: tuple[int, ...] = HORIZONS, spacing: int = SPACING, least: int = LEAST_ROWS) -> DataFrame:
    """A row for each origin and horizon: the state-space parameters chosen on the inner folds, and the errors of all and of the chosen ones.

    The residuals of a refit are filtered by its coefficients: states of the log
    price less b times those of the basis.  Columns: asset_id, idx, date, horizon,
    target_date, n_folds, grid (from 0), log_median, err_0.., err_chosen.
    """
    fits = refits(bars, least)
    observed = fits.withColumns({f"_x{j}": x for j, x in enumerate(basis(F.col("t")))})
    filtered = statespace.linear_states(observed, ["y", "_x0", "_x1", "_x2", "_x3"], "states").where("b IS NOT NULL")
    rows = ahead(filtered, horizons)

    def forecast(g: int) -> Column:
        phi = statespace.GRID[g].persistence
        state = lambda j, part: F.col("states")[(g * 5 + j) * 2 + part]
        level, rest = (state(0, part) - sum((F.col("b")[j] * state(j + 1, part) for j in range(4)), F.lit(0.0)) for part in (0, 1))
        return regression.dot(F.col("b"), basis(F.col("target_t"))) + level + rest * F.pow(F.lit(phi), F.col("horizon"))

    n = len(statespace.GRID)
    rows = rows.withColumns({f"m_{g}": forecast(g) for g in range(n)})
    each = F.explode(F.array(*(F.struct(F.lit(g).alias("grid"), F.abs(F.col(f"m_{g}") - F.col("target_y")).alias("loss")) for g in range(n)))).alias("_one")
    losses = rows.where(F.col("idx") >= least).select("asset_id", "idx", "horizon", each).select("asset_id", "idx", "horizon", "_one.*")
    outer = origins(rows, spacing)
    chosen = best_of(inner_losses(outer, losses, "grid", least), ["asset_id", "idx", "horizon"], F.col("loss"), F.col("grid"))
    met = outer.join(chosen.select("asset_id", "idx", "horizon", "n_folds", "grid"), ["asset_id", "idx", "horizon"], "left")
    met = met.withColumns({"n_folds": F.coalesce("n_folds", F.lit(0)), "grid": F.coalesce("grid", F.lit(0))})
    met = met.withColumn("log_median", F.element_at(F.array(*(F.col(f"m_{g}") for g in range(n))), F.col("grid") + 1))
    errors = [F.abs(F.col(f"m_{g}") - F.col("target_y")).alias(f"err_{g}") for g in range(n)]
    return met.select("asset_id", "idx", "date", "horizon", "target_date", "n_folds", "grid", "log_median", *errors, F.abs(F.col("log_median") - F.col("target_y")).alias("err_chosen"))
