"""Stateful scans of a series, for what no window frame expresses: recursions and greedy selection.

A series is one asset's days, so a scan's group is bounded by the calendar.
"""

from __future__ import annotations

from bisect import bisect_right, insort
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def scan(rows: DataFrame, keys: list[str], order: list[str], step: Callable[[pd.DataFrame], dict[str, np.ndarray]], added: str) -> DataFrame:
    """Rows with new columns that ``step`` computes from the sorted rows of each group."""
    names = [part.split()[0] for part in added.split(", ")]
    schema = StructType(list(rows.schema.fields))
    for part in added.split(", "):
        schema = schema.add(*part.split())

    def run(group: pd.DataFrame) -> pd.DataFrame:
        ordered = group.sort_values(order, kind="stable").reset_index(drop=True)
        found = step(ordered)
        return ordered.assign(**{n: found[n] for n in names})

    return rows.groupBy(*keys).applyInPandas(run, schema)


def ema(values: np.ndarray, n: int) -> np.ndarray:
    """Exponential mean with weight 2 / (n + 1), started by the first value."""
    out, alpha, state = np.full(len(values), np.nan), 2.0 / (n + 1), np.nan
    for i, v in enumerate(values):
        state = v if np.isnan(state) else alpha * v + (1 - alpha) * state
        out[i] = state
    return out


def macd(values: np.ndarray, fast: int = 12, slow: int = 26, signal: int = 9) -> tuple[np.ndarray, np.ndarray]:
    line = ema(values, fast) - ema(values, slow)
    return line, ema(line, signal)


def wilder_rsi(values: np.ndarray, n: int = 14) -> np.ndarray:
    """Relative strength: means of the first n gains and losses, then recursive means; 50 if flat."""
    out = np.full(len(values), np.nan)
    moves = np.diff(values)
    if len(moves) < n:
        return out
    gain, loss = np.maximum(moves, 0), np.maximum(-moves, 0)
    up, down = gain[:n].mean(), loss[:n].mean()
    for i in range(n, len(values)):
        if i > n:
            up, down = (up * (n - 1) + gain[i - 1]) / n, (down * (n - 1) + loss[i - 1]) / n
        out[i] = 50.0 if up == down == 0 else 100.0 if down == 0 else 100 - 100 / (1 + up / down)
    return out


def cooldown(index: np.ndarray, wanted: np.ndarray, gap: int) -> np.ndarray:
    """Greedy choice: a wanted row is taken if the last one taken lies at least ``gap`` back."""
    taken, last = np.zeros(len(index), bool), None
    for i in np.flatnonzero(wanted):
        if last is None or index[i] - last >= gap:
            taken[i], last = True, index[i]
    return taken


def kalman_local_level(values: np.ndarray, q: float, r: float) -> np.ndarray:
    """Filtered level of a random walk seen with noise; a missing value only predicts."""
    out, level, var = np.full(len(values), np.nan), np.nan, 0.0
    for i, v in enumerate(values):
        if np.isnan(level):
            if not np.isnan(v):
                level, var = v, r
        else:
            var += q
            if not np.isnan(v):
                gain = var / (var + r)
                level, var = level + gain * (v - level), (1 - gain) * var
        out[i] = level
    return out


def islands(rows: DataFrame, flag: str, keys: list[str], order: str) -> DataFrame:
    """Rows where the flag holds, with a number for each unbroken run."""
    along = Window.partitionBy(*keys).orderBy(order)
    number = F.row_number().over(along) - F.row_number().over(Window.partitionBy(*keys, flag).orderBy(order))
    return rows.withColumn("island", number).where(F.col(flag))


def gap_segments(rows: DataFrame, keys: list[str], order: str, days: int) -> DataFrame:
    """Rows with a segment number that rises where more than ``days`` days lie between neighbours."""
    along = Window.partitionBy(*keys).orderBy(order)
    far = F.coalesce(F.datediff(order, F.lag(order).over(along)) > days, F.lit(False)).cast("int")
    return rows.withColumn("_far", far).withColumn("segment", F.sum("_far").over(along.rowsBetween(Window.unboundedPreceding, 0))).drop("_far")


def running_ranks(values: np.ndarray, least: int, inclusive: bool = False) -> np.ndarray:
    """Share of the values before each one (with itself, if ``inclusive``) that are not above it, once there are ``least``; missing values are passed over.

    The values so far are kept sorted, so a step is a search.
    """
    out, seen = np.full(len(values), np.nan), []
    for i, v in enumerate(values):
        if np.isnan(v):
            continue
        if inclusive:
            insort(seen, v)
        if len(seen) >= max(1, least):
            out[i] = bisect_right(seen, v) / len(seen)
        if not inclusive:
            insort(seen, v)
    return out


def with_ranks(rows: DataFrame, columns: dict[str, str], least: int, inclusive: bool = False) -> DataFrame:
    """Rows of assets with the running rank of each column, under the name that ``columns`` gives it."""

    def step(group: pd.DataFrame) -> dict[str, np.ndarray]:
        return {to: running_ranks(group[c].to_numpy(float), least, inclusive) for c, to in columns.items()}

    ranked = scan(rows, ["asset_id"], ["date"], step, ", ".join(f"{to} double" for to in columns.values()))
    return ranked.withColumns({to: F.nanvl(to, F.lit(None).cast("double")) for to in columns.values()})
