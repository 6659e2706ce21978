"""Least squares from running sums: every refit of a series comes from one pass over it.

The sums of products over a frame are window aggregates; only the normal
equations of each row, a few numbers, go to numpy, which solves a batch of them
at once.  No row of training data is read twice.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, StructType


def product_sums(rows: DataFrame, xs: list[Column], y: Column, frame: WindowSpec, prefix: str) -> DataFrame:
    """Adds the sums over the frame of x_i * x_j ({prefix}g{i}{j}, j <= i) and of x_i * y ({prefix}t{i})."""
    sums = {}
    for i, a in enumerate(xs):
        for j, b in enumerate(xs[: i + 1]):
            sums[f"{prefix}g{i}{j}"] = F.sum(a * b).over(frame)
        sums[f"{prefix}t{i}"] = F.sum(a * y).over(frame)
    return rows.withColumns(sums)


def solved(rows: DataFrame, k: int, prefix: str, to: str, where: Column, ridge: float = 0.0) -> DataFrame:
    """Replaces the sums of product_sums by ``to``, an array of k coefficients; null where ``where`` fails or the equations have no single solution.

    ``ridge`` is added to the diagonal, but not to that of the first column (the
    intercept).  Each batch's systems are solved together.
    """
    kept = [c for c in rows.columns if not c.startswith((f"{prefix}g", f"{prefix}t"))]
    schema = StructType([rows.schema[c] for c in kept]).add(to, ArrayType(DoubleType()))
    asked = rows.withColumn(f"{prefix}asked", where)

    def solve(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            gram, right = np.empty((len(frame), k, k)), np.empty((len(frame), k))
            for i in range(k):
                for j in range(i + 1):
                    gram[:, i, j] = gram[:, j, i] = frame[f"{prefix}g{i}{j}"]
                right[:, i] = frame[f"{prefix}t{i}"]
            gram[:, range(1, k), range(1, k)] += ridge
            scale = np.sqrt(np.einsum("nii->ni", gram))
            # scaled to a unit diagonal, a system is refused where its least eigenvalue is nothing but rounding
            with np.errstate(divide="ignore", invalid="ignore"):
                even = gram / scale[:, :, None] / scale[:, None, :]
            good = frame[f"{prefix}asked"].fillna(False).to_numpy(bool) & np.isfinite(even).all((1, 2)) & np.isfinite(right).all(1)
            good[good] = np.linalg.eigvalsh(even[good])[:, 0] > 1e-12
            found = [None] * len(frame)
            solutions = np.linalg.solve(even[good], (right[good] / scale[good])[:, :, None])[:, :, 0] / scale[good]
            for n, solution in zip(np.flatnonzero(good), solutions, strict=True):
                found[n] = solution
            yield frame[kept].assign(**{to: pd.Series(found, dtype=object)})

    return asked.mapInPandas(solve, schema)


def dot(coefficients: Column, xs: list[Column]) -> Column:
    return sum((coefficients[i] * x for i, x in enumerate(xs)), F.lit(0.0))
