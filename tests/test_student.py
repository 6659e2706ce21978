"""Student's t against published quantiles, numerical integration and boundary rules."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.functions import student as st
from tidewell.plans.distributions import PUBLISHED

INF = float("inf")


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame(rows, schema).coalesce(1).select(column).collect()]


def density(x, nu):
    return math.exp(math.lgamma((nu + 1) / 2) - math.lgamma(nu / 2)) / math.sqrt(nu * math.pi) * (1 + x * x / nu) ** (-(nu + 1) / 2)


def test_published_quantiles(spark):
    asked = [(float(nu), p, want) for nu, wants in PUBLISHED.items() for p, want in zip((0.025, 0.05, 0.1), wants)]
    both = asked + [(nu, 1 - p, -want) for nu, p, want in asked]
    got = values(spark, [(nu, p) for nu, p, _ in both], "nu double, p double", st.t_quantile(F.col("p"), F.col("nu")))
    assert got == pytest.approx([want for *_, want in both], abs=1e-6)


def test_cdf_matches_integration(spark):
    asked = [(x, nu) for nu in (2.5, 3.0, 7.0, 40.0, 200.0) for x in (-6.0, -1.0, -0.01, 0.3, 2.0, 9.0)]
    got = values(spark, asked, "x double, nu double", st.t_cdf(F.col("x"), F.col("nu")))
    for (x, nu), p in zip(asked, got):
        grid = np.linspace(0, x, 20_001)
        assert p == pytest.approx(0.5 + np.trapezoid([density(v, nu) for v in grid], grid), abs=1e-7)


def test_infinite_degrees_are_normal_and_the_middle_is_zero(spark):
    got = values(spark, [(0.5, 5.0), (0.975, INF), (0.5, INF)], "p double, nu double", st.t_quantile(F.col("p"), F.col("nu")))
    assert got == pytest.approx([0.0, 1.959964, 0.0], abs=1e-6)
    assert values(spark, [(0.0, INF), (0.0, 4.0), (None, 4.0)], "x double, nu double", st.t_cdf(F.col("x"), F.col("nu"))) == pytest.approx([0.5, 0.5, None], abs=1e-6)


def test_log_density_has_unit_variance(spark):
    grid = np.linspace(-60, 60, 6_001)
    for nu in (5.0, INF):
        logs = values(spark, [(float(x), nu) for x in grid], "x double, nu double", st.t_log_density(F.col("x"), F.col("nu")))
        shares = np.exp(logs)
        assert np.trapezoid(shares, grid) == pytest.approx(1, abs=1e-4)
        assert np.trapezoid(shares * grid**2, grid) == pytest.approx(1, abs=5e-3)


def test_prices_at_the_boundaries(spark):
    price = st.price_cdf(F.lit(100.0), F.lit(0.2), F.col("price"), F.col("nu"))
    got = values(spark, [(100.0, 5.0), (INF, 5.0), (0.0, 5.0), (-3.0, INF), (-INF, 5.0), (None, 5.0)], "price double, nu double", price)
    assert got == pytest.approx([0.5, 1.0, 0.0, 0.0, 0.0, None])
    assert math.isnan(values(spark, [(float("nan"), 5.0)], "price double, nu double", price)[0])
    back = st.price_cdf(F.lit(50.0), F.lit(0.3), st.price_quantile(F.lit(50.0), F.lit(0.3), st.t_quantile(F.col("p"), F.col("nu")), F.col("nu")), F.col("nu"))
    assert values(spark, [(0.05, 3.0), (0.9, 12.0)], "p double, nu double", back) == pytest.approx([0.05, 0.9], abs=1e-9)


@pytest.mark.parametrize("p, nu, told", [(0.1, 2.0, "degrees of freedom"), (0.0, 5.0, "probability"), (1.0, 5.0, "probability")])
def test_what_has_no_meaning_is_an_error(spark, p, nu, told):
    with pytest.raises(Exception, match=told):
        values(spark, [(p, nu)], "p double, nu double", st.t_quantile(F.col("p"), F.col("nu")))
