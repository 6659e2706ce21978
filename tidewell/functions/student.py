"""Student's t distribution as Columns of fixed depth, and predictive distributions in price space.

The cumulative function is a regularised incomplete beta function: a continued
fraction (modified Lentz) folded DEPTH times in the JVM.  The quantile halves a
bracket HALVINGS times around it, so it costs HALVINGS times as much: ask for it
once for each probability and degree of freedom, and join.

Degrees of freedom are more than two, so that a variance exists; infinity is the
normal distribution.  ``sigma`` is a standard deviation of the log price: a t
variate is scaled to unit variance first.
"""

from __future__ import annotations

from math import log, pi

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidewell.functions.scalars import normal_cdf, normal_quantile

DEPTH = 40
HALVINGS = 60
#: A quantile lies within this of zero for probabilities from 1e-9 to 1 - 1e-9.
BRACKET = 2.0**20
_TINY = 1e-300
#: Lanczos coefficients of the gamma function (g = 7).
LANCZOS = (
    0.9999999999998099, 676.5203681218851, -1259.1392167224028, 771.3234287776531, -176.6150291621406,
    12.507343278686905, -0.13857109526572012, 9.984369578019572e-6, 1.5056327351493116e-7,
)


def log_gamma(x: Column) -> Column:
    """For x of 0.5 or more."""
    z = x - 1.0
    series = sum((F.lit(c) / (z + float(i)) for i, c in enumerate(LANCZOS[1:], 1)), F.lit(LANCZOS[0]))
    t = z + 7.5
    return 0.5 * log(2 * pi) + (z + 0.5) * F.ln(t) - t + F.ln(series)


def _away_from_zero(x: Column) -> Column:
    return F.when(F.abs(x) < _TINY, F.lit(_TINY)).otherwise(x)


def _let(value: Column, f) -> Column:
    return F.element_at(F.transform(F.array(value), f), 1)


def _continued_fraction(x: Column, a: Column, b: Column) -> Column:
    def level(s: Column, numerator: Column) -> Column:
        return F.struct((1 / _away_from_zero(1 + numerator * s["d"])).alias("d"), _away_from_zero(1 + numerator / s["c"]).alias("c"), s["h"].alias("h"))

    def product(s: Column) -> Column:
        return F.struct(s["d"].alias("d"), s["c"].alias("c"), (s["h"] * s["d"] * s["c"]).alias("h"))

    def step(s: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return _let(_let(_let(level(s, even), product), lambda q: level(q, odd)), product)

    first = 1 / _away_from_zero(1 - (a + b) * x / (a + 1))
    start = F.struct(first.alias("d"), F.lit(1.0).alias("c"), first.alias("h"))
    return F.aggregate(F.array(*(F.lit(float(m)) for m in range(1, DEPTH + 1))), start, step, lambda s: s["h"])


def incomplete_beta(x: Column, a: Column, b: Column) -> Column:
    """Regularised, for a and b of 0.5 or more; by the side on which the fraction converges fast."""

    def of(v: Column) -> Column:
        x, a, b = v["x"], v["a"], v["b"]
        near = x < (a + 1) / (a + b + 2)
        front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
        side = lambda p, q: F.when(near, p).otherwise(q)
        sides = F.struct(near.alias("near"), front.alias("front"), side(x, 1 - x).alias("x"), side(a, b).alias("a"), side(b, a).alias("b"))
        part = _let(sides, lambda s: F.struct(s["near"].alias("near"), (s["front"] * _continued_fraction(s["x"], s["a"], s["b"]) / s["a"]).alias("part")))
        found = _let(part, lambda s: F.when(s["near"], s["part"]).otherwise(1 - s["part"]))
        return F.when(x <= 0, 0.0).when(x >= 1, 1.0).otherwise(found)

    return _let(F.struct(x.alias("x"), a.alias("a"), b.alias("b")), of)


def checked(nu: Column) -> Column:
    return F.when(nu > 2, nu).when(nu.isNotNull(), F.raise_error(F.lit("degrees of freedom must be more than two")).cast("double"))


def _finite_nu(nu: Column) -> Column:
    """A number where nu is infinite: the branch is not taken there, but its parts may be computed."""
    return F.when(nu == float("inf"), 1e6).otherwise(checked(nu))


def _t_cdf(value: Column, nu: Column) -> Column:
    def of(v: Column) -> Column:
        value, nu = v["value"], v["nu"]
        tail = 0.5 * incomplete_beta(nu / (nu + value * value), nu / 2, F.lit(0.5))
        return F.when(value == 0, 0.5).otherwise(_let(tail, lambda t: F.when(value > 0, 1 - t).otherwise(t)))

    return _let(F.struct(value.alias("value"), nu.alias("nu")), of)


def t_cdf(value: Column, nu: Column) -> Column:
    def of(v: Column) -> Column:
        value, nu = v["value"], v["nu"]
        return F.when(F.isnan(value), value).when(nu == float("inf"), normal_cdf(value)).when(value.isNotNull() & nu.isNotNull(), _t_cdf(value, _finite_nu(nu)))

    return _let(F.struct(value.alias("value"), nu.alias("nu")), of)


def t_quantile(p: Column, nu: Column) -> Column:
    """For p strictly between 0 and 1; other probabilities are an error."""

    def search(v: Column) -> Column:
        def halve(s: Column, _: Column) -> Column:
            def narrowed(m: Column) -> Column:
                low = _t_cdf(m, v["nu"]) < v["p"]
                return F.struct(F.when(low, m).otherwise(s["low"]).alias("low"), F.when(low, s["high"]).otherwise(m).alias("high"))

            return _let((s["low"] + s["high"]) / 2, narrowed)

        start = F.struct(F.lit(0.0).alias("low"), F.lit(BRACKET).alias("high"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(HALVINGS)), start, halve, lambda s: (s["low"] + s["high"]) / 2)

    def of(v: Column) -> Column:
        p, nu = v["p"], v["nu"]
        found = _let(F.struct(F.greatest(p, 1 - p).alias("p"), _finite_nu(nu).alias("nu")), search)
        other = F.when(p < 0.5, -1.0).otherwise(1.0) * found
        return F.when(nu == float("inf"), normal_quantile(p)).when(p == 0.5, 0.0).when(p.isNotNull() & nu.isNotNull(), other)

    sound = F.when((p > 0) & (p < 1), p).when(p.isNotNull(), F.raise_error(F.lit("a probability must lie strictly between zero and one")).cast("double"))
    return _let(F.struct(sound.alias("p"), nu.alias("nu")), of)


def t_log_density(value: Column, nu: Column) -> Column:
    """Of a variate scaled to unit variance."""
    n = _finite_nu(nu)
    scaled = log_gamma((n + 1) / 2) - log_gamma(n / 2) - 0.5 * F.ln(pi * (n - 2)) - (n + 1) / 2 * F.ln(1 + value * value / (n - 2))
    return F.when(nu == float("inf"), -0.5 * log(2 * pi) - value * value / 2).otherwise(scaled)


def unit_scale(nu: Column) -> Column:
    """Standard deviation of 1 over that of a t variate."""
    return F.when(nu == float("inf"), 1.0).otherwise(F.sqrt((_finite_nu(nu) - 2) / _finite_nu(nu)))


def price_quantile(median: Column, sigma: Column, variate: Column, nu: Column) -> Column:
    """The price at a variate of t_quantile."""
    return median * F.exp(sigma * unit_scale(nu) * variate)


def price_cdf(median: Column, sigma: Column, price: Column, nu: Column) -> Column:
    """Share of the distribution up to a price: 0 for prices that are not positive, 1 at infinity, NaN for NaN."""
    z = F.ln(F.when(price > 0, price) / median) / sigma / unit_scale(nu)
    return F.when(F.isnan(price), price).when(price == float("inf"), 1.0).when(price <= 0, 0.0).otherwise(t_cdf(z, nu))

