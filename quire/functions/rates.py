"""Exact interval ends of rates, as column expressions: the incomplete beta function and its inverse."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

CONFIDENCE = 0.95
#: Bisection steps: an end is exact to 2^-48.
HALVINGS = 48
TINY = 1e-300


def log_gamma(x: Column) -> Column:
    """Logarithm of the gamma function for x of 1 or more: Stirling's series, seven places up."""
    z = x + 7
    series = 1 / (12 * z) - 1 / (360 * z * z * z) + 1 / (1260 * z * z * z * z * z)
    down = sum((F.ln(x + k) for k in range(1, 7)), F.ln(x))
    return (z - 0.5) * F.ln(z) - z + 0.9189385332046727 + series - down


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The continued fraction of the incomplete beta function, front to back, for x below the mean."""
    steps = F.sequence(F.lit(1), (F.lit(40) + 4 * F.ceil(F.sqrt(a + b))).cast("int"))
    kept = lambda v: F.when(F.abs(v) < TINY, F.lit(TINY)).otherwise(v)

    def term(k: Column) -> Column:
        m = F.floor(k / 2).cast("double")
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return F.when(k % 2 == 0, even).otherwise(odd)

    state = lambda c, d, h: F.struct(c.alias("c"), d.alias("d"), h.alias("h"))
    # each step multiplies the value of the denominator so far by c and by d, the reciprocal of v
    follow = lambda s, k: F.transform(F.array(F.struct(kept(1 + term(k) / s["c"]).alias("c"), kept(1 + term(k) * s["d"]).alias("v"))), lambda t: state(t["c"], 1 / t["v"], s["h"] * t["c"] / t["v"]))[0]
    return F.aggregate(steps, state(F.lit(1.0), F.lit(0.0), F.lit(1.0)), follow, lambda s: 1 / s["h"])


def beta_below(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function I_x(a, b), for a and b of 1 or more and x inside (0, 1)."""
    front = F.exp(log_gamma(a + b) - log_gamma(a) - log_gamma(b) + a * F.ln(x) + b * F.ln(1 - x))
    return F.when(x < (a + 1) / (a + b + 2), front * _fraction(a, b, x) / a).otherwise(1 - front * _fraction(b, a, 1 - x) / b)


def beta_at(a: Column, b: Column, p: float) -> Column:
    """The x whose I_x(a, b) is ``p``: bisection, a halving a step."""
    a, b = a.cast("double"), b.cast("double")
    widths = F.array(*[F.lit(2.0 ** -(k + 1)) for k in range(HALVINGS)])
    return F.aggregate(widths, F.lit(0.0), lambda low, w: F.when(beta_below(a, b, low + w) < p, low + w).otherwise(low))


def lower_end(k: Column, n: Column, miss: float = (1 - CONFIDENCE) / 2) -> Column:
    """Exact lower end of a rate after k of n: below it, k or more hits have a probability under ``miss``. 0 without trials."""
    return F.when((n <= 0) | (k <= 0), 0.0).otherwise(beta_at(k, n - k + 1, miss))


def upper_end(k: Column, n: Column, miss: float = (1 - CONFIDENCE) / 2) -> Column:
    """Exact upper end: above it, k or fewer hits have a probability under ``miss``. 1 without trials."""
    return F.when((n <= 0) | (k >= n), 1.0).otherwise(beta_at(k + 1, n - k, 1 - miss))
