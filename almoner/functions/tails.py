"""Tail probabilities of Student's t, for p-values of slopes and correlations."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(a * math.log(x) + b * math.log1p(-x) - math.log(a) - math.lgamma(a) - math.lgamma(b) + math.lgamma(a + b))
    # evaluated from the last of many terms back
    value = 1.0
    for m in range(400, 0, -1):
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        value = 1 + even / (1 + odd / value)
    first = -(a + b) * x / (a + 1)
    return front / (1 + first / value)


def t_two_sided(t: float | None, df: float) -> float | None:
    """P(|T| >= |t|)."""
    if t is None or df <= 0 or math.isnan(t):
        return None
    return beta_share(df / 2, 0.5, df / (df + t * t))


# Lanczos' approximation of the gamma function, g = 7, nine terms.
LANCZOS = (0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059, 12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7)
#: Terms of the continued fraction.
TERMS = 400


def log_gamma(x: Column) -> Column:
    """Of numbers of 0.5 and more."""
    z = x - 1
    series = F.lit(LANCZOS[0])
    for i, v in enumerate(LANCZOS[1:]):
        series = series + v / (z + (i + 1))
    t = z + 7.5
    return 0.5 * math.log(2 * math.pi) + (z + 0.5) * F.log(t) - t + F.log(series)


def _fraction(a: Column, b: Column, x: Column) -> Column:
    """The incomplete beta function up to the middle, by its continued fraction from the last term back."""

    def term(value: Column, m: Column) -> Column:
        even = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        odd = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        return 1 + even / (1 + odd / value)

    front = F.exp(a * F.log(x) + b * F.log1p(-x) - F.log(a) - log_gamma(a) - log_gamma(b) + log_gamma(a + b))
    value = F.aggregate(F.sequence(F.lit(TERMS), F.lit(1), F.lit(-1)), F.lit(1.0), lambda v, m: term(v, m.cast("double")))
    return front / (1 - (a + b) * x / (a + 1) / value)


def beta_share_column(a: Column, b: Column, x: Column) -> Column:
    """The regularised incomplete beta function, as a column."""
    inside = F.when((x > 0) & (x < 1), x)
    return F.when(x <= 0, 0.0).when(x >= 1, 1.0).when(x > (a + 1) / (a + b + 2), 1 - _fraction(b, a, 1 - inside)).otherwise(_fraction(a, b, inside))


def t_two_sided_column(t: Column, df: Column) -> Column:
    """P(|T| >= |t|); NULL without a t or degrees of freedom."""
    n = F.when(df > 0, df.cast("double"))
    return F.when(F.isnan(t), F.lit(None).cast("double")).otherwise(beta_share_column(n / 2, F.lit(0.5), n / (n + t * t)))


def correlation_p(r: Column, n: Column) -> Column:
    """The two-sided p-value of Pearson's r over n pairs; 0 for a perfect line."""
    df = n - 2
    t = F.try_divide(r * F.sqrt(F.when(df > 0, df.cast("double"))), F.sqrt(F.greatest(1 - r * r, F.lit(0.0))))
    return F.when((F.abs(r) >= 1) & (df > 0), 0.0).otherwise(t_two_sided_column(t, df))


def sql_t_two_sided(t: str, df: str) -> str:
    """The same as a DuckDB expression over columns."""

    def fraction(a: str, b: str, x: str) -> str:
        front = f"exp({a} * ln({x}) + {b} * ln(1 - {x}) - ln({a}) - lgamma({a}) - lgamma({b}) + lgamma({a} + {b}))"
        value = f"list_reduce(list_prepend(1.0::DOUBLE, list_transform(range({TERMS}, 0, -1), lambda m: m::DOUBLE)), lambda v, m: 1 + (m * ({b} - m) * {x} / (({a} + 2 * m - 1) * ({a} + 2 * m))) / (1 + (-({a} + m) * ({a} + {b} + m) * {x} / (({a} + 2 * m) * ({a} + 2 * m + 1))) / v))"
        return f"({front} / (1 - ({a} + {b}) * {x} / ({a} + 1) / {value}))"

    a, b, x = f"({df} / 2.0::DOUBLE)", "0.5::DOUBLE", f"({df} / ({df} + {t} * {t}))"
    return f"CASE WHEN {x} >= 1 THEN 1 WHEN {x} <= 0 THEN 0 WHEN {x} > ({a} + 1) / ({a} + {b} + 2) THEN 1 - {fraction(b, a, f'(1 - {x})')} ELSE {fraction(a, b, x)} END"
