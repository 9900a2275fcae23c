"""Missing values: one layer that every operator uses.

Missing is NULL, never NaN: a NaN would poison sums and win every maximum.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def known(x: Column | str) -> Column:
    """NaN becomes NULL."""
    return F.nanvl(col(x), F.lit(None).cast("double"))


def number(x: Column | str) -> Column:
    """A text as a number, NULL if it isn't one."""
    return known(F.trim(col(x).cast("string")).try_cast("double"))


def ratio(a: Column | str, b: Column | str) -> Column:
    """a / b; NULL where b is 0 or NULL."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def clip(x: Column | str, low: float | None = None, high: float | None = None) -> Column:
    """NULL stays NULL: greatest and least alone would skip it."""
    x = col(x)
    out = x if low is None else F.greatest(x, F.lit(float(low)))
    out = out if high is None else F.least(out, F.lit(float(high)))
    return F.when(x.isNotNull(), out)


def zero_filled(x: Column | str, width: int) -> Column:
    """Leading zeros up to a width; longer texts are not cut."""
    x = col(x).cast("string")
    return F.when(F.length(x) >= width, x).otherwise(F.lpad(x, width, "0"))


def total(x: Column | str) -> Column:
    """A sum that is 0 over nothing."""
    return F.coalesce(F.sum(col(x)), F.lit(0.0))


def row_mean(columns: list[Column | str]) -> Column:
    """The mean of a row's known values; NULL if there are none."""
    values = [known(col(x).cast("double")) for x in columns]
    n = reduce(lambda a, b: a + b, [F.when(v.isNotNull(), 1).otherwise(0) for v in values])
    return F.when(n > 0, reduce(lambda a, b: a + b, [F.coalesce(v, F.lit(0.0)) for v in values]) / n)


def blank(x: Column | str) -> Column:
    """NULL, empty, or what a frame's printed missing value looks like."""
    t = F.lower(F.trim(col(x).cast("string")))
    return t.isNull() | t.isin("", "nan", "none", "null")


def correlation(x: Column | str, y: Column | str) -> Column:
    """Pearson's, over rows where both are known; NULL without spread, where corr would divide by zero."""
    x, y = col(x).cast("double"), col(y).cast("double")
    a, b = F.when(y.isNotNull(), x), F.when(x.isNotNull(), y)
    return known(ratio(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b)))
