"""Numbers: lenient casts, the rounding used in results, null-safe ratios."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def lenient(c: Column | str) -> Column:
    """A double; what can't be parsed is 0."""
    return F.coalesce(F.expr(f"try_cast({c} AS DOUBLE)") if isinstance(c, str) else c.try_cast("double"), F.lit(0.0))


def strict(c: Column) -> Column:
    """A double; what can't be parsed is null, for policies that skip the row."""
    return c.try_cast("double")


def money(c: Column | str) -> Column:
    """Exact decimal, so that sums don't depend on the order of rows."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,4)")


def half_up(c: Column, digits: int = 4) -> Column:
    """floor(x * 10^n + 0.5) / 10^n, the same in every engine."""
    return F.floor(c * float(10**digits) + 0.5) / float(10**digits)


def exact_mean(c: Column) -> Column:
    """Mean of a decimal: exact sum, one division."""
    return F.try_divide(F.sum(c).cast("double"), F.count(c).cast("double"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is 0."""
    return F.try_divide(a.cast("double"), b.cast("double"))


def index_low(n: Column, q: float) -> Column:
    """Row of the low percentile floor(q * (n - 1)), from 0."""
    return F.floor(F.lit(q) * (n - 1)).cast("int")


def index_clipped(n: Column, q: float) -> Column:
    """Row of the percentile min(n - 1, floor(q * n)), from 0."""
    return F.least(n - 1, F.floor(F.lit(q) * n)).cast("int")


def index_near(n: Column, q: float) -> Column:
    """Row of the percentile nearest to q * (n - 1), halves up, from 0."""
    return F.floor(F.lit(q) * (n - 1) + 0.5).cast("int")
