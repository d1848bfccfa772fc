"""NULL- and NaN-safe comparisons and coercions.

Spark orders NaN above every number, so a bare ``score >= t`` is true for NaN. A missing score must never
raise an alert: every threshold test in the engine goes through these helpers and yields true or false, not NULL.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def col(name: str) -> Column:
    """A column by its exact name, also when it holds spaces, dots or slashes."""
    return F.col("`" + name.replace("`", "``") + "`")


def present(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c.cast("double"))


def finite(c: Column) -> Column:
    return present(c) & (F.abs(c.cast("double")) < F.lit(float("inf")))


def ge(c: Column, t) -> Column:
    return F.coalesce(present(c) & (c >= t), F.lit(False))


def gt(c: Column, t) -> Column:
    return F.coalesce(present(c) & (c > t), F.lit(False))


def le(c: Column, t) -> Column:
    return F.coalesce(present(c) & (c <= t), F.lit(False))


def lt(c: Column, t) -> Column:
    return F.coalesce(present(c) & (c < t), F.lit(False))


def true(c: Column) -> Column:
    return F.coalesce(c.cast("boolean"), F.lit(False))


def nan_to_null(c: Column) -> Column:
    d = c.cast("double")
    return F.when(~F.isnan(d), d)


def to_number(c: Column) -> Column:
    """Numeric coercion: anything missing, malformed or NaN becomes 0."""
    zero = F.lit(0.0)
    return F.coalesce(F.nanvl(c.try_cast("double"), zero), zero)


def ratio(num: Column, den: Column) -> Column:
    """num / den with the denominator held at 1 or more."""
    return num.cast("double") / F.greatest(den.cast("double"), F.lit(1.0))


def finite_to_null(c: Column) -> Column:
    """The number, NULL where it is missing, NaN or infinite."""
    return F.when(finite(c), c.cast("double"))


def clip(c: Column, lo: float, hi: float) -> Column:
    """Held between two bounds. A missing value stays missing: it must never read as a bound."""
    return F.when(present(c), F.least(F.greatest(c, F.lit(float(lo))), F.lit(float(hi))))


def rate(flag: Column) -> Column:
    """Share of rows where the flag holds, 0 for an empty table."""
    return ratio(F.count_if(flag), F.count(F.lit(1)))
