"""Column arithmetic that gives the same digits whatever the row order or engine.

Money is summed in whole cents (long) and rates are rounded in integers, so no
floating-point sum decides a rounded digit. A long that overflows raises (ANSI mode).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def cents(amount: Column | str) -> Column:
    """Money column as whole cents."""
    amount = F.col(amount) if isinstance(amount, str) else amount
    return (amount * 100).cast("long")


def money(total_cents: Column | str) -> Column:
    """Whole cents back to a double with two decimals."""
    total_cents = F.col(total_cents) if isinstance(total_cents, str) else total_cents
    return total_cents.cast("double") / F.lit(100.0).cast("double")


def ratio_2dp(num: Column, den: Column, scale: int = 1) -> Column:
    """``scale * num / den`` to two decimals, halves up; NULL where ``den`` is 0 or NULL.

    For non-negative integers only.
    """
    den = F.nullif(den.cast("long"), F.lit(0).cast("long"))
    hundredths = _div((num.cast("long") * (200 * scale) + den), den * 2)
    return hundredths.cast("double") / F.lit(100.0).cast("double")


def percent(num: Column, den: Column) -> Column:
    """Share in percent, two decimals, halves up."""
    return ratio_2dp(num, den, scale=100)


def percent_1dp(num: Column, den: Column) -> Column:
    """Share in tenths of a percent as a whole number, halves to even."""
    den = F.nullif(den.cast("long"), F.lit(0).cast("long"))
    scaled = num.cast("long") * 1000
    low = _div(scaled, den)
    twice_rest = (scaled - low * den) * 2
    up = (twice_rest > den) | ((twice_rest == den) & (low % 2 == 1))
    return low + up.cast("long")


def floor_div(num: Column, den: Column) -> Column:
    """Integer quotient rounded towards minus infinity (``den`` > 0), for decimals too."""
    return _div(num - F.pmod(num, den), den)


def _div(num: Column, den: Column) -> Column:
    return F.call_function("div", num, den)


def epoch_second(ts: Column) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp, without consulting any zone."""
    day = F.unix_date(ts.cast("date")).cast("long")
    return day * 86400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def epoch_micros(ts: Column) -> Column:
    """Whole microseconds since 1970 of a zone-less timestamp, without consulting any zone."""
    within = (F.extract(F.lit("SECOND"), ts) * 1_000_000).cast("long")
    return (epoch_second(ts) - F.second(ts)) * 1_000_000 + within


def minutes_between(start: Column, end: Column) -> Column:
    """Whole minutes from ``start`` to ``end``, cut off, as TIMESTAMPDIFF(MINUTE) counts them."""
    gap = end - start
    part = lambda unit: F.extract(F.lit(unit), gap).cast("long")
    return part("DAY") * 1440 + part("HOUR") * 60 + part("MINUTE")
