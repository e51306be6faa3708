"""Column expressions shared by every job.

All of them are built-in Spark expressions, so they stay inside whole-stage codegen.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = [
    "MONEY", "SCORE", "RATE", "money", "to_money", "dec", "out", "ratio", "sum_if", "avg_if",
    "count_if_null_sum", "max2", "min2", "clip", "monday_week", "week_of_year", "day_of_week",
    "date_key", "player_key", "as_double",
]

MONEY = "decimal(18,2)"   # money inside the engine: exact sums, order independent
SCORE = "decimal(9,6)"    # scores rounded to 6 places: exact sums of scores
RATE = "decimal(6,4)"     # RTPs and fee rates


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def dec(text: str) -> Column:
    """Exact decimal literal (``F.lit(0.01)`` would be a double)."""
    return F.lit(Decimal(text))


def money(x) -> Column:
    return _c(x).cast(MONEY)


def to_money(x) -> Column:
    """Round an exact decimal expression to cents (half up) and type it as money."""
    return F.round(_c(x), 2).cast(MONEY)


def as_double(x) -> Column:
    return _c(x).cast("double")


def out(x, name: str) -> Column:
    """Output a money/score column as double under a stable name."""
    return _c(x).cast("double").alias(name)


def ratio(num, den) -> Column:
    """``num / NULLIF(den, 0)`` in double arithmetic; NULL on a zero or NULL denominator."""
    return F.try_divide(_c(num).cast("double"), _c(den).cast("double"))


def sum_if(cond) -> Column:
    """``SUM(cond)``: NULL over no rows or all-NULL conditions (not 0 like ``count_if``)."""
    return F.sum(_c(cond).cast("int")).cast("bigint")


def count_if_null_sum(cond) -> Column:
    return sum_if(cond)


def avg_if(cond) -> Column:
    """``AVG(cond)`` as a share of rows (NULL conditions skipped)."""
    return F.avg(_c(cond).cast("double"))


def max2(a, b) -> Column:
    """Scalar two-argument MAX that returns NULL when either side is NULL."""
    a, b = _c(a), _c(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.greatest(a, b))


def min2(a, b) -> Column:
    a, b = _c(a), _c(b)
    return F.when(a.isNull() | b.isNull(), F.lit(None)).otherwise(F.least(a, b))


def clip(x, lo, hi) -> Column:
    x = _c(x)
    return F.when(x.isNull(), F.lit(None)).otherwise(F.least(F.greatest(x, lo), hi))


def monday_week(x) -> Column:
    """Monday of the week containing the timestamp/date, as a date."""
    return F.to_date(F.date_trunc("week", _c(x)))


def week_of_year(x) -> Column:
    """Monday-first week number with a week 0 before the first Monday, plus one."""
    d = _c(x)
    return (F.floor((F.dayofyear(d) - 1 + 7 - F.weekday(d)) / 7) + 1).cast("int")


def day_of_week(x) -> Column:
    """1 = Monday ... 7 = Sunday."""
    return (F.weekday(_c(x)) + 1).cast("int")


def date_key(x) -> Column:
    """YYYYMMDD integer key of a day."""
    d = _c(x)
    return (F.year(d) * 10000 + F.month(d) * 100 + F.dayofmonth(d)).cast("int")


def player_key(x) -> Column:
    """Operator player id from an integer customer key: ``PLR-`` and seven digits."""
    return F.concat(F.lit("PLR-"), F.lpad(_c(x).cast("string"), 7, "0"))
