"""Global filter of every dashboard query: a half-open day range plus an optional market."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

ALL_MARKETS = "All markets"
MONTH_COLUMN = "event_month"
# Event-day columns of the facts; facts also carry ``event_month`` (yyyyMM) and are stored
# partitioned by it, so a day predicate on these columns also gets a month predicate.
FACT_DAY_COLUMNS = ("session_date", "transaction_day", "bet_day")


def month_key(day: Column) -> Column:
    return (F.year(day) * 100 + F.month(day)).cast("int")


@dataclass(frozen=True)
class Scope:
    """``start`` and ``end`` are ISO days; ``end`` is the inclusive last day.

    Rows match when ``start <= t < end + 1 day``. ``country == 'All markets'`` drops the market
    predicate entirely, so the optimizer sees a bare scan for the all-markets case.
    """

    start: str
    end: str
    country: str = ALL_MARKETS

    @property
    def start_day(self) -> dt.date:
        return dt.date.fromisoformat(self.start)

    @property
    def end_day(self) -> dt.date:
        return dt.date.fromisoformat(self.end)

    @property
    def bound_day(self) -> dt.date:
        """Exclusive upper bound (last day + 1)."""
        return self.end_day + dt.timedelta(days=1)

    @property
    def days(self) -> int:
        return (self.end_day - self.start_day).days + 1

    def previous(self) -> "Scope":
        """The equally long period that ends where this one starts."""
        prev_end = self.start_day - dt.timedelta(days=1)
        prev_start = self.start_day - dt.timedelta(days=self.days)
        return Scope(prev_start.isoformat(), prev_end.isoformat(), self.country)

    def with_country(self, country: str) -> "Scope":
        return Scope(self.start, self.end, country)

    # literals -------------------------------------------------------------------------
    @property
    def lo_ts(self) -> Column:
        return F.lit(f"{self.start} 00:00:00").cast("timestamp_ntz")

    @property
    def hi_ts(self) -> Column:
        return F.lit(f"{self.bound_day.isoformat()} 00:00:00").cast("timestamp_ntz")

    @property
    def lo_date(self) -> Column:
        return F.lit(self.start).cast("date")

    @property
    def hi_date(self) -> Column:
        return F.lit(self.bound_day.isoformat()).cast("date")

    # predicates -----------------------------------------------------------------------
    def ts_in(self, col: str | Column) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        return (c >= self.lo_ts) & (c < self.hi_ts)

    def date_in(self, col: str | Column) -> Column:
        c = F.col(col) if isinstance(col, str) else col
        pred = (c >= self.lo_date) & (c < self.hi_date)
        if isinstance(col, str) and col in FACT_DAY_COLUMNS:
            # redundant month bounds: partition pruning on the stored facts
            m = F.col(MONTH_COLUMN)
            lo, hi = self.start_day, self.end_day
            pred = (m >= F.lit(lo.year * 100 + lo.month)) & (m <= F.lit(hi.year * 100 + hi.month)) & pred
        return pred

    @property
    def all_markets(self) -> bool:
        return self.country == ALL_MARKETS

    def market(self, col: str | Column = "country") -> Column:
        c = F.col(col) if isinstance(col, str) else col
        return F.lit(True) if self.all_markets else (c == F.lit(self.country))

    def ts_and_market(self, ts_col: str, country_col: str = "country") -> Column:
        pred = self.ts_in(ts_col)
        return pred if self.all_markets else pred & self.market(country_col)

    def date_and_market(self, date_col: str, country_col: str = "country") -> Column:
        pred = self.date_in(date_col)
        return pred if self.all_markets else pred & self.market(country_col)
