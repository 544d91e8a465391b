"""Relative time windows, resolved against a fixed clock: half-open intervals in UTC."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import UTC, datetime, timedelta

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_CLOCK = datetime(2026, 7, 15, tzinfo=UTC)
GRAINS = ("month", "week")


class UnknownWindow(ValueError):
    """A phrase that no rule resolves; none is guessed."""


def require_utc(clock: datetime) -> datetime:
    if clock.tzinfo is None or clock.utcoffset() != timedelta(0):
        raise ValueError("the clock must be an aware time in UTC")
    return clock


def _month(t: datetime, by: int = 0) -> datetime:
    n = t.year * 12 + t.month - 1 + by
    return datetime(n // 12, n % 12 + 1, 1, tzinfo=UTC)


def _quarter(t: datetime, by: int = 0) -> datetime:
    return _month(datetime(t.year, (t.month - 1) // 3 * 3 + 1, 1, tzinfo=UTC), 3 * by)


def _week(t: datetime, by: int = 0) -> datetime:
    day = datetime(t.year, t.month, t.day, tzinfo=UTC)
    return day - timedelta(days=day.weekday()) + timedelta(weeks=by)


@dataclass(frozen=True)
class Window:
    start: datetime
    end: datetime
    grain: str | None = None

    def __post_init__(self):
        if self.start >= self.end:
            raise ValueError("a window ends after it starts")

    def contains(self, t: Column) -> Column:
        return (t >= _literal(self.start)) & (t < _literal(self.end))

    def periods(self, grain: str) -> list[tuple[datetime, datetime]]:
        """The window's months or weeks, which must tile it exactly."""
        step = {"month": lambda t: _month(t, 1), "week": lambda t: t + timedelta(weeks=1)}[grain]
        on = {"month": _month(self.start), "week": _week(self.start)}[grain]
        out, at = [], self.start
        while at < self.end and on == self.start:
            out.append((at, step(at)))
            at = step(at)
        if not out or at != self.end:
            raise ValueError(f"the window isn't whole {grain}s")
        return out


@dataclass(frozen=True)
class Trend:
    """A series by grain up to an exclusive end, without a start; the month that holds the clock isn't complete and is left
    out."""

    grain: str
    end: datetime

    def contains(self, t: Column) -> Column:
        return t < _literal(self.end)


def _literal(t: datetime) -> Column:
    return F.lit(t.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")


def _year_before(clock: datetime) -> datetime:
    if (clock.month, clock.day) == (2, 29):
        raise ValueError("a 29 February has no day a year before")
    return clock.replace(year=clock.year - 1)


RULES = {
    "last 30 days": lambda c: Window(c - timedelta(days=30), c),
    "last month": lambda c: Window(_month(c, -1), _month(c), "month"),
    "current month": lambda c: Window(_month(c), c),
    "last quarter": lambda c: Window(_quarter(c, -1), _quarter(c), "month"),
    "last 12 weeks": lambda c: Window(_week(c, -12), _week(c), "week"),
    "the last two months": lambda c: Window(_month(c, -2), _month(c), "month"),
    "the last year": lambda c: Window(_year_before(c), c),
    "the last 12 complete months": lambda c: Window(_month(c, -12), _month(c), "month"),
    "per month (trend)": lambda c: Trend("month", _month(c)),
}


def resolve(phrase: str, clock: datetime = DEFAULT_CLOCK) -> Window | Trend:
    said = " ".join(phrase.casefold().split())
    if said not in RULES:
        raise UnknownWindow(phrase)
    return RULES[said](require_utc(clock))


def within(df: DataFrame, column: str, window: Window | Trend) -> DataFrame:
    """Rows of the window: plain bounds on the column, which reach the scan."""
    return df.where(window.contains(F.col(column)))


def by_period(df: DataFrame, column: str, window: Window | Trend, grain: str | None = None) -> DataFrame:
    """(period, rows) of each month or week in the window that has rows."""
    grain = grain or window.grain or "month"
    return within(df, column, window).groupBy(F.date_trunc(grain, column).cast("timestamp_ntz").alias("period")).agg(F.count("*").alias("rows"))


def period_table(spark, window: Window, grain: str) -> DataFrame:
    """(period_start, period_end) of a window's periods."""
    plain = [(a.replace(tzinfo=None).isoformat(sep=" "), b.replace(tzinfo=None).isoformat(sep=" ")) for a, b in window.periods(grain)]
    return spark.createDataFrame(plain, "a string, b string").select(F.col("a").cast("timestamp_ntz").alias("period_start"), F.col("b").cast("timestamp_ntz").alias("period_end"))
