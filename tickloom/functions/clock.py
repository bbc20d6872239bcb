"""Sessions and bucket clocks as column expressions.

All of them take the session time zone UTC (``spark.sql.session.timeZone``), which the readers check.
"""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .interval import Interval

NEW_YORK = "America/New_York"


@dataclass(frozen=True)
class Session:
    """A daily local window, minutes of the day, end exclusive."""

    tz: str = NEW_YORK
    start: int = 570
    end: int = 960

    def __post_init__(self):
        ZoneInfo(self.tz)
        if not 0 <= self.start < self.end <= 1440:
            raise ValueError("a session ends after it starts, within one day")

    @classmethod
    def parse(cls, hours: str, tz: str = NEW_YORK) -> Session:
        m = re.fullmatch(r"\s*(\d{1,2}):(\d{2})\s*-\s*(\d{1,2}):(\d{2})\s*", hours)
        if not m or int(m[2]) > 59 or int(m[4]) > 59:
            raise ValueError(f"no session: {hours!r}; HH:MM-HH:MM is")
        return cls(tz, int(m[1]) * 60 + int(m[2]), int(m[3]) * 60 + int(m[4]))

    @property
    def seconds(self) -> int:
        return (self.end - self.start) * 60

    def contains(self, time: Column) -> Column:
        here = local(time, self.tz)
        minute = F.hour(here) * 60 + F.minute(here)
        return (minute >= self.start) & (minute < self.end)

    def open_of(self, time: Column) -> Column:
        """Epoch of the session's opening on time's local day."""
        at = F.date_trunc("day", local(time, self.tz)) + F.make_dt_interval(F.lit(0), F.lit(self.start // 60), F.lit(self.start % 60))
        return F.unix_seconds(F.to_utc_timestamp(at, self.tz))


RTH, EXTENDED = Session(), Session(start=240, end=1200)


def session_for(use_rth: bool, rth: str | None = None, extended: str | None = None, tz: str = NEW_YORK, flag: str | None = None) -> Session:
    """The flag before the configured hours before the defaults of the mode."""
    hours = flag or (rth if use_rth else extended)
    default = RTH if use_rth else EXTENDED
    return Session.parse(hours, tz) if hours else Session(tz, default.start, default.end)


@dataclass(frozen=True)
class Clock:
    """How buckets are anchored: ``session`` (sub-day from its opening), else ``tz`` for calendar units and UTC below."""

    tz: str = "UTC"
    session: Session | None = None

    @classmethod
    def of(cls, session: Session) -> Clock:
        return cls(session.tz, session)


def local(time: Column, tz: str) -> Column:
    return F.from_utc_timestamp(F.timestamp_seconds(time), tz)


def local_day_key(time: Column, tz: str) -> Column:
    return F.date_format(local(time, tz), "yyyyMMdd").cast("int")


def _floor_date(day: Column, interval: Interval) -> Column:
    n = F.lit(interval.count)
    if interval.unit == "d":
        return F.date_sub(day, F.pmod(F.datediff(day, F.lit("1970-01-01").cast("date")), n))
    if interval.unit == "w":
        return F.date_sub(day, F.pmod(F.datediff(day, F.lit("1970-01-05").cast("date")), n * 7))
    if interval.unit == "mo":
        index = F.year(day) * 12 + F.month(day) - 1
        index = index - F.pmod(index, n)
        return F.make_date(F.floor(index / 12).cast("int"), (F.pmod(index, F.lit(12)) + 1).cast("int"), F.lit(1))
    return F.make_date((F.year(day) - F.pmod(F.year(day), n)).cast("int"), F.lit(1), F.lit(1))


def _midnight(day: Column, tz: str) -> Column:
    return F.unix_seconds(F.to_utc_timestamp(day.cast("timestamp"), tz))


def bucket_start(time: Column, interval: Interval, clock: Clock) -> Column:
    """Epoch of the start of time's bucket. Exact for widths that divide an hour or a day; see needs_kernel for others."""
    width = interval.seconds
    if width is not None:
        if clock.session is None:
            return time - F.pmod(time, F.lit(width))
        return time - F.pmod(time - clock.session.open_of(time), F.lit(width))
    start = _midnight(_floor_date(F.to_date(local(time, clock.tz)), interval), clock.tz)
    return F.when(start < 0, time - F.pmod(time, F.lit(86_400))).otherwise(start)


def spill_end(time: Column, interval: Interval, clock: Clock) -> Column:
    """The end of the session-anchored bucket that was open when time's local day began."""
    midnight = _midnight(F.to_date(local(time, clock.session.tz)), clock.session.tz)
    return bucket_start(midnight - 1, interval, clock) + interval.seconds


def next_bucket(start: Column, interval: Interval, clock: Clock) -> Column:
    """Epoch of the bucket after the one that begins at start."""
    if interval.seconds is not None:
        return start + interval.seconds
    day, n = F.to_date(local(start, clock.tz)), interval.count
    later = {"d": lambda: F.date_add(day, n), "w": lambda: F.date_add(day, 7 * n), "mo": lambda: F.add_months(day, n), "y": lambda: F.add_months(day, 12 * n)}
    return _midnight(later[interval.unit](), clock.tz)


def needs_kernel(interval: Interval, clock: Clock) -> bool:
    """Whether buckets may move under an open one (session-anchored widths that do not divide an hour)."""
    return clock.session is not None and interval.seconds is not None and 3600 % interval.seconds != 0 and interval.seconds != 3600


def warn_uneven(interval: Interval, session: Session) -> None:
    if interval.seconds and session.seconds % interval.seconds:
        warnings.warn(f"{interval.label} does not divide the session; its last bar is short", stacklevel=2)
