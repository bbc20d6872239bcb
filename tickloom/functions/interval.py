"""Bar intervals such as ``5m``, ``1d`` or ``3mo``."""

from __future__ import annotations

import re
from dataclasses import dataclass

SECONDS = {"s": 1, "m": 60, "h": 3600}
#: Fixed value: the largest count of an interval.
MAX_COUNT = 100_000


@dataclass(frozen=True)
class Interval:
    count: int
    unit: str  # s m h d w mo y

    def __post_init__(self):
        if self.unit not in ("s", "m", "h", "d", "w", "mo", "y") or not 1 <= self.count <= MAX_COUNT:
            raise ValueError(f"no interval: {self.count}{self.unit}")

    @property
    def seconds(self) -> int | None:
        """Width below a day's units; None for calendar units."""
        return self.count * SECONDS[self.unit] if self.unit in SECONDS else None

    @property
    def label(self) -> str:
        return f"{self.count}{self.unit}"


def looks_like_interval(token: str) -> bool:
    return re.fullmatch(r"\d+(s|mo|m|h|d|w|y)", token.lower()) is not None


def interval(token: str | Interval) -> Interval:
    if isinstance(token, Interval):
        return token
    m = re.fullmatch(r"(\d+)(s|mo|m|h|d|w|y)", token.strip().lower())
    if not m:
        raise ValueError(f"no interval: {token!r}")
    return Interval(int(m[1]), m[2])


def granularity_label(gap: int) -> str:
    """The interval that a least gap between bars tells of; days and more with room for clock changes."""
    day = 86_400
    if gap < day:
        return next(f"{gap // n}{u}" for n, u in ((3600, "h"), (60, "m"), (1, "s")) if gap % n == 0)
    near = (("1d", 82_800, 90_000), ("1w", 7 * day - 7200, 7 * day + 7200), ("1mo", 28 * day, 31 * day), ("1y", 365 * day, 366 * day))
    return next((name for name, lo, hi in near if lo <= gap <= hi), f"{(gap + day // 2) // day}d")
