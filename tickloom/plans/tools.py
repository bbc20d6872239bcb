"""What a tool server would call: bounded answers as plain objects that JSON can hold."""

from __future__ import annotations

import base64
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row

from ..functions.chart import png
from ..functions.render import iso
from ..functions.schema import kind_of
from ..operators import inspect, stats
from ..operators.indicators import spec
from .plot import chart
from .request import bars, indicators

#: Rows of an answer: without a wish, and at most.
ROWS, MOST_ROWS = 1_000, 10_000
TIMES = ("time", "first", "last")


def plain(row: Row, tz: str = "UTC") -> dict:
    """The row with times as ISO 8601 in tz, and null for what is not finite."""
    value = lambda n, x: None if isinstance(x, float) and not math.isfinite(x) else iso(x, tz) if n in TIMES and isinstance(x, int) else x
    return {n: value(n, x) for n, x in row.asDict().items()}


def limit(wish: int | None) -> int:
    return min(max(ROWS if wish is None else wish, 1), MOST_ROWS)


def listing(df: DataFrame, tz: str = "UTC", most: int | None = None, order: Sequence[str] = ("symbol",)) -> dict:
    """{items, truncated}: the first rows by `order`, and whether there are more."""
    n = limit(most)
    rows = df.orderBy(*order).limit(n + 1).collect()
    return {"items": [plain(r, tz) for r in rows[:n]], "truncated": len(rows) > n}


def list_series(source: DataFrame, tz: str = "UTC", most: int | None = None) -> dict:
    return listing(inspect.catalogue(source, kind_of(source)), tz, most)


def get_stat(source: DataFrame, tz: str = "UTC", most: int | None = None) -> dict:
    return listing(stats.stat(source), tz, most)


def get_bars(source: DataFrame, every: str, tz: str = "UTC", most: int | None = None, **how) -> dict:
    return listing(bars(source, every, **how), tz, most, ("symbol", "time"))


def get_indicators(source: DataFrame, every: str, specs: Sequence[str], tz: str = "UTC", most: int | None = None, **how) -> dict:
    out = indicators(source, every, *specs, **how).select("symbol", "time", "close", *(spec(s).name for s in specs))
    return listing(out, tz, most, ("symbol", "time"))


def get_plot(source: DataFrame, every: str, specs: Sequence[str] = (), volume: bool = False, tz: str = "UTC", **how) -> dict:
    """A PNG in base 64."""
    canvas = chart(bars(source, every, **how), *specs, every=every, volume=volume, tz=tz)
    return {"mime": "image/png", "data": base64.b64encode(png(canvas)).decode()}
