"""A chart of one symbol's bars with indicators."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.chart import Canvas, Layout, render
from ..operators.indicators import calc, spec

#: Bars of one chart, at most; more are refused, as the rows are drawn on the driver.
MOST_BARS = 50_000


def chart(bars: DataFrame, *specs: str, every: str = "", volume: bool = False, tz: str = "UTC", width: int = 1200, height: int = 700) -> Canvas:
    """Candles of the bars by time; without specs, with a moving average of 20 bars.

    Bars of several sources of the symbol are merged by time. Bars of more than one symbol, none, or more than MOST_BARS
    raise ValueError.
    """
    told = [spec(s) for s in specs or ("sma:20",)]
    rows = calc(bars, *told).orderBy("time").limit(MOST_BARS + 1).collect()
    symbols = {r.symbol for r in rows}
    if len(rows) > MOST_BARS:
        raise ValueError(f"more than {MOST_BARS:,} bars; take a wider interval or a shorter range")
    if len(symbols) != 1:
        raise ValueError(f"a chart shows one symbol, not {len(symbols)}")
    layout = Layout(volume=volume)
    for s in told:
        layout.add(s.kind, s.name, [r[s.name] for r in rows])
    return render(rows, layout, layout.title(symbols.pop(), every), tz, width, height)
