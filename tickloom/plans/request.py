"""One request for bars, whatever they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.clock import EXTENDED, RTH, Clock, Session, warn_uneven
from ..functions.interval import Interval, interval as parse
from ..functions.schema import kind_of
from ..operators.adjust import adjust
from ..operators.indicators import calc
from ..operators.resample import forward_fill, resample
from ..sources.tables import in_session, window
from .store import BarStore, StaleError, stale


def bars(
    source: DataFrame, every: str | Interval | None = None, *, rth: bool = False, session: Session | None = None, fill: bool = False, start: int | None = None, end: int | None = None,
    actions: DataFrame | None = None, adjustment: str = "split-only", store: BarStore | None = None,
) -> DataFrame:
    """Bars from ticks, finer bars or, if a store is given, its table: scan, filter, resample, fill, adjust.

    Without an interval bars pass through and ticks are refused. The session filters ticks only. A stored table stands
    in for ticks unless bars are filled, and raises StaleError if it is behind them.
    """
    kind = kind_of(source)
    clock = Clock.of(session or (RTH if rth else EXTENDED))
    if every is None:
        if kind == "tick":
            raise ValueError("ticks need an interval")
        out = window(source, start, end)
    else:
        every = parse(every)
        warn_uneven(every, clock.session)
        held = store.read(source.sparkSession, store.key(every, clock, rth)) if store and kind == "tick" and not fill else None
        if held is not None:
            if stale(held, in_session(source, clock.session if rth else None, kind), every, clock).where("stale").head(1):
                raise StaleError("the stored bars are behind their ticks; sync them")
            out = window(held, start, end)
        else:
            rows = in_session(window(source, start, end), clock.session if rth else None, kind)
            out = resample(rows, every, clock)
            out = forward_fill(out, every, clock) if fill else out
    return adjust(out, actions, adjustment) if actions is not None else out


def indicators(source: DataFrame, every: str | None, *specs: str, **how) -> DataFrame:
    """Bars with indicator columns."""
    if not specs:
        raise ValueError("an indicator is needed")
    return calc(bars(source, every, **how), *specs)
