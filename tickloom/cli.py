"""Commands over canonical Parquet tables: ``python -m tickloom.cli bars 5m rth 2024-01-02..2024-01-31 csv ticks.parquet``.

Words after the verb may come in any order. Each is, in this order of trial, ``rth``, ``fill``, a range, an interval, an
indicator, a format, else a path; of the first four and the format there is one at most.
"""

from __future__ import annotations

import argparse
import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.chart import encoded, sixel
from .functions.clock import Clock, session_for
from .functions.interval import interval, looks_like_interval
from .functions.render import FORMATS, rendered
from .functions.report import by_symbol
from .functions.schema import kind_from_token, kind_of, stored_bars, stored_calc
from .operators import inspect, stats
from .operators.indicators import calc, spec
from .plans.plot import chart
from .plans.request import bars
from .plans.store import BarStore
from .sources import tables
from .sources.discover import Settings, settings, table_files

KINDS = ("tick", "ticks", "bar", "bars")
STORED_FORMS = ("csv", "jsonl", "raw", "hex")
VERBS = ("ls", "inspect", "verify", "stat", "bars", "calc", "plot", "sync", "unsync")


@dataclass
class Words:
    """What the words after a verb say."""

    rth: bool = False
    fill: bool = False
    span: tuple[int | None, int | None] | None = None
    every: str | None = None
    specs: list[str] = field(default_factory=list)
    form: str | None = None
    paths: list[str] = field(default_factory=list)


def classify(words: Sequence[str], tz: str) -> Words:
    out = Words()

    def once(name: str, value) -> None:
        if getattr(out, name):
            raise ValueError(f"said twice: {value}")
        setattr(out, name, value)

    for w in words:
        low = w.lower()
        if low in ("rth", "fill"):
            once(low, True)
        elif (span := tables.parse_range(w, tz)) is not None:
            once("span", span)
        elif looks_like_interval(w):
            once("every", interval(w).label)
        elif is_spec(w):
            out.specs.append(low)
        elif low in FORMATS:
            once("form", low)
        else:
            out.paths.append(w)
    return out


def is_spec(word: str) -> bool:
    try:
        spec(word)
    except ValueError:
        return False
    return True


def source(spark: SparkSession, paths: Sequence[str], symbols: str | None = None) -> DataFrame:
    """The series of all paths; of the named symbols, if there are any."""
    tables.check_session(spark)
    out = tables.union_sources([spark.read.parquet(p) for p in paths])
    return tables.of_symbols(out, symbols.split(",")) if symbols else out


def listed(spark: SparkSession, paths: Sequence[str], kind: str | None = None, symbols: str | None = None) -> DataFrame:
    """The catalogue of the tables, of ticks and bars side by side, with where each series is and its files' bytes."""
    out = None
    for own in ("tick", "bar"):
        mine = [p for p in paths if kind_of(spark.read.parquet(p)) == own] if kind in (None, own) else []
        if mine:
            rows = inspect.catalogue(source(spark, mine, symbols), own).join(table_files(spark, mine), "symbol")
            out = rows if out is None else out.unionByName(rows)
    if out is None:
        raise ValueError(f"no {kind} tables")
    return out.orderBy("symbol", "kind")


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tickloom")
    p.add_argument("verb", choices=VERBS)
    p.add_argument("words", nargs="*")
    p.add_argument("--symbols", help="of the tables, these symbols, parted by commas")
    p.add_argument("--start")
    p.add_argument("--end")
    p.add_argument("--session", help="HH:MM-HH:MM")
    p.add_argument("--tz")
    p.add_argument("--config", help="a TOML file of settings")
    p.add_argument("--actions", help="a TOML file with [actions]")
    p.add_argument("--total-return", action="store_true")
    p.add_argument("--summary", action="store_true")
    p.add_argument("--periods-per-year", type=float)
    p.add_argument("--output", help="write Parquet instead of text; of plot, a .six, .sixel or PNG file")
    p.add_argument("--volume", action="store_true", help="of plot, a panel of volumes")
    p.add_argument("--store", help="the folder of stored bars")
    p.add_argument("--force", action="store_true")
    return p


def run(spark: SparkSession, argv: Sequence[str]) -> Iterator[str]:
    """The lines that a command prints."""
    a = parser().parse_intermixed_args(argv)
    told = settings(Path(a.config).read_text()) if a.config else Settings()
    a.tz, a.session, a.store, a.periods_per_year = a.tz or told.tz, a.session or told.session, a.store or told.store, a.periods_per_year or told.periods_per_year
    w = classify(a.words, a.tz)
    start, end = w.span or (None, None)
    # a flag goes before its side of the range
    start = tables.parse_bound(a.start, a.tz) if a.start else start
    end = tables.parse_bound(a.end, a.tz, end=True) if a.end else end
    session, form = session_for(w.rth, tz=a.tz, flag=a.session), w.form or "table"
    if form == "hex" and a.verb not in ("bars", "calc") or form == "hex" and a.summary:
        raise ValueError("only rows of bars and calc have a hex form")
    if a.verb in ("sync", "unsync"):
        if a.actions:
            raise ValueError("stored bars are raw; actions are applied when they are read")
        if not a.store:
            raise ValueError("--store is needed")
        store, every, clock = BarStore(a.store), w.every or "1m", Clock.of(session)
        if a.verb == "unsync":
            key = store.unsync(spark, every, clock, w.rth, really=a.force)
            yield f"removed {key}" if a.force else f"would remove {key}; --force does"
        else:
            held = store.sync(source(spark, told.paths(w.paths), a.symbols), every, clock, w.rth, a.force)
            yield from rendered(held.groupBy("symbol").agg(F.count(F.lit(1)).alias("bars"), F.max("time").alias("last")).orderBy("symbol"), form, a.tz)
        return
    if a.verb == "ls" and (kinds := [x for x in w.paths if x.lower() in KINDS]):
        w.paths = [x for x in w.paths if x not in kinds]
        if len(kinds) > 1:
            raise ValueError(f"said twice: {kinds[1]}")
    else:
        kinds = []
    paths = told.paths(w.paths)
    if a.verb == "ls":
        yield from rendered(listed(spark, paths, kind_from_token(kinds[0]) if kinds else None, a.symbols), form, a.tz)
        return
    rows = source(spark, paths, a.symbols)
    kind = kind_of(rows)
    actions = tables.load_actions(spark, Path(a.actions).read_text()) if a.actions else None
    order = [c for c in ("symbol", "time", "seq") if c in rows.columns]
    if a.verb == "inspect":
        yield by_symbol("inspect", inspect.catalogue(rows, kind))
        yield from rendered(inspect.preview(rows).orderBy(*order), form, a.tz)
    elif a.verb == "verify":
        yield by_symbol("verify", inspect.verify(rows), stats.stat(rows))
    elif a.verb == "stat":
        if form == "raw":
            raise ValueError("stat has no raw form")
        rows = tables.in_session(tables.window(rows, start, end), session if w.rth else None, kind)
        if actions is not None:
            from .operators.adjust import adjust

            if kind == "bar" and (wide := inspect.least_gaps(rows).where(F.col("gap") > inspect.DAY).orderBy("symbol").head(1)):
                raise ValueError(f"bars of {wide[0].symbol} are wider than a day: an action may fall inside one, so they cannot be adjusted")

            rows = adjust(rows, actions, "total" if a.total_return else "split-only")
        yield from rendered(stats.stat(rows).orderBy("symbol"), form, a.tz)
    else:
        if a.verb == "calc" and not w.specs:
            raise ValueError("an indicator is needed")
        if a.verb == "bars" and w.specs:
            raise ValueError("bars has no indicators; calc has")
        out = bars(
            rows, w.every or "1d", rth=w.rth, session=session, fill=w.fill, start=start, end=end, actions=actions,
            adjustment="total" if a.total_return else "split-only", store=BarStore(a.store) if a.store else None,
        )
        if a.verb == "plot":
            every = w.every or "1d"
            canvas = chart(out, *w.specs, every=every, volume=a.volume, tz=a.tz)
            if a.output:
                Path(a.output).write_bytes(encoded(canvas, a.output))
                yield f"wrote {a.output}"
            else:
                yield sixel(canvas)
            return
        if a.verb == "calc":
            added = calc(out, *w.specs)
            if a.summary:
                returns = stats.return_summary(out, periods_per_year=a.periods_per_year)
                volatile = next((spec(s).name for s in w.specs if spec(s).kind == "vol"), None)
                regime = [stats.volatility_regime(added, volatile)] if volatile else []
                yield by_symbol("summary", stats.price_summary(out), returns, stats.labels(returns), *regime)
                yield from rendered(stats.column_summary(added, *(spec(s).name for s in w.specs)).orderBy("symbol", "name"), form, a.tz)
                return
            decimals = {spec(s).name: spec(s).decimals for s in w.specs}
            out = added.select("symbol", "time", "close", *decimals)
            if a.output or form in STORED_FORMS:
                out = stored_calc(out, decimals)
        if a.output:
            out.write.parquet(a.output)
            yield f"wrote {a.output}"
            return
        if a.verb == "bars" and form in STORED_FORMS:
            out = stored_bars(out)
        yield from rendered(out.orderBy("symbol", "time"), form, a.tz)


def main() -> int:
    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    try:
        for line in run(spark, sys.argv[1:]):
            print(line)
    except (ValueError, RuntimeError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
