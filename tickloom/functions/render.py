"""Rows as table, csv, md, jsonl, raw or hex text. For results of a bounded size: rows stream through the driver."""

from __future__ import annotations

import datetime as dt
import json
import math
import struct
from collections.abc import Iterator
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame

FORMATS = ("table", "csv", "md", "jsonl", "raw", "hex")
#: The little-endian widths of stored columns; any other is a signed 32-bit one, whose least value is null.
WIDTHS = {**dict.fromkeys(("time", "price_e4", "open", "high", "low", "close", "vwap"), "I"), "volume": "q", "trades": "Q", "size": "i", "seq": "q"}


def comma(n: int) -> str:
    return f"{n:,}"


def price(x: float | None) -> str:
    return f"{x:,.4f}" if x is not None and math.isfinite(x) else "-"


def iso(epoch: int, tz: str = "UTC") -> str:
    text = dt.datetime.fromtimestamp(epoch, ZoneInfo(tz)).isoformat()
    return text.replace("+00:00", "Z")


def csv_cell(x: str) -> str:
    return '"' + x.replace('"', '""') + '"' if any(c in x for c in ',"\n\r') else x


def md_cell(x: str) -> str:
    return x.replace("|", "\\|")


def human(name: str, x, tz: str) -> str:
    if x is None or isinstance(x, float) and not math.isfinite(x):
        return "-"
    if name in ("time", "first", "last") and isinstance(x, int):
        return iso(x, tz)
    return price(x) if isinstance(x, float) else comma(x) if isinstance(x, int) and not isinstance(x, bool) else str(x)


def stored(x) -> str:
    return "" if x is None or isinstance(x, float) and not math.isfinite(x) else str(x)


def frame(names: list[str], row) -> str:
    """A stored row's bytes as hex digits, after its symbol."""
    packed = (struct.pack("<" + WIDTHS.get(n, "i"), -(1 << 31) if x is None else x) for n, x in zip(names, row) if n != "symbol")
    return f"{row['symbol']}\t{b''.join(packed).hex()}"


def rendered(df: DataFrame, how: str = "table", tz: str = "UTC") -> Iterator[str]:
    """Lines: readable values for table and md, stored ones for csv, jsonl, raw and hex."""
    if how not in FORMATS:
        raise ValueError(f"no format: {how!r}")
    names, rows = df.columns, df.toLocalIterator()
    if how == "csv":
        yield ",".join(names)
        for r in rows:
            yield ",".join(csv_cell(stored(x)) for x in r)
    elif how == "raw":
        for r in rows:
            yield "\t".join(stored(x) for x in r)
    elif how == "hex":
        for r in rows:
            yield frame(names, r)
    elif how == "jsonl":
        for r in rows:
            yield json.dumps({n: None if isinstance(x, float) and not math.isfinite(x) else x for n, x in zip(names, r)}, default=str)
    elif how == "md":
        yield "| " + " | ".join(names) + " |"
        yield "|" + " --- |" * len(names)
        for r in rows:
            yield "| " + " | ".join(md_cell(human(n, x, tz)) for n, x in zip(names, r)) + " |"
    else:
        cells = [names, *([human(n, x, tz) for n, x in zip(names, r)] for r in rows)]
        wide = [max(len(c[k]) for c in cells) for k in range(len(names))]
        for c in cells:
            yield "  ".join(x.rjust(w) for x, w in zip(c, wide)).rstrip()
