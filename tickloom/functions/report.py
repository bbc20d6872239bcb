"""Reports as TOML text."""

from __future__ import annotations

import datetime as dt
import json
import math
import re


def _key(name: str) -> str:
    return name if re.fullmatch(r"[A-Za-z0-9_-]+", name) else json.dumps(name)


def _value(x) -> str:
    if isinstance(x, bool):
        return str(x).lower()
    if isinstance(x, float):
        return repr(x)
    if isinstance(x, int):
        return str(x)
    if isinstance(x, (dt.date, dt.datetime)):
        return x.isoformat()
    if isinstance(x, (list, tuple)):
        return "[" + ", ".join(map(_value, x)) + "]"
    return json.dumps(str(x), ensure_ascii=False).replace("\x7f", "\\u007f")


def _absent(x) -> bool:
    return x is None or isinstance(x, float) and not math.isfinite(x)


def toml(report: dict, path: tuple[str, ...] = ()) -> str:
    """A nested dict as TOML. Absent and non-finite values are left out; a list of dicts is an array of tables."""
    tables = {k: v for k, v in report.items() if isinstance(v, dict) or isinstance(v, list) and v and all(isinstance(x, dict) for x in v)}
    lines = [f"{_key(k)} = {_value(v)}" for k, v in report.items() if k not in tables and not _absent(v)]
    out = "".join(f"{x}\n" for x in lines)
    for k, v in tables.items():
        here = (*path, k)
        name = ".".join(map(_key, here))
        for part in v if isinstance(v, list) else [v]:
            out += ("\n" if out else "") + (f"[[{name}]]\n" if isinstance(v, list) else f"[{name}]\n") + toml(part, here)
    return out


def by_symbol(title: str, *frames) -> str:
    """A report with a table for each symbol from frames that hold one row for each."""
    found: dict[str, dict] = {}
    for f in frames:
        for r in f.orderBy("symbol").toLocalIterator():
            row = r.asDict()
            found.setdefault(row.pop("symbol"), {}).update(row)
    return toml({"report": title, "series": found})
