"""Indicator columns over bars: ``sma:20``, ``ema:20``, ``dema:20``, ``vsma``, ``vema``, ``vdema``, ``rsi:14``, ``ret:log``, ``vol:20``."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WINDOWED, RECURSIVE = ("sma", "vsma", "ret", "vol"), ("ema", "dema", "vema", "vdema", "rsi")


@dataclass(frozen=True)
class Spec:
    kind: str
    arg: int | str

    @property
    def name(self) -> str:
        return f"{self.kind}_{self.arg}"

    @property
    def decimals(self) -> int:
        return 8 if self.kind in ("ret", "vol") else 0 if self.kind[0] == "v" else 4


def spec(token: str) -> Spec:
    kind, _, arg = token.strip().lower().partition(":")
    if kind == "ret" and arg in ("log", "simple"):
        return Spec(kind, arg)
    if kind in WINDOWED + RECURSIVE and kind != "ret" and re.fullmatch(r"\d+", arg) and int(arg) >= 1:
        return Spec(kind, int(arg))
    raise ValueError(f"no indicator: {token!r}")


# -- streaming kernels: one value in, one value or None out ---------------------------------------------------------


def ema_kernel(n: int) -> Callable[[float], float | None]:
    alpha, seen, state = 2 / (n + 1), 0, 0.0

    def push(x: float) -> float | None:
        nonlocal seen, state
        seen += 1
        if seen <= n:
            state += x
            if seen < n:
                return None
            state /= n
            return state
        state = alpha * x + (1 - alpha) * state
        return state

    return push


def dema_kernel(n: int) -> Callable[[float], float | None]:
    outer, inner = ema_kernel(n), ema_kernel(n)

    def push(x: float) -> float | None:
        e = outer(x)
        ee = inner(e) if e is not None else None
        return 2 * e - ee if ee is not None else None

    return push


def rsi_kernel(n: int) -> Callable[[float], float | None]:
    last, seen, gain, loss = None, 0, 0.0, 0.0

    def push(x: float) -> float | None:
        nonlocal last, seen, gain, loss
        if last is None:
            last = x
            return None
        up, down = max(x - last, 0.0), max(last - x, 0.0)
        last, seen = x, seen + 1
        if seen <= n:
            gain, loss = gain + up, loss + down
            if seen < n:
                return None
            gain, loss = gain / n, loss / n
        else:
            gain, loss = (gain * (n - 1) + up) / n, (loss * (n - 1) + down) / n
        return 100.0 if loss == 0 else 100 - 100 / (1 + gain / loss)

    return push


def kernel(s: Spec) -> Callable[[float], float | None]:
    return {"ema": ema_kernel, "vema": ema_kernel, "dema": dema_kernel, "vdema": dema_kernel, "rsi": rsi_kernel}[s.kind](s.arg)


def _recursive(batches: Iterator[pa.RecordBatch], specs: list[Spec]) -> Iterator[pa.RecordBatch]:
    """Runs the kernels over the bars of each symbol as they stream by in time order: memory is one state for each."""
    symbol, push, begun = None, [], False
    for batch in batches:
        get = lambda c: batch.column(batch.schema.get_field_index(c)).to_pylist()
        out: list[list] = [[] for _ in specs]
        for s, close, volume in zip(get("symbol"), get("close"), get("volume")):
            if not begun or s != symbol:
                symbol, push, begun = s, [kernel(x) for x in specs], True
            for column, x, f in zip(out, specs, push):
                column.append(f(float(volume) if x.kind[0] == "v" else close))
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, pa.float64()) for c in out)], names=[*batch.schema.names, *(x.name for x in specs)])


def _windowed(s: Spec) -> Column:
    w = Window.partitionBy("symbol").orderBy("time")
    if s.kind in ("sma", "vsma"):
        x = F.col("volume" if s.kind == "vsma" else "close").cast("double")
        return F.when(F.row_number().over(w) >= s.arg, F.avg(x).over(w.rowsBetween(1 - s.arg, 0)))
    last = F.lag("close").over(w)
    ratio = F.try_divide(F.col("close"), last)
    if s.kind == "ret":
        return F.log(ratio) if s.arg == "log" else F.try_divide(F.col("close") - last, last)
    if s.arg < 2:
        return F.lit(None).cast("double")
    trailing = w.rowsBetween(1 - s.arg, 0)
    return F.when(F.count("__ret").over(trailing) == s.arg, F.stddev_samp("__ret").over(trailing))


def calc(bars: DataFrame, *specs: str | Spec, **custom: Column) -> DataFrame:
    """bars with a column for each spec and each custom column.

    Windowed and recursive indicators share one shuffle by symbol and one sort. A custom column is any column expression
    over the bars, such as a window function.
    """
    told = [spec(s) if isinstance(s, str) else s for s in specs]
    if len({s.name for s in told}) < len(told) or set(custom) & {s.name for s in told}:
        raise ValueError("an indicator is named twice")
    out = bars
    if any(s.kind == "vol" for s in told):
        w = Window.partitionBy("symbol").orderBy("time")
        out = out.withColumn("__ret", F.log(F.try_divide(F.col("close"), F.lag("close").over(w))))
    for s in told:
        if s.kind in WINDOWED:
            out = out.withColumn(s.name, _windowed(s))
    for name, c in custom.items():
        out = out.withColumn(name, c)
    out = out.drop("__ret")
    again = [s for s in told if s.kind in RECURSIVE]
    if again:
        schema = T.StructType([*out.schema.fields, *(T.StructField(s.name, T.DoubleType()) for s in again)])
        out = out.repartition("symbol").sortWithinPartitions("symbol", "time").mapInArrow(lambda it: _recursive(it, again), schema)
    return out.select(*bars.columns, *(s.name for s in told), *custom)


def grouped(bars: DataFrame, schema: str, f) -> DataFrame:
    """A user function of a symbol's whole bars (pandas, in time order) to rows of the schema."""
    return bars.groupBy("symbol").applyInPandas(lambda pdf: f(pdf.sort_values("time")), schema)
