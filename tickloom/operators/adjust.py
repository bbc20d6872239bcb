"""Corporate actions: back-adjustment of bars and ticks, and split detection.

The factors of a symbol are a handful of time intervals, worked out by aggregation over its few actions and joined by
broadcast; the rows themselves are neither sorted nor shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import NEW_YORK
from ..functions.schema import finite, kind_of, normalize_symbol

MODES = {"raw": "raw", "split-only": "split-only", "splits": "split-only", "total-return": "total-return", "total": "total-return"}
#: Actions up to which the factors are broadcast (about 60 bytes each).
BROADCAST_ACTIONS = 100_000


def mode(token: str) -> str:
    if token.lower() not in MODES:
        raise ValueError(f"no adjustment: {token!r}")
    return MODES[token.lower()]


def _few(actions: DataFrame) -> bool:
    return actions.limit(BROADCAST_ACTIONS + 1).count() <= BROADCAST_ACTIONS


def _at(actions: DataFrame, tz: str) -> DataFrame:
    ex = F.unix_seconds(F.to_utc_timestamp(F.col("ex_date").cast("timestamp"), tz))
    ratio = F.coalesce(F.col("split"), 1 / F.col("reverse_split"))
    return actions.select(normalize_symbol(F.col("symbol")).alias("__s"), ex.alias("__ex"), ratio.alias("__ratio"), "dividend")


def factors(actions: DataFrame, how: str = "split-only", tz: str = NEW_YORK, bars: DataFrame | None = None) -> DataFrame:
    """(__s, __lo, __hi, __pf, __vf): the price and volume factors of times in [lo, hi).

    The actions of a symbol multiply from the latest back. total-return needs the bars, whose last raw close before each
    ex-date turns a dividend D into the factor (C - D) / C.
    """
    a = _at(actions, tz)
    if how == "total-return":
        if bars is None:
            raise ValueError("total-return needs the whole series")
        b = bars.select(normalize_symbol(F.col("symbol")).alias("__bs"), F.col("time").alias("__bt"), F.col("close").alias("__bc"))
        ex = a.where("dividend is not null").select("__s", "__ex").distinct()
        last = b.join(F.broadcast(ex) if _few(actions) else ex, (F.col("__bs") == F.col("__s")) & (F.col("__bt") < F.col("__ex")))
        last = last.groupBy("__s", "__ex").agg(F.max_by("__bc", "__bt").alias("__c"))
        a = a.join(last, ["__s", "__ex"], "left")
        dividend = F.when((F.col("__c") > 0) & (F.col("dividend") < F.col("__c")), (F.col("__c") - F.col("dividend")) / F.col("__c"))
    else:
        dividend = F.lit(None).cast("double")
    steps = a.select("__s", "__ex", F.coalesce(1 / F.col("__ratio"), dividend, F.lit(1.0)).alias("p"), F.coalesce("__ratio", F.lit(1.0)).alias("v"))
    product = lambda c: F.aggregate(F.sort_array(F.collect_list(F.struct("k", c)), False), F.lit(1.0), lambda acc, x: acc * x[c])
    # the factor before an ex-date multiplies that action and all later ones
    marks = steps.select("__s", "__ex").distinct()
    later = marks.join(steps.select(F.col("__s").alias("s2"), F.col("__ex").alias("k"), "p", "v"), (F.col("__s") == F.col("s2")) & (F.col("k") >= F.col("__ex")))
    out = later.groupBy("__s", F.col("__ex").alias("__hi")).agg(product("p").alias("__pf"), product("v").alias("__vf"))
    lo = F.lag("__hi").over(Window.partitionBy("__s").orderBy("__hi"))
    return out.select("__s", F.coalesce(lo, F.lit(-(1 << 62))).alias("__lo"), "__hi", "__pf", "__vf")


def adjust(df: DataFrame, actions: DataFrame, how: str = "split-only", tz: str = NEW_YORK) -> DataFrame:
    """Back-adjusted ticks or bars; rows at or after the last ex-date and symbols without actions stay as they are."""
    how, kind = mode(how), kind_of(df)
    if how == "raw":
        return df
    f = factors(actions, how, tz, df if kind == "bar" else None)
    if _few(actions):
        f = F.broadcast(f)
    j = df.join(f, (normalize_symbol(df["symbol"]) == f["__s"]) & (df["time"] >= f["__lo"]) & (df["time"] < f["__hi"]), "left")
    p, v = F.coalesce("__pf", F.lit(1.0)), F.coalesce("__vf", F.lit(1.0))
    scaled: dict[str, Column] = {c: F.col(c) * p for c in ("open", "high", "low", "close", "vwap") if c in df.columns}
    if kind == "tick":
        scaled = {"price_e4": F.round(F.col("price_e4") * p).cast("long"), "size": F.least(F.greatest(F.round(F.col("size") * v), F.lit(-2.0**31)), F.lit(2.0**31 - 1)).cast("int")}
    else:
        scaled["volume"] = F.round(F.col("volume") * v).cast("long")
    return j.select(*(scaled[c].alias(c) if c in scaled else df[c] for c in df.columns))


def detect_splits(bars: DataFrame) -> DataFrame:
    """(symbol, time, ratio) where a bar opens near a whole fraction or multiple of the close before."""
    last = F.lag("close").over(Window.partitionBy("symbol").orderBy("time"))
    gap = F.when((F.col("open") > 0) & (last > 0), last / F.col("open"))
    b = bars.select("symbol", "time", gap.alias("gap")).where(finite(F.col("gap")))
    x = F.when(F.col("gap") > 1.5, F.col("gap")).when(F.col("gap") < 1 / 1.5, 1 / F.col("gap"))
    whole = F.round(x)
    b = b.withColumns({"x": x, "whole": whole}).where((F.col("whole") >= 2) & (F.abs((F.col("x") - F.col("whole")) / F.col("whole")) < 0.05))
    return b.select("symbol", "time", F.when(F.col("gap") > 1.5, F.col("whole")).otherwise(1 / F.col("whole")).alias("ratio"))
