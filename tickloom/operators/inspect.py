"""Catalogue rows, granularity, hours, previews and checks of stored series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import RTH, Session, local

DAY = 86_400


def least_gaps(df: DataFrame) -> DataFrame:
    """(symbol, gap, granularity): the least positive gap between rows and the interval it tells of."""
    last = F.lag("time").over(Window.partitionBy("symbol").orderBy("time"))
    g = df.select("symbol", (F.col("time") - last).alias("gap")).groupBy("symbol").agg(F.min(F.when(F.col("gap") > 0, F.col("gap"))).alias("gap"))
    gap, text = F.col("gap"), lambda x, u: F.concat(F.floor(x).cast("string"), F.lit(u))
    label = (
        F.when(gap.isNull(), None)
        .when((gap < DAY) & (gap % 3600 == 0), text(gap / 3600, "h"))
        .when((gap < DAY) & (gap % 60 == 0), text(gap / 60, "m"))
        .when(gap < DAY, text(gap, "s"))
        .when(gap.between(82_800, 90_000), "1d")
        .when(gap.between(7 * DAY - 7200, 7 * DAY + 7200), "1w")
        .when(gap.between(28 * DAY, 31 * DAY), "1mo")
        .when(gap.between(365 * DAY, 366 * DAY), "1y")
        .otherwise(text((gap + DAY // 2) / DAY, "d"))
    )
    return g.select("symbol", "gap", label.alias("granularity"))


def hours(df: DataFrame, rth: Session = RTH) -> DataFrame:
    """(symbol, hours): ``rth`` if all rows are in it, ``extended`` if not, ``n/a`` if all share one minute of the day."""
    return df.groupBy("symbol").agg(_hours(rth).alias("hours"))


def _hours(rth: Session) -> Column:
    here = local(F.col("time"), rth.tz)
    minute = F.hour(here) * 60 + F.minute(here)
    return F.when(F.min(minute) == F.max(minute), "n/a").when(F.bool_or(~rth.contains(F.col("time"))), "extended").otherwise("rth")


def catalogue(df: DataFrame, kind: str, rth: Session = RTH) -> DataFrame:
    """(symbol, kind, rows, first, last, granularity, hours) of each series."""
    out = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("rows"), F.min("time").alias("first"), F.max("time").alias("last"), _hours(rth).alias("hours"))
    # gaps are looked for in bars only: ticks have no granularity, and their gaps would take a sort of every tick
    out = out.join(least_gaps(df).select("symbol", "granularity"), "symbol") if kind == "bar" else out.withColumn("granularity", F.lit(None).cast("string"))
    return out.select("symbol", F.lit(kind).alias("kind"), "rows", "first", "last", "granularity", "hours")


def preview(df: DataFrame, ends: int = 3) -> DataFrame:
    """The first and last rows of each series, with their place from 1; all where there are no more."""
    order = [c for c in ("time", "seq") if c in df.columns]
    # each end is a ranked limit of its own, so that a task sorts and keeps no more than the ends
    by = Window.partitionBy("symbol")
    head = df.withColumn("place", F.row_number().over(by.orderBy(*order))).where(F.col("place") <= ends)
    tail = df.withColumn("__back", F.row_number().over(by.orderBy(*(F.desc(c) for c in order)))).where(F.col("__back") <= ends)
    tail = tail.join(df.groupBy("symbol").agg(F.count(F.lit(1)).alias("__rows")), "symbol").withColumn("place", (F.col("__rows") - F.col("__back") + 1).cast("int"))
    return head.unionByName(tail.where(F.col("place") > ends).select(*head.columns))


def verify(df: DataFrame) -> DataFrame:
    """(symbol, rows, null_rows, bad_prices, repeated_keys) of each series; clean series have zeros."""
    prices = [c for c in ("price_e4", "open", "high", "low", "close") if c in df.columns]
    key = ["time", *(["seq"] if "seq" in df.columns else [])]
    empty = F.greatest(*(F.col(c).isNull().cast("int") for c in (*key, *prices))) if len(key) + len(prices) > 1 else F.col(key[0]).isNull().cast("int")
    bad = F.greatest(*((F.col(c) < 0).cast("int") for c in prices)) if len(prices) > 1 else (F.col(prices[0]) < 0).cast("int")
    by_key = df.groupBy("symbol", *key).agg(F.count(F.lit(1)).alias("n"), F.sum(empty).alias("e"), F.sum(bad).alias("b"))
    return by_key.groupBy("symbol").agg(F.sum("n").alias("rows"), F.sum("e").alias("null_rows"), F.sum("b").alias("bad_prices"), F.sum(F.col("n") - 1).alias("repeated_keys"))


def recent(df: DataFrame, n: int = 1000) -> DataFrame:
    """The last n rows of each series (1 to 10,000) with the total before the cut."""
    n = min(max(n, 1), 10_000)
    total = df.groupBy("symbol").agg(F.count(F.lit(1)).alias("total"))
    order = [F.desc(c) for c in ("time", "seq") if c in df.columns]
    last = df.withColumn("__r", F.row_number().over(Window.partitionBy("symbol").orderBy(*order))).where(F.col("__r") <= n)
    return last.join(total, "symbol").select(*df.columns, "total")
