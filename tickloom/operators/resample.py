"""Ticks and bars to bars, and forward fill."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.clock import Clock, bucket_start, needs_kernel, next_bucket, spill_end
from ..functions.interval import Interval, interval as parse
from ..functions.schema import BARS, finite, kind_of, unscale_price

#: Seconds: of buckets up to this wide, the one open at a midnight began after the one open at the midnight before ended.
APART = 11 * 3600


def _partial(df: DataFrame, kind: str, *keys) -> DataFrame:
    """Rows by symbol and keys as o, h, l, c, volume, mass and trades, with the places of the first and the last of them."""
    if kind == "tick":
        at, size = F.struct("time", "seq"), F.col("size").cast("long")
        o = h = low = c = F.col("price_e4")
        volume, mass, trades = size, (F.col("price_e4") * size).cast("decimal(38,0)"), F.lit(1)
    else:
        at, (o, h, low, c) = F.struct("time"), map(F.col, ("open", "high", "low", "close"))
        volume, trades = F.col("volume"), F.col("trades")
        mass = F.when(finite(F.col("vwap")), F.col("vwap") * F.col("volume")).otherwise(0.0)
    count = F.count(trades) if kind == "tick" else F.sum(trades)
    return df.groupBy("symbol", *keys).agg(
        F.min_by(o, at).alias("o"), F.max(h).alias("h"), F.min(low).alias("l"), F.max_by(c, at).alias("c"),
        F.sum(volume).alias("volume"), F.sum(mass).alias("mass"), count.alias("trades"), F.min(at).alias("first"), F.max(at).alias("last"),
    )


def _merged(parts: DataFrame) -> DataFrame:
    """Partial rows of the same symbol and bucket as one."""
    return parts.groupBy("symbol", "bucket").agg(
        F.min_by("o", "first").alias("o"), F.max("h").alias("h"), F.min("l").alias("l"), F.max_by("c", "last").alias("c"),
        F.sum("volume").alias("volume"), F.sum("mass").alias("mass"), F.sum("trades").alias("trades"),
    )


def _finished(parts: DataFrame, kind: str) -> DataFrame:
    mass = F.col("mass").cast("double") / 10_000 if kind == "tick" else F.col("mass")
    prices = [(unscale_price(F.col(a)) if kind == "tick" else F.col(a)).alias(b) for a, b in zip("ohlc", ("open", "high", "low", "close"))]
    vwap = F.when(F.col("volume") != 0, mass / F.col("volume"))
    return parts.select("symbol", F.col("bucket").alias("time"), *prices, "volume", vwap.alias("vwap"), "trades")


def _open_buckets(batches, width: int):
    """Adds the bucket that each row of a symbol, in time order, falls in: it stays in the open one until that ends."""
    symbol, start, end = None, 0, 0
    for batch in batches:
        out = []
        for s, t, b in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("symbol", "time", "__b"))):
            if s != symbol or t >= end:
                symbol, start, end = s, b, max(b + width, b + 1)
            out.append(start)
        yield batch.set_column(batch.schema.get_field_index("__b"), "__b", pa.array(out, pa.int64()))


def resample(df: DataFrame, every: str | Interval, clock: Clock = Clock(), fill: bool = False) -> DataFrame:
    """Bars of the interval from ticks or bars, one shuffle of partly aggregated rows.

    Only session-anchored widths that do not divide an hour take another way: their buckets may move at a local midnight
    while one is open. Up to APART seconds, rows are first aggregated by their own bucket and by whether the one open at
    midnight may hold them, which no row of such a part differs in; only these parts pass in time order through a state
    of one bucket for each symbol. Wider ones pass so row by row.
    """
    every, kind = parse(every), kind_of(df)
    bucket = bucket_start(F.col("time"), every, clock)
    if not needs_kernel(every, clock):
        parts = _partial(df, kind, bucket.alias("bucket"))
    elif every.seconds <= APART:
        parts = _partial(df, kind, bucket.cast("long").alias("__b"), (F.col("time") < spill_end(F.col("time"), every, clock)).alias("__spilled"))
        named = parts.withColumn("time", F.col("first.time")).repartition("symbol").sortWithinPartitions("symbol", "time")
        parts = _merged(named.mapInArrow(lambda it: _open_buckets(it, every.seconds), named.schema).withColumnRenamed("__b", "bucket"))
    else:
        order = ["symbol", "time", *(["seq"] if kind == "tick" else [])]
        named = df.withColumn("__b", bucket.cast("long")).repartition("symbol").sortWithinPartitions(*order)
        parts = _partial(named.mapInArrow(lambda it: _open_buckets(it, every.seconds), named.schema), kind, F.col("__b").alias("bucket"))
    bars = _finished(parts, kind)
    return forward_fill(bars, every, clock) if fill else bars


def forward_fill(bars: DataFrame, every: str | Interval, clock: Clock) -> DataFrame:
    """Flat bars of the last close between real ones; below a day only up to the session's close."""
    every = parse(every)
    w = Window.partitionBy("symbol").orderBy("time")
    b = bars.withColumn("__next", F.lead("time").over(w))
    first, stop = next_bucket(F.col("time"), every, clock), F.col("__next")
    if every.seconds is not None:
        if clock.session is not None:
            close = clock.session.open_of(F.col("time")) + clock.session.seconds
            stop = F.when(stop.isNotNull(), F.least(stop, close))  # nothing follows the last bar
        times = F.when(stop > first, F.sequence(first, stop - 1, F.lit(every.seconds).cast("long")))
        gaps = b.withColumn("__t", F.explode(times))
    else:  # calendar buckets: whole counts of the unit from the bar's own bucket on
        day = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("time"), clock.tz))
        until = F.to_date(F.from_utc_timestamp(F.timestamp_seconds("__next"), clock.tz))
        unit = {"d": f"INTERVAL {every.count} DAY", "w": f"INTERVAL {7 * every.count} DAY", "mo": f"INTERVAL {every.count} MONTH", "y": f"INTERVAL {every.count} YEAR"}[every.unit]
        days = F.when(until > day, F.sequence(day, until, F.expr(unit)))
        gaps = b.withColumn("__d", F.explode(days)).withColumn("__t", F.unix_seconds(F.to_utc_timestamp(F.col("__d").cast("timestamp"), clock.tz)))
        gaps = gaps.where((F.col("__t") > F.col("time")) & (F.col("__t") < F.col("__next")))
    close = F.col("close")
    flat = gaps.select("symbol", F.col("__t").alias("time"), close.alias("open"), close.alias("high"), close.alias("low"), close.alias("close"), F.lit(0).cast("long").alias("volume"), close.alias("vwap"), F.lit(0).cast("long").alias("trades"))
    return bars.select(*(f.name for f in BARS)).unionByName(flat)
