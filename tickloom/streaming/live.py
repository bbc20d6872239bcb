"""Live bars with Structured Streaming."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import Clock
from ..functions.interval import interval as parse
from ..functions.schema import unscale_price
from ..plans.store import BarStore


def tick_stream(spark: SparkSession, path: str, schema, **options: str) -> DataFrame:
    return spark.readStream.options(**options).schema(schema).parquet(path)


def tumbling_bars(ticks: DataFrame, every: str, late: str = "1 minute") -> DataFrame:
    """Bars of a tick stream in UTC-aligned tumbling windows; ticks later than `late` behind the newest are dropped."""
    width = parse(every).seconds
    if width is None:
        raise ValueError("calendar buckets lose the watermark; use refresh_on_batch")
    at, size = F.struct("time", "seq"), F.col("size").cast("long")
    stream = ticks.withColumn("ts", F.timestamp_seconds("time")).withWatermark("ts", late)
    out = stream.groupBy("symbol", F.window("ts", f"{width} seconds")).agg(
        F.min_by("price_e4", at).alias("o"), F.max("price_e4").alias("h"), F.min("price_e4").alias("l"), F.max_by("price_e4", at).alias("c"),
        F.sum(size).alias("volume"), F.sum((F.col("price_e4") * size).cast("decimal(38,0)")).alias("mass"), F.count(F.lit(1)).alias("trades"),
    )
    prices = [unscale_price(F.col(a)).alias(b) for a, b in zip("ohlc", ("open", "high", "low", "close"))]
    vwap = F.when(F.col("volume") != 0, F.col("mass").cast("double") / 10_000 / F.col("volume"))
    return out.select("symbol", F.unix_seconds(F.col("window.start")).alias("time"), *prices, "volume", vwap.alias("vwap"), "trades")


def drained(bars: DataFrame, mode: str = "complete") -> DataFrame:
    """Runs a stream over what is there now and returns its rows."""
    name = f"drained_{uuid.uuid4().hex}"
    query = bars.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return bars.sparkSession.table(name)


def refresh_on_batch(ticks: DataFrame, store: BarStore, history: str, every: str, clock: Clock):
    """A writer that adds each micro-batch to the tick history and refreshes the stored bars from their last bucket on.

    A batch is a folder of the history that is named by its epoch, so one that is replayed after a failure replaces
    itself. The history has to belong to the stream's checkpoint.
    """

    def each(batch: DataFrame, epoch: int) -> None:
        batch.write.mode("overwrite").parquet(f"{history}/epoch={epoch}")
        store.sync(batch.sparkSession.read.schema(batch.schema).parquet(history).select(*batch.columns), every, clock)

    return ticks.writeStream.foreachBatch(each)
