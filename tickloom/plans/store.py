"""Materialised bar tables: keyed by interval, session and fill, refreshed from their last bucket on."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import Clock, next_bucket
from ..functions.interval import Interval, interval as parse
from ..functions.schema import BARS
from ..operators.resample import resample
from ..sources.tables import in_session


#: Symbols up to which the last buckets of a table are broadcast, and the least of them bounds the scan of ticks.
MOST_SYMBOLS = 10_000


class StaleError(RuntimeError):
    pass


@dataclass(frozen=True)
class BarStore:
    """Bar tables below a root folder, one for each key and generation; a refresh writes the next generation whole."""

    root: str

    def key(self, every: str | Interval, clock: Clock, rth: bool, fill: bool = False) -> str:
        s = clock.session
        hours = f"{s.tz}-{s.start}-{s.end}".replace("/", "_") if s else clock.tz.replace("/", "_")
        return f"{self.root}/{parse(every).label}.{'rth' if rth else 'ext'}{'.fill' if fill else ''}.{hours}"

    def _fs(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p

    def generation(self, spark: SparkSession, key: str) -> int:
        """The latest complete generation, 0 if none."""
        fs, p = self._fs(spark, key)
        if not fs.exists(p):
            return 0
        done = [0]
        for s in fs.listStatus(p):
            name = s.getPath().getName()
            if name.startswith("g") and self._fs(spark, f"{key}/{name}/_SUCCESS")[0].exists(self._fs(spark, f"{key}/{name}/_SUCCESS")[1]):
                done.append(int(name[1:]))
        return max(done)

    def read(self, spark: SparkSession, key: str) -> DataFrame | None:
        g = self.generation(spark, key)
        return spark.read.schema(BARS).parquet(f"{key}/g{g}") if g else None

    def sync(self, ticks: DataFrame, every: str | Interval, clock: Clock, rth: bool = False, force: bool = False) -> DataFrame:
        """Brings the table up to date and returns it: stored bars before each symbol's last bucket stay, the rest is computed."""
        spark, key, every = ticks.sparkSession, self.key(every, clock, rth), parse(every)
        source = in_session(ticks, clock.session if rth else None, "tick")
        g = self.generation(spark, key)
        if g and not force:
            old = spark.read.schema(BARS).parquet(f"{key}/g{g}")
            last = old.groupBy("symbol").agg(F.max("time").alias("__last"))
            told = last.limit(MOST_SYMBOLS + 1).collect()
            tail = source
            if 0 < len(told) <= MOST_SYMBOLS:
                last = F.broadcast(spark.createDataFrame(told, last.schema))
                # a literal bound reaches the scan; symbols without stored bars are looked for in their column alone
                new = source.select("symbol").distinct().join(last, "symbol", "left_anti")
                tail = source.where(F.col("time") >= min(r["__last"] for r in told))
                if new.head(1):
                    tail = tail.join(last, "symbol", "left_semi").unionByName(source.join(last, "symbol", "left_anti"))
            tail = tail.join(last, "symbol", "left").where(F.col("__last").isNull() | (F.col("time") >= F.col("__last"))).drop("__last")
            kept = old.join(last, "symbol").where(F.col("time") < F.col("__last")).drop("__last")
            bars = kept.unionByName(resample(tail, every, clock))
        else:
            bars = resample(source, every, clock)
        bars.select(*(f.name for f in BARS)).repartitionByRange("symbol", "time").sortWithinPartitions("symbol", "time").write.mode("overwrite").parquet(f"{key}/g{g + 1}")
        if g:
            fs, p = self._fs(spark, f"{key}/g{g - 1}")
            fs.delete(p, True)
        return self.read(spark, key)

    def unsync(self, spark: SparkSession, every: str | Interval, clock: Clock, rth: bool = False, really: bool = False) -> str:
        """Removes a table; without really, only tells which."""
        key = self.key(every, clock, rth)
        if really:
            fs, p = self._fs(spark, key)
            fs.delete(p, True)
        return key


def stale(bars: DataFrame, ticks: DataFrame, every: str | Interval, clock: Clock) -> DataFrame:
    """(symbol, last_bar, last_tick, stale): stale if a tick is at or after the bucket that follows the last bar."""
    every = parse(every)
    b = bars.groupBy("symbol").agg(F.max("time").alias("last_bar"))
    t = ticks.groupBy("symbol").agg(F.max("time").alias("last_tick"))
    return t.join(b, "symbol", "left").select("symbol", "last_bar", "last_tick", (F.col("last_bar").isNull() | (F.col("last_tick") >= next_bucket(F.col("last_bar"), every, clock))).alias("stale"))
