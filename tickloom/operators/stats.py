"""Series statistics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.schema import finite, kind_of, unscale_price

YEAR = 365.25 * 86_400


def stat(df: DataFrame) -> DataFrame:
    """(symbol, trades, first, last, low, high, vwap, volume), the same from ticks and from their bars."""
    if kind_of(df) == "tick":
        size = F.col("size").cast("long")
        out = df.groupBy("symbol").agg(
            F.count(F.lit(1)).alias("trades"), F.min("time").alias("first"), F.max("time").alias("last"), unscale_price(F.min("price_e4")).alias("low"), unscale_price(F.max("price_e4")).alias("high"),
            (F.sum((F.col("price_e4") * size).cast("decimal(38,0)")).cast("double") / 10_000).alias("mass"), F.sum(size).alias("volume"),
        )
    else:
        mass = F.when(finite(F.col("vwap")), F.col("vwap") * F.col("volume")).otherwise(0.0)
        out = df.groupBy("symbol").agg(
            F.sum("trades").alias("trades"), F.min("time").alias("first"), F.max("time").alias("last"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum(mass).alias("mass"), F.sum("volume").alias("volume")
        )
    vwap = F.when(F.col("volume") != 0, F.col("mass") / F.col("volume"))
    return out.select("symbol", "trades", "first", "last", "low", "high", vwap.alias("vwap"), "volume")


def price_summary(bars: DataFrame) -> DataFrame:
    """(symbol, bars, first, last, high, low, drawdown, years, cagr) of the closes."""
    out = bars.groupBy("symbol").agg(
        F.count(F.lit(1)).alias("bars"), F.min_by("close", "time").alias("first"), F.max_by("close", "time").alias("last"), F.max("close").alias("high"), F.min("close").alias("low"), ((F.max("time") - F.min("time")) / YEAR).alias("years")
    )
    growth = F.try_divide(F.col("last"), F.col("first"))
    return out.withColumns({"drawdown": F.try_divide(F.col("last"), F.col("high")) - 1, "cagr": F.when((F.col("years") > 0) & (growth > 0), F.pow(growth, 1 / F.col("years")) - 1)})


def column_summary(rows: DataFrame, *columns: str) -> DataFrame:
    """(symbol, name, n, mean, min, max, last) of the finite values of each column."""
    long = rows.select("symbol", "time", F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("v")) for c in columns))).alias("x"))
    long = long.select("symbol", "time", "x.name", "x.v").where(finite(F.col("v")))
    return long.groupBy("symbol", "name").agg(F.count("v").alias("n"), F.avg("v").alias("mean"), F.min("v").alias("min"), F.max("v").alias("max"), F.max_by("v", "time").alias("last"))


def returns(bars: DataFrame, method: str = "log") -> DataFrame:
    last = F.lag("close").over(Window.partitionBy("symbol").orderBy("time"))
    r = F.log(F.try_divide(F.col("close"), last)) if method == "log" else F.try_divide(F.col("close") - last, last)
    return bars.select("symbol", "time", r.alias("r")).where(finite(F.col("r")))


def return_summary(bars: DataFrame, method: str = "log", periods_per_year: float | None = None) -> DataFrame:
    """Distribution, annualised figures and labels of the returns, a row for each symbol."""
    r = F.col("r")
    p = F.percentile("r", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = returns(bars, method).groupBy("symbol").agg(
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("stdev"), F.coalesce(F.skewness("r"), F.lit(0.0)).alias("skew"), F.coalesce(F.kurtosis("r"), F.lit(0.0)).alias("kurtosis"),
        F.min("r").alias("min"), F.max("r").alias("max"), p.alias("p"), F.sum(r).alias("total"),
    )
    span = bars.groupBy("symbol").agg(((F.max("time") - F.min("time")) / YEAR).alias("years"))
    out = out.join(span, "symbol")
    ppy = F.lit(float(periods_per_year)) if periods_per_year else F.when(F.col("years") > 0, F.col("n") / F.col("years"))
    out = out.withColumns({"p25": F.col("p")[0], "median": F.col("p")[1], "p75": F.col("p")[2], "jarque_bera": F.col("n") / 6 * (F.pow("skew", F.lit(2)) + F.pow("kurtosis", F.lit(2)) / 4), "ppy": ppy})
    out = out.withColumns({"ann_return": F.col("mean") * F.col("ppy"), "ann_vol": F.col("stdev") * F.sqrt("ppy")})
    return out.withColumn("sharpe", F.when(F.col("stdev") > 0, F.col("ann_return") / F.col("ann_vol"))).drop("p", "total")


def labels(summary: DataFrame) -> DataFrame:
    """The fixed words for trend, volatility, skew, tails and distribution."""
    c = F.col
    words: dict[str, Column] = {
        "trend": F.when(c("ann_return") > 0.02, "up").when(c("ann_return") < -0.02, "down").otherwise("flat"),
        "volatility": F.when(~finite(c("ann_vol")), "n/a").when(c("ann_vol") < 0.15, "low").when(c("ann_vol") <= 0.25, "moderate").otherwise("high"),
        "skewness": F.when(F.abs("skew") < 0.5, "symmetric").when(c("skew") > 0, "right").otherwise("left"),
        "tails": F.when(c("kurtosis") > 1, "fat").when(c("kurtosis") < -1, "thin").otherwise("normal"),
        "distribution": F.when(c("jarque_bera") > 5.99, "non-normal").otherwise("near-normal"),
    }
    return summary.select("symbol", *(w.alias(k) for k, w in words.items()))


def volatility_regime(rows: DataFrame, column: str) -> DataFrame:
    """(symbol, regime): the last value of a volatility column against its mean; null unless the mean is above 0."""
    s = column_summary(rows, column)
    ratio = F.when(F.col("mean") > 0, F.col("last") / F.col("mean"))
    regime = F.when(ratio > 1.25, "elevated").when(ratio < 0.8, "calm").when(ratio.isNotNull(), "normal")
    return s.select("symbol", regime.alias("regime"))


def summarize(bars: DataFrame, method: str = "log", periods_per_year: float = 252.0) -> DataFrame:
    """(symbol, n, mean, stdev, min, max, annualized) of the returns."""
    return returns(bars, method).groupBy("symbol").agg(
        F.count("r").alias("n"), F.avg("r").alias("mean"), F.stddev_samp("r").alias("stdev"), F.min("r").alias("min"), F.max("r").alias("max"), (F.stddev_samp("r") * periods_per_year**0.5).alias("annualized")
    )
