"""Canonical tables and fixed-point numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _struct(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in columns.items()])


_S, _L, _I, _D = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()
TICKS = _struct(symbol=_S, time=_L, seq=_L, price_e4=_L, size=_I)
BARS = _struct(symbol=_S, time=_L, open=_D, high=_D, low=_D, close=_D, volume=_L, vwap=_D, trades=_L)
ACTIONS = _struct(symbol=_S, ex_date=T.DateType(), split=_D, reverse_split=_D, dividend=_D)
#: The largest stored price (unsigned 32 bits) and indicator (signed 32 bits, whose least value is null).
MAX_PRICE, MAX_FIXED = 4_294_967_295, 2_147_483_647


class SchemaError(ValueError):
    pass


def kind_of(df: DataFrame) -> str:
    """``tick`` or ``bar`` by exact columns and types; anything else is refused."""
    have = {(f.name, f.dataType.simpleString()) for f in df.schema}
    for kind, schema in (("tick", TICKS), ("bar", BARS)):
        if have == {(f.name, f.dataType.simpleString()) for f in schema}:
            return kind
    raise SchemaError(f"neither ticks nor bars: {df.schema.simpleString()}")


def kind_from_token(token: str) -> str:
    kinds = {"tick": "tick", "ticks": "tick", "bar": "bar", "bars": "bar"}
    if token.lower() not in kinds:
        raise ValueError(f"no kind: {token!r}")
    return kinds[token.lower()]


def finite(x: Column) -> Column:
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))


def scale_price(x: Column) -> Column:
    """Price in ten-thousandths; 0 if negative or not finite, clamped to 32 bits."""
    return F.when(finite(x) & (x >= 0), F.least(F.round(x * 10_000), F.lit(float(MAX_PRICE)))).otherwise(0).cast("long")


def unscale_price(raw: Column) -> Column:
    return raw / F.lit(10_000.0)


def scale_fixed(x: Column, decimals: int) -> Column:
    """Saturating fixed-point integer; null if not finite."""
    scaled = F.round(x * float(10**decimals))
    return F.when(finite(x), F.greatest(F.least(scaled, F.lit(float(MAX_FIXED))), F.lit(float(-MAX_FIXED)))).cast("int")


def normalize_symbol(x):
    return x.strip().upper() if isinstance(x, str) else F.upper(F.trim(x))


def stored_bars(bars: DataFrame) -> DataFrame:
    """The integer form of bars that exports show; an absent vwap is 0."""
    prices = [scale_price(F.col(c)).alias(c) for c in ("open", "high", "low", "close")]
    return bars.select("symbol", "time", *prices, "volume", scale_price(F.col("vwap")).alias("vwap"), "trades")


def calc_schema(*columns: str) -> T.StructType:
    """The stored form of indicator rows: 32-bit fixed-point columns after the price."""
    return _struct(symbol=_S, time=_L, close=_L, **dict.fromkeys(columns, _I))


def stored_calc(rows: DataFrame, decimals: dict[str, int]) -> DataFrame:
    """The integer form of indicator rows (symbol, time, close, ...): each column in its own decimals, null where absent."""
    return rows.select("symbol", "time", scale_price(F.col("close")).alias("close"), *(scale_fixed(F.col(c), d).alias(c) for c, d in decimals.items()))


def unstored_bars(rows: DataFrame) -> DataFrame:
    """Bars from their integer form; a vwap of 0 is absent if nothing was traded."""
    prices = [unscale_price(F.col(c)).alias(c) for c in ("open", "high", "low", "close")]
    vwap = F.when(F.col("volume") != 0, unscale_price(F.col("vwap")))
    return rows.select("symbol", "time", *prices, "volume", vwap.alias("vwap"), "trades")


def valid_ticks(ticks: DataFrame) -> DataFrame:
    """Provider ticks (symbol, time, seq, price, size) as canonical ticks; a bad price or time raises when it is read."""
    scaled = F.round(F.col("price") * 10_000)
    bad = ~finite(F.col("price")) | (F.col("price") < 0) | (scaled > MAX_PRICE)
    price = F.when(bad, F.raise_error(F.concat(F.lit("bad price: "), F.col("price").cast("string")))).otherwise(scaled).cast("long")
    time = F.when(F.col("time").between(0, MAX_PRICE), F.col("time")).otherwise(F.raise_error(F.lit("time out of range"))).cast("long")
    return ticks.select(normalize_symbol(F.col("symbol")).alias("symbol"), time.alias("time"), "seq", price.alias("price_e4"), F.col("size").cast("int").alias("size"))
