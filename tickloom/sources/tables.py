"""Reading ticks, bars and actions."""

from __future__ import annotations

import datetime as dt
import re
import tomllib
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import NEW_YORK, Session
from ..functions.schema import ACTIONS, BARS, TICKS, kind_of, normalize_symbol, scale_price


def check_session(spark: SparkSession) -> None:
    if spark.conf.get("spark.sql.session.timeZone") not in ("UTC", "Etc/UTC"):
        raise ValueError("spark.sql.session.timeZone has to be UTC")


def read_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """Canonical Parquet ticks or bars."""
    check_session(spark)
    df = spark.read.parquet(path)
    if kind_of(df.select(*(f.name for f in (TICKS if kind == "tick" else BARS)))) != kind:
        raise ValueError(f"{path} does not hold {kind}s")
    return df


def events_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table as ticks: a symbol for each event type."""
    check_session(spark)
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    return e.select(
        F.col("event_type").alias("symbol"),
        F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"),
        F.col("event_id").alias("seq"),
        scale_price(F.col("value")).alias("price_e4"),
        F.regexp_extract("props", r'"k": *(-?\d+)', 1).cast("int").alias("size"),
    )


def lineitem_ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lineitem table as ticks: a symbol for each return flag and line status."""
    check_session(spark)
    x = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    return x.select(
        F.concat("l_returnflag", "l_linestatus").alias("symbol"),
        F.unix_seconds(F.col("l_shipdate").cast("timestamp")).alias("time"),
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("seq"),
        scale_price(F.col("l_extendedprice") / F.col("l_quantity")).alias("price_e4"),
        F.col("l_quantity").cast("int").alias("size"),
    )


def window(df: DataFrame, start: int | None = None, end: int | None = None) -> DataFrame:
    """Rows of the time range, both ends included; start after end gives none."""
    if start is not None:
        df = df.where(F.col("time") >= start)
    if end is not None:
        df = df.where(F.col("time") <= end)
    return df


def in_session(df: DataFrame, session: Session | None, kind: str) -> DataFrame:
    """Ticks of the session. Bars carry bucket starts, so they are never filtered."""
    return df.where(session.contains(F.col("time"))) if session is not None and kind == "tick" else df


def union_sources(frames: list[DataFrame]) -> DataFrame:
    """Several sources as one series; ticks and bars do not mix."""
    if len({kind_of(f) for f in frames}) > 1:
        raise ValueError("cannot mix ticks and bars of a symbol")
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def of_symbols(df: DataFrame, symbols: list[str]) -> DataFrame:
    return df.where(normalize_symbol(F.col("symbol")).isin([normalize_symbol(s) for s in symbols]))


def parse_bound(text: str, tz: str = NEW_YORK, end: bool = False) -> int:
    """Epoch second of an instant with offset, an epoch integer, or a local date or datetime of tz; an end date is its last second."""
    text = text.strip()
    if re.fullmatch(r"[\d,]+", text):
        return int(text.replace(",", ""))
    if re.fullmatch(r"\d{4}-\d{2}-\d{2}", text):
        day = dt.datetime.fromisoformat(text).replace(tzinfo=ZoneInfo(tz))
        if end:
            return int((day + dt.timedelta(days=1)).timestamp()) - 1
        return int(day.timestamp())
    at = dt.datetime.fromisoformat(text.replace("Z", "+00:00"))
    return int((at if at.tzinfo else at.replace(tzinfo=ZoneInfo(tz))).timestamp())


def parse_range(token: str, tz: str = NEW_YORK) -> tuple[int | None, int | None] | None:
    """The bounds of START..END, either side optional; None if the token is no range."""
    a, dots, b = token.partition("..")
    if not dots:
        return None
    try:
        return (parse_bound(a, tz) if a else None), (parse_bound(b, tz, end=True) if b else None)
    except ValueError:
        return None


def actions_frame(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Validated corporate actions; each has exactly one of split, reverse_split and dividend."""
    out = []
    for r in rows:
        kinds = [k for k in ("split", "reverse_split", "dividend") if r.get(k) is not None]
        if len(kinds) != 1:
            raise ValueError(f"an action has one of split, reverse_split and dividend: {r}")
        x = float(r[kinds[0]])
        if not 0 < x < float("inf") or kinds[0] == "split" and x == 1 or kinds[0] == "reverse_split" and x <= 1:
            raise ValueError(f"bad value: {r}")
        day = r.get("date", r.get("ex_date"))
        day = dt.date.fromisoformat(day) if isinstance(day, str) else day
        out.append((normalize_symbol(r["symbol"]), day, *(x if k == kinds[0] else None for k in ("split", "reverse_split", "dividend"))))
    return spark.createDataFrame(sorted(out, key=lambda r: r[:2]), ACTIONS)


def load_actions(spark: SparkSession, text: str) -> DataFrame:
    """The [actions] tables of a TOML text: a list of actions for each symbol; other sections are ignored."""
    found = tomllib.loads(text).get("actions", {})
    rows = [{"symbol": s, **a} for s, actions in found.items() for a in actions]
    if not rows:
        raise ValueError("no [actions]")
    return actions_frame(spark, rows)
