"""The queries of the engine over the driver's tables and the SQL that tells the same.

Times are epoch seconds. Doubles are rounded on both sides, as sums of them depend on their order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions.clock import RTH, Clock, NEW_YORK
from .functions.schema import stored_bars
from .operators import adjust as adj
from .operators import indicators, inspect, stats
from .operators.resample import resample
from .plans.request import bars as request
from .plans.store import BarStore, stale
from .sources import tables

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

NY, SESSION = Clock(NEW_YORK), Clock.of(RTH)
#: The window of tick_scan_window and stat_windowed: 2024-01-08 to 2024-01-12 in New York.
START, END = 1_704_690_000, 1_705_121_999

TICKS = """WITH ticks AS (SELECT event_type AS symbol, CAST(floor(epoch(ts)) AS BIGINT) AS time, event_id AS seq, CAST(round(value * 10000) AS BIGINT) AS price_e4,
 CAST(regexp_extract(props, '"k": *(-?[0-9]+)', 1) AS INTEGER) AS size FROM events),
local_ticks AS (SELECT *, timezone('America/New_York', to_timestamp(time)) AS here FROM ticks),
rth_ticks AS (SELECT *, CAST(epoch(timezone('America/New_York', date_trunc('day', here) + INTERVAL 570 MINUTE)) AS BIGINT) AS open_at FROM local_ticks
 WHERE hour(here) * 60 + minute(here) >= 570 AND hour(here) * 60 + minute(here) < 960)"""
LINES = """WITH lines AS (SELECT l_returnflag || l_linestatus AS symbol, CAST(floor(epoch(l_shipdate)) AS BIGINT) AS time, l_orderkey * 8 + l_linenumber AS seq,
 CAST(round(l_extendedprice / l_quantity * 10000) AS BIGINT) AS price_e4, CAST(l_quantity AS INTEGER) AS size, l_shipdate AS here FROM lineitem)"""


def ohlc(source: str, bucket: str) -> str:
    return f"""(SELECT symbol, {bucket} AS time, first(price_e4 ORDER BY {source}.time, seq) / 10000.0 AS open, max(price_e4) / 10000.0 AS high, min(price_e4) / 10000.0 AS low,
 last(price_e4 ORDER BY {source}.time, seq) / 10000.0 AS close, CAST(sum(size) AS BIGINT) AS volume,
 CASE WHEN sum(size) <> 0 THEN CAST(sum(price_e4 * size) AS DOUBLE) / 10000 / sum(size) END AS vwap, count(*) AS trades FROM {source} GROUP BY 1, 2)"""


BAR_COLUMNS = "symbol, time, open, high, low, close, volume, round(vwap, 6) AS vwap, trades"
HOUR = "time - time % 3600"
DAY_NY = "CAST(epoch(timezone('America/New_York', date_trunc('day', here))) AS BIGINT)"


def told(df: DataFrame) -> DataFrame:
    return df.select("symbol", "time", "open", "high", "low", "close", "volume", F.round("vwap", 6).alias("vwap"), "trades")


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def bars_query(name: str, every: str, clock: Clock, sql: str, source=tables.events_ticks, **how) -> None:
    def run(spark, sf_dir):
        rows = tables.in_session(source(spark, sf_dir), clock.session, "tick")
        return told(resample(rows, every, clock, **how))

    query(name, sql)(run)


def hourly(spark, sf_dir) -> DataFrame:
    return resample(tables.events_ticks(spark, sf_dir), "1h")


def daily_lines(spark, sf_dir) -> DataFrame:
    return resample(tables.lineitem_ticks(spark, sf_dir), "1d")


def local_bucket(day: str) -> str:
    return f"CAST(epoch(timezone('America/New_York', CAST({day} AS TIMESTAMP))) AS BIGINT)"


bars_query("bars_utc_5m", "5m", Clock(), f"{TICKS} SELECT {BAR_COLUMNS} FROM {ohlc('ticks', 'time - time % 300')}")
bars_query("bars_session_1h_rth", "1h", SESSION, f"{TICKS} SELECT {BAR_COLUMNS} FROM {ohlc('rth_ticks', 'open_at + (time - open_at) // 3600 * 3600')}")
bars_query("bars_session_7m_rth", "7m", SESSION, f"{TICKS} SELECT {BAR_COLUMNS} FROM {ohlc('rth_ticks', 'open_at + (time - open_at) // 420 * 420')}")
bars_query("bars_daily_ny", "1d", NY, f"{TICKS} SELECT {BAR_COLUMNS} FROM {ohlc('local_ticks', DAY_NY)}")
DAY = "CAST(here AS DATE)"
bars_query("bars_2d", "2d", NY, f"{TICKS} SELECT {BAR_COLUMNS} FROM {ohlc('local_ticks', local_bucket(f'{DAY} - CAST(({DAY} - DATE {chr(39)}1970-01-01{chr(39)}) % 2 AS INTEGER)'))}")
bars_query("bars_weekly", "1w", NY, f"{TICKS} SELECT {BAR_COLUMNS} FROM {ohlc('local_ticks', local_bucket(f'date_trunc({chr(39)}week{chr(39)}, here)'))}")
LINE_BARS = "CAST(epoch(date_trunc('{}', here)) AS BIGINT)"
bars_query("bars_monthly", "1mo", Clock(), f"{LINES} SELECT {BAR_COLUMNS} FROM {ohlc('lines', LINE_BARS.format('month'))}", tables.lineitem_ticks)
bars_query("bars_quarterly_3mo", "3mo", Clock(), f"{LINES} SELECT {BAR_COLUMNS} FROM {ohlc('lines', LINE_BARS.format('quarter'))}", tables.lineitem_ticks)
bars_query("bars_yearly", "1y", Clock(), f"{LINES} SELECT {BAR_COLUMNS} FROM {ohlc('lines', LINE_BARS.format('year'))}", tables.lineitem_ticks)


@query("tick_scan_window", f"{TICKS} SELECT symbol, time, seq, price_e4, size FROM ticks WHERE time BETWEEN {START} AND {END}")
def _(spark, sf_dir):
    return tables.window(tables.events_ticks(spark, sf_dir), START, END)


@query("session_filter_rth", f"{TICKS} SELECT symbol, time, seq, price_e4, size FROM rth_ticks")
def _(spark, sf_dir):
    return tables.in_session(tables.events_ticks(spark, sf_dir), RTH, "tick")


@query("bars_stored_form", f"{TICKS} SELECT symbol, time, CAST(round(open * 10000) AS BIGINT) AS open, CAST(round(high * 10000) AS BIGINT) AS high, CAST(round(low * 10000) AS BIGINT) AS low, CAST(round(close * 10000) AS BIGINT) AS close, volume, CAST(round(coalesce(vwap, 0) * 10000) AS BIGINT) AS vwap, trades FROM {ohlc('ticks', HOUR)}")
def _(spark, sf_dir):
    return stored_bars(hourly(spark, sf_dir))


MINUTES = f"minutes AS (SELECT * FROM {ohlc('ticks', 'time - time % 60')})"
FROM_MINUTES = """(SELECT symbol, time - time % 900 AS time, first(open ORDER BY minutes.time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY minutes.time) AS close,
 CAST(sum(volume) AS BIGINT) AS volume, CASE WHEN sum(volume) <> 0 THEN sum(CASE WHEN vwap IS NULL THEN 0 ELSE vwap * volume END) / sum(volume) END AS vwap, CAST(sum(trades) AS BIGINT) AS trades FROM minutes GROUP BY 1, 2)"""


@query("bars_from_bars_1m_to_15m", f"{TICKS}, {MINUTES} SELECT {BAR_COLUMNS} FROM {FROM_MINUTES}")
def _(spark, sf_dir):
    return told(resample(resample(tables.events_ticks(spark, sf_dir), "1m"), "15m"))


@query("bars_multi_source_union", f"{TICKS} SELECT {BAR_COLUMNS} FROM {ohlc('ticks', HOUR)}")
def _(spark, sf_dir):
    t = tables.events_ticks(spark, sf_dir)
    return told(resample(tables.union_sources([t.where("seq % 2 = 0"), t.where("seq % 2 = 1")]), "1h"))


FILLED = """ UNION ALL SELECT symbol, t AS time, close AS open, close AS high, close AS low, close, 0 AS volume, close AS vwap, 0 AS trades
 FROM (SELECT *, unnest({times}) AS t FROM (SELECT *, lead(time) OVER (PARTITION BY symbol ORDER BY time) AS following FROM b))"""
SESSION_END = "CAST(epoch(timezone('America/New_York', date_trunc('day', timezone('America/New_York', to_timestamp(time))) + INTERVAL 960 MINUTE)) AS BIGINT)"
FILL_SESSION = FILLED.format(times=f"range(time + 1800, CASE WHEN following IS NULL THEN time ELSE least(following, {SESSION_END}) END, 1800)")
FILL_HOURS = "open_at + (time - open_at) // 1800 * 1800"


@query("bars_fill_session", f"{TICKS}, b AS (SELECT * FROM {ohlc('rth_ticks', FILL_HOURS)}) SELECT {BAR_COLUMNS} FROM (SELECT * FROM b{FILL_SESSION})")
def _(spark, sf_dir):
    return told(request(tables.events_ticks(spark, sf_dir), "30m", rth=True, fill=True))


SPARSE = "sparse AS (SELECT * FROM lines WHERE time % 2592000 < 864000)"
FILL_DAILY = FILLED.format(times="range(time + 86400, coalesce(following, time), 86400)")


@query("bars_fill_daily", f"{LINES}, {SPARSE}, b AS (SELECT * FROM {ohlc('sparse', 'time - time % 86400')}) SELECT {BAR_COLUMNS} FROM (SELECT * FROM b{FILL_DAILY})")
def _(spark, sf_dir):
    return told(resample(tables.lineitem_ticks(spark, sf_dir).where("time % 2592000 < 864000"), "1d", fill=True))


FILL_MINUTES = FILLED.format(times="range(time + 60, coalesce(following, time), 60)")


@query("bars_fill_utc_1m", f"{TICKS}, b AS (SELECT * FROM {ohlc('ticks', 'time - time % 60')}) SELECT {BAR_COLUMNS} FROM (SELECT * FROM b{FILL_MINUTES})")
def _(spark, sf_dir):
    return told(resample(tables.events_ticks(spark, sf_dir), "1m", fill=True))


STAT = """SELECT symbol, count(*) AS trades, min(time) AS first, max(time) AS last, min(price_e4) / 10000.0 AS low, max(price_e4) / 10000.0 AS high,
 round(CASE WHEN sum(size) <> 0 THEN CAST(sum(price_e4 * size) AS DOUBLE) / 10000 / sum(size) END, 6) AS vwap, CAST(sum(size) AS BIGINT) AS volume FROM {} GROUP BY symbol"""


def stat_told(df: DataFrame) -> DataFrame:
    return df.withColumn("vwap", F.round("vwap", 6))


@query("stat_ticks", f"{TICKS} {STAT.format('ticks')}")
def _(spark, sf_dir):
    return stat_told(stats.stat(tables.events_ticks(spark, sf_dir)))


@query("stat_windowed", f"{TICKS} {STAT.format(f'(SELECT * FROM ticks WHERE time BETWEEN {START} AND {END})')}")
def _(spark, sf_dir):
    return stat_told(stats.stat(tables.window(tables.events_ticks(spark, sf_dir), START, END)))


@query("stat_bars", f"{LINES} SELECT symbol, trades, time - time % 86400 AS first, last, low, high, vwap, volume FROM (SELECT *, first AS time FROM ({STAT.format('lines')}))")
def _(spark, sf_dir):
    return stat_told(stats.stat(daily_lines(spark, sf_dir)))


HOURLY = f"{TICKS}, b AS (SELECT * FROM {ohlc('ticks', HOUR)}), s AS (SELECT *, row_number() OVER w AS i, lag(close) OVER w AS prev FROM b WINDOW w AS (PARTITION BY symbol ORDER BY time))"


def calc_query(name: str, spec: str, sql: str, decimals: int) -> None:
    column = indicators.spec(spec).name

    def run(spark, sf_dir):
        out = indicators.calc(hourly(spark, sf_dir), spec)
        return out.select("symbol", "time", "close", F.round(column, decimals).alias(column))

    query(name, sql)(run)


def framed(x: str, n: int) -> str:
    return f"CASE WHEN i >= {n} THEN {x} OVER (PARTITION BY symbol ORDER BY time ROWS {n - 1} PRECEDING) END"


def picked(column: str, x: str, decimals: int) -> str:
    return f"{HOURLY} SELECT symbol, time, close, round({x}, {decimals}) AS {column} FROM s"


calc_query("calc_sma", "sma:20", picked("sma_20", framed("avg(close)", 20), 6), 6)
calc_query("calc_vsma", "vsma:10", picked("vsma_10", framed("avg(volume)", 10), 6), 6)
calc_query("calc_ret_log", "ret:log", picked("ret_log", "CASE WHEN prev <> 0 AND close > 0 THEN ln(close / prev) END", 8), 8)
calc_query("calc_ret_simple", "ret:simple", picked("ret_simple", "CASE WHEN prev <> 0 THEN (close - prev) / prev END", 8), 8)
calc_query(
    "calc_vol", "vol:20",
    f"{HOURLY}, r AS (SELECT *, CASE WHEN prev <> 0 AND close > 0 THEN ln(close / prev) END AS ret FROM s) SELECT symbol, time, close, round(CASE WHEN count(ret) OVER v = 20 THEN stddev_samp(ret) OVER v END, 8) AS vol_20 FROM r WINDOW v AS (PARTITION BY symbol ORDER BY time ROWS 19 PRECEDING)", 8,
)


def ema_sql(x: str, n: int, column: str, double: bool) -> str:
    seed, rec = f"CASE WHEN e.i + 1 = {n} THEN (e.total + s.{x}) / {n}", f"WHEN e.i + 1 > {n} THEN {2 / (n + 1)!r}::DOUBLE * s.{x} + (1 - {2 / (n + 1)!r}::DOUBLE) * e.e END"
    inner = f"({seed} {rec})"
    k = 2 * n - 1
    second = f"CASE WHEN e.i + 1 = {k} THEN (e.total2 + {inner}) / {n} WHEN e.i + 1 > {k} THEN {2 / (n + 1)!r}::DOUBLE * {inner} + (1 - {2 / (n + 1)!r}::DOUBLE) * e.e2 END"
    out = "2 * e - e2" if double else "e"
    begin = f"SELECT symbol, i, time, close, {x}::DOUBLE AS total, CASE WHEN {n} = 1 THEN {x}::DOUBLE END AS e, 0::DOUBLE AS total2, NULL::DOUBLE AS e2 FROM s WHERE i = 1"
    step = f"SELECT s.symbol, s.i, s.time, s.close, e.total + s.{x}, {inner}, e.total2 + coalesce({inner}, 0), {second} FROM e JOIN s ON s.symbol = e.symbol AND s.i = e.i + 1"
    return HOURLY.replace("WITH ", "WITH RECURSIVE ", 1) + f", e AS ({begin} UNION ALL {step}) SELECT symbol, time, close, round({out}, 6) AS {column} FROM e"


calc_query("calc_ema", "ema:10", ema_sql("close", 10, "ema_10", False), 6)
calc_query("calc_vema", "vema:10", ema_sql("volume", 10, "vema_10", False), 6)
calc_query("calc_dema", "dema:10", ema_sql("close", 10, "dema_10", True), 6)
calc_query("calc_vdema", "vdema:10", ema_sql("volume", 10, "vdema_10", True), 6)
RSI_STEP = "CASE WHEN r.i < 15 THEN r.{0} + greatest({1}, 0) WHEN r.i = 15 THEN (r.{0} / 14 * 13 + greatest({1}, 0)) / 14 ELSE (r.{0} * 13 + greatest({1}, 0)) / 14 END"
calc_query(
    "calc_rsi", "rsi:14",
    HOURLY.replace("WITH ", "WITH RECURSIVE ", 1) + f""", r AS (SELECT symbol, i, time, close, 0::DOUBLE AS g, 0::DOUBLE AS l FROM s WHERE i = 1 UNION ALL
 SELECT s.symbol, s.i, s.time, s.close, {RSI_STEP.format('g', 's.close - r.close')}, {RSI_STEP.format('l', 'r.close - s.close')} FROM r JOIN s ON s.symbol = r.symbol AND s.i = r.i + 1)
 SELECT symbol, time, close, round(CASE WHEN i < 15 THEN NULL WHEN l = 0 THEN 100 ELSE 100 - 100 / (1 + g / l) END, 6) AS rsi_14 FROM r""", 6,
)


@query("calc_custom_zscore", f"{HOURLY} SELECT symbol, time, close, round((close - avg(close) OVER v) / nullif(stddev_samp(close) OVER v, 0), 6) AS zscore FROM s WINDOW v AS (PARTITION BY symbol ORDER BY time ROWS 19 PRECEDING)")
def _(spark, sf_dir):
    w = Window.partitionBy("symbol").orderBy("time").rowsBetween(-19, 0)
    out = indicators.calc(hourly(spark, sf_dir), zscore=F.try_divide(F.col("close") - F.avg("close").over(w), F.nullif(F.stddev_samp("close").over(w), F.lit(0.0))))
    return out.select("symbol", "time", "close", F.round("zscore", 6).alias("zscore"))


ACTION_ROWS = [
    {"symbol": "click", "date": "2024-01-10", "split": 4}, {"symbol": "click", "date": "2024-01-20", "reverse_split": 10}, {"symbol": "Error ", "date": "2024-01-15", "split": 2},
    {"symbol": "view", "date": "2024-01-12", "dividend": 0.5}, {"symbol": "view", "date": "2024-01-18", "split": 3}, {"symbol": "click", "date": "2024-01-25", "dividend": 0.25},
]
EX = "CAST(epoch(timezone('America/New_York', TIMESTAMP '2024-01-{} 00:00:00')) AS BIGINT)"
SPLITS = "acts AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {EX.format(d)}, {r})" for s, d, r in (("click", 10, "4.0::DOUBLE"), ("click", 20, "(1 / 10.0)::DOUBLE"), ("error", 15, "2.0::DOUBLE"), ("view", 18, "3.0::DOUBLE"))) + ") AS t(symbol, ex, ratio))"
VF = "coalesce((SELECT product(ratio) FROM acts a WHERE a.symbol = b.symbol AND a.ex > b.time), 1)"


def actions(spark) -> DataFrame:
    return tables.actions_frame(spark, ACTION_ROWS)


def adjusted(df: DataFrame) -> DataFrame:
    return df.select("symbol", "time", *(F.round(c, 4).alias(c) for c in ("open", "high", "low", "close")), "volume", F.round("vwap", 4).alias("vwap"), "trades")


def adjusted_sql(p: str) -> str:
    return "SELECT symbol, time, " + ", ".join(f"round({c} * {p}, 4) AS {c}" for c in ("open", "high", "low", "close")) + f", CAST(round(volume * v) AS BIGINT) AS volume, round(vwap * {p}, 4) AS vwap, trades FROM x"


DAILY = f"{TICKS}, b AS (SELECT * FROM {ohlc('local_ticks', DAY_NY)})"


@query("adjust_splits_bars", f"{DAILY}, {SPLITS}, x AS (SELECT *, {VF} AS v FROM b) {adjusted_sql('(1 / v)')}")
def _(spark, sf_dir):
    return adjusted(adj.adjust(resample(tables.events_ticks(spark, sf_dir), "1d", NY), actions(spark)))


@query("adjust_splits_ticks", f"{TICKS}, {SPLITS}, x AS (SELECT *, {VF} AS v FROM ticks b) SELECT symbol, time, seq, CAST(round(price_e4 / v) AS BIGINT) AS price_e4, CAST(round(size * v) AS INTEGER) AS size FROM x")
def _(spark, sf_dir):
    return adj.adjust(tables.events_ticks(spark, sf_dir), actions(spark))


DIVIDENDS = "divs AS (SELECT * FROM (VALUES " + ", ".join(f"('{s}', {EX.format(d)}, {x})" for s, d, x in (("view", 12, "0.5::DOUBLE"), ("click", 25, "0.25::DOUBLE"))) + ") AS t(symbol, ex, amount)), raws AS (SELECT d.*, (SELECT last(close ORDER BY b.time) FROM b WHERE b.symbol = d.symbol AND b.time < d.ex) AS c FROM divs d)"
DF = "coalesce((SELECT product((c - amount) / c) FROM raws r WHERE r.symbol = b.symbol AND r.ex > b.time AND c > 0 AND amount < c), 1)"


@query("adjust_total_return", f"{DAILY}, {SPLITS}, {DIVIDENDS}, x AS (SELECT *, {VF} AS v, {DF} AS d FROM b) {adjusted_sql('(d / v)')}")
def _(spark, sf_dir):
    return adjusted(adj.adjust(resample(tables.events_ticks(spark, sf_dir), "1d", NY), actions(spark), "total"))


@query("detect_splits", f"{HOURLY}, g AS (SELECT symbol, time, prev / open AS gap FROM s WHERE open > 0 AND prev > 0), x AS (SELECT *, CASE WHEN gap > 1.5 THEN gap WHEN gap < 1 / 1.5 THEN 1 / gap END AS y FROM g) SELECT symbol, time, CASE WHEN gap > 1.5 THEN round(y) ELSE 1 / round(y) END AS ratio FROM x WHERE round(y) >= 2 AND abs((y - round(y)) / round(y)) < 0.05")
def _(spark, sf_dir):
    return adj.detect_splits(hourly(spark, sf_dir))


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


SPAN = "(max(time) - min(time)) / 31557600.0"


@query("summary_price", f"{HOURLY} SELECT symbol, count(*) AS bars, first(close ORDER BY time) AS first, last(close ORDER BY time) AS last, max(close) AS high, min(close) AS low, round({SPAN}, 6) AS years, round(last(close ORDER BY time) / max(close) - 1, 6) AS drawdown, round(ln(last(close ORDER BY time) / first(close ORDER BY time)) / ({SPAN}), 6) AS log_growth FROM b GROUP BY symbol")
def _(spark, sf_dir):
    # the growth rate as a logarithm: over a month of these prices the rate itself has more digits than a double
    out = stats.price_summary(hourly(spark, sf_dir))
    return rounded(out.withColumn("log_growth", F.log(F.col("last") / F.col("first")) / F.col("years")).drop("cagr"))


@query("summary_columns", f"{HOURLY}, c AS (SELECT symbol, time, {framed('avg(close)', 20)} AS sma_20, CASE WHEN prev <> 0 AND close > 0 THEN ln(close / prev) END AS ret_log FROM s), u AS (SELECT symbol, time, 'sma_20' AS name, sma_20 AS v FROM c UNION ALL SELECT symbol, time, 'ret_log', ret_log FROM c) SELECT symbol, name, count(v) AS n, round(avg(v), 6) AS mean, round(min(v), 6) AS min, round(max(v), 6) AS max, round(last(v ORDER BY time), 6) AS last FROM u WHERE v IS NOT NULL GROUP BY symbol, name")
def _(spark, sf_dir):
    return rounded(stats.column_summary(indicators.calc(hourly(spark, sf_dir), "sma:20", "ret:log"), "sma_20", "ret_log"))


RETURNS = f"""{HOURLY}, r AS (SELECT symbol, CASE WHEN prev <> 0 AND close > 0 THEN ln(close / prev) END AS r FROM s), y AS (SELECT symbol, {SPAN} AS years FROM b GROUP BY symbol),
m AS (SELECT symbol, count(r) AS n, avg(r) AS mean, stddev_samp(r) AS stdev, min(r) AS min, max(r) AS max, quantile_cont(r, 0.25) AS p25, quantile_cont(r, 0.5) AS median, quantile_cont(r, 0.75) AS p75 FROM r WHERE r IS NOT NULL GROUP BY symbol),
k AS (SELECT r.symbol, avg(power(r - mean, 2)) AS m2, avg(power(r - mean, 3)) AS m3, avg(power(r - mean, 4)) AS m4 FROM r JOIN m USING (symbol) WHERE r IS NOT NULL GROUP BY r.symbol),
f AS (SELECT m.*, years, CASE WHEN m2 > 0 THEN m3 / power(m2, 1.5) ELSE 0 END AS skew, CASE WHEN m2 > 0 THEN m4 / (m2 * m2) - 3 ELSE 0 END AS kurtosis, n / years AS ppy FROM m JOIN k USING (symbol) JOIN y USING (symbol)),
a AS (SELECT *, n / 6.0 * (skew * skew + kurtosis * kurtosis / 4) AS jarque_bera, mean * ppy AS ann_return, stdev * sqrt(ppy) AS ann_vol FROM f)"""


@query("summary_returns", f"{RETURNS} SELECT symbol, n, round(mean, 6) AS mean, round(stdev, 6) AS stdev, round(skew, 6) AS skew, round(kurtosis, 6) AS kurtosis, round(jarque_bera, 4) AS jarque_bera, round(min, 6) AS min, round(p25, 6) AS p25, round(median, 6) AS median, round(p75, 6) AS p75, round(max, 6) AS max FROM a")
def _(spark, sf_dir):
    s = stats.return_summary(hourly(spark, sf_dir))
    return rounded(s.select("symbol", "n", "mean", "stdev", "skew", "kurtosis", F.round("jarque_bera", 4).alias("jarque_bera"), "min", "p25", "median", "p75", "max"))


@query("summary_annualized", f"{RETURNS} SELECT symbol, round(ppy, 4) AS ppy, round(ann_return, 4) AS ann_return, round(ann_vol, 4) AS ann_vol, round(ann_return / ann_vol, 4) AS sharpe FROM a")
def _(spark, sf_dir):
    return rounded(stats.return_summary(hourly(spark, sf_dir)).select("symbol", "ppy", "ann_return", "ann_vol", "sharpe"), 4)


@query("summary_labels", f"{RETURNS} SELECT symbol, CASE WHEN ann_return > 0.02 THEN 'up' WHEN ann_return < -0.02 THEN 'down' ELSE 'flat' END AS trend, CASE WHEN ann_vol < 0.15 THEN 'low' WHEN ann_vol <= 0.25 THEN 'moderate' ELSE 'high' END AS volatility, CASE WHEN abs(skew) < 0.5 THEN 'symmetric' WHEN skew > 0 THEN 'right' ELSE 'left' END AS skewness, CASE WHEN kurtosis > 1 THEN 'fat' WHEN kurtosis < -1 THEN 'thin' ELSE 'normal' END AS tails, CASE WHEN jarque_bera > 5.99 THEN 'non-normal' ELSE 'near-normal' END AS distribution FROM a")
def _(spark, sf_dir):
    return stats.labels(stats.return_summary(hourly(spark, sf_dir)))


@query("summarize_simple", f"{HOURLY}, r AS (SELECT symbol, (close - prev) / nullif(prev, 0) AS r FROM s) SELECT symbol, count(r) AS n, round(avg(r), 6) AS mean, round(stddev_samp(r), 6) AS stdev, round(min(r), 6) AS min, round(max(r), 6) AS max, round(stddev_samp(r) * sqrt(252), 6) AS annualized FROM r WHERE r IS NOT NULL GROUP BY symbol")
def _(spark, sf_dir):
    return rounded(stats.summarize(hourly(spark, sf_dir), "simple"))


OUTSIDE = "hour(here) * 60 + minute(here) < 570 OR hour(here) * 60 + minute(here) >= 960"
HOURS = f"CASE WHEN min(hour(here) * 60 + minute(here)) = max(hour(here) * 60 + minute(here)) THEN 'n/a' WHEN bool_or({OUTSIDE}) THEN 'extended' ELSE 'rth' END"
GAPS = "SELECT symbol, min(CASE WHEN time > p THEN time - p END) AS gap FROM (SELECT symbol, time, lag(time) OVER (PARTITION BY symbol ORDER BY time) AS p FROM {}) GROUP BY symbol"
LABEL = "CASE WHEN gap < 86400 AND gap % 3600 = 0 THEN (gap // 3600) || 'h' WHEN gap < 86400 AND gap % 60 = 0 THEN (gap // 60) || 'm' WHEN gap < 86400 THEN gap || 's' WHEN gap BETWEEN 82800 AND 90000 THEN '1d' WHEN gap BETWEEN 597600 AND 612000 THEN '1w' WHEN gap BETWEEN 2419200 AND 2678400 THEN '1mo' WHEN gap BETWEEN 31536000 AND 31622400 THEN '1y' ELSE ((gap + 43200) // 86400) || 'd' END"
LOCAL_BARS = "here AS (SELECT *, timezone('America/New_York', to_timestamp(time)) AS here FROM b)"


@query("catalog_ls", f"{HOURLY}, {LOCAL_BARS}, g AS ({GAPS.format('b')}) SELECT symbol, 'bar' AS kind, count(*) AS rows, min(time) AS first, max(time) AS last, {LABEL.replace('gap', 'max(gap)')} AS granularity, {HOURS} AS hours FROM here JOIN g USING (symbol) GROUP BY symbol")
def _(spark, sf_dir):
    return inspect.catalogue(hourly(spark, sf_dir), "bar")


@query("granularity_detect", f"{DAILY}, g AS ({GAPS.format('b')}) SELECT symbol, gap, {LABEL} AS granularity FROM g")
def _(spark, sf_dir):
    return inspect.least_gaps(resample(tables.events_ticks(spark, sf_dir), "1d", NY))


@query("hours_classify", f"{TICKS} SELECT symbol, {HOURS} AS hours FROM local_ticks GROUP BY symbol")
def _(spark, sf_dir):
    return inspect.hours(tables.events_ticks(spark, sf_dir))


@query("inspect_preview", f"{TICKS}, p AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY time, seq) AS place, count(*) OVER (PARTITION BY symbol) AS n FROM ticks) SELECT symbol, time, seq, price_e4, size, place FROM p WHERE place <= 3 OR place > n - 3")
def _(spark, sf_dir):
    return inspect.preview(tables.events_ticks(spark, sf_dir))


@query("verify_ticks", f"{TICKS} SELECT symbol, count(*) AS rows, 0 AS null_rows, 0 AS bad_prices, count(*) - count(DISTINCT (time, seq)) AS repeated_keys FROM ticks GROUP BY symbol")
def _(spark, sf_dir):
    return inspect.verify(tables.events_ticks(spark, sf_dir))


@query("recent_n_per_symbol", f"{HOURLY} SELECT symbol, time, close, round(sma_20, 6) AS sma_20, total FROM (SELECT *, {framed('avg(close)', 20)} AS sma_20, count(*) OVER (PARTITION BY symbol) AS total, row_number() OVER (PARTITION BY symbol ORDER BY time DESC) AS back FROM s) WHERE back <= 25")
def _(spark, sf_dir):
    out = inspect.recent(indicators.calc(hourly(spark, sf_dir), "sma:20"), 25)
    return out.select("symbol", "time", "close", F.round("sma_20", 6).alias("sma_20"), "total")


def _root(spark: SparkSession) -> str:
    import tempfile
    import uuid

    shared = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="tickloom-")
    return f"{shared.rstrip('/')}/bars-{uuid.uuid4().hex}"


@query("sync_incremental", f"{TICKS} SELECT {BAR_COLUMNS} FROM {ohlc('ticks', HOUR)}")
def _(spark, sf_dir):
    store, t = BarStore(_root(spark)), tables.events_ticks(spark, sf_dir)
    store.sync(t.where(F.col("time") < END), "1h", Clock())
    return told(store.sync(t, "1h", Clock()))


@query("sidecar_staleness", f"{TICKS}, o AS (SELECT * FROM ticks WHERE time < {END} OR symbol = 'click'), l AS (SELECT symbol, max(time - time % 3600) AS last_bar FROM o GROUP BY symbol) SELECT symbol, last_bar, max(time) AS last_tick, max(time) >= last_bar + 3600 AS stale FROM ticks LEFT JOIN l USING (symbol) GROUP BY symbol, last_bar")
def _(spark, sf_dir):
    t = tables.events_ticks(spark, sf_dir)
    return stale(resample(t.where((F.col("time") < END) | (F.col("symbol") == "click")), "1h"), t, "1h", Clock())


@query("stream_bars_tumbling", f"{TICKS} SELECT {BAR_COLUMNS} FROM {ohlc('ticks', HOUR)}")
def _(spark, sf_dir):
    from .streaming import live

    path = f"{sf_dir}/events.parquet"
    raw = live.tick_stream(spark, path[:-1] + "[t]", spark.read.parquet(path).schema)  # a pattern may be a file or a folder
    ticks = raw.select(
        F.col("event_type").alias("symbol"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("time"), F.col("event_id").alias("seq"),
        F.round(F.col("value") * 10_000).cast("long").alias("price_e4"), F.regexp_extract("props", r'"k": *(-?\d+)', 1).cast("int").alias("size"),
    )
    return told(live.drained(live.tumbling_bars(ticks, "1h")))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
