"""Semantics on fixtures whose results are known."""

import datetime as dt
import os
import random
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from tickloom.functions import render
from tickloom.functions.clock import RTH, Clock, Session, bucket_start
from tickloom.functions.interval import granularity_label, interval
from tickloom.functions.schema import ACTIONS, BARS, TICKS, kind_of, scale_fixed, scale_price
from tickloom.operators import adjust, indicators, inspect, stats
from tickloom.operators.resample import resample
from tickloom.plans.request import bars as request
from tickloom.plans.store import BarStore, StaleError, stale
from tickloom.sources import tables
from tickloom.streaming import ingest, live

OPEN = 1_704_205_800  # 2024-01-02 09:30 in New York
NY = Clock("America/New_York")


def ticks(spark, rows, symbol="A"):
    return spark.createDataFrame([(symbol, t, k, round(p * 10_000), s) for k, (t, p, s) in enumerate(rows)], TICKS)


def bars(spark, closes, volumes=None, step=86_400, symbol="A"):
    volumes = volumes or [100] * len(closes)
    return spark.createDataFrame([(symbol, i * step, c, c, c, c, v, c, 1) for i, (c, v) in enumerate(zip(map(float, closes), volumes))], BARS)


def times(df):
    return [r.time for r in df.orderBy("time").collect()]


def test_ohlcv_and_ties_within_a_second(spark):
    got = resample(ticks(spark, [(0, 10, 100), (30, 12, 50), (59, 11, 25), (60, 11.5, 200), (60, 9, 1)]), "1m").orderBy("time").collect()
    assert tuple(got[0])[1:7] == (0, 10.0, 12.0, 10.0, 11.0, 175) and got[0].vwap == pytest.approx(1875 / 175) and got[0].trades == 3
    assert (got[1].open, got[1].close) == (11.5, 9.0)


def test_bars_to_bars(spark):
    source = spark.createDataFrame([("A", 0, 10.0, 11.0, 9.5, 10.5, 100, 10.2, 5), ("A", 30, 10.5, 12.0, 9.0, 11.5, 200, 11.0, 8), ("A", 90, 1.0, 1.0, 1.0, 1.0, 0, None, 1)], BARS)
    a, b = resample(source, "1m").orderBy("time").collect()
    assert (a.open, a.high, a.low, a.close, a.volume, a.trades) == (10.0, 12.0, 9.0, 11.5, 300, 13) and a.vwap == pytest.approx((10.2 * 100 + 11 * 200) / 300)
    assert b.vwap is None


def test_fill(spark):
    got = resample(ticks(spark, [(0, 10, 100), (180, 13, 100)]), "1m", Clock(), fill=True).orderBy("time").collect()
    assert [(r.time, r.close, r.volume) for r in got] == [(0, 10, 100), (60, 10, 0), (120, 10, 0), (180, 13, 100)]
    day = ticks(spark, [(OPEN, 1, 1), (OPEN + 3 * 3600, 2, 1), (OPEN + 86_400, 3, 1)])
    assert times(resample(day, "1h", Clock.of(RTH), fill=True)) == [OPEN + h * 3600 for h in range(7)] + [OPEN + 86_400]


def test_days_of_the_exchange(spark):
    t = ticks(spark, [(1704207600, 10, 1), (1704241800, 11, 1), (1704294000, 12, 1)])
    assert times(resample(t, "1d", NY)) == [1704171600, 1704258000]
    assert len(times(resample(t, "1d"))) == 2


@pytest.mark.parametrize("every", ["1d", "3d", "2w", "5mo", "3y", "1h", "7m"])
def test_buckets_against_zoneinfo_across_clock_changes(spark, every):
    zone, one = ZoneInfo("America/New_York"), interval(every)
    at = [1_710_000_000 + 1801 * k for k in range(200)] + [1_730_500_000 + 1801 * k for k in range(200)]
    clock = Clock.of(RTH) if one.seconds else NY

    def expected(t):
        here = dt.datetime.fromtimestamp(t, zone)
        if one.seconds:
            opened = int(dt.datetime(here.year, here.month, here.day, 9, 30, tzinfo=zone).timestamp())
            return opened + (t - opened) // one.seconds * one.seconds
        d, n = here.date(), one.count
        if one.unit == "d":
            d -= dt.timedelta((d - dt.date(1970, 1, 1)).days % n)
        elif one.unit == "w":
            d -= dt.timedelta((d - dt.date(1970, 1, 5)).days % (7 * n))
        elif one.unit == "mo":
            i = d.year * 12 + d.month - 1
            d = dt.date((i - i % n) // 12, (i - i % n) % 12 + 1, 1)
        else:
            d = dt.date(d.year - d.year % n, 1, 1)
        return int(dt.datetime(d.year, d.month, d.day, tzinfo=zone).timestamp())

    df = spark.createDataFrame([(t,) for t in at], "time long")
    assert [(r[0], r[1]) for r in df.select("time", bucket_start(F.col("time"), one, clock)).collect()] == [(t, expected(t)) for t in at]


def test_indicators(spark):
    def column(df, name):
        return [r[name] for r in df.orderBy("time").collect()]

    ramp = bars(spark, [1, 2, 3, 4, 5], [10, 20, 30, 40, 50])
    got = indicators.calc(ramp, "sma:2", "vsma:2", "rsi:2", "ema:2", "dema:2", "ret:log", "vol:2", "vol:1")
    assert column(got, "sma_2") == [None, 1.5, 2.5, 3.5, 4.5] and column(got, "vsma_2") == [None, 15, 25, 35, 45]
    assert column(got, "rsi_2") == [None, None, 100, 100, 100] and column(got, "vol_1") == [None] * 5
    assert column(got, "ema_2") == pytest.approx([None, 1.5, 2.5, 3.5, 4.5], nan_ok=True) and column(got, "dema_2")[:2] == [None, None]
    with pytest.raises(ValueError):
        indicators.calc(ramp, "sma:2", "sma:2")
    for bad in ("sma:0", "ret:x", "abc:1", "sma"):
        with pytest.raises(ValueError):
            indicators.spec(bad)


def test_adjustment_and_detection(spark):
    split = tables.actions_frame(spark, [{"symbol": "a ", "date": "1970-01-03", "split": 4}])
    got = adjust.adjust(bars(spark, [100, 100, 25, 25], [400, 400, 1600, 1600]), split, tz="UTC").orderBy("time").collect()
    assert [(r.close, r.volume) for r in got] == [(25, 1600)] * 4
    dividend = tables.actions_frame(spark, [{"symbol": "A", "date": "1970-01-02", "dividend": 1}])
    assert [r.close for r in adjust.adjust(bars(spark, [100, 99]), dividend, "total", "UTC").orderBy("time").collect()] == [99, 99]
    assert [r.close for r in adjust.adjust(bars(spark, [100, 99]), dividend, "splits", "UTC").orderBy("time").collect()] == [100, 99]
    assert [r.ratio for r in adjust.detect_splits(bars(spark, [100, 25, 20, 200, 150])).orderBy("time").collect()] == [4, 0.1]
    for bad in ({"split": 1}, {"reverse_split": 0.5}, {"dividend": -1}, {}, {"split": 2, "dividend": 1}):
        with pytest.raises(ValueError):
            tables.actions_frame(spark, [{"symbol": "A", "date": "1970-01-02", **bad}])


def test_adjusted_sizes_stop_at_the_type_s_bounds(spark):
    t = ticks(spark, [(OPEN, 10, 2_000_000_000), (OPEN + 1, 10, 3)])
    split = spark.createDataFrame([("A", dt.date(2024, 6, 1), 4.0, None, None)], ACTIONS)
    assert [r[0] for r in adjust.adjust(t, split).orderBy("seq").select("size").collect()] == [2**31 - 1, 12]


def test_late_ticks_of_a_stream(spark, tmp_path):
    for k, rows in enumerate(([(0, 10, 1), (600, 11, 1)], [(1200, 12, 1)], [(30, 99, 1), (2400, 13, 1)])):
        ticks(spark, rows).coalesce(1).write.mode("append").parquet(str(tmp_path))
        for f in tmp_path.glob("part-*"):  # a file for each batch, in this order; lateness counts from the batch before
            if f.stat().st_mtime > 1e9:
                os.utime(f, (k + 1, k + 1))
    stream = live.tumbling_bars(live.tick_stream(spark, str(tmp_path), TICKS, maxFilesPerTrigger="1"), "1m")
    got = live.drained(stream, "append").orderBy("time").collect()
    assert [(r.time, r.high, r.trades) for r in got][:3] == [(0, 10.0, 1), (600, 11.0, 1), (1200, 12.0, 1)]


def test_stat_is_the_same_from_ticks_and_bars(spark):
    t = ticks(spark, [(100, 10, 100), (100, 12, 300), (160, 11, 200)])
    a, b = stats.stat(t).first(), stats.stat(resample(t, "1s")).first()
    assert a.asDict() == {**b.asDict(), "vwap": pytest.approx(b.vwap)} and (a.trades, a.volume, a.low, a.high) == (3, 600, 10, 12)


def test_sources(spark):
    t = ticks(spark, [(0, 1, 1), (10, 1, 1)])
    assert tables.window(t, 0, 10).count() == 2 and tables.window(t, 5, 1).count() == 0 and kind_of(t) == "tick"
    with pytest.raises(ValueError):
        tables.union_sources([t, bars(spark, [1])])
    assert tables.parse_range("2024-01-02..2024-01-02") == (1704171600, 1704257999) and tables.parse_range("a/b") is None
    assert tables.parse_bound("1,704,171,600") == tables.parse_bound("2024-01-02T05:00:00Z") == 1704171600
    with pytest.raises(ValueError):
        Session.parse("16:00-09:30")


def test_request_filters_ticks_only(spark):
    t = ticks(spark, [(OPEN - 60, 9, 1), (OPEN, 10, 1), (OPEN + 23_400, 11, 1)])
    assert request(t, "1d", rth=True).first().trades == 1 and request(t, "1d").first().trades == 3
    assert request(resample(t, "1m"), "1d", rth=True).first().trades == 3
    with pytest.raises(ValueError):
        request(t)


def test_store(spark, tmp_path):
    store, t = BarStore(str(tmp_path)), ticks(spark, [(600 * k, 1 + k, 10) for k in range(60)])
    store.sync(t.where("time < 19000"), "1h", Clock())
    assert stale(store.read(spark, store.key("1h", Clock(), False)), t, "1h", Clock()).first().stale
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(store.sync(t, "1h", Clock())) == key(resample(t, "1h"))
    other = BarStore(str(tmp_path / "x"))
    session = Clock.of(Session(start=240, end=1200))
    other.sync(t.where("time < 19000"), "1h", session)
    with pytest.raises(StaleError):
        request(t, "1h", store=other)


def test_store_with_new_symbols(spark, tmp_path):
    store, t = BarStore(str(tmp_path)), ticks(spark, [(600 * k, 1 + k, 10) for k in range(60)])
    both = t.unionByName(t.withColumn("symbol", F.lit("NEW"))).unionByName(t.withColumn("symbol", F.lit("OLD")).where("time < 9000"))
    store.sync(both.where("symbol != 'NEW' and time < 19000"), "1h", Clock())
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(store.sync(both, "1h", Clock())) == key(resample(both, "1h")) == key(store.sync(both, "1h", Clock()))


@pytest.mark.parametrize("every", ["7m", "50m", "5h", "11h", "13h"])
def test_buckets_open_at_midnight(spark, every):
    clock, width, start = Clock.of(RTH), interval(every).seconds, 1_709_960_400  # the clock changes the day after
    rng = random.Random(every)
    rows = sorted({start + rng.randrange(5 * 86_400) for _ in range(400)} | {start + 86_400 * k - rng.randrange(3600) for k in range(6)})
    df = ticks(spark, [(t, 1 + k, 1 + k % 7) for k, t in enumerate(rows)])
    own = dict(df.select("time", bucket_start(F.col("time"), interval(every), clock)).collect())
    want, opened, end = {}, None, 0
    for k, t in enumerate(sorted(own)):
        if opened is None or t >= end:
            opened, end = own[t], own[t] + width
        want.setdefault(opened, []).append(t)
    at = {r.time: (r.price_e4 / 10_000, r.size) for r in df.collect()}
    expected = [(b, at[ts[0]][0], max(at[t][0] for t in ts), min(at[t][0] for t in ts), at[ts[-1]][0], sum(at[t][1] for t in ts), len(ts)) for b, ts in sorted(want.items())]
    got = resample(df, every, clock).orderBy("time").select("time", "open", "high", "low", "close", "volume", "trades").collect()
    assert [tuple(r) for r in got] == expected


def test_catalogue_helpers(spark):
    assert [granularity_label(g) for g in (60, 1800, 3600, 90_000, 604_800, 2 * 86_400)] == ["1m", "30m", "1h", "1d", "1w", "2d"]
    b = bars(spark, range(1, 11), step=3600)
    assert inspect.least_gaps(b).first().granularity == "1h" and inspect.preview(b).count() == 6
    assert [(r.time, r.total) for r in inspect.recent(b, 2).orderBy("time").collect()] == [(8 * 3600, 10), (9 * 3600, 10)]
    assert inspect.verify(ticks(spark, [(0, 1, 1), (0, 1, 1)])).first()[1:] == (2, 0, 0, 0)


def test_fixed_point(spark):
    df = spark.createDataFrame([(1.00005,), (-1.0,), (float("nan"),), (1e9,), (None,)], "x double")
    assert [r[0] for r in df.select(scale_price(F.col("x"))).collect()] == [10001, 0, 0, 4294967295, 0]
    assert [r[0] for r in df.select(scale_fixed(F.col("x"), 4)).collect()] == [10001, -10000, None, 2147483647, None]


def test_rendering(spark):
    b = bars(spark, [1234.5])
    assert list(render.rendered(b, "csv"))[1].startswith("A,0,1234.5,") and "1,234.5000" in list(render.rendered(b))[1]
    assert render.csv_cell('a"b') == '"a""b"' and render.md_cell("a|b") == "a\\|b" and render.iso(0) == "1970-01-01T00:00:00Z"


def test_ingest(spark, tmp_path):
    recorded = {"A": [(OPEN + k // 2, 10.0 + k, k) for k in range(7)], "B": [(5, 1.0, 1), (9, 1.0, 1), (7, 1.0, 1)]}
    p = ingest.ReplayProvider(recorded, [ingest.RetryableError("once")])
    failed = ingest.ingest(spark, p, [ingest.Contract("a"), ingest.Contract("b")], str(tmp_path), OPEN + 100, most=2)
    assert list(failed) == ["B"] and spark.read.parquet(f"{tmp_path}/symbol=A").count() == 7
    ingest.ingest(spark, p, [ingest.Contract("A")], str(tmp_path), OPEN + 100)
    assert spark.read.parquet(f"{tmp_path}/symbol=A").count() == 7
    assert ingest.Contract("X", expiration="20240119", strike=150, right="C").title == "X_20240119_C_150"
    for bad in ({"expiration": "2024"}, {"right": "C"}):
        with pytest.raises(ValueError):
            ingest.Contract("X", **bad)
    with pytest.raises(NotImplementedError):
        ingest.provider("polygon")
