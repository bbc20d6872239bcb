"""Downloads, provider shapes, bounded answers and the hex form."""

import json
import signal
import struct
import threading
import time

import pytest

from tickloom import cli
from tickloom.functions.schema import TICKS, SchemaError
from tickloom.plans import tools
from tickloom.streaming import download as d
from tickloom.streaming.ingest import Contract, ReplayProvider, RetryableError

OPEN = 1_704_205_800
TICK = [(OPEN + i // 2, 10.0 + i, i + 1) for i in range(9)]
FAST = {"retry_spacing": 0.0, "most": 2}


def read(spark, path):
    return [tuple(r) for r in spark.read.parquet(path).orderBy("seq").select("time", "seq", "price_e4", "size").collect()]


def test_cadence_changes_files_and_no_rows(spark, tmp_path):
    want, files = [(t, i, round(p * 10_000), s) for i, (t, p, s) in enumerate(TICK)], []
    for every in (-1, 0, 3600):
        at = str(tmp_path / f"c{every}")
        got = d.download(spark, lambda: ReplayProvider({"A": TICK}), [Contract("a")], at, OPEN + 100, commit=every, options=("zstd:3", "page=64k"), **FAST)
        assert (got.added, got.failed, got.code) == ({"A": 9}, {}, 0)
        assert read(spark, f"{at}/symbol=A") == want
        files.append(len(list((tmp_path / f"c{every}" / "symbol=A").glob("part-*.zstd.parquet"))))
    assert files[0] == files[2] == 1 < files[1]


def test_a_failure_keeps_what_came_and_stops_no_other(spark, tmp_path):
    class Torn(ReplayProvider):
        def ticks(self, contract, start, *rest):
            if contract.title == "B" and start > OPEN + 1:
                raise OSError("torn")
            return super().ticks(contract, start, *rest)

    at, both = str(tmp_path), [Contract("A"), Contract("B")]
    got = d.download(spark, lambda: Torn({"A": TICK, "B": TICK}), both, at, OPEN + 100, commit=-1, **FAST)
    assert got.failed == {"B": "torn"} and got.code == 1 and got.added == {"A": 9, "B": 4}
    got = d.download(spark, lambda: ReplayProvider({"A": TICK, "B": TICK}), both, at, OPEN + 100, **FAST)
    assert got.added == {"A": 0, "B": 5} and read(spark, f"{at}/symbol=B") == read(spark, f"{at}/symbol=A")


def test_one_writer_and_one_schema(spark, tmp_path):
    at = str(tmp_path)
    with d.locked(spark, f"{at}/symbol=A"):
        got = d.download(spark, lambda: ReplayProvider({"A": TICK}), [Contract("A")], at, OPEN + 100, **FAST)
        assert "has a writer" in got.failed["A"]
    assert d.stored(spark, f"{at}/symbol=A") is None
    spark.range(3).write.parquet(f"{at}/symbol=X")
    with pytest.raises(SchemaError):
        d.stored(spark, f"{at}/symbol=X")


def test_connections_are_retried_and_replaced_once():
    made = []

    def connect():
        made.append(1)
        if len(made) == 1:
            raise RetryableError("not up yet")
        return ReplayProvider({"A": TICK})

    link = d.Link(connect)
    assert (len(made), link.generation) == (2, 1)
    for _ in range(3):
        link.reconnect(1)
    assert (len(made), link.generation) == (3, 2)
    link._client.errors = [ConnectionError("dead"), OSError("other")]
    with pytest.raises(RetryableError):
        link.call("ticks", Contract("A"), OPEN, OPEN + 9, 5, False)
    assert link.generation == 3 and link.call("head", Contract("A")) == OPEN
    with pytest.raises(RetryableError):
        d.tried(lambda: (_ for _ in ()).throw(RetryableError("no")), 2, d.Pacer(0.0))


def test_pacing_and_cancelling(spark, tmp_path):
    now, slept = [0.0], []

    class Fake(d.Cancel):
        def sleep(self, seconds):
            slept.append(round(seconds, 6))

    p = d.Pacer(2.0, Fake(), clock=lambda: now[0])
    for _ in range(3):
        p.wait()
    now[0] = 100.0
    p.wait()
    assert slept == [0, 2, 4, 0]
    cancel, left = d.Cancel(), []
    threading.Timer(0.1, cancel.stop).start()
    began = time.monotonic()
    with pytest.raises(d.Canceled):
        cancel.sleep(30)
    assert time.monotonic() - began < 10
    got = d.download(spark, lambda: ReplayProvider({"A": TICK}), [Contract("A")], str(tmp_path), OPEN + 100, cancel=cancel, **FAST)
    assert got.stopped and got.code == 130 and not got.failed
    with d.Cancel().on_interrupt(left.append) as c:
        signal.raise_signal(signal.SIGINT)
        assert c and not left
        signal.raise_signal(signal.SIGINT)
        assert left == [130]


def test_provider_shapes():
    asked = []
    p = d.DatabentoShape(lambda *a: asked.append(a) or [(OPEN * 10**9 + 999_999_999, 1_500_000_000, 7)], "S", "O")
    assert p.ticks(Contract("A"), OPEN, OPEN + 10**6, 1000) == [(OPEN, 1.5, 7)] and asked == [("S", "A", OPEN, OPEN + 86_400)]
    option = {"expiration": "20240119", "strike": 150, "right": "C"}
    p.ticks(Contract("A", **option, local_symbol="A  240119C"), OPEN, OPEN + 5, 1000)
    assert asked[1] == ("O", "A  240119C", OPEN, OPEN + 5)
    for bad in (lambda: p.head(Contract("A")), lambda: p.ticks(Contract("A"), 1, 2, 3, True), lambda: p.ticks(Contract("A", **option), 1, 2, 3)):
        with pytest.raises(ValueError):
            bad()
    ib = d.IbkrShape(lambda c, start, most, rth: [(start, 1.0, most), (start + 9, 1.0, 1)], lambda c: OPEN)
    assert ib.ticks(Contract("A"), OPEN, OPEN + 9, 5000) == [(OPEN, 1.0, 1000)]


def test_writer_options():
    assert d.parquet_options("zstd:9", "page=1m", "GROUP=64m") == {"compression": "zstd", "parquet.compression.codec.zstd.level": "9", "parquet.page.size": "1048576", "parquet.block.size": "67108864"}
    for bad in (["snappy:3"], ["brie"], ["zstd", "gzip"], ["page=1g"]):
        with pytest.raises(ValueError):
            d.parquet_options(*bad)


def test_bounded_answers(spark):
    rows = spark.createDataFrame([("A", OPEN + 60 * i, i, 10_000 * (i + 1), 5) for i in range(6)], TICKS)
    got = tools.get_bars(rows, "1m", "America/New_York", 4)
    assert len(got["items"]) == 4 and got["truncated"] and got["items"][0]["time"] == "2024-01-02T09:30:00-05:00"
    assert not tools.get_bars(rows, "1m")["truncated"] and (tools.limit(None), tools.limit(0), tools.limit(10**9)) == (1000, 1, 10_000)
    assert [r["sma_2"] for r in tools.get_indicators(rows, "1m", ["sma:2"])["items"]][:2] == [None, 1.5]
    for answer in (got, tools.list_series(rows), tools.get_stat(rows), tools.get_plot(rows, "1m")):
        json.dumps(answer, allow_nan=False)


def test_hex(spark, tmp_path):
    path = str(tmp_path / "a.parquet")
    spark.createDataFrame([("A", OPEN + i, i, 10_000, 5) for i in range(3)], TICKS).write.parquet(path)
    symbol, frame = list(cli.run(spark, ["bars", "1m", "hex", path]))[0].split("\t")
    assert symbol == "A" and struct.unpack("<IIIIIqIQ", bytes.fromhex(frame)) == (OPEN, 10_000, 10_000, 10_000, 10_000, 15, 10_000, 3)
    frame = list(cli.run(spark, ["calc", "1m", "sma:2", "hex", path]))[0].split("\t")[1]
    assert struct.unpack("<IIi", bytes.fromhex(frame)) == (OPEN, 10_000, -(1 << 31))
    with pytest.raises(ValueError, match="hex"):
        list(cli.run(spark, ["ls", "hex", path]))
