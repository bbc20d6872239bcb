"""Which tables a command means, settings, and the stored forms."""

import json
import tomllib

import pytest

import tickloom
from tickloom import cli
from tickloom.functions.clock import Clock
from tickloom.functions.schema import BARS, TICKS, calc_schema, stored_bars, stored_calc, unstored_bars
from tickloom.operators import inspect, stats
from tickloom.sources.discover import discovered, settings
from tickloom.streaming.ingest import Contract, plan, safe_title

OPEN = 1_704_205_800


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    ticks = [("AAPL", OPEN + 60 * i, i, 1_850_000 + 1000 * i, 100) for i in range(20)]
    spark.createDataFrame(ticks, TICKS).write.parquet(f"{at}/AAPL.parquet")
    spark.createDataFrame([("MSFT", *t[1:]) for t in ticks], TICKS).write.parquet(f"{at}/MSFT.PARQUET")
    week = [("IBM", OPEN + 7 * 86_400 * i, 10.0, 11.0, 9.0, 10.0 + i, 100, 10.0, 5) for i in range(4)]
    spark.createDataFrame(week, BARS).write.parquet(f"{at}/weekly.parquet")
    (at / "notes.txt").write_text("no table")
    return at


def test_words_that_name_tables(folder, monkeypatch):
    a, m, w = (str(folder / x) for x in ("AAPL.parquet", "MSFT.PARQUET", "weekly.parquet"))
    assert discovered([str(folder)]) == [a, m, w]
    assert discovered([a, str(folder), a]) == [a, m, w]
    assert discovered(["aapl", "weekly"], str(folder)) == [a, w]
    assert discovered(["s3a://bucket/x"]) == ["s3a://bucket/x"]
    monkeypatch.chdir(folder)
    assert discovered([]) == ["AAPL.parquet", "MSFT.PARQUET", "weekly.parquet"]
    with pytest.raises(ValueError, match="nothing"):
        discovered(["nothing"], str(folder))


def test_settings(folder):
    told = settings(f'output_dir = "{folder}"\nsymbols = ["msft", "AAPL"]\ntz = "UTC"\n[actions]\nAAPL = []')
    assert told.tz == "UTC" and told.paths(["aapl"]) == [str(folder / "AAPL.parquet")]
    assert settings(f'output_dir = "{folder}"\nsymbols = ["aapl"]').paths([]) == [str(folder / "AAPL.parquet")]
    for bad in ('colour = "red"', "symbols = [1]", "tz = 3", 'periods_per_year = "many"', "periods_per_year = true"):
        with pytest.raises(ValueError):
            settings(bad)


def test_ls_of_kinds_with_bytes_and_paths(spark, folder):
    every = [json.loads(x) for x in cli.run(spark, ["ls", "jsonl", str(folder)])]
    assert [(r["symbol"], r["kind"], r["rows"], r["granularity"]) for r in every] == [("AAPL", "tick", 20, None), ("IBM", "bar", 4, "1w"), ("MSFT", "tick", 20, None)]
    for r in every:
        assert r["bytes"] == sum(x.stat().st_size for x in (folder / r["path"].split("/")[-1]).glob("part-*"))
    assert [json.loads(x)["symbol"] for x in cli.run(spark, ["ls", "bars", "jsonl", str(folder)])] == ["IBM"]
    assert len(list(cli.run(spark, ["ls", "ticks", "jsonl", str(folder)]))) == 2


def test_a_settings_file_stands_for_words(spark, folder, tmp_path):
    (tmp_path / "s.toml").write_text(f'output_dir = "{folder}"\nsymbols = ["aapl"]')
    row = json.loads(next(iter(cli.run(spark, ["stat", "jsonl", "--config", str(tmp_path / "s.toml")]))))
    assert (row["symbol"], row["trades"]) == ("AAPL", 20)


def test_wide_bars_are_not_adjusted(spark, folder, tmp_path):
    (tmp_path / "a.toml").write_text('[actions]\nIBM = [{ date = "2024-01-10", split = 2.0 }]\nAAPL = [{ date = "2024-01-10", split = 2.0 }]')
    actions = ["--actions", str(tmp_path / "a.toml")]
    with pytest.raises(ValueError, match="wider than a day"):
        list(cli.run(spark, ["stat", "jsonl", str(folder / "weekly.parquet"), *actions]))
    assert json.loads(next(iter(cli.run(spark, ["stat", "jsonl", str(folder / "AAPL.parquet"), *actions]))))["high"] == pytest.approx(93.45)


def test_stored_forms(spark, folder, tmp_path):
    rows = [json.loads(x) for x in cli.run(spark, ["calc", "5m", "sma:2", "ret:log", "vsma:2", "jsonl", str(folder / "AAPL.parquet")])]
    assert (rows[0]["close"], rows[0]["sma_2"], rows[0]["ret_log"]) == (1_854_000, None, None)
    assert (rows[1]["sma_2"], rows[1]["vsma_2"]) == (1_856_500, 500) and rows[1]["ret_log"] == round(1e8 * __import__("math").log(185.9 / 185.4))
    out = str(tmp_path / "calc")
    list(cli.run(spark, ["calc", "5m", "sma:2", "--output", out, str(folder / "AAPL.parquet")]))
    assert {(f.name, f.dataType) for f in spark.read.parquet(out).schema} == {(f.name, f.dataType) for f in calc_schema("sma_2")}
    empty = spark.createDataFrame([("A", 1, float("nan"), None, float("inf"))], "symbol string, time long, close double, x double, y double")
    assert tuple(stored_calc(empty, {"x": 4, "y": 8}).first()) == ("A", 1, 0, None, None)
    b = spark.createDataFrame([("A", 0, 1.5, 2.25, 1.0, 2.0, 10, 1.75, 3), ("A", 60, 2.0, 2.0, 2.0, 2.0, 0, None, 0)], BARS)
    assert sorted(map(tuple, unstored_bars(stored_bars(b)).collect())) == sorted(map(tuple, b.collect()))


def test_volatility_regime_and_summary(spark, folder):
    rows = [("A", i, v) for i, v in enumerate([1.0, 1.0, 4.0])] + [("B", i, v) for i, v in enumerate([2.0, 2.0, 0.5])] + [("C", 0, 1.0), ("D", 0, 0.0), ("E", 0, None)]
    got = {r.symbol: r.regime for r in stats.volatility_regime(spark.createDataFrame(rows, "symbol string, time long, vol_2 double"), "vol_2").collect()}
    assert {k: v for k, v in got.items() if v} == {"A": "elevated", "B": "calm", "C": "normal"}
    told = tomllib.loads(next(iter(cli.run(spark, ["calc", "1m", "vol:2", "--summary", str(folder / "AAPL.parquet")]))))
    assert told["series"]["AAPL"]["regime"] in ("elevated", "calm", "normal")


def test_unsafe_titles_and_clashes():
    for bad in ("../../x", "", " A", "A.", "a/b", "con", "LPT1.x", "a\tb", ".", "..", "a:b"):
        with pytest.raises(ValueError, match="safe"):
            safe_title(bad)
    assert safe_title("BRK.B") == "BRK.B" and safe_title("COM10")
    with pytest.raises(ValueError):
        plan([Contract("aapl"), Contract("AAPL")], None, 10)


def test_a_replayed_batch_replaces_itself(spark, tmp_path, monkeypatch):
    from tickloom.plans.store import BarStore
    from tickloom.streaming import live

    held = []
    writer = type("W", (), {"foreachBatch": lambda self, f: held.append(f)})()
    stream = type("S", (), {"writeStream": writer})()
    store = BarStore(str(tmp_path / "bars"))
    live.refresh_on_batch(stream, store, str(tmp_path / "history"), "5m", Clock("UTC"))
    batch = spark.createDataFrame([("AAPL", OPEN + 60 * i, i, 1_850_000, 100) for i in range(10)], TICKS)
    for epoch in (0, 0):
        held[0](batch, epoch)
    held[0](batch.selectExpr("symbol", "time + 600 AS time", "seq + 10 AS seq", "price_e4", "size"), 1)
    bars = store.read(spark, store.key("5m", Clock("UTC"), False)).collect()
    assert sum(r.trades for r in bars) == 20 and len(bars) == 4


def test_previews_of_short_series_and_public_names(spark):
    b = spark.createDataFrame([("A", i, i, 10, 1) for i in range(4)] + [("B", 5, 0, 10, 1)], TICKS)
    assert sorted((r.symbol, r.time, r.place) for r in inspect.preview(b).collect()) == [("A", 0, 1), ("A", 1, 2), ("A", 2, 3), ("A", 3, 4), ("B", 5, 1)]
    assert all(getattr(tickloom, name) is not None for name in tickloom.__all__)
    with pytest.raises(AttributeError):
        tickloom.nothing
