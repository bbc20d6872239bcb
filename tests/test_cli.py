"""Commands, their words, and reports."""

import json
import tomllib

import pytest

from tickloom import cli
from tickloom.functions.report import toml
from tickloom.functions.schema import TICKS

OPEN = 1_704_205_800  # 2024-01-02 09:30 in New York


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    """20 ticks, one a minute."""
    out = str(tmp_path_factory.mktemp("ticks") / "aapl")
    spark.createDataFrame([("AAPL", OPEN + 60 * i, i, 1_850_000 + 1000 * i, 100) for i in range(20)], TICKS).write.parquet(out)
    return out


def test_words():
    w = cli.classify(["csv", "RTH", "x/2024.parquet", "5m", "sma:20", "2024-01-02..", "ret:log"], "America/New_York")
    assert (w.rth, w.fill, w.every, w.specs, w.form, w.paths) == (True, False, "5m", ["sma:20", "ret:log"], "csv", ["x/2024.parquet"])
    assert w.span == (1_704_171_600, None)
    for twice in (["1m", "5m"], ["rth", "rth"], ["csv", "md"], ["2024-01-02..", "..2024-01-03"]):
        with pytest.raises(ValueError):
            cli.classify(twice, "UTC")


def test_toml_round_trip():
    report = {"title": 'a "b"\n', "n": 3, "x": 1.5, "yes": True, "none": None, "nan": float("nan"), "series": {"A.B": {"n": 1, "list": [1, 2]}}, "rows": [{"k": 1}, {"k": 2}]}
    got = tomllib.loads(toml(report))
    assert got == {k: v for k, v in report.items() if k not in ("none", "nan")}


def test_bars_and_flags_before_ranges(spark, path):
    lines = list(cli.run(spark, ["bars", "5m", "rth", "csv", path]))
    assert len(lines) == 5 and lines[1].split(",")[1:3] == [str(OPEN), "1850000"]
    got = [json.loads(x) for x in cli.run(spark, ["bars", "5m", "jsonl", f"{OPEN}..", path, "--end", str(OPEN + 299)])]
    assert [r["trades"] for r in got] == [5]
    assert len(list(cli.run(spark, ["bars", "5m", "csv", "rth", "--session", "20:00-23:00", path]))) == 1


def test_stat_ls_verify_and_summary(spark, path):
    row = json.loads(next(iter(cli.run(spark, ["stat", "jsonl", path]))))
    assert (row["trades"], row["volume"], row["low"], row["high"]) == (20, 2000, 185.0, 186.9)
    assert "AAPL" in "\n".join(cli.run(spark, ["ls", "md", path]))
    assert tomllib.loads("\n".join(cli.run(spark, ["verify", path])))["series"]["AAPL"]["repeated_keys"] == 0
    assert any(line.startswith("AAPL") for line in cli.run(spark, ["calc", "5m", "sma:2", "raw", path]))
    report = next(iter(cli.run(spark, ["calc", "5m", "sma:2", "--summary", path])))
    assert tomllib.loads(report)["series"]["AAPL"]["bars"] == 4


def test_sync_and_errors(spark, path, tmp_path):
    assert list(cli.run(spark, ["sync", "5m", "raw", path, "--store", str(tmp_path)]))[0].split("\t")[1] == "4"
    assert "would remove" in next(iter(cli.run(spark, ["unsync", "5m", "--store", str(tmp_path)])))
    for bad in (["calc", "5m", path], ["bars", "5m"], ["stat", "raw", path], ["sync", path]):
        with pytest.raises(ValueError):
            list(cli.run(spark, bad))
