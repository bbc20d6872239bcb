"""Times the headline queries on BENCH_SF_DIR (default sf0.1) and prints one JSON line."""

import json
import os
import time
from pathlib import Path

from pyspark.sql import SparkSession

from tickloom import catalogue

HEADLINE = [
    "bars_utc_5m", "bars_session_1h_rth", "bars_daily_ny", "bars_monthly", "bars_from_bars_1m_to_15m", "bars_fill_session", "stat_ticks", "calc_sma", "calc_ema", "calc_rsi", "calc_vol",
    "adjust_splits_bars", "adjust_total_return", "detect_splits", "summary_returns", "catalog_ls", "recent_n_per_symbol",
]


def main() -> None:
    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, times = catalogue.queries(), {}
    queries[HEADLINE[0]](spark, sf).write.format("noop").mode("overwrite").save()  # starts the executors' threads
    for name in HEADLINE:
        began = time.time()
        queries[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf).name}))


if __name__ == "__main__":
    main()
