"""Which tables a command means: paths, folders of tables, symbols of the output folder, and a settings file."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.clock import NEW_YORK
from ..functions.schema import normalize_symbol

SUFFIX = ".parquet"


def _is_table(p: Path) -> bool:
    """A Parquet file, or a folder that Spark wrote."""
    if p.is_dir():
        return p.name.lower().endswith(SUFFIX) or any(x.suffix.lower() == SUFFIX and x.name.startswith("part-") for x in p.iterdir())
    return p.is_file() and p.name.lower().endswith(SUFFIX)


def tables_below(folder: str | Path) -> list[str]:
    """The tables right below a folder, by name; the extension's case does not matter."""
    return sorted(str(p) for p in Path(folder).iterdir() if not p.name.startswith((".", "_")) and _is_table(p))


def discovered(words: list[str], output_dir: str = ".") -> list[str]:
    """The tables that the words mean, each once, in their order; without words, those of the current folder.

    A word is a URI, which is taken as it is, a table, a folder of tables, or a symbol whose table is in output_dir, as
    written or in capitals.
    """
    out: list[str] = []
    for w in words or ["."]:
        p = Path(w)
        if "://" in w or p.exists() and _is_table(p):
            found = [w]
        elif p.is_dir():
            found = tables_below(p)
        else:
            named = (Path(output_dir) / f"{s}{SUFFIX}" for s in (w, normalize_symbol(w)))
            found = [str(x) for x in named if x.exists()][:1]
            if not found:
                raise ValueError(f"no file, folder or symbol is named {w!r} (symbols are looked for in {output_dir})")
        out += [x for x in found if x not in out]
    if not out:
        raise ValueError("no tables found" + ("" if words else " in the current folder"))
    return out


def table_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(symbol, path, bytes): the tables that hold a symbol and the size of their files with rows of it."""
    each = []
    for p in paths:
        at = spark.read.parquet(p).select("symbol", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_size").alias("size")).distinct()
        each.append(at.groupBy("symbol").agg(F.sum("size").alias("bytes")).withColumn("path", F.lit(p)))
    out = each[0]
    for x in each[1:]:
        out = out.unionByName(x)
    return out.groupBy("symbol").agg(F.array_join(F.sort_array(F.collect_list("path")), ", ").alias("path"), F.sum("bytes").alias("bytes"))


@dataclass
class Settings:
    """What a settings file may say; any other key is refused, but for ``[actions]``, which `load_actions` reads."""

    output_dir: str = "."
    symbols: list[str] = field(default_factory=list)
    tz: str = NEW_YORK
    session: str | None = None
    store: str | None = None
    periods_per_year: float | None = None

    def paths(self, words: list[str]) -> list[str]:
        """The tables that the words mean; without words, those of the file's symbols, if it names any."""
        return discovered(list(words) or list(self.symbols), self.output_dir)


def settings(text: str) -> Settings:
    told = tomllib.loads(text)
    told.pop("actions", None)
    known = {f.name: f for f in fields(Settings)}
    if strange := sorted(told.keys() - known.keys()):
        raise ValueError(f"unknown settings: {', '.join(strange)}")
    kinds = {"symbols": list, "periods_per_year": (int, float)}
    for name, value in told.items():
        if not isinstance(value, kinds.get(name, str)) or isinstance(value, bool) or name == "symbols" and not all(isinstance(x, str) for x in value):
            raise ValueError(f"a wrong kind of value: {name}")
    return Settings(**told)
