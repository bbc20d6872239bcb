"""Mixing sources to target weights by capped water-filling.

Each source's target is its weight's share of all words, at most ``most`` times its own size. Sources above are clamped
and their excess is shared among the rest by weight, again until none is above. A document is then taken
``floor(target / size of its source)`` times, and once more if its seeded hash is at or below its source's cut; the cut
is where the words taken once more come nearest to what is missing. So a decision depends only on a row and its source:
rows are never collected, sorted or numbered, and a source of any size is cut by two small aggregations.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, stage

#: Sources up to which the table of sources is broadcast (about 100 bytes each); beyond, it is joined by a shuffle.
BROADCAST_SOURCES = 50_000
SEED = 17


def water_fill(sizes: Sequence[int], weights: Sequence[float], most: float, total: float | None = None) -> list[float]:
    """Targets that share total (default: the sum of sizes) by weight, none above most times its size."""
    total = sum(sizes) if total is None else total
    targets: list[float] = [0.0] * len(sizes)
    free = list(range(len(sizes)))
    left = total
    while free:
        share = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] > most * sizes[i] * share]
        if not over:
            for i in free:
                targets[i] = float(left) * weights[i] / share
            break
        for i in over:
            targets[i] = float(most * sizes[i])
            left -= most * sizes[i]
        free = [i for i in free if i not in set(over)]
    return targets


def word_count(text) -> F.Column:
    return F.coalesce(F.regexp_count(text, F.lit(SPACE.replace("[", "[^", 1) + "+")), F.lit(0)).cast("long")


def _hash(doc_id, seed: int) -> F.Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))


def source_plan(slim: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = SEED) -> tuple[DataFrame, int]:
    """(source, source_size, target, whole, cut) for the rows (source, size, hash): one row for each source.

    Sources in code-point order, null last, weigh the given weights, repeating. The table of sources (not of rows) is
    worked out on the driver.
    """
    spark = slim.sparkSession
    found = [(r[0], r[1]) for r in slim.groupBy("source").agg(F.sum("size")).collect()]
    found.sort(key=lambda r: (r[0] is None, r[0] or ""))
    sizes = [int(n) for _, n in found]
    targets = water_fill(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    rows = []
    for (source, n), target in zip(found, targets):
        whole = int(target // n) if n else 0
        rows.append((source, int(n), target, whole, int(target - whole * n + 0.5)))
    plan = spark.createDataFrame(rows, "source string, source_size long, target double, whole long, missing long")
    by_bucket = slim.groupBy("source", F.substring("hash", 1, 3).alias("bucket")).agg(F.sum("size").alias("words"))
    order = Window.partitionBy("source").orderBy("bucket")  # at most 4096 buckets of a source
    by_bucket = by_bucket.withColumn("before", F.sum("words").over(order) - F.col("words"))
    p = plan.select(F.col("source").alias("s"), "missing")
    edge = by_bucket.join(F.broadcast(p) if len(rows) <= BROADCAST_SOURCES else p, F.col("source").eqNullSafe(F.col("s")))
    edge = edge.where("before <= missing").groupBy("s").agg(F.max(F.struct("bucket", "before", "missing")).alias("e"))
    edge = stage(edge.select("s", "e.bucket", "e.before", "e.missing"), "edges")
    inside = slim.select("source", "size", "hash")
    at = F.col("source").eqNullSafe(F.col("s")) & (F.substring("hash", 1, 3) == F.col("bucket"))
    inside = inside.join(F.broadcast(edge) if len(rows) <= BROADCAST_SOURCES else edge, at)
    inside = inside.groupBy("s", "hash", "before", "missing").agg(F.sum("size").alias("words"))
    inside = inside.withColumn("upto", F.col("before") + F.sum("words").over(Window.partitionBy("s").orderBy("hash")))
    cut = inside.where("2 * upto - words <= 2 * missing").groupBy("s").agg(F.max("hash").alias("hash"))
    # where not even the first hash of the bucket fits, all buckets before it are taken
    cut = edge.join(cut.withColumnRenamed("s", "c"), F.col("s").eqNullSafe(F.col("c")), "left").select("s", F.coalesce("hash", "bucket").alias("cut"))
    out = plan.join(cut, F.col("source").eqNullSafe(F.col("s")), "left")
    return stage(out.select("source", "source_size", "target", "whole", F.coalesce("cut", F.lit("")).alias("cut")), "mix"), len(rows)


def mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), most: int = 3, seed: int = SEED) -> DataFrame:
    """docs (doc_id, text, source, ...) with __size, __source_size, __target and __times (repetitions, 0 or more).

    A null text has size 0; a null source is a source of its own; a null doc_id hashes as the empty string; rows that
    repeat a doc_id share one decision. An empty table stays empty.
    """
    sized = docs.withColumns({"__size": word_count(docs["text"]), "__hash": _hash(docs["doc_id"], seed)})
    slim = stage(sized.select("source", F.col("__size").alias("size"), F.col("__hash").alias("hash")), "sizes")
    plan, n = source_plan(slim, weights, most, seed)
    plan = plan.select(F.col("source").alias("__source"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), F.col("whole").alias("__whole"), F.col("cut").alias("__cut"))
    if n <= BROADCAST_SOURCES:
        out = sized.join(F.broadcast(plan), sized["source"].eqNullSafe(plan["__source"]), "left")
    else:  # a hot source is dealt over 64 salts
        salted = sized.withColumn("__salt", F.pmod(F.xxhash64("__hash"), F.lit(64)))
        plan = plan.withColumn("__salt2", F.explode(F.sequence(F.lit(0), F.lit(63))))
        out = salted.join(plan, salted["source"].eqNullSafe(plan["__source"]) & (F.col("__salt") == F.col("__salt2")), "left").drop("__salt", "__salt2")
    times = F.col("__whole") + (F.col("__hash") <= F.col("__cut")).cast("long")
    return out.withColumn("__times", F.least(times, F.lit(most))).drop("__source", "__whole", "__cut", "__hash")


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: each row of docs as often as it is taken."""
    out = mix(docs, **how).where("__times > 0")
    return out.withColumn("__n", F.explode(F.sequence(F.lit(1), F.col("__times")))).select(*docs.columns)
