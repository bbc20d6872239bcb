"""Quality rules: base rules and a hashed n-gram log-likelihood ratio, all as DataFrame expressions.

The ratio compares two multinomials over hashed word unigrams and bigrams: of trusted documents (labelled good) and of
the whole corpus. A document's score is its summed log ratio divided by its number of n-grams. The threshold is fitted
on the labelled sample and then applied to every document.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, stage, words

BUCKETS = 10_000
#: Labelled rows that fit the target multinomial and the threshold: those of the least hashes of their doc_id.
SAMPLE = 20_000
#: Fixed value: the symbols of the base rule.
SYMBOLS = "#*$%&|<>"


def bound(df: DataFrame, **columns: F.Column) -> DataFrame:
    """df with the columns, each worked out once for a row.

    A condition that always holds but counts as not deterministic keeps the optimiser from moving a filter on them below
    this projection and from putting their expressions in the place of their names, where a lambda would repeat them for
    each word. Their values are deterministic. A comparison with rand() would not do, as the optimiser decides it.
    """
    kept = [c for c in df.columns if c not in columns]
    always = F.spark_partition_id() >= 0
    return df.select(*kept, *[F.when(always, x).alias(name) for name, x in columns.items()])


def _n_repeat(s: str) -> F.Column:
    """Words in 3-word windows found twice or more, from the windows' hashes h and places i, sorted."""
    same = lambda x, j, d: F.coalesce(x["h"] == F.get(F.col(s), j + F.lit(d))["h"], F.lit(False))
    found = F.filter(F.col(s), lambda x, j: same(x, j, -1) | same(x, j, 1))
    return F.size(F.array_distinct(F.flatten(F.transform(found, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))


def with_words(docs: DataFrame) -> DataFrame:
    return bound(docs, __w=words(docs["text"]))


def base_rules(worded: DataFrame, buckets: int | None = None, ratios: list[float] | None = None) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed to rows with text and __w, and
    takes __w away; with ratios of so many buckets, adds llr too.

    Columns of these names are replaced. Arrays are dropped as soon as what is wanted of them is known, since each
    step copies its rows.
    """
    text = F.coalesce("text", F.lit(""))
    bare = lambda x: F.translate(x, " \t\n\x0b\x0c\r", "")
    windows = F.transform(F.sequence(F.lit(0), F.size("__w") - 3), lambda i: F.xxhash64(F.get("__w", i), F.get("__w", i + 1), F.get("__w", i + 2)))
    out = bound(
        worded,
        n_words=F.size("__w").cast("long"),
        word_chars=F.length(bare(text)).cast("long"),
        n_symbols=(F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"),
        __lines=F.filter(F.split(text, "\n"), lambda x: F.length(bare(x)) > 0),
        __h=F.when(F.size("__w") >= 4, windows).otherwise(F.array().cast("array<bigint>")),
        **({} if ratios is None else {"__b": _buckets(buckets)}),
    ).drop("__w")
    repeated = F.size("__h") > F.size(F.array_distinct("__h"))
    places = F.sort_array(F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    out = bound(
        out,
        n_dup_lines=(F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"),
        __s=F.when(repeated, places).otherwise(F.array().cast("array<struct<h:bigint,i:int>>")),
        **({} if ratios is None else {"llr": score(ratios)}),
    ).drop("__lines", "__h", "__b")
    out = bound(out, n_repeat_words=F.when(F.size("__s") > 0, _n_repeat("__s")).otherwise(0).cast("long")).drop("__s")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed)


def _buckets(buckets: int) -> F.Column:
    """Buckets of a row's word unigrams and bigrams."""
    one = F.transform("__w", lambda w: F.pmod(F.xxhash64(w), F.lit(buckets)).cast("int"))
    two = F.transform(F.sequence(F.lit(0), F.size("__w") - 2), lambda i: F.pmod(F.xxhash64(F.get("__w", i), F.get("__w", i + 1)), F.lit(buckets)).cast("int"))
    return F.when(F.size("__w") > 1, F.concat(one, two)).otherwise(one)


def _counts(worded: DataFrame, buckets: int) -> dict[int, int]:
    rows = worded.select(F.explode(_buckets(buckets)).alias("b")).groupBy("b").agg(F.count(F.lit(1)))
    return dict(map(tuple, rows.collect()))  # at most `buckets` rows


def score(ratios: list[float]) -> F.Column:
    """The length-normalised log-likelihood ratio of a row with __w; of no words, 0."""
    table = F.split(F.lit(",".join(map(repr, ratios))), ",").cast("array<double>")
    total = F.aggregate(F.col("__b"), F.lit(0.0), lambda acc, b: acc + F.get(table, b))
    return F.when(F.size("__b") > 0, total / F.size("__b")).otherwise(0.0)


def fitted_threshold(scores: list[tuple[float, int]], least_kept: float = 0.995) -> float:
    """The score that parts good (1) from bad (0) with the least weighted error, kept low enough for least_kept of the good.

    Of equal errors, the lowest score. Without one of the kinds nothing is rejected.
    """
    scores = sorted(scores)
    n = [sum(q == 0 for _, q in scores), sum(q == 1 for _, q in scores)]
    if not n[0] or not n[1]:
        return -math.inf
    best, least, lost, caught = -math.inf, 1.0, 0, 0
    for i, (x, q) in enumerate(scores):
        if i and x > scores[i - 1][0]:
            error = lost / n[1] + 1 - caught / n[0]
            if error < least and lost <= (1 - least_kept) * n[1]:
                best, least = (x + scores[i - 1][0]) / 2, error
        lost += q == 1
        caught += q == 0
    return best


def quality_rules(docs: DataFrame, labels: DataFrame, buckets: int = BUCKETS, sample: int = SAMPLE) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, llr and kept.

    labels: (doc_id, quality); of the labelled rows the `sample` rows of the least hashes fit the target multinomial
    and the threshold, the raw multinomial counts every document. A null or empty text has no words and fails the base
    rules. Rows that repeat, null ids and unknown columns pass through; null or other labels than 0 and 1 are unused,
    and without good or without bad labels only the base rules reject. A document with labels of both kinds counts as
    bad. Columns of docs that have the names of added ones are replaced; names that begin with two underscores are taken.
    The driver holds one number for each bucket and sampled row.
    """
    worded = with_words(docs)
    known = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.min("quality").alias("__q"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    known = stage(known.select(F.col("doc_id").alias("__id"), "__q"), "labelled")
    held = docs.select("doc_id", "text").join(F.broadcast(known), F.col("doc_id") == F.col("__id"))
    held = stage(with_words(held).select("doc_id", "__q", "__w"), "sample")
    raw, target = _counts(worded.select("__w"), buckets), _counts(held.where("__q = 1"), buckets)
    all_raw, all_target = sum(raw.values()) + buckets, sum(target.values()) + buckets
    ratios = [math.log((target.get(b, 0) + 1) / all_target) - math.log((raw.get(b, 0) + 1) / all_raw) for b in range(buckets)]
    scored = bound(held, __b=_buckets(buckets)).select(score(ratios), "__q", F.size("__w"))
    threshold = fitted_threshold([(x, q) for x, q, n in scored.collect() if n >= 50])
    return base_rules(worded, buckets, ratios).withColumn("kept", ~F.col("base_failed") & (F.col("llr") >= F.lit(threshold)))
