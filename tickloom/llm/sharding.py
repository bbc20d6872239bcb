"""Sharding by a minimax contiguous partition.

Groups of equal texts are atomic and ordered by the hash of their text. The smallest capacity with which a greedy pass
over the ordered groups needs no more than the given shards is found by binary search, and the groups are cut there.

The ordered groups are never collected. The driver holds sums over hash prefixes; where a pass would cut inside a prefix
that still holds several groups, only such prefixes are summed again one step finer, until every cut falls between
groups. So what the driver holds depends on the number of shards, not on the rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stage

_FIRST, _MORE, _KEY = 3, 2, 32  # hexadecimal digits of the first prefixes, of a step, and of a whole key
SALTS = 16


class Sums:
    """Ordered prefixes with their bytes and numbers of groups."""

    def __init__(self, parts: dict[str, tuple[int, int]]):
        self.names = sorted(parts)
        self.atomic = [parts[n][1] == 1 or len(n) >= _KEY for n in self.names]
        self.ends, at = [], 0
        for n in self.names:
            at += parts[n][0]
            self.ends.append(at)
        self.total = at

    def starts(self, i: int) -> int:
        return self.ends[i - 1] if i else 0

    def advance(self, at: int, most: int, fine: bool) -> tuple[int, int | None]:
        """(the furthest cut within most bytes from at, the divisible prefix in which the true cut lies)."""
        i = bisect_right(self.ends, at + most)
        if i == len(self.ends):
            return self.total, None
        end = max(self.starts(i), at)
        if not self.atomic[i] and self.starts(i) < at + most:
            return (at + most if fine else end), i
        return end, None

    def feasible(self, most: int, shards: int, fine: bool) -> bool:
        at = 0
        for _ in range(shards):
            to, _i = self.advance(at, most, fine)
            if to == self.total:
                return True
            if to == at:
                return False
            at = to
        return False

    def capacity(self, shards: int, fine: bool) -> int:
        lo, hi = -(-self.total // shards), self.total
        while lo < hi:
            mid = (lo + hi) // 2
            lo, hi = (lo, mid) if self.feasible(mid, shards, fine) else (mid + 1, hi)
        return lo

    def unclear(self, low: int, high: int, shards: int) -> set[int]:
        """Divisible prefixes between the least and the furthest place of each cut for capacities from low to high."""
        out: set[int] = set()
        a = b = 0
        for _ in range(shards):
            a, _i = self.advance(a, low, False)
            b, _i = self.advance(b, high, True)
            first, last = bisect_right(self.ends, a), bisect_left(self.ends, b)
            out.update(i for i in range(first, min(last + 1, len(self.ends))) if not self.atomic[i])
            if b >= self.total:
                break
        return out


def balanced_cuts(sums: Sums, capacity: int, shards: int) -> tuple[list[int], set[int]]:
    """(indices of the prefixes after which to cut, divisible prefixes that are in the way).

    Every shard keeps to the capacity; within it, cuts lie nearest to an even share of what is left, so that large
    atomic groups do not leave later shards empty.
    """
    unclear: set[int] = set()
    floor, at = [0] * shards, sums.total  # floor[k]: the least place of cut k from which the rest still fits
    for k in range(shards - 1, -1, -1):
        i = bisect_left(sums.ends, at - capacity) if at > capacity else -1
        if i >= 0:
            if not sums.atomic[i] and sums.ends[i] != at - capacity:
                unclear.add(i)
            at = sums.ends[i]
        else:
            at = 0
        floor[k] = at
    cuts, at = [], 0
    for k in range(shards - 1):
        want = at + (sums.total - at) // (shards - k)
        i = bisect_right(sums.ends, want)
        if i < len(sums.ends) and not sums.atomic[i]:
            unclear.add(i)
        below, above = (sums.starts(i), sums.ends[i] if i < len(sums.ends) else sums.total)
        options = [x for x in (below, above, floor[k + 1]) if floor[k + 1] <= x <= at + capacity and x >= at]
        if not options:
            j = bisect_right(sums.ends, at + capacity)
            if j < len(sums.ends) and not sums.atomic[j]:
                unclear.add(j)
            options = [max(at, sums.starts(j))]
        at = min(options, key=lambda x: (abs(x - want), x))
        cuts.append(bisect_left(sums.ends, at) if at else -1)
    return cuts, unclear


def minimax_cuts(groups: DataFrame, shards: int) -> tuple[list[str], int]:
    """(keys after which to cut, capacity) for groups (key, size), keys of 32 hexadecimal digits, each once."""

    def summed(df: DataFrame, digits: int) -> dict[str, tuple[int, int]]:
        found = df.groupBy(F.substring("key", 1, digits).alias("p")).agg(F.sum("size"), F.count(F.lit(1)), F.min("key"))
        # a prefix of one group is named by its whole key: no finer look is needed
        return {(key if n == 1 else p): (int(size), n) for p, size, n, key in found.collect()}

    parts = summed(groups, _FIRST)
    while True:
        sums = Sums(parts)
        if not parts:
            return [], 0
        low, high = sums.capacity(shards, True), sums.capacity(shards, False)
        again = sums.unclear(low, high, shards) if low != high else set()
        if not again:
            cuts, again = balanced_cuts(sums, high, shards)
            if not again:
                return ["" if c < 0 else sums.names[c] for c in cuts], high
        by_digits: dict[int, list[str]] = {}
        for i in again:
            by_digits.setdefault(len(sums.names[i]), []).append(sums.names[i])
        for digits, names in by_digits.items():
            for n in names:
                del parts[n]
            wanted = groups.sparkSession.createDataFrame([(n,) for n in names], "p string")
            found = groups.join(F.broadcast(wanted), F.substring("key", 1, digits) == F.col("p"), "left_semi")
            parts |= summed(found, min(digits + _MORE, _KEY))


def sharded(docs: DataFrame, shards: int = 40) -> DataFrame:
    """(doc_id, size, text_crc32, shard, slot) of each row of docs (doc_id, text).

    size: UTF-8 bytes of the text plus 16. A null text counts as empty and shares the group of empty texts. Repeated
    rows each get a slot of their own; rows of a null doc_id are placed like others. Slots count from 0 without gaps
    within a shard, in the order of hash prefix, salt, text hash and doc_id; fewer groups than shards leave shards
    empty. Other columns are ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    slim = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.md5(F.encode(text, "UTF-8")).alias("key"))
    slim = stage(slim, "sizes")
    groups = stage(slim.groupBy("key").agg(F.sum("size").alias("size")), "groups")
    cuts, _ = minimax_cuts(groups, shards)
    shard = F.lit(0)
    for c in cuts:
        shard = shard + ((F.substring("key", 1, len(c)) > F.lit(c)) if c else F.lit(True)).cast("int")
    # places: by bucket of hash prefix and salt, so that one large group is dealt over several tasks
    placed = slim.withColumns({"shard": shard, "__bucket": F.substring("key", 1, 3), "__salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")})
    at = ["shard", "__bucket", "__salt"]
    counts = placed.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))  # at most 16 ** 3 * SALTS rows and one more for each cut
    before = F.sum("n").over(Window.partitionBy("shard").orderBy("__bucket", "__salt")) - F.col("n")
    counts = counts.withColumn("before", before).drop("n")
    inside = F.row_number().over(Window.partitionBy(*at).orderBy("key", "doc_id")) - 1
    out = placed.withColumn("inside", inside).join(F.broadcast(counts), at)
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("inside") + F.col("before")).cast("long").alias("slot"))
