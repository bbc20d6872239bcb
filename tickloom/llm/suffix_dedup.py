"""Suffix-array dedup of byte strings that repeat anywhere in the corpus.

A byte goes if a string of `length` bytes that covers it starts at another place too. Strings are dealt into shards by
content: each string's anchor is the 64-byte gram of the least hash in it, so equal strings have equal anchors and meet
in one shard. Only anchors that occur at two places or more are dealt, as stretches of text that hold all strings of an
anchor. Each shard sorts the suffixes of its distinct stretches by Larsson-Sadakane refinement, finds the common prefixes
of neighbours by Kasai's bound, and marks the strings whose prefix of `length` bytes a neighbour shares. An anchor whose
stretches do not fit one shard is split over several, which are merged by binary search.

Equal texts form a class at once and enter the search as one, whatever their number, and so do equal stretches: a shard
holds a stretch once, and one at two places or more repeats as a whole. Anchors at many places are dealt by the content next
to them as well, and those at very many by each whole string, so that no task gets a whole group of different contexts
and the parts of one anchor stay below HOTTEST stretches.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, prefix_hashes, stage, text_chunks, unstage, _powers

LENGTH, GRAM = 200, 64
#: Bytes of distinct stretches in a shard.
SHARD = 1 << 20
#: An anchor at more places than HOT is dealt in blocks of BLOCK string starts, each by the content they share; at more
#: than HOTTEST, in blocks of one.
HOT, BLOCK, HOTTEST = 1_000, 17, 100_000
#: Stretches that a task remembers to have given the bytes of.
SEEN = 200_000
#: Tasks that the places of one stretch of such anchors go to.
SALTS = 16


# -- anchors --------------------------------------------------------------------------------------------------------


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w neighbours of x."""
    n = len(x)
    if n < w:
        return x[:0]
    padded = np.full(-(-n // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(place, first start, last start, hash) of each anchor: it is that of all strings from the first to the last start."""
    gram = min(GRAM, length)
    n = len(data)
    if n < length:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    p = prefix_hashes(data)
    _, down = _powers(n + 1)
    h = mix((p[gram:] - p[:-gram]) * down[: n - gram + 1])
    bits = np.uint64(max(20, int(n).bit_length()))
    least = _sliding_least((h >> bits << bits) | np.arange(len(h), dtype=np.uint64), length - gram + 1)
    place = (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
    start = np.arange(len(place))
    # strings that do not cross texts
    end_of = offsets[1:][np.searchsorted(offsets[1:], start, "right")]
    start = start[start + length <= end_of]
    place = place[start]
    if not len(start):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    new = np.r_[True, (place[1:] != place[:-1]) | (start[1:] != start[:-1] + 1)]
    first = start[new]
    last = start[np.r_[new[1:], True]]
    place = place[new]
    return place, first, last, h[place]


def _key(raw: bytes) -> bytes:
    return hashlib.md5(raw).digest()


def _anchor_rows(batches, length: int):
    """(hash, key, place) of each anchor; key is the text's."""
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(0), 1 << 19):
            place, _, _, h = anchors(data, offsets, length)
            text = np.searchsorted(offsets, place, "right") - 1
            at = place - offsets[text]
            raw = data.tobytes()
            keys = pa.array([_key(raw[a:b]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], pa.binary())
            yield pa.record_batch([pa.array(h.view(np.int64)), keys.take(pa.array(text)), pa.array(at.astype(np.int32))], ["hash", "key", "place"])


def _stretches(batches, length: int):
    """(at, digest, hot, key, start, size, bytes) of the stretches of the wanted anchors: what they are dealt by, a hash
    of their bytes, whether their anchor is at many places, the text's key and the place in it.

    The bytes of a stretch come with the first of its rows, or with a few if the task has seen many others since.
    """
    schema = pa.schema([("at", pa.int64()), ("digest", pa.int64()), ("hot", pa.bool_()), ("key", pa.binary()), ("start", pa.int32()), ("size", pa.int32()), ("bytes", pa.binary())])
    seen: set[tuple[int, int]] = set()
    for batch in batches:
        out, size = [], 0
        for text, key, wanted in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if _key(raw) != key:  # another text of the same doc_id
                continue
            data = np.frombuffer(raw, np.uint8)
            place, first, last, h = anchors(data, np.array([0, len(data)]), length)
            block = {x["place"]: x["block"] for x in wanted}
            for p, a, z, x in zip(place.tolist(), first.tolist(), last.tolist(), h.view(np.int64).tolist()):
                if p not in block:
                    continue
                k = block[p]
                if not k:
                    pieces = [(x, a, z)]
                else:
                    pieces = []
                    for b in range((p - z) // k, (p - a) // k + 1):
                        lo, hi = p - k * b - k + 1, p - k * b  # starts of the block
                        core = hashlib.blake2b(raw[hi : hi - k + 1 + length], digest_size=8, salt=b.to_bytes(4, "little"))
                        core.update(x.to_bytes(8, "little", signed=True))
                        pieces.append((int.from_bytes(core.digest(), "little", signed=True), max(a, lo), min(z, hi)))
                for at, s, e in pieces:
                    piece = raw[s : e + length]
                    digest = int.from_bytes(hashlib.blake2b(piece, digest_size=8).digest(), "little", signed=True)
                    new = (at, digest) not in seen
                    if new:
                        if len(seen) >= SEEN:
                            seen.clear()
                        seen.add((at, digest))
                        size += len(piece)
                    out.append((at, digest, k > 0, key, s, len(piece), piece if new else None))
                    size += 40
            if size > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)


# -- shards ---------------------------------------------------------------------------------------------------------


def _words_at(data: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on as one big-endian number; zeros follow the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.zeros(len(data), np.uint64)
    for k in range(8):
        out = (out << np.uint64(8)) | padded[k : k + len(data)]
    return out


def suffix_array(data: np.ndarray) -> np.ndarray:
    """The sorted suffixes: Larsson-Sadakane refinement.

    Ranks are the first place of a group; each round sorts only groups of several members, by the rank of what follows
    their sorted prefix, which doubles.
    """
    n = len(data)
    words = _words_at(data)
    order = np.argsort(words, kind="stable").astype(np.int32)
    words = words[order]
    new = np.r_[True, words[1:] != words[:-1]]
    del words
    rank = np.empty(n, np.int32)
    rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
    h = 8
    where = np.flatnonzero(~(new & np.r_[new[1:], True]))  # places in the order whose groups have several members
    while len(where):
        at = order[where].astype(np.int64)
        follow = np.where(at + h < n, rank[np.minimum(at + h, n - 1)].astype(np.int64) + n + 1, n - at)  # past the end: the shorter first
        own = rank[at]
        by = np.argsort((own.astype(np.int64) << 32) | follow, kind="stable")
        at, own, follow = at[by], own[by], follow[by]
        order[where] = at
        new = np.r_[True, (own[1:] != own[:-1]) | (follow[1:] != follow[:-1])]
        group = where[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))]
        rank[at] = group
        where = where[~(new & np.r_[new[1:], True])]
        h *= 2
    return order


def common_prefixes(data: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes, at most `most`, that each suffix in the order shares with the one before it.

    Kasai's bound: a suffix shares with its predecessor at least what the suffix one place to the left shares, less one.
    So places are worked out in waves, each between places already known, from that bound on.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.int64)
    before = np.empty(n, np.int32)
    before[order[1:]] = order[:-1]
    before[order[0]] = -1
    words = _words_at(data)
    known = np.zeros(n, np.int32)

    def extend(at: np.ndarray, low: np.ndarray) -> None:
        have = np.where(before[at] < 0, 0, low)
        live = np.flatnonzero(before[at] >= 0)
        while len(live):
            a, b, k = at[live], before[at[live]].astype(np.int64), have[live].astype(np.int64)
            end = np.maximum(a, b) + k
            inside = (end < n) & (k < most)
            live, a, b, k, end = live[inside], a[inside], b[inside], k[inside], end[inside]
            if not len(live):
                break
            x = words[a + k] ^ words[b + k]
            same = np.full(len(x), 8)
            differ = x != 0
            # bytes before the first that differs, from the place of the highest bit
            high = np.floor(np.log2(np.maximum(x[differ] >> np.uint64(8), np.uint64(0)).astype(np.float64) * 256 + (x[differ] & np.uint64(255)).astype(np.float64))).astype(np.int64)
            same[differ] = 7 - np.minimum(high, 63) // 8
            have[live] = k + np.minimum(same, n - end)
            live = live[(same == 8) & (end + 8 <= n)]
        known[at] = np.minimum(have, most)

    step = 64
    extend(np.arange(0, n, step), np.zeros(-(-n // step), np.int64))
    while step > 1:
        half = step // 2
        at = np.arange(half, n, step)
        extend(at, np.maximum(known[at - half] - half, 0))
        step = half
    return known[order]


class Shard:
    """The strings of distinct stretches, sorted."""

    def __init__(self, stretches: list[bytes], length: int):
        self.length = length
        self.data = np.frombuffer(b"".join(stretches), np.uint8)
        sizes = np.array([len(s) for s in stretches], np.int64)
        self.first = np.cumsum(sizes) - sizes
        starts = np.zeros(len(self.data) + 1, np.int64)
        starts[self.first] += 1
        starts[self.first + sizes - length + 1] -= 1
        self.valid = np.cumsum(starts[:-1]) > 0
        self.repeated = np.zeros(len(self.data), bool)
        order = suffix_array(self.data)
        shared = common_prefixes(self.data, order, length)
        kept = self.valid[order]
        run = np.cumsum(shared < length)[kept]  # strings of one run are equal
        self.order = order[kept]
        if len(run):
            new = np.r_[True, run[1:] != run[:-1]]
            alone = new & np.r_[new[1:], True]
            self.repeated[self.order[~alone]] = True
        self.words = None

    def _rows(self, at: np.ndarray) -> np.ndarray:
        if self.words is None:
            self.words = _words_at(self.data)
        steps = [*range(0, self.length - 7, 8)]
        if self.length % 8:
            steps.append(self.length - 8)
        return self.words[at[:, None] + np.array(steps)]

    def merge(self, other: Shard) -> None:
        """Marks in both what either also holds, by binary search of the smaller part's strings in the larger."""
        for i in range(0, len(self.order), 1 << 14):
            at = self.order[i : i + (1 << 14)]
            mine = self._rows(at)
            lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(other.order), np.int64)
            while (open_ := lo < hi).any():
                mid = (lo + hi) // 2
                theirs = other._rows(other.order[np.minimum(mid, len(other.order) - 1)])
                differ = theirs != mine
                k = differ.argmax(1)
                row = np.arange(len(at))
                less = theirs[row, k] < mine[row, k]
                lo = np.where(open_ & less, mid + 1, lo)
                hi = np.where(open_ & ~less, mid, hi)
            inside = np.flatnonzero(lo < len(other.order))
            equal = (other._rows(other.order[lo[inside]]) == mine[inside]).all(1)
            hit = inside[equal]
            self.repeated[at[hit]] = True
            # all of the run of equal strings that begins there: its first is enough, the run is marked by itself
            other.repeated[other.order[lo[hit]]] = True


def _repeats(rows: Iterator[tuple[int, int, bytes]], length: int) -> Iterator[tuple[int, int, int, int]]:
    """(at, digest, first, end) of bytes that distinct stretches (at, digest, bytes), in order of at, share with others."""

    def finish(members: list[tuple[int, int]], shard: Shard) -> Iterator[tuple[int, int, int, int]]:
        ends = np.r_[shard.first[1:], len(shard.data)].tolist()
        for (at, digest), a, z in zip(members, shard.first.tolist(), ends):
            edge = np.flatnonzero(np.diff(np.r_[0, shard.repeated[a : z - length + 1].astype(np.int8), 0]))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist()):
                yield at, digest, s, e - 1 + length

    def merged(members, names, parts) -> None:
        shard = Shard(names, length)
        for _, other in parts:
            shard.merge(other)
            other.words = None
        shard.words = None
        parts.append((members, shard))

    members, names, size, last, parts = [], [], 0, (None, None), []
    for at, digest, raw in rows:
        if (at, digest) == last:  # another task's
            continue
        if size >= SHARD:
            # full: between anchors the shard ends, within one it becomes a part to merge
            merged(members, names, parts)
            members, names, size = [], [], 0
            if at != last[0]:
                for x in parts:
                    yield from finish(*x)
                parts = []
        members.append((at, digest))
        names.append(raw)
        size += len(raw)
        last = at, digest
    if members:
        merged(members, names, parts)
    for x in parts:
        yield from finish(*x)


def _shard_rows(batches, length: int):
    def rows():
        for batch in batches:
            for i in range(0, batch.num_rows, 1000):
                yield from zip(*(c.to_pylist() for c in batch.slice(i, 1000).columns))

    names, types = ["at", "digest", "first", "end"], (pa.int64(), pa.int64(), pa.int32(), pa.int32())
    out: list[tuple] = []
    for r in _repeats(rows(), length):
        out.append(r)
        if len(out) >= 20_000:
            yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)
            out = []
    if out:
        yield pa.record_batch([pa.array(c, t) for c, t in zip(zip(*out), types)], names)


def _cut(batches):
    """What is left of each text: (key, n_removed, n_spans, kept_sha256)."""
    for batch in batches:
        out = []
        for text, key, covered in zip(*(batch.column(i).to_pylist() for i in range(3))):
            raw = (text or "").encode("utf-8", "surrogatepass")
            if _key(raw) != key:
                continue
            merged: list[list[int]] = []
            for x in sorted((x["first"], x["end"]) for x in covered):
                if merged and x[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], x[1])
                else:
                    merged.append([*x])
            left, at = hashlib.sha256(), 0
            for a, b in merged:
                left.update(raw[at:a])
                at = b
            left.update(raw[at:])
            out.append((key, sum(b - a for a, b in merged), len(merged), left.hexdigest()))
        columns = zip(*out) if out else [[]] * 4
        types = pa.binary(), pa.int64(), pa.int64(), pa.string()
        yield pa.record_batch([pa.array(c, t) for c, t in zip(columns, types)], ["key", "n_removed", "n_spans", "kept_sha256"])


def without_repeats(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each row of docs (doc_id, text), texts as UTF-8 bytes.

    A null text is empty. Rows of equal texts repeat each other, so of `length` bytes on they go as a whole; rows that
    repeat a doc_id with other texts are judged by themselves, and so are rows of a null doc_id. Other columns are
    ignored; an empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    raw = F.encode("text", "UTF-8")
    key = F.unhex(F.md5(raw)).alias("key")
    slim = own.select("doc_id", key, F.octet_length("text").cast("long").alias("n_bytes"), F.sha2(raw, 256).alias("sha"))
    slim = stage(slim, "texts")
    copies = slim.groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("doc_id"))

    def read_again(asked):
        """(text, key, ...) of what is asked for (doc_id, key, ...): texts by the least doc_id, those without one by their key."""
        rest = [c for c in asked.columns if c != "doc_id"]
        told = own.join(asked.where("doc_id is not null"), "doc_id").select("text", *rest)
        bare = own.where("doc_id is null").groupBy(key).agg(F.first("text").alias("text"))
        return told.unionByName(bare.join(asked.where("doc_id is null"), "key").select("text", *rest))

    found = own.where(F.octet_length("text") >= length).select("text").mapInArrow(lambda it: _anchor_rows(it, length), "hash long, key binary, place int")
    found = stage(found, "anchors")
    # two places, whichever copy of a text they are in; a place by its hash
    where = F.xxhash64("key", "place")
    ends = found.select("hash", where.alias("at")).groupBy("hash").agg(F.min("at").alias("lo"), F.max("at").alias("hi"), F.count(F.lit(1)).alias("n"))
    block = F.when(F.col("n") > HOTTEST, 1).when(F.col("n") > HOT, BLOCK).otherwise(0)
    twice = ends.where("lo != hi").select("hash", block.alias("block"))
    wanted = found.join(twice, "hash").groupBy("key").agg(F.collect_set(F.struct("place", "block")).alias("places"))
    wanted = wanted.join(copies.select("key", "doc_id"), "key").select("doc_id", "key", "places")
    schema = "at long, digest long, hot boolean, key binary, start int, size int, bytes binary"
    places = stage(read_again(wanted).select("text", "key", "places").mapInArrow(lambda it: _stretches(it, length), schema), "stretches")
    unstage(found)
    shards = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    distinct = places.where("bytes is not null").select("at", "digest", "bytes").repartition(shards, "at").sortWithinPartitions("at", "digest")
    spans = distinct.mapInArrow(lambda it: _shard_rows(it, length), "at long, digest long, first int, end int")
    # a stretch at two places or more repeats as a whole; rows that repeat a text give the same places
    several = places.select("at", "digest", "size", F.xxhash64("key", "start").alias("place")).groupBy("at", "digest").agg(F.max("size").alias("size"), F.min("place").alias("lo"), F.max("place").alias("hi"))
    spans = stage(spans.unionByName(several.where("lo != hi").select("at", "digest", F.lit(0).alias("first"), F.col("size").alias("end"))), "spans")
    # the places of a stretch in salted parts where its anchor is at many places
    hot = places.where("hot").select("at").distinct().withColumn("salts", F.lit(SALTS))
    salted = spans.join(hot, "at", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)))
    salt = F.when(F.col("hot"), F.pmod(F.xxhash64("key", "start"), F.lit(SALTS)).cast("int")).otherwise(0)
    covered = places.select("at", "digest", "key", "start", salt.alias("salt")).join(salted, ["at", "digest", "salt"])
    covered = covered.groupBy("key").agg(F.collect_set(F.struct((F.col("start") + F.col("first")).alias("first"), (F.col("start") + F.col("end")).alias("end"))).alias("covered"))
    single = copies.where("copies = 1").select("key", "doc_id")
    cut = read_again(covered.join(single, "key").select("doc_id", "key", "covered")).select("text", "key", "covered")
    cut = cut.mapInArrow(_cut, "key binary, n_removed long, n_spans long, kept_sha256 string")
    out = slim.join(copies.where("copies > 1").select("key", "copies"), "key", "left").join(cut, "key", "left")
    gone = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, 1).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, hashlib.sha256(b"").hexdigest()).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
