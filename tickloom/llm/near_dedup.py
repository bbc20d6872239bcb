"""MinHash near-dedup by bottom-k sketches from one hash function.

A text's set is the distinct k-word shingles (A-Z folded; fewer words: the whole sequence as one; none: empty). Texts of
equal sets form a class at once. Each class keeps the least hashes of its set; inverted lists of these retained values
give candidate pairs, an estimate from the sketch of the union drops hopeless ones, and the exact Jaccard coefficient of
the full sets confirms the rest. Links make components.

No list is expanded into all its pairs. First each member of a list meets its most typical member, that whose values
are in the longest lists, such as the text that many copies were made from; the confirmed links give components. Then
only members of different components meet, and only those whose signatures of 512 parities allow the similarity: two
sets differ in at least as many values as their signatures do in bits. Of all pairs, only those that signatures of 2,048
parities allow as well become rows that are read with their sketches and texts. So every pair of a list is either confirmed,
refuted, or already in one component, and no link is lost. Values in long lists (65,536 values at most) are
ordered last in every set, so a passage that many texts share does not bring unrelated ones together;
a set with such a value retains its whole prefix of ``n - ceil(0.8 n) + 1`` values, with which no partner can be missed.

Other sets retain the first 24 of that prefix: two sets with a Jaccard coefficient of 0.8 share none of them with a
probability below 1e-16. The estimate drops a link with a probability below 1e-12.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import give_back, released, stage, text_shingles, unstage
from .graph import components

RETAINED, SKETCH = 24, 64
#: Values in lists of more than LIST members go last, the largest lists first, as many as a broadcast table may hold.
LIST, HOT_VALUES, DEMOTIONS = 16, 65_536, 2
#: Parities of a signature: of those that lists are joined by, and of those that each pair is tried by.
BITS, FINE_BITS = 512, 2048
#: Members of a list that one task compares with the others.
PART = 2048
#: What a block of nodes holds at most: members, and shingles of them all (one larger text is alone).
CELL_MEMBERS, CELL_SHINGLES = 256, 1 << 18


def prefix_length(n: int, percent: int) -> int:
    """So many first values of a set of n under any order hold one of every set that is percent similar."""
    return n - -(-percent * n // 100) + 1 if n else 0


def class_key(values: np.ndarray) -> bytes:
    return hashlib.md5(values.tobytes()).digest()


def _retained(values: np.ndarray, hot: np.ndarray | None, percent: int) -> np.ndarray:
    p = prefix_length(len(values), percent)
    if hot is None:
        return values[: min(p, RETAINED)]
    is_hot = np.isin(values, hot, assume_unique=True)
    if not is_hot.any():
        return values[: min(p, RETAINED)]
    return np.concatenate([values[~is_hot], values[is_hot]])[:p]


def signature(values: np.ndarray, bits: int = BITS) -> np.ndarray:
    """So many parities as 64-bit words: bit i tells whether an odd number of the values fall to i."""
    odd = np.bincount((values & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(bool)).view(np.int64)


def _alike(percent: int, bits: int, a: str, b: str, na: str, nb: str) -> F.Column:
    """Whether two signatures allow a link: it differs in (1 - t) / (1 + t) of the summed sizes at most."""
    differ = sum((F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(bits // 64)), F.lit(0))
    return differ * (100 + percent) <= (F.col(na) + F.col(nb)) * (100 - percent)


def _sets(batches, k: int):
    for batch in batches:
        sets = list(text_shingles(batch.column(1), k))
        parities = [np.array([signature(s, bits) for s in sets], np.int64).reshape(-1) for bits in (BITS, FINE_BITS)]
        parities = [pa.FixedSizeListArray.from_arrays(pa.array(x), bits // 64).cast(pa.list_(pa.int64())) for x, bits in zip(parities, (BITS, FINE_BITS))]
        yield pa.record_batch(
            [
                batch.column(0),
                batch.column(2),
                pa.array([class_key(s) if len(s) else None for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([s[:SKETCH].tobytes() for s in sets], pa.binary()),
                *parities,
            ],
            ["doc_id", "key", "node", "n", "sketch", "signature", "fine"],
        )


def least_shared(k: int, percent: int, chance: float = 1e-12) -> int:
    """The least c for which a link shares fewer than c of k sampled values of its union with a probability above chance."""
    q, upto = percent / 100, 0.0
    for c in range(k + 1):
        upto += math.comb(k, c) * q**c * (1 - q) ** (k - c)
        if upto > chance:
            return c
    return k


def _postings(batches, k: int, hot: bytes, percent: int):
    hot = np.frombuffer(hot, np.uint64)
    for batch in batches:
        value, row = [], []
        for i, s in enumerate(text_shingles(batch.column(2), k)):
            value.append(_retained(s, hot, percent))
            row.append(np.full(len(value[-1]), i))
        value, row = np.concatenate(value or [np.zeros(0, np.uint64)]), pa.array(np.concatenate(row or [np.zeros(0, np.int64)]))
        yield pa.record_batch([pa.array(value.view(np.int64)), batch.column(0).take(row), batch.column(1).take(row)], ["value", "node", "n"])


def _sketch_table(data: pa.Array, _k: int) -> list[np.ndarray]:
    return [np.frombuffer(x, np.uint64) for x in data.to_pylist()]


def _likely(sets: list[np.ndarray], percent: int):
    """Tells of pairs of these sketches whether the sketch of the union does not rule out the similarity."""
    none, size = np.uint64((1 << 64) - 1), np.array([len(x) for x in sets])
    least = np.array([least_shared(k, percent) for k in range(SKETCH + 1)])
    table = np.full((len(sets), SKETCH), none)
    for row, x in zip(table, sets):
        row[: len(x)] = x

    def verdict(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(a), bool)
        for i in range(0, len(a), 4096):
            x, y = a[i : i + 4096], b[i : i + 4096]
            both = np.sort(np.concatenate([table[x], table[y]], axis=1), axis=1)
            twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != none)
            new = both != none
            new[:, 1:] &= ~twice
            rank = np.cumsum(new, axis=1)
            whole = (size[x] < SKETCH) & (size[y] < SKETCH)
            k = np.where(whole, rank[:, -1], np.minimum(size[x], size[y]))
            shared = (twice & (rank[:, 1:] <= k[:, None])).sum(axis=1)
            keep[i : i + 4096] = np.where(whole, 100 * shared >= percent * k, shared >= least[np.minimum(k, SKETCH)])
        return keep

    return verdict


def _full_table(data: pa.Array, k: int) -> list[np.ndarray]:
    return list(text_shingles(data, k))


def _linked(sets: list[np.ndarray], percent: int):
    """Tells of pairs of these full sets whether they are links; a bit for each value that two sets at least hold."""
    size = np.array([len(x) for x in sets])
    values, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    width = -(-int((times > 1).sum()) // 64) * 64 or 64
    bits = np.zeros((len(sets), width // 64), np.uint64)
    for row, own in zip(bits, np.split(at, np.cumsum(size)[:-1])):
        dense = np.zeros(width, bool)
        dense[place[own[times[own] > 1]]] = True
        row[:] = np.packbits(dense).view(np.uint64)
    step = max(1, (1 << 21) // bits.shape[1])

    def verdict(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        keep = np.zeros(len(a), bool)
        for i in range(0, len(a), step):
            x, y = a[i : i + step], b[i : i + step]
            shared = np.bitwise_count(bits[x] & bits[y]).sum(axis=1, dtype=np.int64)
            keep[i : i + step] = 100 * shared >= percent * (size[x] + size[y] - shared)
        return keep

    return verdict


def _cells(batches, k: int, percent: int, read, judge):
    """The pairs that the judge keeps. Rows come cell by cell, the members of a cell before its pairs."""
    cell, names, sets, verdict = None, {}, [], None
    for batch in batches:
        cells, pair = batch.column(0).to_numpy(), batch.column(1).to_numpy() == 1
        keep = np.zeros(len(cells), bool)
        edges = [0, *(np.flatnonzero(np.diff(cells)) + 1).tolist(), len(cells)] if len(cells) else []
        for s, e in zip(edges[:-1], edges[1:]):
            if cells[s] != cell:
                cell, names, sets, verdict = cells[s], {}, [], None
            m = e - int(pair[s:e].sum())
            if m > s:
                for node in batch.column(2).slice(s, m - s).to_pylist():
                    names[node] = len(names)
                sets += read(batch.column(4).slice(s, m - s), k)
            if e > m:
                verdict = verdict or judge(sets, percent)
                a, b = (np.array([names[x] for x in batch.column(c).slice(m, e - m).to_pylist()]) for c in (2, 3))
                keep[m:e] = verdict(a, b)
        yield batch.select(["a", "b", "cell"]).filter(pa.array(keep))


def _blocks(listed: DataFrame, percent: int) -> DataFrame:
    """(node, block, typical) of members of lists: block, a part of a bounded number and total size of a node's longest
    list; typical, the greater the longer the lists of its prefix and the fewer its values that are in none."""
    prefix = F.max("n") - F.ceil(F.max("n") * percent / 100) + 1
    top = listed.groupBy("node").agg(F.max(F.struct("members", "value", "total")).alias("t"), (F.sum(F.log("members")) / prefix).alias("typical"))
    parts = F.greatest(F.ceil(F.col("t.members") / CELL_MEMBERS), F.ceil(F.col("t.total") / CELL_SHINGLES))
    return top.select("node", F.xxhash64("t.value", F.pmod(F.xxhash64("node"), parts)).alias("block"), "typical")


def _in_cells(pairs: DataFrame, held: DataFrame, k: int, percent: int, read, judge) -> DataFrame:
    """The pairs (a, b, cell) that the judge keeps by what is held (node, data) of both.

    A cell is a pair of blocks. What is held of a node goes once to each cell that has a pair of it, not to each pair.
    """
    named = pairs.select("cell", F.explode(F.array("a", "b")).alias("node")).distinct().join(held, "node")
    named = named.select("cell", F.lit(0).alias("kind"), F.col("node").alias("a"), F.lit(None).cast("binary").alias("b"), "data")
    rows = named.unionByName(pairs.select("cell", F.lit(1).alias("kind"), "a", "b", F.lit(None).cast(held.schema["data"].dataType).alias("data")))
    rows = rows.repartition("cell").sortWithinPartitions("cell", "kind")
    return rows.mapInArrow(released(lambda it: _cells(it, k, percent, read, judge)), "a binary, b binary, cell long")


def _staged(df: DataFrame, name: str) -> DataFrame:
    """df as a table; its shuffle files go at once, not when the driver happens to collect its garbage."""
    out = stage(df, name)
    give_back(df.sparkSession)
    return out


def _judged(docs: DataFrame, k: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, node, n) of each row and (node, root, component) of each class; key is a hash of the text.

    root names the component, component is its least doc_id (null: none of its rows has one).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("key"))
    schema = "doc_id long, key long, node binary, n long, sketch binary, signature array<long>, fine array<long>"
    sets = _staged(docs.select("doc_id", "text", "key").mapInArrow(released(lambda it: _sets(it, k)), schema), "sets")
    classes = sets.where("node is not null").groupBy("node")
    classes = classes.agg(F.min(F.struct("doc_id", "key", "n", "sketch", "signature", "fine")).alias("x"), F.min("doc_id").alias("least"))
    classes = _staged(classes.select("node", "least", "x.key", "x.n", "x.sketch", "x.signature", "x.fine"), "classes")
    nameless = bool(classes.where("least is null").head(1))

    # the sketch holds the first 64 values, so lists of up to 24 values come from it without the text
    def first(batches):
        for batch in batches:
            value = [_retained(np.frombuffer(s, np.uint64), None, 0)[: min(prefix_length(n, percent), RETAINED)] for s, n in zip(batch.column(2).to_pylist(), batch.column(1).to_pylist())]
            row = pa.array(np.repeat(np.arange(len(value)), [len(v) for v in value]))
            value = np.concatenate(value or [np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.record_batch([pa.array(value), batch.column(0).take(row), batch.column(1).take(row)], ["value", "node", "n"])

    def near(nodes):
        """(node, n, text) of classes, read once more where the text is needed: the rows of the least doc_id, or of its key."""
        asked = classes.join(nodes, "node", "left_semi").select("node", "least", "key")
        told = docs.join(asked.where("least is not null").select(F.col("least").alias("doc_id"), "node"), "doc_id").select("doc_id", "text", "node")
        if nameless:
            own = docs.where("doc_id is null").groupBy("key").agg(F.first("text").alias("text"))
            told = told.unionByName(own.join(asked.where("least is null").select("key", "node"), "key").select(F.lit(None).cast("long").alias("doc_id"), "text", "node"))
        return told.mapInArrow(released(lambda it: _own(it, k)), "node binary, n long, text string").dropDuplicates(["node"])

    postings = _staged(classes.select("node", "n", "sketch").mapInArrow(released(first), "value long, node binary, n long"), "postings")
    # values in many lists go last in every set; what moves up in their place may be in many lists as well
    hot_values = np.zeros(0, np.uint64)
    for _ in range(DEMOTIONS):
        lists = _staged(postings.groupBy("value").agg(F.count(F.lit(1)).alias("members")).where(F.col("members") > LIST), "lists")
        fresh = lists if not len(hot_values) else lists.join(F.broadcast(_as_frame(spark, hot_values)), "value", "left_anti")
        room = HOT_VALUES - len(hot_values)
        sizes = sorted(map(tuple, fresh.groupBy("members").count().collect()), reverse=True)
        least = LIST
        for members, n in sizes:  # the largest lists that the table has room for
            room -= n
            if room < 0:
                least = members
                break
        hot = _staged(fresh.where(F.col("members") > least).select("value"), "hot")
        new = np.array([r[0] for r in hot.collect()], np.int64).view(np.uint64)  # at most HOT_VALUES
        if not len(new):
            unstage(lists, hot)
            break
        hot_values = np.sort(np.concatenate([hot_values, new]))
        touched = _staged(postings.join(F.broadcast(hot), "value", "left_semi").select("node").distinct(), "touched")
        values = hot_values.tobytes()
        again = near(touched).mapInArrow(released(lambda it, values=values: _postings(it, k, values, percent)), "value long, node binary, n long")
        before, postings = postings, _staged(postings.join(touched, "node", "left_anti").unionByName(again), "postings")
        unstage(lists, hot, touched, before)
    shared = postings.groupBy("value").agg(F.count(F.lit(1)).alias("members"), F.sum("n").alias("total")).where("members > 1")
    every_listed = _staged(postings.join(shared, "value"), "listed")
    unstage(postings)
    blocks = _staged(_blocks(every_listed, percent).join(classes.select("node", "n", "fine"), "node"), "blocks")
    listed = every_listed.select("value", "node", "n", "members")
    block = lambda x: blocks.select(F.col("node").alias(x), F.col("block").alias(f"b{x}"), F.col("n").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
    fit = (F.col("na") * 100 >= F.col("nb") * percent) & (F.col("nb") * 100 >= F.col("na") * percent)

    def met(pairs, before):
        """The candidate pairs (a, na, b, nb) that fine signatures allow, each once, and the new links among them."""
        pairs = pairs.where((F.col("a") != F.col("b")) & fit).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        pairs = pairs if before is None else pairs.join(before, ["a", "b"], "left_anti")
        cell = F.xxhash64(F.least("ba", "bb"), F.greatest("ba", "bb")).alias("cell")
        pairs = pairs.join(block("a"), "a").join(block("b"), "b").where(_alike(percent, FINE_BITS, "fa", "fb", "na", "nb"))
        pairs = _staged(pairs.select("a", "b", cell), "pairs")
        held = classes.select("node", F.col("sketch").alias("data"))
        likely = _staged(_in_cells(pairs, held, k, percent, _sketch_table, _likely), "likely")
        texts = near(likely.select(F.explode(F.array("a", "b")).alias("node")).distinct()).select("node", F.col("text").alias("data"))
        links = _staged(_in_cells(likely, texts, k, percent, _full_table, _linked).select("a", "b"), "confirmed")
        unstage(likely)
        return pairs.select("a", "b"), links

    told = listed.join(blocks.select("node", "typical"), "node")
    heads = told.groupBy("value").agg(F.max_by(F.struct("node", "n"), F.struct("typical", "node")).alias("h"))
    star = told.join(heads, "value").where(F.col("node") != F.col("h.node"))
    seen, links = met(star.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("h.node").alias("b"), F.col("h.n").alias("nb")), None)
    roots = _staged(components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))), "roots")
    # members of one list that are still apart
    told = _staged(listed.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node")), "rooted")
    mixed = told.groupBy("value").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("value")
    apart = told.join(mixed, "value", "left_semi").join(classes.select("node", "signature"), "node")
    parts = F.ceil(F.col("members") / PART).cast("int")
    x = apart.select("value", F.pmod(F.xxhash64("node"), parts).cast("int").alias("part"), F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), F.col("signature").alias("sa"))
    y = apart.select("value", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("root").alias("rb"), F.col("signature").alias("sb"))
    alike = _alike(percent, BITS, "sa", "sb", "na", "nb")
    rest = x.join(y, (x["value"] == y["value"]) & (x["part"] == y["part"]) & (x["ra"] != y["rb"]) & (x["a"] < y["b"]) & fit & alike)
    _, more = met(rest.select("a", "na", "b", "nb"), seen)
    if more.head(1):
        every = links.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v"))
        roots = _staged(components(every), "roots")
    unstage(told, every_listed)
    give_back(spark)
    member = classes.select("node", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    low = member.groupBy("root").agg(F.min("least").alias("component"))
    return sets.select("doc_id", "key", "node", "n"), member.join(low, "root").select("node", "root", "component")


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of docs (doc_id, text).

    Links sets of a Jaccard coefficient of percent / 100 or more. component_id: the least doc_id reachable; kept: it is
    the row's own doc_id. A null or wordless text is linked with nothing. Repeated rows each get a row of the same
    class. A row of a null doc_id is linked as any other, but takes no part in the least id; without a doc_id in its
    component, component_id is null and kept true. Other columns of docs are ignored; an empty table gives an empty
    table.
    """
    rows, classes = _judged(docs, words, percent)
    out = rows.join(classes.select("node", "component"), "node", "left")
    component = F.coalesce("component", "doc_id")
    kept = F.when(F.col("node").isNull(), True).otherwise(F.col("doc_id").eqNullSafe(F.col("component")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), kept.alias("kept"))


def _as_frame(spark, values: np.ndarray) -> DataFrame:
    return spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "value long")


def _own(batches, k: int):
    """The rows whose text has the class that was asked for."""
    for batch in batches:
        sets = list(text_shingles(batch.column(1), k))
        mine = [len(s) > 0 and class_key(s) == node for s, node in zip(sets, batch.column(2).to_pylist())]
        out = pa.record_batch([batch.column(2), pa.array([len(s) for s in sets], pa.int64()), batch.column(1)], ["node", "n", "text"])
        yield out.filter(pa.array(mine, pa.bool_()))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row of docs for each component: that of the least doc_id; of rows that repeat a doc_id, the first by text.

    Of a component without any doc_id, one row of the least text hash stays. Rows without words are linked with nothing
    and all stay, as far as they differ in doc_id.
    """
    rows, classes = _judged(docs, words, percent)
    rows = rows.join(classes, "node", "left")
    kept = rows.where("doc_id is not null and (node is null or doc_id = component)").select("doc_id").distinct()
    out = docs.join(kept, "doc_id", "left_semi").select(*docs.columns)
    turn = Window.partitionBy("doc_id").orderBy(F.sha2(F.coalesce("text", F.lit("")), 256))
    out = out.withColumn("__turn", F.row_number().over(turn)).where("__turn = 1").drop("__turn")
    # rows without a doc_id are told by their texts
    bare = docs.where("doc_id is null").withColumn("__key", F.xxhash64("text"))
    alone = rows.where("doc_id is null and component is null and node is not null").groupBy("root").agg(F.min("key").alias("__key")).select("__key").distinct()
    one = bare.join(alone, "__key", "left_semi").withColumn("__turn", F.row_number().over(Window.partitionBy("__key").orderBy("text"))).where("__turn = 1")
    wordless = bare.join(rows.where("doc_id is null and node is null").select(F.col("key").alias("__key")).distinct(), "__key", "left_semi")
    return out.unionByName(one.select(*docs.columns)).unionByName(wordless.select(*docs.columns))
