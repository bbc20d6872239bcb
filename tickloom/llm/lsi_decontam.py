"""Benchmark decontamination by latent semantic retrieval.

Documents and benchmark items are cut into passages of 32 words (a step of 8), vectors of hashed words weighted by tf-idf.
A randomised SVD gives a latent basis: every task multiplies its passages by a random matrix and back
(``A' (A R)``), the partial products are summed in a distributed table, and the small eigenproblem of the sketch is
solved on the driver. Every passage of every document is then compared with all item passages by cosine in that space;
candidates are checked by the longest common subsequence with the item, so paraphrases with changed, missing or added
words are found as well. A large share of the item or a long verbatim run of it is a hit by itself; a smaller share, a
weak paraphrase, only with the item's last words, its answer.

The benchmark is the query set and is held by every task; documents are never compared with each other.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, released, stage, text_chunks, word_hashes

BUCKETS = 1 << 15
RANK = 64
WINDOW, STEP = 32, 8
COSINE, COMMON, ANSWER = 0.35, 0.6, 0.5
#: A hit by itself: this share of an item, of EVIDENCE words at least, or a verbatim run as `run_length` tells.
LARGE, EVIDENCE, RUN = 0.8, 13, 25
_PART = 512  # buckets in a row of the summed product
_AT_ONCE = 1 << 22  # numbers that a check of candidates holds


def _bucket(hashes: np.ndarray, buckets: int) -> np.ndarray:
    return (hashes >> np.uint64(40)).astype(np.int64) % buckets


def _frequencies(batches, buckets: int):
    total, n = np.zeros(buckets, np.int64), 0
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(0), 1 << 17):
            _, _, h, owner = word_hashes(data, offsets, True)
            pairs = owner * buckets + _bucket(h, buckets)
            if (j - i) * buckets <= _AT_ONCE * 8:
                held = np.zeros((j - i) * buckets, bool)
                held[pairs] = True
                pairs = np.flatnonzero(held)
            else:
                pairs = np.unique(pairs)
            total += np.bincount(pairs % buckets, minlength=buckets)
            n += j - i
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(np.append(seen, -1)), pa.array(np.append(total[seen], n))], ["bucket", "n"])


def _window_bounds(owner: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray]:
    """First and end word of each block of STEP words; blocks do not cross texts."""
    starts = np.searchsorted(owner, np.arange(n_texts + 1))
    lengths = np.diff(starts)
    blocks = -(-lengths // STEP)
    text = np.repeat(np.arange(n_texts), blocks)
    place = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    return starts[:-1][text] + place * STEP, text


def _sums(table: np.ndarray, rows: np.ndarray, first: np.ndarray, most: int) -> np.ndarray:
    """Sums of the table's rows over runs of `most` at most; the table's last row is zero."""
    lengths = np.diff(np.append(first, len(rows)))
    out = table[rows[first]]
    more = np.empty_like(out)
    for d in range(1, most):
        at = np.where(lengths > d, rows[np.minimum(first + d, len(rows) - 1)], len(table) - 1)
        out += table.take(at, axis=0, out=more, mode="clip")
    return out


def _run_sums(table: np.ndarray, rows: np.ndarray, first: np.ndarray, most: int = 16) -> np.ndarray:
    """Sums of the table's rows over runs of any length: of parts of `most` rows first, the longest parts ahead."""
    lengths = np.diff(np.append(first, len(rows)))
    parts = -(-lengths // most)
    begin = np.cumsum(parts) - parts
    place = np.arange(int(parts.sum())) - np.repeat(begin, parts)
    start = np.repeat(first, parts) + place * most
    size = np.minimum(np.repeat(first + lengths, parts) - start, most)
    order = np.argsort(most - size, kind="stable")
    start, longer = start[order], np.cumsum(np.bincount(size, minlength=most + 1)[::-1])[::-1]
    sums = table[rows[start]]
    more = np.empty_like(sums)
    for d in range(1, most):
        k = longer[d + 1]
        sums[:k] += table.take(rows[start[:k] + d], axis=0, out=more[:k], mode="clip")
    out = np.empty_like(sums)
    out[order] = sums
    return out if len(out) == len(first) else _run_sums(out, np.arange(len(out)), begin, most)


def _with_zero(table: np.ndarray) -> np.ndarray:
    return np.concatenate([table, np.zeros_like(table[:1])])


def _windows(blocks: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Sums over WINDOW words from each block on, within its text."""
    out = blocks.copy()
    for d in range(1, WINDOW // STEP):
        same = text[d:] == text[:-d]
        np.add(out[: len(blocks) - d], blocks[d:], out=out[: len(blocks) - d], where=same.reshape(-1, *[1] * (blocks.ndim - 1)))
    return out


def _products(batches, idf: np.ndarray, buckets: int, rank: int):
    """Partial A' (A R) of the passages (blocks of WINDOW words without overlap)."""
    random = np.random.default_rng(11).standard_normal((buckets, rank)).astype(np.float32)
    weighted, square = _with_zero(random * idf[:, None]), idf**2
    total = np.zeros((buckets, rank))
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(0)):
            _, _, h, owner = word_hashes(data, offsets, True)
            if not len(h):
                continue
            b = _bucket(h, buckets)
            starts = np.searchsorted(owner, np.arange(j - i))
            is_new = (np.arange(len(h)) - starts[owner]) % WINDOW == 0
            new, passage = np.flatnonzero(is_new), np.cumsum(is_new) - 1
            norm = np.sqrt(np.add.reduceat(square[b], new)) + 1e-9
            y = _sums(weighted, b, new, WINDOW)
            y /= (norm**2)[:, None]
            order = np.argsort(b.astype(np.uint16) if buckets <= 1 << 16 else b, kind="stable")  # 16 bits: a radix sort
            sorted_b = b[order]
            first = np.flatnonzero(np.r_[True, sorted_b[1:] != sorted_b[:-1]])
            sums = _run_sums(y, passage[order], first)
            total[sorted_b[first]] += sums * idf[sorted_b[first]][:, None]
    parts = total.astype(np.float32).reshape(-1, _PART * rank)
    yield pa.record_batch([pa.array(np.arange(len(parts))), pa.array([p.tobytes() for p in parts], pa.binary())], ["part", "sums"])


def _summed(batches):
    """Adds up the partial products, part by part, as they stream in."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        for part, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            x = np.frombuffer(raw, np.float32).astype(np.float64)
            held[part] = held[part] + x if part in held else x
    yield pa.record_batch([pa.array(list(held), pa.int64()), pa.array([x.tobytes() for x in held.values()], pa.binary())], ["part", "sums"])


def latent_basis(product: np.ndarray, random: np.ndarray, rank: int) -> np.ndarray:
    """Orthonormal columns that span the leading right singular vectors, from Y = A'A R alone."""
    inner = random.T @ product
    values, vectors = np.linalg.eigh((inner + inner.T) / 2)
    good = values > max(values.max(), 1e-12) * 1e-7
    core = product @ (vectors[:, good] / np.sqrt(values[good]))
    left, _, _ = np.linalg.svd(core, full_matrices=False)
    return left[:, :rank].astype(np.float32)


class Items:
    """The benchmark: item passages for the search and words for the checks."""

    def __init__(self, rows: list[tuple[int, str]], idf: np.ndarray, basis: np.ndarray):
        texts = pa.array([t or "" for _, t in rows], pa.string())
        self.ids, self.words = [r[0] for r in rows], []
        vectors, self.item = [], []
        for i, j, data, offsets in text_chunks(texts):
            _, _, h, owner = word_hashes(data, offsets, True)
            starts = np.searchsorted(owner, np.arange(j - i + 1))
            for a, b in zip(starts[:-1], starts[1:]):
                w, k = h[a:b], len(self.words)
                self.words.append(w)
                for at in range(0, max(1, len(w) - WINDOW + 1 + STEP), STEP * 2):
                    part = w[at : at + WINDOW]
                    if len(part):
                        x = _bucket(part, len(idf))
                        norm = math.sqrt(float((idf[x] ** 2).sum())) + 1e-9
                        vectors.append((basis[x] * idf[x][:, None]).sum(0) / norm)
                        self.item.append(k)
        v = np.array(vectors, np.float32).reshape(-1, basis.shape[1])
        # divided by its own squared length: a passage's cosine with itself is 1 in any basis
        self.vectors = v / np.maximum((v**2).sum(1), 1e-6)[:, None]
        self.item = np.array(self.item, np.int64)
        # for each item, the places of its distinct words in the vocabulary of all items
        self.vocabulary = np.unique(np.concatenate([np.zeros(0, np.uint64), *self.words]))
        self.leading = np.zeros(1 << 20, bool)
        self.leading[self.vocabulary >> np.uint64(44)] = True
        self.place = np.full((len(self.words), len(self.vocabulary)), -1, np.int16)
        self.least = []
        for k, w in enumerate(self.words):
            own = np.unique(w)
            self.place[k, np.searchsorted(self.vocabulary, own)] = np.arange(len(own))
            # a subsequence of so many words has so many distinct ones at least
            self.least.append(min(COMMON * len(w), run_length(len(w))) - (len(w) - len(own)))
        self.least = np.array(self.least, float)
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.masks = []
        for w in self.words:
            masks: dict[int, int] = {}
            for k, x in enumerate(w.tolist()):
                masks[x] = masks.get(x, 0) | 1 << k
            self.masks.append(masks)

    def known(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the words are in the vocabulary, and where."""
        maybe = np.flatnonzero(self.leading[words >> np.uint64(44)])
        at = np.minimum(np.searchsorted(self.vocabulary, words[maybe]), len(self.vocabulary) - 1)
        right = self.vocabulary[at] == words[maybe]
        return maybe[right], at[right]

    def possible(self, k: np.ndarray, lo: np.ndarray, hi: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Of stretches known[lo:hi] of vocabulary words, whether each can hold enough of its item k."""
        out = hi - lo >= self.least[k]
        # of neighbouring stretches of one item, all go where the whole of them cannot hold it
        rough = np.flatnonzero(out)
        rough = rough[np.lexsort((lo[rough], k[rough]))]
        new = (np.diff(k[rough], prepend=-1) != 0) | (np.diff(lo[rough], prepend=-1) > 32)
        new |= np.arange(len(rough)) % 16 == 0
        group = np.cumsum(new) - 1
        begin = np.flatnonzero(new)
        if len(rough):
            whole = self._enough(k[rough[begin]], lo[rough[begin]], np.maximum.reduceat(hi[rough], begin), known)
            out[rough[~whole[group]]] = False
        some = np.flatnonzero(out)
        out[some] = self._enough(k[some], lo[some], hi[some], known)
        return out

    def _enough(self, k: np.ndarray, lo: np.ndarray, hi: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Of stretches known[lo:hi], whether each holds as many distinct words of its item k as the least hit."""
        out = np.ones(len(k), bool)
        some, width = np.flatnonzero(out), max(map(len, self.words))
        part = np.cumsum(hi[some] - lo[some] + width) // _AT_ONCE
        for one in np.split(some, np.flatnonzero(np.diff(part)) + 1) if len(some) else []:
            sizes = hi[one] - lo[one]
            row = np.repeat(np.arange(len(one)), sizes)
            at = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes - lo[one], sizes)
            place = self.place[k[one][row], known[at]]
            seen = np.zeros((len(one), width), bool)
            seen[row[place >= 0], place[place >= 0]] = True
            out[one] = seen.sum(1) >= self.least[k[one]]
        return out

    def common(self, k: int, words: np.ndarray) -> tuple[int, int]:
        """Words of item k in its longest common subsequence with words, and how many of its last words that holds at most."""
        n = len(self.words[k])
        whole = (1 << n) - 1
        v, masks = whole, self.masks[k]
        for x in words.tolist():
            m = masks.get(x)
            if m is not None:
                u = v & m
                v = ((v + u) | (v - u)) & whole
        taken = ~v & whole
        last = n - answer_length(n)
        return taken.bit_count(), (taken >> last).bit_count()


def run_length(n: int) -> int:
    """So many words of an item of n, one after another, are a hit: COMMON of it, from EVIDENCE to RUN words, or all of it."""
    return min(n, max(EVIDENCE, min(RUN, math.ceil(COMMON * n))))


def longest_run(item: np.ndarray, words: np.ndarray) -> int:
    """Words of the longest stretch that both hold without a gap."""
    most, ends = 0, np.zeros(len(item) + 1, np.int64)
    for x in words:
        ends[1:] = np.where(item == x, ends[:-1] + 1, 0)
        most = max(most, int(ends.max()))
    return most


def answer_length(n: int) -> int:
    """The answer is the last fifth of an item's words, three at least."""
    return min(n, max(3, n // 5))


def _hits(batches, bench: list, idf: np.ndarray, basis: np.ndarray):
    items = Items(bench, idf, basis)
    table = _with_zero(basis * idf[:, None])
    square = (idf**2).astype(np.float32)
    schema = pa.schema([("row", pa.int64()), ("item_id", pa.int64()), ("common", pa.float64()), ("answer", pa.float64()), ("cosine", pa.float64()), ("first_word", pa.int64())])
    for batch in batches:
        out = []
        for i, j, data, offsets in text_chunks(batch.column(1), 1 << 18):
            _, _, h, owner = word_hashes(data, offsets, True)
            if not len(h) or not len(items.vectors):
                continue
            b = _bucket(h, len(idf))
            first, text = _window_bounds(owner, j - i)
            latent = _windows(_sums(table, b, first, STEP), text)
            norm = _windows(np.add.reduceat(square[b], first), text)
            latent /= np.sqrt(norm)[:, None] + 1e-9
            starts = np.searchsorted(owner, np.arange(j - i + 1))
            known_at, known = items.known(h)
            before = np.searchsorted(known_at, np.arange(len(h) + 1))  # vocabulary words before each word
            best: dict[tuple[int, int], tuple] = {}
            for at in range(0, len(latent), 4096):
                cosine = latent[at : at + 4096] @ items.vectors.T
                w, q = np.divmod(np.flatnonzero(cosine >= COSINE), cosine.shape[1])
                # of the passages of one item, the first tells of them all
                k = items.item[q]
                one = np.flatnonzero(np.diff(w, prepend=-1) | np.diff(k, prepend=-1))
                w, q, k = w[one], q[one], k[one]
                t = text[at + w]
                a = np.maximum(starts[t], first[at + w] - items.lengths[k])
                z = np.minimum(starts[t + 1], first[at + w] + WINDOW + items.lengths[k])
                left = np.flatnonzero(items.possible(k, before[a], before[z], known))
                for w, q, t, k, a, z in zip(*(x[left].tolist() for x in (w, q, t, k, a, z))):
                    n = len(items.words[k])
                    if (old := best.get((t, k))) and (old[0] >= 1 or old[3] <= a and z <= old[4]):
                        continue
                    lcs, held = items.common(k, h[a:z])
                    share, answer = lcs / n, held / answer_length(n)
                    hit = share >= COMMON and answer >= ANSWER or share >= LARGE and lcs >= EVIDENCE
                    hit = hit or lcs >= run_length(n) and longest_run(items.words[k], h[a:z]) >= run_length(n)
                    if hit and (not old or share > old[0]):
                        best[t, k] = (share, answer, float(cosine[w, q]), a, z, a - int(starts[t]))
            out += [(batch.column(0)[i + t].as_py(), items.ids[k], x[0], x[1], x[2], x[5]) for (t, k), x in best.items()]
        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in out], schema)


def contaminated(docs: DataFrame, benchmark: DataFrame, buckets: int = BUCKETS, rank: int = RANK) -> DataFrame:
    """(doc_id, item_id, common, answer, cosine, first_word): the benchmark items that documents hold.

    common and answer: the shares of the item's and of its answer's words found in order; cosine: in the latent space;
    first_word: where the searched stretch begins. Null or wordless texts and items match nothing; equal items each
    match; rows that repeat a doc_id are judged by themselves; a null doc_id is returned as null. Other columns are
    ignored and an empty table on either side gives no rows. The driver holds the benchmark, one number for each bucket
    and the basis (buckets x rank).
    """
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    bench = sorted((tuple(r) for r in benchmark.select(F.col("item_id").cast("long"), "text").collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    out = "row long, item_id long, common double, answer double, cosine double, first_word long"
    names = [x.split()[0] for x in out.replace("row", "doc_id").split(", ")]
    counted = docs.select("text").mapInArrow(released(lambda it: _frequencies(it, buckets)), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect()
    counts, n = np.zeros(buckets), 0
    for b, x in counted:
        if b < 0:
            n = x
        else:
            counts[b] = x
    if not bench or not n:
        return spark.createDataFrame([], out.replace("row", "doc_id"))
    idf = np.log((n + 1) / (counts + 1) + 1e-3).clip(0).astype(np.float32)
    # items are weighted to half of the whole, so that the leading directions tell them apart
    parts = docs.select("text").mapInArrow(released(lambda it: _products(it, idf, buckets, rank)), "part long, sums binary")
    parts = parts.repartition(buckets // _PART, "part").mapInArrow(released(_summed), "part long, sums binary").collect()
    give_back(spark)  # what the JVM held of the parts, before the basis takes its memory
    basis = _basis(parts, bench, idf, buckets, rank)
    give_back(spark)
    return docs.mapInArrow(released(lambda it: _hits(it, bench, idf, basis)), out).toDF(*names)


def _basis(parts: list, bench: list, idf: np.ndarray, buckets: int, rank: int) -> np.ndarray:
    """The latent basis from the summed products, which are taken off the list, and the items'."""
    product, own = np.zeros((buckets // _PART, _PART * rank)), np.zeros((buckets // _PART, _PART * rank))
    while parts:
        part, raw = parts.pop()
        product[part] += np.frombuffer(raw, np.float64)
    for (part, raw) in _own_product(bench, idf, buckets, rank):
        own[part] += np.frombuffer(raw, np.float32)
    own *= max(np.linalg.norm(product) / max(np.linalg.norm(own), 1e-9), 1) * 4
    product += own
    del own
    random = np.random.default_rng(11).standard_normal((buckets, rank)).astype(np.float32)
    return latent_basis(product.reshape(buckets, rank), random.astype(np.float64), rank)


def _own_product(bench, idf, buckets, rank):
    batch = pa.record_batch([pa.array([t for _, t in bench], pa.string())], ["text"])
    for out in _products([batch], idf, buckets, rank):
        yield from zip(out.column(0).to_pylist(), out.column(1).to_pylist())


def clean_documents(docs: DataFrame, benchmark: DataFrame, **how) -> DataFrame:
    """The rows of docs that no benchmark item is found in, each judged by its own text, with a doc_id or without."""
    key = F.xxhash64("text")
    named = contaminated(docs.select(key.alias("doc_id"), "text"), benchmark, **how).select(F.col("doc_id").alias("__text")).distinct()
    named = stage(named, "hits")
    return docs.join(named, key == named["__text"], "left_anti").select(*docs.columns)
