"""Token ids in blocks of a static range asymmetric numeral system.

A token file set is three tables below one folder: ``frequencies`` (symbol, frequency; shared by all blocks, sum 2**20),
``blocks`` (one row for each independent block) and ``shards`` (tokens of each shard). A block holds whole documents in
ascending doc_id order and its payload: 32-bit words of interleaved 64-bit coder states, one state for each lane, with a
checkpoint of all states every few steps. Decoding may begin at any checkpoint; each stretch from one checkpoint to the
next has its own CRC-32, and the document ids and lengths have theirs.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import give_back, released, shared_dir, stage, text_chunks

BITS = 20  # of the frequencies' sum
BLOCK_TOKENS = 1 << 18
CHECK_STEPS = 128
END_ID = 1
_LOW = np.uint64(1 << 31)

BLOCKS = "shard int, block long, first_token long, n_docs int, n_tokens long, lanes int, doc_ids binary, doc_lengths binary, index_crc32 long, words binary, checkpoints binary"


class TokenFormatError(ValueError):
    """A block's checksum does not match."""


def normalised(counts: np.ndarray) -> np.ndarray:
    """Frequencies of sum 2**BITS, at least 1 for each symbol that occurs."""
    out = np.zeros(len(counts), np.int64)
    seen = np.flatnonzero(counts)
    if not len(seen):
        return out
    room = (1 << BITS) - len(seen)
    share = counts[seen].astype(np.float64) / counts[seen].sum() * room
    out[seen] = 1 + np.floor(share).astype(np.int64)
    left = (1 << BITS) - int(out.sum())
    out[seen[np.argsort(np.floor(share) - share, kind="stable")[:left]]] += 1
    return out


class Coder:
    def __init__(self, frequencies: np.ndarray):
        self.f = frequencies.astype(np.uint64)
        self.c = (np.cumsum(frequencies) - frequencies).astype(np.uint64)
        self.most = self.f << np.uint64(63 - BITS)
        self.symbol = np.repeat(np.arange(len(frequencies), dtype=np.uint32), frequencies)
        self.fill = int(np.argmax(frequencies)) if len(frequencies) else 0

    def encode(self, ids: np.ndarray, lanes: int) -> tuple[bytes, bytes]:
        """(words, checkpoints) of the ids; a checkpoint is its words' position, the CRC of its ids and the states."""
        steps = -(-len(ids) // lanes)
        padded = np.full(steps * lanes, self.fill, np.int64)
        padded[: len(ids)] = ids
        rows = padded.reshape(steps, lanes)
        x = np.full(lanes, _LOW, np.uint64)
        bits, out, marks, written = np.uint64(BITS), [], [], 0
        for t in range(steps - 1, -1, -1):
            s = rows[t]
            f = self.f[s]
            full = x >= self.most[s]
            if full.any():
                low = x[full].astype(np.uint32)
                out.append(low)
                written += len(low)
                x = np.where(full, x >> np.uint64(32), x)
            q = x // f
            x = (q << bits) + (x - q * f) + self.c[s]
            if t % CHECK_STEPS == 0:
                marks.append((written, zlib.crc32(ids[t * lanes : (t + CHECK_STEPS) * lanes].astype("<u4").tobytes()), x))
        words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
        kept = b"".join(np.array([written - at, crc], "<u8").tobytes() + state.astype("<u8").tobytes() for at, crc, state in marks[::-1])
        return words.astype("<u4").tobytes(), kept

    def decode(self, words: bytes, checkpoints: bytes, n: int, lanes: int, part: int | None = None) -> np.ndarray:
        """The n ids, or only those of one stretch between checkpoints."""
        words, marks = np.frombuffer(words, "<u4"), np.frombuffer(checkpoints, "<u8").reshape(-1, lanes + 2)
        out = []
        for k in range(len(marks)) if part is None else [part]:
            at, crc, x = int(marks[k, 0]), int(marks[k, 1]), marks[k, 2:].astype(np.uint64)
            here = min(n - k * CHECK_STEPS * lanes, CHECK_STEPS * lanes)
            got = np.empty((-(-here // lanes), lanes), np.uint32)
            mask, bits = np.uint64((1 << BITS) - 1), np.uint64(BITS)
            for t in range(len(got)):
                slot = x & mask
                s = self.symbol[slot]
                got[t] = s
                x = self.f[s] * (x >> bits) + slot - self.c[s]
                short = np.flatnonzero(x < _LOW)
                if len(short):
                    x[short] = (x[short] << np.uint64(32)) | words[at : at + len(short)].astype(np.uint64)
                    at += len(short)
            ids = got.reshape(-1)[:here]
            if zlib.crc32(ids.astype("<u4").tobytes()) != crc:
                raise TokenFormatError(f"stretch {k}: checksum differs")
            out.append(ids)
        return np.concatenate(out) if out else np.zeros(0, np.uint32)


# -- tokenising -----------------------------------------------------------------------------------------------------

_ENCODERS: dict[str, _Table] = {}
_SEPARATOR = "\x01"
#: New pieces that a Python worker encodes at once.
NEW = 50_000
#: Kinds of bytes: letters, marks of ASCII but the apostrophe, others. The pre-tokenizer parts letters from marks.
_LETTER, _MARK = 1, 2
_KIND = np.array([_LETTER if c.isalpha() else _MARK if "!" <= c <= "~" and c != "'" and not c.isdigit() else 0 for c in map(chr, range(128))] + 128 * [0], np.uint8)
#: Second bytes of the letters of Latin-1 in UTF-8, behind 0xC3; the first 31 are capitals.
_LATIN = np.isin(np.arange(256), [x for x in range(0x80, 0xC0) if x not in (0x97, 0xB7)])


def id_type(tokenizer) -> str:
    """The numpy type that holds every id of the tokenizer and END_ID."""
    return "<u2" if tokenizer.get_vocab_size() < 1 << 16 else "<u4"


class _Words:
    """Ids of the pieces between blanks, as little-endian 16- or 32-bit bytes, encoded by the library when first seen.

    Only for tokenizers that drop white space, lower-case, and part letters from marks.
    """

    MOST = 500_000  # pieces kept by a Python worker

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.known: dict[str, bytes] = {}  # no subclass: set.difference is quick with plain ones only
        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = id_type(self.tokenizer)
        mark = self.tokenizer.encode(_SEPARATOR, add_special_tokens=False).ids
        self.mark = mark[0] if len(mark) == 1 else None

    def learn(self, pieces: list[str]) -> None:
        """Adds the pieces; those learned before may be forgotten."""
        if len(self.known) + len(pieces) > self.MOST:
            self.known.clear()
        self._encode([p for p in pieces if p not in self.known])

    def _encode(self, pieces: list[str]) -> None:
        plain = [p for p in pieces if _SEPARATOR not in p] if self.mark is not None else []
        parts = [plain[i : i + 4096] for i in range(0, len(plain), 4096)]
        joined = self.tokenizer.encode_batch_fast([f" {_SEPARATOR} ".join(x) for x in parts], add_special_tokens=False)
        width = np.dtype(self.dtype).itemsize
        for some, encoded in zip(parts, joined):
            ids = np.array(encoded.ids, self.dtype)
            ends = np.append(np.flatnonzero(ids == self.mark), len(ids))
            if len(ends) != len(some):  # a piece holds the separator's own id
                continue
            raw, at = ids.tobytes(), 0
            for piece, end in zip(some, (ends * width).tolist()):
                self.known[piece] = raw[at:end]
                at = end + width
        for piece in pieces:
            if piece not in self.known:
                self.known[piece] = np.array(self.tokenizer.encode(piece, add_special_tokens=False).ids, self.dtype).tobytes()

    def each(self, pieces: list[str]) -> list[bytes]:
        """The ids of each of these distinct pieces."""
        new = [p for p in pieces if p not in self.known]
        for i in range(0, len(new), NEW):
            self.learn(new[i : i + NEW])
        try:
            return [self.known[p] for p in pieces]
        except KeyError:  # learning forgot some
            out = []
            for i in range(0, len(pieces), NEW):
                self.learn(pieces[i : i + NEW])
                out += [self.known[p] for p in pieces[i : i + NEW]]
            return out


class _Table:
    """Ids of pieces of up to 16 bytes by the bytes themselves, in arrays; all others are asked from _Words by name.

    A slot holds one piece, and the first one keeps it. Where half of the slots are taken, all are given up.
    """

    SLOTS = 20  # bits

    def __init__(self, words: _Words):
        self.words = words
        self.clear()

    def clear(self) -> None:
        # the piece's bytes in two columns, then its size, 0 in a free slot, and the number and place of its ids
        self.slots = np.zeros((1 << self.SLOTS, 4), np.int64)
        self.ids, self.used, self.taken = np.array([END_ID], self.words.dtype), 1, 0

    def _room(self, n: int) -> None:
        if self.used + n > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(n, self.used), self.ids.dtype)])

    def encode(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, ends): the ids of the texts in data one after another, each closed by END_ID, and where each text ends."""
        data, start, size, owner = _pieces(data, offsets)
        low, high = _leading(data, start, size)
        slot = ((low ^ (high * np.uint64(0x9E3779B97F4A7C15)) ^ size.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - self.SLOTS)).astype(np.int64)
        if 2 * self.taken > 1 << self.SLOTS:
            self.clear()
        low, high = low.view(np.int64), high.view(np.int64)
        found = self.slots[slot]
        at, length = found[:, 3] >> 32, found[:, 3] & 0xFFFFFFFF
        missed = np.flatnonzero((found[:, 2] != size) | (found[:, 0] != low) | (found[:, 1] != high) | (size > 16))
        if len(missed):
            raw = data.tobytes()
            pieces = [raw[s:e].decode() for s, e in zip(start[missed].tolist(), (start[missed] + size[missed]).tolist())]
            names: dict[str, int] = {}
            which = np.array([names.setdefault(p, len(names)) for p in pieces])
            one = np.empty(len(names), np.int64)
            one[which] = missed  # a place of each name
            made = self.words.each(list(names))
            width = self.ids.dtype.itemsize
            n = np.array([len(x) // width for x in made], np.int64)
            # names that get a slot stay, the ids of all others are forgotten after these texts
            free = np.flatnonzero((found[one, 2] == 0) & (size[one] <= 16))
            stay = np.zeros(len(names), bool)
            stay[free[np.unique(slot[one[free]], return_index=True)[1]]] = True
            order = np.argsort(~stay, kind="stable")
            begin = np.empty(len(names), np.int64)
            begin[order] = self.used + np.cumsum(n[order]) - n[order]
            self._room(int(n.sum()))
            self.ids[self.used : self.used + int(n.sum())] = np.frombuffer(b"".join([made[i] for i in order.tolist()]), self.ids.dtype)
            self.used += int(n[stay].sum())
            self.taken += int(stay.sum())
            here = one[stay]
            self.slots[slot[here]] = np.stack([low[here], high[here], size[here], begin[stay] << 32 | n[stay]], axis=1)
            at[missed], length[missed] = begin[which], n[which]
        words_of = np.bincount(owner, minlength=len(offsets) - 1)
        close = np.cumsum(words_of) + np.arange(len(words_of))
        is_word = np.ones(len(start) + len(words_of), bool)
        is_word[close] = False
        all_at, all_length = np.zeros(len(is_word), np.int64), np.ones(len(is_word), np.int64)
        all_at[is_word], all_length[is_word] = at, length
        upto = np.cumsum(all_length)
        ids = self.ids[np.arange(int(upto[-1])) + np.repeat(all_at - upto + all_length, all_length)]
        return ids, upto[close]


def _pieces(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, start, size, text index) of the pieces between blanks.

    A piece of letters, and marks behind them, is parted into the two, and its letters become lower-case, so that the
    library sees each word once.
    """
    n = len(data)
    ink = (data != 0x20) & (data != 0x0A)
    first, last = ink.copy(), ink.copy()
    first[1:] &= ~ink[:-1]
    last[:-1] &= ~ink[1:]
    edge = offsets[offsets < n]
    first[edge] = ink[edge]
    edge = offsets[offsets > 0] - 1
    last[edge] = ink[edge]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    kind = _KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[_LATIN[data[lead + 1]]]
    kind[lead] = kind[lead + 1] = _LETTER
    other = kind == 0
    other[1:] |= (kind[1:] == _LETTER) & (kind[:-1] == _MARK) & ~first[1:]
    others, letters = np.zeros(n + 1, np.int32), np.zeros(n + 1, np.int32)
    np.cumsum(other, out=others[1:])
    np.cumsum(kind == _LETTER, out=letters[1:])
    plain = (others[end] == others[start]) & (kind[start] == _LETTER) if n else np.zeros(0, bool)
    capital = (data >= 0x41) & (data <= 0x5A)
    second = lead[data[lead + 1] < 0x9F] + 1
    capital[second] = True
    capital = np.flatnonzero(capital)
    data = data.copy()
    data[capital[plain[np.searchsorted(start, capital, "right") - 1]]] += 0x20
    middle = np.where(plain, start + letters[end] - letters[start], end)
    marked = middle < end
    # the marks of a piece come right behind its letters
    at = np.arange(len(start)) + np.cumsum(marked) - marked
    starts, ends = np.empty(len(start) + int(marked.sum()), np.int64), np.empty(len(start) + int(marked.sum()), np.int64)
    starts[at], ends[at] = start, middle
    starts[at[marked] + 1], ends[at[marked] + 1] = middle[marked], end[marked]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(np.searchsorted(starts, offsets)))
    return data, starts, ends - starts, owner


def _leading(data: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first 8 bytes and the next 8 of each stretch as integers, with zeros behind its end."""
    padded = np.zeros((len(data) + 7) // 8 * 8 + 24, np.uint8)
    padded[: len(data)] = data
    eights, word, shift = padded.view("<u8"), start >> 3, ((start & 7) << 3).astype(np.uint64)
    a, b, c = eights[word], eights[word + 1], eights[word + 2]
    rest = np.uint64(63) - shift  # a shift by 64 in two steps
    low, high = (a >> shift) | (b << rest << np.uint64(1)), (b >> shift) | (c << rest << np.uint64(1))
    return low & _FIRST_BYTES[np.minimum(size, 8)], high & _FIRST_BYTES[np.clip(size - 8, 0, 8)]


_FIRST_BYTES = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def _tokenised(batches, path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    table = _ENCODERS.get(path) or _ENCODERS.setdefault(path, _Table(_Words(path)))
    for batch in batches:
        for i, j, data, offsets in text_chunks(batch.column(1)):
            ids, ends = table.encode(data, offsets)
            width = ids.dtype.itemsize
            bounds = pa.array(np.append(0, ends) * width, pa.int64()).buffers()[1]
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), j - i, [None, bounds, pa.py_buffer(ids)])
            yield pa.record_batch([batch.column(0).slice(i, j - i), raw.cast(pa.binary())], ["doc_id", "ids"])


def _counts(batches, dtype: str):
    total = np.zeros(1, np.int64)
    for batch in batches:
        for i in range(0, len(batch), 256):
            n = np.bincount(np.frombuffer(b"".join(batch.column(0).slice(i, 256).to_pylist()), dtype))
            if len(n) > len(total):
                total = np.pad(total, (0, len(n) - len(total)))
            total[: len(n)] += n
    seen = np.flatnonzero(total)
    yield pa.record_batch([pa.array(seen), pa.array(total[seen])], ["symbol", "n"])


def _blocks(batches, frequencies: np.ndarray, dtype: str):
    from pyspark import TaskContext

    coder, shard = Coder(frequencies), TaskContext.get().partitionId()
    block = first = 0
    ids, docs, lengths, size = [], [], [], 0

    def row():
        nonlocal block, first, ids, docs, lengths, size
        tokens = np.concatenate(ids)
        lanes = 1024 if len(tokens) >= 1 << 16 else 32
        words, marks = coder.encode(tokens, lanes)
        index = pa.array(docs, pa.int64()), np.array(lengths, "<i8").tobytes()
        # a null doc_id is written as the least 64-bit integer, which sorts where Spark sorts nulls
        index = np.array(index[0].fill_null(-(1 << 63)), "<i8").tobytes(), index[1]
        values = [shard, block, first, len(docs), len(tokens), lanes, *index, zlib.crc32(index[0] + index[1]), words, marks]
        block, first = block + 1, first + len(tokens)
        ids, docs, lengths, size = [], [], [], 0
        types = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.binary(), pa.binary()]
        return pa.record_batch([pa.array([v], t) for v, t in zip(values, types)], [x.split()[0] for x in BLOCKS.split(", ")])

    for batch in batches:
        for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            got = np.frombuffer(raw, dtype)
            if size and size + len(got) > BLOCK_TOKENS:
                yield row()
            ids.append(got)
            docs.append(doc)
            lengths.append(len(got))
            size += len(got)
    if docs:
        yield row()


def _read(batches, frequencies: np.ndarray, bases: dict[int, int]):
    coder = Coder(frequencies)
    for batch in batches:
        for r in batch.to_pylist():
            if zlib.crc32(r["doc_ids"] + r["doc_lengths"]) != r["index_crc32"]:
                raise TokenFormatError(f"shard {r['shard']}, block {r['block']}: index checksum differs")
            ids = coder.decode(r["words"], r["checkpoints"], r["n_tokens"], r["lanes"])
            docs, lengths = np.frombuffer(r["doc_ids"], "<i8"), np.frombuffer(r["doc_lengths"], "<i8")
            ends = np.cumsum(lengths)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * (e - n) : 4 * e]) for e, n in zip(ends.tolist(), lengths.tolist())]
            start = bases[r["shard"]] + r["first_token"] + ends - lengths
            yield pa.record_batch(
                [pa.array(docs, mask=docs == -(1 << 63)), pa.array(start), pa.array(lengths), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"]
            )


def write_tokens(docs: DataFrame, path: str, tokenizer_path: str) -> None:
    """Writes the token files of docs (doc_id, text), each text ended by END_ID, in ascending doc_id order.

    Null doc_ids come first; rows that repeat a doc_id are in the order of their ids; a null text is an empty one. The
    ids pass a table in the shared folder, so nothing is tokenised twice. Of the driver's data, the frequencies grow
    with the vocabulary and the shard totals with the number of partitions, neither with the rows.
    """
    from tokenizers import Tokenizer

    spark, dtype = docs.sparkSession, id_type(Tokenizer.from_file(tokenizer_path))
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(released(lambda it: _tokenised(it, tokenizer_path)), "doc_id long, ids binary")
    ids = stage(ids, "ids")
    give_back(spark)  # the tokenizer too, of which the driver needs the vocabulary's size alone
    counted = ids.select("ids").mapInArrow(released(lambda it: _counts(it, dtype)), "symbol long, n long").groupBy("symbol").agg(F.sum("n")).collect()
    counts = np.zeros(max([-1, *(r[0] for r in counted)]) + 1, np.int64)
    for s, n in counted:
        counts[s] = n
    frequencies = normalised(counts)
    spark.createDataFrame([(i, int(f)) for i, f in enumerate(frequencies) if f], "symbol long, frequency long").coalesce(1).write.parquet(f"{path}/frequencies")
    shards = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = ids.repartitionByRange(shards, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "ids")
    placed.mapInArrow(released(lambda it: _blocks(it, frequencies, dtype)), BLOCKS).write.parquet(f"{path}/blocks")
    spark.read.schema(BLOCKS).parquet(f"{path}/blocks").groupBy("shard").agg(F.sum("n_tokens").alias("n_tokens")).coalesce(1).write.parquet(f"{path}/shards")


def read_tokens(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, from the token files alone."""
    found = spark.read.schema("symbol long, frequency long").parquet(f"{path}/frequencies").collect()
    frequencies = np.zeros(max([-1, *(r[0] for r in found)]) + 1, np.int64)
    for s, n in found:
        frequencies[s] = n
    bases, at = {}, 0
    for shard, n in sorted(map(tuple, spark.read.schema("shard int, n_tokens long").parquet(f"{path}/shards").collect())):
        bases[shard] = at
        at += n
    blocks = spark.read.schema(BLOCKS).parquet(f"{path}/blocks")
    return blocks.mapInArrow(released(lambda it: _read(it, frequencies, bases)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def encoded_documents(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """Writes docs' token files into the shared folder and returns what read_tokens finds in them."""
    path = f"{shared_dir(docs.sparkSession)}/tokens"
    write_tokens(docs, path, tokenizer_path)
    return read_tokens(docs.sparkSession, path)
