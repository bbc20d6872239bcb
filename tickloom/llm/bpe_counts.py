"""Token counts by rank-synchronous array merging.

Texts are cut into pieces (blank and what follows, or a run of white space) whose tokens do not depend on their
neighbours. Pieces not seen before are split into pre-tokens and held together as one ragged numpy array of symbols. In
each round every pre-token finds its pair of the lowest rank and merges all places of that pair at once; pre-tokens
without a known pair are done, and the surviving symbols are their tokens.
"""

from __future__ import annotations

import json
import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: white space as the tokenizers' regular expressions see it.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pre-token rule of byte-level BPE.
_RULE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^S\p{L}\p{N}]+|[S]+(?![^S])|[S]+".replace("S", _SPACE)
_NONE = np.iinfo(np.int64).max


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself, or the next free one from U+0100 on."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class ByteBpe:
    MOST = 500_000  # pieces kept by a Python worker

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        vocab = told["model"]["vocab"]
        merges = [m if isinstance(m, list) else m.split(" ") for m in told["model"]["merges"]]
        self.first = np.array([vocab[c] for c in _byte_symbols()], np.int64)
        key = np.array([(vocab[a] << 20) | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order
        self.merged = np.array([vocab[a + b] for a, b in merges], np.int64)
        self.special = [t["content"] for t in told["added_tokens"]]
        self.special_rule = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or "(?!)")
        self.pieces = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
        self.rule = regex.compile(_RULE)
        self.known: dict[str, int] = {}

    def merge_counts(self, words: list[bytes]) -> np.ndarray:
        """Surviving symbols of each word."""
        n = np.array([len(w) for w in words], np.int64)
        out = n.copy()
        symbol = self.first[np.frombuffer(b"".join(words), np.uint8)]
        owner = np.repeat(np.arange(len(words)), n)
        while len(symbol) > 1:
            pair = (symbol[:-1] << 20) | symbol[1:]
            at = np.minimum(np.searchsorted(self.key, pair), len(self.key) - 1)
            rank = np.where((self.key[at] == pair) & (owner[:-1] == owner[1:]), self.rank[at], _NONE)
            rank = np.append(rank, _NONE)
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            lowest = np.minimum.reduceat(rank, start)
            sizes = np.diff(np.append(start, len(symbol)))
            out[owner[start]] = sizes
            lowest = np.repeat(lowest, sizes)
            live = lowest < _NONE
            symbol, owner, rank, lowest = symbol[live], owner[live], rank[live], lowest[live]
            if not len(symbol):
                break
            hit = rank == lowest
            # of places that overlap (a run of one symbol), every other one from the left
            run = np.flatnonzero(hit & ~np.r_[False, hit[:-1]])
            hit &= (self._place(hit, run) & 1) == 0
            symbol = np.where(hit, self.merged[np.where(hit, rank, 0)], symbol)
            keep = ~np.r_[False, hit[:-1]]
            symbol, owner = symbol[keep], owner[keep]
        if len(symbol) == 1:
            out[owner[0]] = 1
        return out

    @staticmethod
    def _place(hit: np.ndarray, run: np.ndarray) -> np.ndarray:
        if not len(run):
            return np.zeros(len(hit), np.int64)
        return np.arange(len(hit)) - np.concatenate([np.zeros(run[0], np.int64), np.repeat(run, np.diff(np.append(run, len(hit))))])

    def learn(self, pieces: list[str]) -> None:
        if len(self.known) + len(pieces) > self.MOST:
            self.known.clear()
        words, owner = [], []
        for k, piece in enumerate(pieces):
            for w in self.rule.findall(piece):
                words.append(w.encode())
                owner.append(k)
        counts = np.bincount(np.array(owner, np.int64), self.merge_counts(words), len(pieces)) if words else np.zeros(len(pieces))
        self.known.update(zip(pieces, counts.astype(np.int64).tolist()))

    def count(self, texts: list[str]) -> list[int]:
        known, cut = self.known, []
        extra = [0] * len(texts)
        for k, t in enumerate(texts):
            if self.special and any(s in t for s in self.special):
                parts = self.special_rule.split(t)
                extra[k] = len(parts) - 1
                cut.append([p for part in parts for p in self.pieces.findall(part)])
            else:
                cut.append(self.pieces.findall(t))
        out, i = [], 0
        while i < len(cut):
            j, new = i, {}
            while j < len(cut) and len(new) < 50_000:
                new.update((p, None) for p in cut[j] if p not in known)
                j += 1
            before = len(known)
            self.learn(list(new))
            if len(known) < before + len(new):  # it was cleared
                self.learn(list({p for c in cut[i:j] for p in c if p not in known}))
            out += [sum([known[p] for p in c]) for c in cut[i:j]]
            i = j
        return [n + x for n, x in zip(out, extra)]


_COUNTERS: dict[str, ByteBpe] = {}


def _counted(batches, path: str):
    counter = _COUNTERS.get(path) or _COUNTERS.setdefault(path, ByteBpe(path))
    for batch in batches:
        texts = batch.column(1)
        n = [x for i in range(0, len(texts), 500) for x in counter.count([t or "" for t in texts.slice(i, 500).to_pylist()])]
        yield pa.record_batch([batch.column(0), batch.column(2), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])


def token_counts(docs: DataFrame, tokenizer_path: str, limit: int = 512) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row of docs (doc_id, text).

    The tokens are those of the library with its defaults and without added special tokens; special strings inside texts
    count as one token each. A null text is empty and has none. Ids may be null or repeat; other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    out = slim.mapInArrow(lambda it: _counted(it, tokenizer_path), "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)
