"""Byte-level BPE encoding and decoding with a two-tier lookup."""

from __future__ import annotations

import base64
import hashlib
import heapq
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from meterflow.llm.common import buffers, hash_words, mix, pieces, read

class MinimalPerfectHash:
    """Hash and displace: n keys onto 0..n-1 with one number for each bucket of about three keys.

    A bucket of several keys holds the displacement under which all of them fall on free slots; a bucket
    of one key holds its slot itself, as -1 - slot, so the last slots need no search.
    """

    def __init__(self, keys: list[bytes]):
        self.n = max(1, len(keys))
        self.buckets = max(1, self.n // 3)
        h = self.hashes(keys)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        edges = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        size = np.diff(edges)
        self.shift = np.zeros(self.buckets, np.int64)
        self.slot = np.zeros(self.n, np.int64)
        taken = np.zeros(self.n, bool)
        for b in np.argsort(-size, kind="stable").tolist():
            if size[b] < 2:
                break
            members = order[edges[b] : edges[b + 1]]
            for first in range(0, 1 << 24, 64):  # 64 displacements at once
                at = self._place(h[members][None, :], np.arange(first, first + 64)[:, None])
                at.sort(axis=1)
                good = np.flatnonzero(~taken[at].any(axis=1) & (at[:, 1:] != at[:, :-1]).all(axis=1))
                if len(good):
                    break
            self.shift[b] = first + good[0]
            place = self._place(h[members], self.shift[b])
            taken[place] = True
            self.slot[place] = members
        single = np.flatnonzero(size == 1)
        free = np.flatnonzero(~taken)[: len(single)]
        self.shift[single] = -1 - free
        self.slot[free] = order[edges[single]]

    @staticmethod
    def hashes(words: list[bytes]) -> np.ndarray:
        size = np.array([len(w) for w in words], np.int64)
        ends = np.cumsum(size)
        return hash_words(np.frombuffer(b"".join(words), np.uint8), ends - size, ends)

    def _place(self, h: np.ndarray, d) -> np.ndarray:
        return (mix(h + np.asarray(d).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(self.n)).astype(np.int64)

    def index(self, words: list[bytes]) -> np.ndarray:
        """Number of the only key that can equal each word; the caller compares."""
        if not words:
            return np.zeros(0, np.int64)
        h = self.hashes(words)
        d = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        return self.slot[np.where(d < 0, -1 - d, self._place(h, np.maximum(d, 0)))]


class Bpe:
    """Encoder and decoder of one rank file; tiers: whole pre-token by perfect hash, else merges by heap."""

    #: Pre-tokens in each of the two remembered generations; forgetting changes no result.
    REMEMBERED = 150_000

    def __init__(self, ranks_path: str, pattern: str):
        import regex

        self.words: list[bytes] = []
        self.ids: list[int] = []
        with open(ranks_path, "rb") as f:
            for line in f:
                if line.strip():
                    word, rank = line.split()
                    self.words.append(base64.b64decode(word))
                    self.ids.append(int(rank))
        self.perfect = MinimalPerfectHash(self.words)
        self.ranks = dict(zip(self.words, self.ids))  # for pairs within a miss
        by_id: list[bytes | None] = [None] * (max(self.ids, default=-1) + 1)
        for w, i in zip(self.words, self.ids):
            by_id[i] = w
        self.by_id = by_id
        self.find = regex.compile(pattern).findall
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def merges(self, word: bytes) -> list[int]:
        """Ids of a word by merging the pair of least rank, leftmost first.

        The parts are a linked list over the word's bytes; a heap holds rank * n + first byte of each
        pair, and an entry counts only while its pair still has that rank.
        """
        n, get = len(word), self.ranks.get
        nxt, prv = list(range(1, n + 2)), list(range(-1, n))
        pair = [-1] * n
        heap = []
        for i in range(n - 1):
            r = get(word[i : i + 2])
            if r is not None:
                pair[i] = r
                heap.append(r * n + i)
        heapq.heapify(heap)
        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if pair[i] != r:
                continue
            j = nxt[i]
            pair[j] = -1
            k = nxt[i] = nxt[j]
            prv[k] = i
            for a in (prv[i], i):
                if a >= 0 and nxt[a] < n:
                    r = get(word[a : nxt[nxt[a]]])
                    if r is None:
                        pair[a] = -1
                    elif r != pair[a] or a == i:
                        pair[a] = r
                        heapq.heappush(heap, r * n + a)
                elif a >= 0:
                    pair[a] = -1
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : nxt[i]]])
            i = nxt[i]
        return out

    def resolve(self, tokens: list[str]) -> dict[str, bytes]:
        """Ids of distinct pre-tokens as little-endian 32-bit integers: all through the perfect hash, then misses."""
        words = [t.encode() for t in tokens]
        out = {}
        for t, w, i in zip(tokens, words, self.perfect.index(words).tolist()):
            ids = [self.ids[i]] if self.words and self.words[i] == w else self.merges(w)
            out[t] = struct.pack(f"<{len(ids)}I", *ids)
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers."""
        tokens = [self.find(t) for t in texts]
        known, missing = {}, []
        new, old = self.new, self.old
        for t in set().union(*tokens):
            got = new.get(t)
            if got is None:
                got = old.get(t)
                if got is None:
                    missing.append(t)
                    continue
                new[t] = got
            known[t] = got
        found = self.resolve(missing)
        known.update(found)
        new.update((t, v) for t, v in found.items() if len(t) <= 64)
        if len(new) > self.REMEMBERED:
            self.new, self.old = {}, new
        return [b"".join([known[t] for t in row]) for row in tokens]

    def decode(self, ids: np.ndarray) -> bytes:
        table = self.by_id
        return b"".join([table[i] for i in ids.tolist()])


_made: dict[tuple[str, str], Bpe] = {}


def encoder(ranks_path: str, pattern: str) -> Bpe:
    """One encoder for each Python worker; the file's place is the same on all machines."""
    if (ranks_path, pattern) not in _made:
        _made[ranks_path, pattern] = Bpe(ranks_path, pattern)
    return _made[ranks_path, pattern]


def encode_documents(docs: DataFrame, ranks_path: str, pattern: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256[, ids]): each text encoded and decoded again.

    Each match of pattern is encoded alone, without special tokens. Null text: as the empty text, no
    tokens. Repeated rows: equal rows. Very long texts and pre-tokens: whole; a pre-token of n bytes
    takes n log n steps. Extra columns of docs are not read. No shuffle; the vocabulary (bounded by its
    file) is loaded once by each worker.
    """
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids

    def run(batches):
        import pyarrow as pa

        bpe = encoder(ranks_path, pattern)
        sha = lambda x: hashlib.sha256(x).hexdigest()
        for batch in batches:
            _, offsets = buffers(batch.column(1))
            for at, to in pieces(offsets, 2 << 20):
                part = batch.slice(at, to - at)
                counts, a, b, lists = [], [], [], []
                for packed in bpe.encode([t or "" for t in part.column(1).to_pylist()]):
                    ids = np.frombuffer(packed, "<u4")
                    counts.append(len(ids))
                    a.append(sha(packed))
                    b.append(sha(bpe.decode(ids)))
                    if with_ids:
                        lists.append(ids.astype(np.int32))
                cols = [part.column(0), pa.array(counts, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())]
                if with_ids:
                    cols.append(pa.array(lists, pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids"] * with_ids)

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, schema)


def encode_with_public_vocabulary(docs: DataFrame) -> DataFrame:
    import public_tokenizers

    return encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_with_public_vocabulary(read(spark, sf_dir, "documents"))


QUERIES = {"op5_byte_bpe": op5_byte_bpe}
SQL: dict[str, str] = {}
