"""Substring dedup by fixed-block anchors: removes words of a window that also starts earlier."""

from __future__ import annotations

import hashlib
from itertools import compress

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm.common import buffers, cut, dealt, doc_key, drop, hash_words, mix, pieces, read, release, rolling, same_key, split_words

_PIECE = 2 << 20  # bytes of text at once
_OTHER = np.uint64(0xD6E8FEB86659FD93)


def _words(data: np.ndarray, offsets: np.ndarray):
    """Hash and text number of each word, its place in the text, and n+1 offsets of first words."""
    starts, ends, first = split_words(data, offsets)
    n = np.diff(first)
    doc = np.repeat(np.arange(len(n)), n)
    return hash_words(data, starts, ends), doc, np.arange(len(starts)) - first[doc], n


def _ids(batch) -> np.ndarray:
    """Keys of a batch's texts, as rows of two."""
    d = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    return np.stack([d, batch.column(1).to_numpy(zero_copy_only=False)], axis=1)


def _piece(ids: np.ndarray) -> int:
    """A name for some texts that any rerun gives again."""
    import xxhash

    h = xxhash.xxh3_64_intdigest(ids.tobytes())
    return h - (1 << 64) * (h >> 63)


def _batch(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    kinds = {"bucket": pa.int32(), "piece": pa.int64()}
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], kinds.get(n, pa.binary())) for c, n in enumerate(names)], names=names)


_SENT = ["bucket", "piece", "probes", "keys", "place", "docs", "first"]


def _index_and_probes(width: int, buckets: int):
    """One row a bucket and piece: keys of every rolling block, and place of those on fixed block borders.

    Within a piece each key is sent once, however often it occurs. A bordered block whose key occurs again in
    its own piece is a hit already; its place goes past the buckets, in a row of the piece that also holds its
    texts' keys and first words. Places are word numbers in the piece.
    """
    block = width // 2

    def run(batches):
        for batch in batches:
            data_, offsets_ = buffers(batch.column(2))
            ids = _ids(batch)
            for i, j in pieces(offsets_, _PIECE):
                h, doc, at, n = _words(data_[offsets_[i] : offsets_[j]], offsets_[i : j + 1] - offsets_[i])
                k = mix(rolling(h, block))
                doc, at = doc[: len(k)], at[: len(k)]
                place = np.flatnonzero((at + block <= n[doc]) & (n[doc] >= width))
                if not len(place):
                    continue
                k = k[place]
                bucket = (k >> np.uint64(32)) % np.uint64(buckets)
                full = (bucket << np.uint64(32)) | (k & np.uint64(0xFFFFFFFF))
                order = np.argsort(full, kind="stable")
                full, place = full[order], place[order]
                new = np.concatenate([[True], full[1:] != full[:-1]])
                times = np.bincount(np.cumsum(new) - 1)[np.cumsum(new) - 1]
                border = at[place] % block == 0
                own, probe = np.flatnonzero(border & (times == 1)), np.flatnonzero(new & ~(border & (times == 1)))
                pb, bb = (full[probe] >> np.uint64(32)).astype(np.int64), (full[own] >> np.uint64(32)).astype(np.int64)
                used = np.union1d(pb, bb)
                p_edge, b_edge = np.searchsorted(pb, np.append(used, buckets)), np.searchsorted(bb, np.append(used, buckets))
                low, place = full.astype(np.uint32), place.astype(np.uint32)
                name = _piece(ids[i:j])
                known = place[border & (times > 1)].tobytes()
                rows = [(name % buckets, name, b"", b"", known, ids[i:j].tobytes(), np.concatenate([[0], np.cumsum(n)]).astype(np.int64).tobytes())]
                for u in range(len(used)):
                    pr, ow = probe[p_edge[u] : p_edge[u + 1]], own[b_edge[u] : b_edge[u + 1]]
                    rows.append((int(used[u]), name, low[pr].tobytes(), low[ow].tobytes(), place[ow].tobytes(), None, None))
                yield _batch(rows, _SENT)

    return run


_REPLY = "piece long, place binary, docs binary, first binary"


def _replies(rows: list[tuple]):
    import pyarrow as pa

    names = ["piece", "place", "docs", "first"]
    return pa.table({n: pa.array([r[c] for r in rows], pa.int64() if c == 0 else pa.binary()) for c, n in enumerate(names)})


def _hits(key, table):
    """Bordered blocks whose key any other rolling block has; one reply a piece."""
    got = table.to_pylist()
    low = [np.frombuffer(r["keys"], np.uint32) for r in got]
    every = np.sort(np.concatenate([np.frombuffer(r["probes"], np.uint32) for r in got] + low))
    rows = []
    for r, k in zip(got, low):
        if r["docs"] is not None:
            rows.append((r["piece"], r["place"], r["docs"], r["first"]))
            continue
        more = np.searchsorted(every, k, "right") - np.searchsorted(every, k, "left") > 1
        if more.any():
            rows.append((r["piece"], np.frombuffer(r["place"], np.uint32)[more].tobytes(), None, None))
    return _replies(rows)


def _by_doc(key, table):
    """Replies of a piece, as the word numbers within each of its texts."""
    import pyarrow as pa

    got = table.to_pylist()
    about = next(r for r in got if r["docs"] is not None)
    ids, first = np.frombuffer(about["docs"], np.int64).reshape(-1, 2), np.frombuffer(about["first"], np.int64)
    place = np.unique(np.frombuffer(b"".join(r["place"] for r in got), np.uint32)).astype(np.int64)
    doc = np.searchsorted(first, place, "right") - 1
    at = (place - first[doc]).astype(np.uint32)
    cuts = np.searchsorted(doc, np.arange(len(ids) + 1))
    some = np.flatnonzero(np.diff(cuts))
    return pa.table({"_d": pa.array(ids[some, 0]), "_h": pa.array(ids[some, 1]), "v": pa.array([at[cuts[x] : cuts[x + 1]].tobytes() for x in some.tolist()], pa.binary())})


def _gathered(replies: DataFrame) -> DataFrame:
    """(_d, _h, v): all places of each text; rows that repeat with one key share them."""
    return replies.groupBy("piece").applyInArrow(_by_doc, "_d long, _h long, v binary").groupBy("_d", "_h").agg(F.collect_list("v").alias("v"))


def _unpack(found) -> np.ndarray:
    return np.frombuffer(b"".join(found or []), np.uint32).astype(np.int64)


_FOUND = ["bucket", "piece", "keys", "place", "doc", "ids", "docs", "first"]


def _windows(width: int, buckets: int):
    """Extension: each window over a hit block, under a hash of all its words. Only the first of a piece's equals goes out."""
    block = width // 2

    def run(batches):
        for batch in batches:
            data_, offsets_ = buffers(batch.column(2))
            ids = _ids(batch)
            found = batch.column(3).to_pylist()
            for i, j in pieces(offsets_, _PIECE):
                h, doc, at, n = _words(data_[offsets_[i] : offsets_[j]], offsets_[i : j + 1] - offsets_[i])
                raw = rolling(h, width)
                if not len(raw):
                    continue
                first = np.concatenate([[0], np.cumsum(n)])
                hit = np.zeros(first[-1] + width, bool)
                for x in range(j - i):
                    hit[first[x] + _unpack(found[i + x])] = True
                doc, at = doc[: len(raw)], at[: len(raw)]
                place = np.flatnonzero(at + width <= n[doc])
                place = place[hit[place + -at[place] % block]]  # the first whole block of the window
                if not len(place):
                    continue
                raw, at, doc = raw[place], at[place], doc[place]
                k, other = mix(raw), mix(raw * _OTHER + np.uint64(1))
                did = ids[i + doc, 0]
                order = np.lexsort((at, did, k))
                k, other, place, at, did, doc = k[order], other[order], place[order], at[order], did[order], doc[order]
                new = np.concatenate([[True], k[1:] != k[:-1]])
                head = np.flatnonzero(new)[np.cumsum(new) - 1]
                later = (did != did[head]) | (at != at[head])  # equal places of rows that share an id are no earlier ones
                known = place[later].astype(np.uint32).tobytes()
                bucket = (other % np.uint64(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                order = order[~later[order]]
                k, place, doc, bucket = k[order], place[order].astype(np.uint32), doc[order], bucket[order]
                cuts = np.concatenate([[0], np.flatnonzero(bucket[1:] != bucket[:-1]) + 1, [len(bucket)]])
                name = _piece(ids[i:j])
                rows = [(name % buckets, name, b"", known, b"", b"", ids[i:j].tobytes(), first.astype(np.int64).tobytes())]
                for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                    docs, inv = np.unique(doc[a:b], return_inverse=True)
                    small = np.uint16 if len(docs) <= 1 << 16 else np.uint32
                    about = np.stack([ids[docs + i, 0], first[docs]], axis=1)  # id, and the place its words are counted from
                    rows.append((int(bucket[a]), name, k[a:b].tobytes(), place[a:b].tobytes(), inv.astype(small).tobytes(), about.tobytes(), None, None))
                yield _batch(rows, _FOUND)

    return run


def _later(key, table):
    """Windows whose words also start earlier: in another document of smaller id, or earlier in the same. One reply a piece."""
    every = table.to_pylist()
    rows = [(r["piece"], r["place"], r["docs"], r["first"]) for r in every if r["docs"] is not None]
    got = [r for r in every if r["docs"] is None]
    if not got:
        return _replies(rows)
    place = [np.frombuffer(r["place"], np.uint32) for r in got]
    k = np.concatenate([np.frombuffer(r["keys"], np.uint64) for r in got])
    ids, at = [], []
    for r, p in zip(got, place):
        about = np.frombuffer(r["ids"], np.int64).reshape(-1, 2)
        doc = np.frombuffer(r["doc"], np.uint16 if len(about) <= 1 << 16 else np.uint32)
        ids.append(about[doc, 0])
        at.append(p.astype(np.int64) - about[doc, 1])
    d, p = np.concatenate(ids), np.concatenate(at)
    order = np.lexsort((p, d, k))
    k, d, p = k[order], d[order], p[order]
    new = np.concatenate([[True], k[1:] != k[:-1]])
    head = np.flatnonzero(new)[np.cumsum(new) - 1]
    gone = np.zeros(len(k), bool)
    gone[order] = (d != d[head]) | (p != p[head])
    start = 0
    for r, x in zip(got, place):
        out = gone[start : start + len(x)]
        start += len(x)
        if out.any():
            rows.append((r["piece"], x[out].tobytes(), None, None))
    return _replies(rows)


def _kept(width: int, with_text: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            for text, found in zip(batch.column(1), batch.column(2)):
                words = (text.as_py() or "").encode().split()  # bytes: at space and 9 to 13 only
                n = len(words)
                starts = _unpack(found.as_py())
                spans = []
                if len(starts):
                    delta = np.zeros(n + 1, np.int64)
                    np.add.at(delta, starts, 1)
                    np.add.at(delta, np.minimum(starts + width, n), -1)
                    gone = np.cumsum(delta[:-1]) > 0
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
                    spans = edge.tolist()
                    words = list(compress(words, (~gone).tolist()))
                left = b" ".join(words)
                for c, v in zip(cols, (n, n - len(words), hashlib.sha256(left).hexdigest(), spans, left.decode() if with_text else None)):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(cols, types)][: 5 if with_text else 4]], names=["doc_id", "n_words", "n_removed", "kept_sha256", "spans", "kept_text"][: 6 if with_text else 5])

    return run


def remove_repeated_windows(docs: DataFrame, width: int = 20, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, spans[, kept_text]) of every whole text.

    Removes each word covered by a window of width words that also starts earlier (smaller doc_id, or
    the same document further left), judged on the input. Non-overlapping blocks of half a window are
    the index; every rolling block of every text probes it. Each window holds a whole block, so both
    ends of a repeat have a block that is hit. Hits are extended to whole windows, which meet under a
    hash of all their words (64 bits and the bucket's own); all but the earliest go, and neighbouring
    ones merge to maximal repeats. Each piece of text sends a key once, so a passage in a third of
    all texts sends one row a piece to its bucket.

    Null text: no words. Fewer words than a window: nothing removed. Rows that share a doc_id count as
    one document; repeated rows get equal results. A null doc_id stands before all others. Windows
    never cross documents. Other columns are not read.
    """
    if width % 2:
        raise ValueError("width must be even")
    spark = docs.sparkSession
    keyed = docs.select(*doc_key(F.col("doc_id"), F.col("text")), "text")
    buckets = dealt(spark, docs)
    kinds = {"bucket": "int", "piece": "long"}
    schema = lambda names: ", ".join(f"{n} {kinds.get(n, 'binary')}" for n in names)
    sent = keyed.mapInArrow(_index_and_probes(width, buckets), schema(_SENT))
    hits = cut(_gathered(sent.groupBy("bucket").applyInArrow(_hits, _REPLY)), "windows-hits")
    del sent
    release(spark)
    null_safe = F.coalesce(keyed["_d"], F.lit(-(1 << 63)))
    over = hits.join(keyed.withColumn("_d", null_safe), ["_d", "_h"]).select("_d", "_h", "text", "v").sortWithinPartitions("_d", "_h")
    seen = over.mapInArrow(_windows(width, buckets), schema(_FOUND))
    later = cut(_gathered(seen.groupBy("bucket").applyInArrow(_later, _REPLY)), "windows-later")
    drop(hits)
    del over, seen
    release(spark)
    whole = docs.select(*doc_key(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))), F.col("text")), F.col("doc_id").cast("long").alias("doc_id"), "text")
    joined = whole.join(later, same_key(whole, later), "left").select("doc_id", "text", "v")
    return joined.mapInArrow(_kept(width, with_text), "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<long>" + ", kept_text string" * with_text)


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 7: windows of 20 words that also start earlier."""
    return remove_repeated_windows(read(spark, sf_dir, "documents"))


QUERIES = {"op7_substring_dedup": op7_substring_dedup}
SQL: dict[str, str] = {}
