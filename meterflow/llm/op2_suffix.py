"""Suffix-array dedup: removes every byte of a string of given length that also starts elsewhere."""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm.common import buffers, cut, dealt, doc_key, drop, mix, pieces, read, release, same_key

GRAM = 32  # bytes of an anchor
_POS = np.uint64((1 << 24) - 1)
_SLICE = 1 << 20  # bytes of text at once; a longer text goes in overlapping slices
#: Distinct contexts of an anchor that are sorted as one group; more are dealt anew by block and core.
GROUP = 1000
BLOCK = 16
#: A passage of over 50 words: repeats of so many bytes (51 words of five, the space after each included) and words.
PASSAGE = (255, 51)
_NO_ID = -(1 << 63)


# -- two-stage suffix sorting ----------------------------------------------------------------------------


def two_stage_order(data: np.ndarray, ends: np.ndarray, need: np.ndarray, depth: int) -> np.ndarray:
    """Needed suffixes in order, equal to depth bytes at least. ends: each context's end in data, ascending.

    A suffix ends with its context, which sorts first. Suffixes smaller than their successor are sorted
    directly, by their first depth bytes; all others are induced: a scan over the buckets of first
    bytes, smallest first, appends the predecessor of each suffix met to its own bucket. Needed
    suffixes are joined by those after a context's last needed one up to the next that is sorted
    directly (or the end), so that each induced suffix has its successor in the order.
    """
    n = len(data)
    nxt = np.empty(n, np.int16)
    nxt[:-1] = data[1:]
    nxt[ends - 1] = -1
    diff = np.sign(nxt - data.astype(np.int16))
    where = np.where(diff != 0, np.arange(n), n)
    at = np.minimum.accumulate(where[::-1])[::-1]
    small = diff[np.minimum(at, n - 1)] > 0  # smaller than the successor

    # The reach of each context: from the last needed start to the first direct one after it.
    last_need = np.maximum.accumulate(np.where(need, np.arange(n), -1))
    direct_or_end = np.where(small, np.arange(n), n)
    stop = np.minimum.accumulate(direct_or_end[::-1])[::-1]
    context = np.searchsorted(ends, np.arange(n), "right")
    begin = np.concatenate([[0], ends[:-1]])
    tail = last_need[ends - 1]
    has = tail >= begin
    until = np.where(has & (tail + 1 < ends), np.minimum(stop[np.minimum(tail + 1, n - 1)], ends - 1), tail)
    ext = need | ((np.arange(n) > tail[context]) & (np.arange(n) <= until[context]) & has[context])
    large = ext & ~small

    direct = np.flatnonzero(ext & small)
    raw = data.tobytes()
    stops = np.minimum(direct + depth, ends[context[direct]])
    keys = [raw[a:b] for a, b in zip(direct.tolist(), stops.tolist())]
    direct = direct[sorted(range(len(keys)), key=keys.__getitem__)] if keys else direct
    del keys
    by_byte = np.searchsorted(data[direct], np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out: list[np.ndarray] = []

    def push(pos: np.ndarray, own: int) -> np.ndarray:
        """Hand on the larger predecessors of pos; those of the same bucket come back."""
        pos = pos[pos > 0] - 1
        pos = pos[large[pos]]
        pos = pos[context[pos] == context[pos + 1]] if len(pos) else pos
        if not len(pos):
            return pos
        c = data[pos]
        order = np.argsort(c, kind="stable")
        pos, c = pos[order], c[order]
        cuts = np.flatnonzero(c[1:] != c[:-1]) + 1
        same = pos[:0]
        for part in np.split(pos, cuts):
            b = int(data[part[0]])
            if b == own:
                same = part
            else:
                waiting[b].append(part)
        return same

    ending = ends[ext[ends - 1]] - 1  # their successor is the end of the context, the least of all
    ending = ending[large[ending]]
    order = np.argsort(data[ending], kind="stable")
    for part in np.split(ending[order], np.flatnonzero(np.diff(data[ending[order]].astype(np.int16))) + 1):
        if len(part):
            waiting[int(data[part[0]])].append(part)
    for c in range(256):
        batch = np.concatenate(waiting[c]) if waiting[c] else direct[:0]
        while len(batch):
            out.append(batch)
            batch = push(batch, c)
        own = direct[by_byte[c] : by_byte[c + 1]]
        if len(own):
            out.append(own)
            push(own, -1)
        waiting[c] = []
    got = np.concatenate(out) if out else direct
    return got[need[got]]


def common_prefixes(data: np.ndarray, order: np.ndarray, left: np.ndarray, most: int) -> np.ndarray:
    """Length, most at the greatest, of the common prefix of each suffix in order and the one before; 0 first.

    left: bytes from each suffix in order to the end of its context.
    """
    out = np.zeros(len(order), np.int64)
    reach = np.minimum(left, most)
    reach[1:] = np.minimum(reach[1:], reach[:-1])
    eight = np.lib.stride_tricks.sliding_window_view(np.concatenate([data, np.zeros(8, np.uint8)]), 8)
    alive = np.arange(1, len(order))
    for at in range(0, most, 8):
        alive = alive[reach[alive] > at]
        if not len(alive):
            break
        x = np.ascontiguousarray(eight[order[alive] + at]).view("<u8")[:, 0] ^ np.ascontiguousarray(eight[order[alive - 1] + at]).view("<u8")[:, 0]
        differ = x != 0
        low = x[differ] & (~x[differ] + np.uint64(1))
        out[alive[differ]] = at + (np.log2(low.astype(np.float64)).astype(np.int64) >> 3)
        alive = alive[~differ]
        out[alive] = at + 8
    return np.minimum(out, np.concatenate([[0], reach[1:]])) if len(order) else out


def repeated_starts(contexts: list[bytes], starts: list[int], length: int, reach: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each context, of its first so many starts: whether length bytes there, and whether reach bytes, occur at another start of any context."""
    sizes = np.array([len(c) for c in contexts], np.int64)
    ends = np.cumsum(sizes)
    data = np.frombuffer(b"".join(contexts), np.uint8)
    need = np.zeros(len(data), bool)
    for e, s, k in zip(ends.tolist(), sizes.tolist(), starts):
        need[e - s : e - s + k] = True
    order = two_stage_order(data, ends, need, reach)
    prefix = common_prefixes(data, order, ends[np.searchsorted(ends, order, "right")] - order, reach)
    hits = []
    for least in (length, reach):
        full = prefix >= least
        hit = np.zeros(len(data), bool)
        hit[order[full]] = True
        hit[order[:-1][full[1:]]] = True
        hits.append(hit)
    return [tuple(h[e - s : e - s + k] for h in hits) for e, s, k in zip(ends.tolist(), sizes.tolist(), starts)]


# -- anchors ---------------------------------------------------------------------------------------------


def anchors(data: np.ndarray, offsets: np.ndarray, length: int):
    """Contexts of concatenated texts: text number, first byte, last start, anchor's place and hash.

    Each string of length bytes belongs to the least-hashed 32-byte gram within it (the leftmost of
    equals), so equal strings belong to equal grams at equal places. Neighbouring strings of one
    anchor form a context.
    """
    n = len(data)
    none = np.zeros(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(np.uint64)
    x = data.astype(np.uint64) + np.uint64(1)
    k = 1
    while k < GRAM:
        x = x[:-k] * np.uint64(0x9E3779B97F4A7C15 + 2 * k) + x[k:]
        x ^= x >> np.uint64(29)
        k *= 2
    h = mix(x)
    w = length - GRAM + 1  # grams of a string
    key = (h & ~_POS) | np.arange(len(h), dtype=np.uint64)
    padded = np.full(-(-len(key) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(key)] = key
    rows = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(rows, axis=1).reshape(-1)
    back = np.ascontiguousarray(np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1]).reshape(-1)
    count = n - length + 1
    at = (np.minimum(back[:count], ahead[w - 1 : w - 1 + count]) & _POS).astype(np.int64)
    valid = np.ones(count, bool)  # a string stays within its text
    for end in offsets[1:-1]:
        valid[max(0, end - length + 1) : end] = False
    p = np.flatnonzero(valid)
    if not len(p):
        return none, none, none, none, none.astype(np.uint64)
    at = at[p]
    new = np.concatenate([[True], at[1:] != at[:-1]])
    first = np.flatnonzero(new)
    s0, s1, a = p[first], p[np.concatenate([first[1:] - 1, [len(p) - 1]])], at[first]
    doc = np.searchsorted(offsets, s0, "right") - 1
    return doc, s0, s1, a, h[a]


def _slices(offsets: np.ndarray, length: int):
    """(text range, first byte, last byte) parts of a batch: many texts together, or a slice of a long one."""
    for i, j in pieces(offsets, _SLICE):
        a, b = int(offsets[i]), int(offsets[j])
        if b - a <= 2 * _SLICE:
            yield i, j, a, b
        else:
            for s in range(a, b, _SLICE):
                yield i, j, s, min(b, s + _SLICE + length - 1)
                if s + _SLICE + length - 1 >= b:
                    break


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start+1, ... of each range, one after the other."""
    before = np.cumsum(sizes) - sizes
    return np.repeat(starts - before, sizes) + np.arange(int(sizes.sum()))


def _flat(column, kind) -> tuple[np.ndarray, np.ndarray]:
    """All pairs in a column of binary values, nulls as empty, and the number of pairs of each value."""
    import pyarrow.compute as pc

    column = pc.fill_null(column.combine_chunks() if hasattr(column, "combine_chunks") else column, b"")
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False)
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, 2).astype(np.int64), sizes // (2 * np.dtype(kind).itemsize)


def _signed(h: int) -> int:
    return h - (1 << 64) * (h >> 63)


_MEMBERS = "piece long, h long, c long, t int, _d long, _h long, s long, n int, off int, k int, at binary, ids binary"


def _members(length: int, reach: int):
    """One row a piece of text and class of contexts, with all its places; and one row a piece with its texts' keys.

    A class is the bytes of a context: from its first start to reach bytes after its last, or the text's end.
    """

    def run(batches):
        import pyarrow as pa
        import xxhash

        kinds = [pa.int64()] * 3 + [pa.int32()] + [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()] * 2
        names = [x.split()[0] for x in _MEMBERS.split(", ")]
        for batch in batches:
            data, offsets = buffers(batch.column(2))
            ids = np.stack([batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)], axis=1)
            for i, j, a, b in _slices(offsets, length):
                whole = j - i > 1 or (a == offsets[i] and b == offsets[j])
                off = offsets[i : j + 1] - a if whole else np.array([0, b - a])
                doc, s0, s1, at, h = anchors(data[a:b], off, length)
                if not len(doc):
                    continue
                end = np.minimum(s1 + reach, offsets[i + 1 + doc] - a)
                raw = data[a : a + int(end.max())].tobytes()
                k, where = s1 - s0 + 1, at - s0
                seeds = (where * (1 << 20) + k).tolist()
                c = np.array([xxhash.xxh3_64_intdigest(raw[x:y], seed) for x, y, seed in zip(s0.tolist(), end.tolist(), seeds)], np.uint64)
                begin = (s0 + a) - offsets[i + doc]
                order = np.lexsort((np.arange(len(h)), c, h))
                new = np.concatenate([[True], (h[order[1:]] != h[order[:-1]]) | (c[order[1:]] != c[order[:-1]])])
                edge = np.append(np.flatnonzero(new), len(order))
                lead = order[edge[:-1]]
                by_text = np.argsort(lead, kind="stable")  # neighbours share their keys, which files keep short
                lead, times = lead[by_text], np.diff(edge)[by_text]
                places = np.stack([doc, begin], axis=1)[order[_ranges(edge[:-1][by_text], times)]]
                lists = pa.Array.from_buffers(pa.binary(), len(lead), [None, pa.py_buffer((16 * np.concatenate([[0], np.cumsum(times)])).astype(np.int32)), pa.py_buffer(places.tobytes())])
                name = _signed(xxhash.xxh3_64_intdigest(ids[i:j].tobytes(), a if not whole else 0))
                n = len(lead)
                key = ids[i + doc[lead]]
                cols = [np.full(n, name), h[lead].view(np.int64), c[lead].view(np.int64), times, key[:, 0], key[:, 1], begin[lead], (end - s0)[lead], where[lead], k[lead]]
                yield pa.RecordBatch.from_arrays([*[pa.array(x).cast(t) for x, t in zip(cols, kinds)], lists, pa.nulls(n, pa.binary())], names=names)
                yield pa.RecordBatch.from_arrays([pa.array([name if f == "piece" else ids[i:j].tobytes() if f == "ids" else None], t) for f, t in zip(names, kinds)], names=names)

    return run


def _contexts(length: int, reach: int, group: int):
    """Bytes of the wanted contexts; those of a large group go as blocks of starts, keyed by their common core."""

    def run(batches):
        import pyarrow as pa
        import xxhash

        schema = pa.schema([("g", pa.int64()), ("h", pa.int64()), ("c", pa.int64()), ("base", pa.int32()), ("k", pa.int32()), ("several", pa.bool_()), ("bytes", pa.binary())])
        for batch in batches:
            rows: list[tuple] = []
            for text, wants in zip(batch.column(0), batch.column(1)):
                raw = (text.as_py() or "").encode()
                for w in wants.as_py():
                    ctx = raw[w["s"] : w["s"] + w["n"]]
                    several = w["times"] > 1
                    if w["met"] <= group:
                        rows.append((w["h"], w["h"], w["c"], 0, w["k"], several, ctx))
                        continue
                    last, off, p = w["k"] - 1, w["off"], 0
                    while p <= last:  # starts whose distance to the anchor falls in one block
                        blk = (off - p) // BLOCK
                        q = min(last, off - blk * BLOCK)
                        core = ctx[off - blk * BLOCK : off - blk * BLOCK - BLOCK + 1 + length]
                        g = xxhash.xxh3_64_intdigest(core, seed=(w["h"] ^ blk) & ((1 << 64) - 1))
                        rows.append((_signed(g), w["h"], w["c"], p, q - p + 1, several, ctx[p : q + reach]))
                        p = q + 1
                if len(rows) > 4096:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    return run


def _runs(hit: np.ndarray) -> np.ndarray:
    """[a, b) pairs of runs of true."""
    d = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    return d.reshape(-1, 2)


def _sorted_groups(length: int, reach: int, chunk: int = 60_000):
    """Marks of each context met once, from suffix arrays over whole groups, about chunk starts together."""

    def run(key, table):
        import pyarrow as pa

        table = table.sort_by("g")
        g = table.column("g").to_numpy()
        several = table.column("several").to_numpy(zero_copy_only=False)
        k = table.column("k").to_numpy()
        column = table.column("bytes").combine_chunks()
        edges = np.concatenate([[0], np.flatnonzero(g[1:] != g[:-1]) + 1, [len(g)]])
        found: list[tuple[int, bytes, bytes]] = []
        i = 0
        total = np.concatenate([[0], np.cumsum(k)])
        while i < len(edges) - 1:
            j = i + 1
            while j < len(edges) - 1 and total[edges[j + 1]] - total[edges[i]] <= chunk:
                j += 1
            rows = range(edges[i], edges[j])
            for r, (short, long) in zip(rows, repeated_starts(column.slice(edges[i], edges[j] - edges[i]).to_pylist(), k[rows.start : rows.stop].tolist(), length, reach)):
                if not several[r] and short.any():
                    found.append((r, _runs(short).astype("<i4").tobytes(), _runs(long).astype("<i4").tobytes()))
            i = j
        at = pa.array([r for r, _, _ in found], pa.int64())
        return pa.table({c: table.column(c).take(at) for c in ("h", "c", "base")} | {"short": pa.array([x for _, x, _ in found], pa.binary()), "long": pa.array([x for _, _, x in found], pa.binary())})

    return run


def _merged(spans: np.ndarray) -> np.ndarray:
    """Sorted [a, b) pairs of the union of pairs."""
    if not len(spans):
        return spans.reshape(-1, 2)
    spans = spans[np.argsort(spans[:, 0], kind="stable")]
    far = np.maximum.accumulate(spans[:, 1])
    new = np.concatenate([[True], spans[1:, 0] > far[:-1]])
    first = np.flatnonzero(new)
    return np.stack([spans[first, 0], far[np.append(first[1:], len(spans)) - 1]], axis=1)


def _by_text(length: int, reach: int):
    """Spans of bytes of a piece's texts, from the replies to its classes."""

    def run(key, table):
        import pyarrow as pa

        about = table.filter(table.column("ids").is_valid())
        ids = np.frombuffer(about.column("ids")[0].as_py(), np.int64).reshape(-1, 2)
        table = table.filter(table.column("at").is_valid())
        at, places = _flat(table.column("at"), np.int64)
        first = np.cumsum(places) - places
        n, k = (table.column(c).to_numpy().astype(np.int64) for c in ("n", "k"))
        column = table.column("m").combine_chunks()
        whole = column.is_null().to_numpy(zero_copy_only=False)  # classes that are met twice
        lists = column.fill_null([])
        marks, row = lists.flatten(), np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
        base = marks.field("base").to_numpy(zero_copy_only=False).astype(np.int64)
        out: list[dict[int, bytes]] = []
        for name, size in (("short", length), ("long", reach)):
            runs, counts = _flat(marks.field(name), "<i4")
            spans = runs + np.repeat(base, counts)[:, None] + np.array([0, size - 1])
            of = np.repeat(row, counts)
            some = np.flatnonzero(whole & (n >= size))
            spans = np.concatenate([spans, np.stack([np.zeros(len(some), np.int64), np.minimum(k[some] - 1, n[some] - size) + size], axis=1)])
            of = np.concatenate([of, some])
            where = at[_ranges(first[of], places[of])]
            spans = np.repeat(spans, places[of], axis=0) + where[:, 1:]
            far = int(spans.max(initial=0)) + 2
            joint = _merged(spans + where[:, :1] * far)
            doc = joint[:, 0] // far
            joint -= (doc * far)[:, None]
            edge = np.concatenate([[0], np.flatnonzero(doc[1:] != doc[:-1]) + 1, [len(doc)]]) if len(doc) else np.zeros(1, np.int64)
            out.append({int(doc[a]): joint[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist())})
        some = sorted(out[0])
        return pa.table({"_d": pa.array(ids[some, 0]), "_h": pa.array(ids[some, 1]), "short": pa.array([out[0][x] for x in some], pa.binary()), "long": pa.array([out[1].get(x, b"") for x in some], pa.binary())})

    return run


def _removed(with_text: bool, words: int, cut_passages: bool):
    def run(batches):
        import pyarrow as pa

        for batch in batches:
            cols: list[list] = [[], [], [], [], [], [], []]
            for text, found in zip(batch.column(1), batch.column(2)):
                raw = (text.as_py() or "").encode()
                got = found.as_py() or []
                short, long = (_merged(np.frombuffer(b"".join(f[x] for f in got), np.int64).reshape(-1, 2)) for x in ("short", "long"))
                passages = short[[len(raw[a:b].split()) >= words for a, b in short.tolist()]] if words else short[:0]
                if cut_passages:
                    long = _merged(np.concatenate([long, passages]))
                at, kept = 0, []
                for a, b in long.tolist():
                    kept.append(raw[at:a])
                    at = b
                kept.append(raw[at:])
                left = b"".join(kept)
                for c, v in zip(cols, (len(raw), len(raw) - len(left), len(long), hashlib.sha256(left).hexdigest(), long.reshape(-1).tolist(), left.decode("utf-8", "ignore") if with_text else None, int((passages[:, 1] - passages[:, 0]).sum()))):
                    c.append(v)
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string(), pa.int64())
            arrays = [pa.array(c, t) for c, t in zip(cols, types)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *arrays[:5], *arrays[5:6] * with_text, *arrays[6:] * bool(words), *batch.columns[3:]], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", *["kept_text"] * with_text, *["n_shared"] * bool(words), *batch.schema.names[3:]])

    return run


def remove_repeats(docs: DataFrame, length: int = 400, with_text: bool = False, keep: tuple[str, ...] = (), passage: tuple[int, int] | None = None, cut_passages: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept_text][, n_shared], keep...) of every whole text.

    Removes each byte covered by a string of length bytes that also starts anywhere else, judged on the
    input. passage, if given, is a number of bytes (length at most) and of words: n_shared counts the bytes
    of maximal runs that strings of so many bytes which start twice cover, and that hold so many words.
    They come from the same suffix arrays and are removed, too, if cut_passages is set.

    Anchors (content-chosen grams) bring together all places at which one string can start: contexts
    whose anchor occurs once hold no repeat. Equal contexts of an anchor are one class, counted within
    each piece of text and then over all; a class met twice repeats as a whole. Where an anchor has
    several classes, the bytes of one representative each are sorted by the two-stage suffix sort, and
    adjacent common prefixes mark the repeated starts. An anchor with very many classes is dealt by
    blocks of starts and their common core, so one passage in a third of all texts spreads over tasks,
    and the reply to a class is one row a piece, however often the piece holds it.

    Null text: empty, nothing removed. Repeated rows (one id, one text): each is a place of its own, so
    their strings of length bytes go. Clashing or extra columns of docs aren't read unless in keep.
    Texts of any length go through in slices. kept_text drops the bytes of cut code points.
    """
    (least, words), reach = passage or (length, 0), length
    if least > reach:
        raise ValueError("a passage must not exceed length")
    spark = docs.sparkSession
    key = doc_key(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NO_ID)), F.col("text"))
    keyed = docs.select(*key, "text")
    buckets = dealt(spark, docs)
    members = cut(keyed.where(F.octet_length("text") >= least).mapInArrow(_members(least, reach), _MEMBERS), "suffix-members")
    classes = members.where("ids IS NULL").groupBy("h", "c").agg(F.sum("t").alias("times"), F.min(F.struct(F.xxhash64("piece", "c").alias("o"), "_d", "_h", "s", "n", "off", "k")).alias("r"))
    classes = cut(classes, "suffix-classes")
    anchors_ = classes.groupBy("h").agg(F.sum("times").alias("_t"), F.count(F.lit(1)).alias("met")).where("_t > 1").drop("_t")
    wants = classes.join(anchors_.where("met > 1"), "h").select("r._d", "r._h", F.struct("h", "c", "times", "met", "r.s", "r.n", "r.off", "r.k").alias("w"))
    wants = cut(wants.groupBy("_d", "_h").agg(F.collect_list("w").alias("w")), "suffix-wants")
    whole = cut(classes.where("times > 1").select("h", "c"), "suffix-whole")
    drop(classes)
    release(spark)
    # Lists gathered by text have no proven bound, so they are never broadcast to the texts.
    one = keyed.join(wants.hint("merge"), ["_d", "_h"]).select("text", "w")
    bytes_ = one.mapInArrow(_contexts(least, reach, GROUP), "g long, h long, c long, base int, k int, several boolean, bytes binary")
    bucket = F.pmod("g", F.lit(8 * buckets))  # several a task, so that tasks are alike
    marks = bytes_.repartition(buckets, bucket).groupBy(bucket.alias("_b"))
    marks = cut(marks.applyInArrow(_sorted_groups(least, reach), "h long, c long, base int, short binary, long binary"), "suffix-marks")
    drop(wants)
    release(spark)
    by_class = marks.groupBy("h", "c").agg(F.collect_list(F.struct("base", "short", "long")).alias("m"))  # one row a class, of as many blocks as its context has
    by_class = by_class.unionByName(whole.select("h", "c", F.lit(None).cast(by_class.schema["m"].dataType).alias("m")))
    told = members.where("ids IS NULL").select("piece", "h", "c", "at", "n", "k").join(by_class, ["h", "c"]).select("piece", "at", "n", "k", "m", F.lit(None).cast("binary").alias("ids"))
    about = members.where("ids IS NOT NULL").join(told.select("piece").distinct(), "piece", "left_semi")
    none = {f: F.lit(None).cast(told.schema[f].dataType).alias(f) for f in ("at", "n", "k", "m")}
    told = told.unionByName(about.select("piece", *none.values(), "ids"))
    spans = told.groupBy("piece").applyInArrow(_by_text(least, reach), "_d long, _h long, short binary, long binary")
    spans = cut(spans.groupBy("_d", "_h").agg(F.collect_list(F.struct("short", "long")).alias("found")), "suffix-spans")
    for done in (members, marks, whole):
        drop(done)
    release(spark)
    full = docs.select(*key, F.col("doc_id").cast("long").alias("doc_id"), "text", *keep)
    joined = full.join(spans.hint("merge"), same_key(full, spans), "left").select("doc_id", "text", "found", *keep)
    fields = {f.name: f.dataType.simpleString() for f in joined.schema}
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<long>" + ", kept_text string" * with_text + ", n_shared long" * bool(words) + "".join(f", `{k}` {fields[k]}" for k in keep)
    return joined.mapInArrow(_removed(with_text, words, cut_passages), schema)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 2 at 400 bytes, with n_shared: bytes of repeated passages of over 50 words, which stay if shorter."""
    return remove_repeats(read(spark, sf_dir, "documents"), passage=PASSAGE)


QUERIES = {"op2_suffix_dedup": op2_suffix_dedup}
SQL: dict[str, str] = {}
