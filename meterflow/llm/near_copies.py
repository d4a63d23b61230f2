"""Near copies by shared word shingles: an exact join of all pairs of a given Jaccard similarity, and their components.

SimHash fingerprints of the shingles are joined on pigeonhole blocks first; what is close is verified and
collapses most copies. Pairs of a similarity of 0.8 lay 4 to 14 of 64 bits apart in a count, which no
blocks can bring together, so an exact join by prefixes finds the rest.

Two sets of which one has n shingles reach a similarity of a/b only if they share one of their first
n - ceil(n * a/b) + 1 shingles in an order common to all sets. Documents meet at these; what meets is
verified on the texts, so no pair is missed and none is only alike by its sketch.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meterflow.llm.common import buffers, cut, drop, hash_words, mix, pieces, release, rolling, split_words
from meterflow.llm.graph import components
from meterflow.llm.op6_simhash import links

WIDTH = 5
SIMILAR = (4, 5)  # a similarity of 0.8 or more
#: One of SHARE documents, or SAMPLE of them where that is more, has its shingles counted to put common ones last.
#: Any order is exact; this one keeps meetings few.
SHARE, SAMPLE, COMMON, MOST_COMMON = 8, 8000, 2, 200_000
#: Keys of a set, each of LEAST[1] least hashes; two sets share one with the chance of so many draws at their similarity.
LEAST = (5, 3)
#: Rounds in which each meeting place compares with one document only, while pairs are more than MANY times the places.
ROUNDS, MANY = 2, 4
#: Words of 64 parities each: one parity of the shingles at each value of their lowest bits.
PARITIES = 8
#: Shares of the shingles that meet one after the other, so that the exchange files of one are on disk at once.
PARTS = 4
#: Sets to be verified in one round that are broadcast at most, of 33 bytes each; more are joined by an exchange.
NEEDED = 250_000


def _few(batches, rows: int = 512):
    """Batches again, in slices of so many rows, so that their hashes are few at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def shingles(texts, width: int = WIDTH, most: int = 1 << 20) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles of lower-case words; all words are one if there are fewer.

    Texts of most bytes together, or one longer text, are hashed at a time.
    """
    whole, at = buffers(texts)
    out = []
    for i, j in pieces(at, most):
        data, offsets = whole[at[i] : at[j]], at[i : j + 1] - at[i]
        data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
        starts, ends, first = split_words(data, offsets)
        h = hash_words(data, starts, ends)
        rows = mix(rolling(h, width))
        for f, g in zip(first[:-1].tolist(), first[1:].tolist()):
            out.append(np.unique(rows[f : g - width + 1]) if g - f >= width else mix(rolling(h[f:g], g - f) + np.uint64(g - f)) if g > f else h[:0].copy())
    return out


def prefix(n: int) -> int:
    """How many shingles of a set of n must be looked at."""
    return n - -(-n * SIMILAR[0] // SIMILAR[1]) + 1 if n else 0


def _majority(s: np.ndarray) -> int:
    """SimHash of a set of hashes: bits set in over half of them, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(s), 1 << 16):
        ones += np.unpackbits(s[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(s)).tobytes(), "big", signed=True)


def _least(s: np.ndarray) -> list[int]:
    """Keys of a sorted set: its least hashes of each value of the lowest bits, a few of them a key; none of an empty set."""
    if not len(s):
        return []
    n = LEAST[0] * LEAST[1]
    least = np.zeros(n, np.uint64)
    least[((s & np.uint64(0xFFFFFFFF)) % np.uint64(n)).astype(np.int64)[::-1]] = s[::-1]  # of equal places the last one stays
    of = least.reshape(LEAST)
    key = np.zeros(LEAST[0], np.uint64)
    for j in range(LEAST[1]):
        key = mix(key + of[:, j])
    return key.view(np.int64).tolist()


def _common(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of the shingles found most often in a share of the documents, MOST_COMMON of them at most."""
    n = max(docs.count(), 1)
    share = min(1.0, max(SAMPLE / n, 1 / SHARE))
    sample = docs.where(F.pmod(F.xxhash64(F.lit(5), "_h", "_d"), F.lit(1_000_003)) < 1_000_003 * share)

    def run(batches):
        import pyarrow as pa

        for batch in _few(batches):
            sets = shingles(batch.column(0))
            at, times = np.unique(np.concatenate([*sets, np.zeros(0, np.uint64)]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(times, pa.int64())], names=["k", "n"])

    found = sample.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).where(F.col("n") >= COMMON)
    found = cut(found, "alike-common")
    levels = found.groupBy(F.least("n", F.lit(10_000)).alias("n")).agg(F.count(F.lit(1)).alias("m")).orderBy(F.desc("n")).collect()
    fits = [r.n for r, total in zip(levels, np.cumsum([r.m for r in levels])) if total <= MOST_COMMON]
    got = found.where(F.col("n") >= fits[-1]).select("k").collect() if fits else []
    drop(found)
    return np.sort(np.array([r.k for r in got], np.int64).view(np.uint64))


def sketches(docs: DataFrame) -> DataFrame:
    """(_d, _h, v, n, f, p, w, keys) of docs' _d, _h, text: a hash of the whole set, its size, SimHash, parities, least hashes and prefix."""
    sent = docs.sparkSession.sparkContext.broadcast(_common(docs))

    def run(batches):
        import pyarrow as pa
        import xxhash

        common = sent.value
        for batch in _few(batches):
            v, n, f, p, w, keys = [], [], [], [], [], []
            for s in shingles(batch.column(2)):
                v.append(xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63))
                n.append(len(s))
                f.append(_majority(s))
                odd = np.bincount((s & np.uint64(64 * PARITIES - 1)).astype(np.int64), minlength=64 * PARITIES) & 1
                p.append(np.packbits(odd.astype(np.uint8)).view(np.int64).tolist())
                w.append(_least(s))
                often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s if len(common) else np.zeros(len(s), bool)
                keys.append(np.concatenate([s[~often], s[often]])[: prefix(len(s))].view(np.int64))
            ends = np.cumsum([0, *map(len, keys)])
            listed = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([*keys, np.zeros(0, np.int64)]), pa.int64()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(v, pa.int64()), pa.array(n, pa.int64()), pa.array(f, pa.int64()), pa.array(p, pa.list_(pa.int64())), pa.array(w, pa.list_(pa.int64())), listed], names=["_d", "_h", "v", "n", "f", "p", "w", "keys"])

    return docs.select("_d", "_h", "text").mapInArrow(run, "_d long, _h long, v long, n long, f long, p array<long>, w array<long>, keys array<long>")


def _verified(pairs: DataFrame, places: DataFrame, docs: DataFrame) -> DataFrame:
    """Those (a, b) of pairs whose texts are alike; only texts of sets in pairs are moved.

    places: v, _x, _z, _h, the row of docs that stands for each set.
    """
    sets = pairs.select(F.col("a").alias("v")).unionByName(pairs.select(F.col("b").alias("v"))).distinct()
    needed = cut(sets.join(places, "v"), "alike-needed")
    keyed = docs.select(F.coalesce("_d", F.lit(0)).alias("_x"), F.col("_d").isNull().alias("_z"), "_h", "text")
    small = needed.count() <= NEEDED
    texts = keyed.join(F.broadcast(needed) if small else needed, ["_x", "_z", "_h"]).select("v", "text").dropDuplicates(["v"])
    texts = cut(texts, "alike-texts")
    drop(needed)

    def run(batches):
        import pyarrow as pa

        for batch in _few(batches):
            x, y = shingles(batch.column(2)), shingles(batch.column(3))
            same = [len(np.intersect1d(s, t, assume_unique=True)) for s, t in zip(x, y)]
            alike = pa.array([SIMILAR[1] * k >= SIMILAR[0] * (len(s) + len(t) - k) for k, s, t in zip(same, x, y)], pa.bool_())
            yield pa.RecordBatch.from_arrays([c.filter(alike) for c in batch.columns[:2]], names=["a", "b"])

    a, b = texts.toDF("a", "ta"), texts.toDF("b", "tb")
    found = cut(pairs.join(a, "a").join(b, "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long"), "alike-edges")
    drop(texts)
    release(docs.sparkSession)
    return found


def _could(x: str, y: str):
    """Sizes, and what is left of both sets from a first shared shingle on, allow the similarity."""
    a, b = SIMILAR
    size = F.expr(f"{b} * least({x}.n, {y}.n) >= {a} * greatest({x}.n, {y}.n)")
    return size & F.expr(f"{a + b} * least({x}.n - {x}.i, {y}.n - {y}.i) >= {a} * ({x}.n + {y}.n)")


def _might(x: str, y: str):
    """Some set of one component and some of another may pass _could at a place: of components of one set, _could itself."""
    a, b = SIMILAR
    size = F.expr(f"{b} * {x}.high >= {a} * {y}.low AND {b} * {y}.high >= {a} * {x}.low")
    return size & F.expr(f"{a + b} * least({x}.left, {y}.left) >= {a} * ({x}.low + {y}.low)")


def _differ(x: str, y: str):
    """Parities differ at no more places than sets so alike can differ in shingles."""
    a, b = SIMILAR
    differ = " + ".join(f"bit_count({x}.p[{i}] ^ {y}.p[{i}])" for i in range(PARITIES))
    return F.expr(f"{a + b} * ({differ}) <= {b - a} * ({x}.n + {y}.n)")


def _parities(pairs: DataFrame, marks: DataFrame) -> DataFrame:
    """Those (a, b) of pairs whose parities allow the similarity."""
    one = marks.select("v", F.struct("n", "p").alias("x"))
    return pairs.join(one.toDF("a", "x"), "a").join(one.toDF("b", "y"), "b").where(_differ("x", "y")).select("a", "b")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _meet(now: DataFrame, marks: DataFrame) -> DataFrame:
    """(a, b) of now's sets of two components that share a place and could be alike by sizes, positions and parities.

    Components are paired first, so that members of one are never compared. One set that stands alone for its
    component at a place is judged there by its parities; larger components are opened to their members, the
    smaller of two first, so that a large one's are not written once for each that it meets.
    """
    rows = now.join(marks.select("v", "p"), "v").select("k", "c", F.struct("v", "n", "i", "p").alias("s"))
    each = rows.groupBy("k", "c").agg(F.count(F.lit(1)).alias("m"), F.min("s.n").alias("low"), F.max("s.n").alias("high"), F.max(F.expr("s.n - s.i")).alias("left"), F.min_by("s", "s.v").alias("s"))
    each = each.select("k", "c", F.struct("m", "low", "high", "left").alias("e"), F.when(F.col("m") == 1, F.col("s")).alias("s"))
    x, y = each.select("k", F.col("c").alias("ca"), F.col("e").alias("ea"), F.col("s").alias("x")), each.select("k", F.col("c").alias("cb"), F.col("e").alias("eb"), F.col("s").alias("y"))
    could = _could("x", "y") & _differ("x", "y")
    both = F.col("x").isNotNull() & F.col("y").isNotNull()
    two = x.join(y, "k").where((F.col("ca") < F.col("cb")) & _might("ea", "eb") & (~both | could))
    fewer = F.expr("ea.m <= eb.m")
    first, second = F.when(fewer, F.col("ca")).otherwise(F.col("cb")), F.when(fewer, F.col("cb")).otherwise(F.col("ca"))
    two = two.select("k", first.alias("ca"), second.alias("cb"), F.when(both, F.col("x.v")).alias("a"), F.when(both, F.col("y.v")).alias("b"))
    two = cut(two, "alike-met")
    x, y = rows.select("k", F.col("c").alias("ca"), F.col("s").alias("x")), rows.select("k", F.col("c").alias("cb"), F.col("s").alias("y"))
    opened = two.where("a IS NULL").select("k", "ca", "cb")
    members = opened.join(x, ["k", "ca"]).join(y, ["k", "cb"]).where(could).select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
    pairs = cut(_ordered(two.where("a IS NOT NULL").select("a", "b").unionByName(members)), "alike-pairs")
    drop(two)
    return pairs


def _hubs(marks: DataFrame, found: DataFrame) -> DataFrame:
    """(a, b): each set with the least of those that share one of its keys of least hashes, unless they are one component.

    At most LEAST[0] pairs a set, however many sets meet.
    """
    a, b = SIMILAR
    each = marks.join(found.toDF("v", "c"), "v", "left").select("v", "n", F.coalesce("c", "v").alias("c"), F.posexplode("w").alias("j", "w"))
    least = each.groupBy("j", "w").agg(F.min(F.struct("v", "n", "c")).alias("x"))
    pairs = each.join(least, ["j", "w"]).where(f"c != x.c AND {b} * least(n, x.n) >= {a} * greatest(n, x.n)")
    return pairs.select(F.col("x.v").alias("a"), F.col("v").alias("b")).distinct()


def _labelled(places: DataFrame, found: DataFrame) -> DataFrame:
    """places with c, the component of v, at keys where two components still meet."""
    out = places.join(found.toDF("v", "c"), "v", "left").withColumn("c", F.coalesce("c", "v"))
    open_ = out.groupBy("k").agg(F.min("c").alias("_a"), F.max("c").alias("_b")).where("_a < _b").select("k")
    return out.join(open_, "k")


def alike(docs: DataFrame, sketched: DataFrame) -> DataFrame:
    """(v, component) of sets that are alike to another, over chains of alike sets.

    Copies are one vertex. Sets of close fingerprints are verified first, then sets with the least of those
    that share a key of least hashes, which brings nearly all groups of near copies together. Sets of different
    components that still meet at a shingle are compared pair by pair. Only while these pairs are many times the
    places, all that meet at one are first compared with one of about their size, another at each, in rows linear in theirs.
    """
    rows = sketched.select("v", "n", F.posexplode("keys").alias("i", "k"))
    parts = []
    for part in range(PARTS):
        some = rows.where(F.pmod("k", F.lit(PARTS)) == part)
        shared = some.groupBy("k").agg(F.min("v").alias("_a"), F.max("v").alias("_b")).where("_a < _b").select("k")
        parts.append(cut(some.join(shared, "k").select("k", "v", "n", "i").distinct(), "alike-places"))
        release(docs.sparkSession)
    places = parts[0]
    for more in parts[1:]:
        places = places.unionByName(more)
    met = places.select("v").distinct()
    marks = cut(sketched.select("v", "n", "p", "w").join(met, "v", "left_semi").dropDuplicates(["v"]), "alike-marks")
    row = F.struct(F.col("_d").isNull().alias("_z"), F.coalesce("_d", F.lit(0)).alias("_x"), "_h")
    one = cut(sketched.groupBy("v").agg(F.min(row).alias("_r")).select("v", "_r.*"), "alike-rows")
    release(docs.sparkSession)
    prints = cut(sketched.groupBy("f").agg(F.min("v").alias("rep")), "alike-prints")
    equal = sketched.join(prints, "f").where("v > rep").select(F.col("rep").alias("a"), F.col("v").alias("b"))
    close = cut(links(prints.select(F.col("f").alias("fp"), "rep")).unionByName(equal).distinct(), "alike-close")
    edges = [_verified(close, one, docs)]
    drop(prints)
    drop(close)
    found = components(edges[0], "alike-components")
    hubs = cut(_parities(_hubs(marks, found), marks), "alike-hubs")
    edges.append(_verified(hubs, one, docs))
    drop(hubs)
    found = components(edges[0].unionByName(edges[1]), "alike-components")
    for turn in range(ROUNDS + 1):
        now = cut(_labelled(places, found), "alike-open")
        total = now.count()
        each = now.groupBy("k", "c").agg(F.count(F.lit(1)).alias("m"))
        open_pairs = each.groupBy("k").agg(((F.sum("m") * F.sum("m") - F.sum(F.col("m") * F.col("m"))) / 2).alias("p")).agg(F.sum("p")).first()[0]
        if not open_pairs:
            drop(now)
            break
        last = turn == ROUNDS or open_pairs <= MANY * total
        if last:
            pairs = _meet(now, marks)
        else:
            banded = now.withColumn("band", F.floor(F.log("n") / F.log(F.lit(SIMILAR[1] / SIMILAR[0]))))
            least = banded.groupBy("k", "band").agg(F.min(F.struct(F.xxhash64(F.lit(turn), "k", "c").alias("o"), "c", "v", "n", "i")).alias("x"))
            pairs = banded.alias("y").join(least, ["k", "band"]).where((F.col("x.c") != F.col("y.c")) & _could("x", "y")).select(F.col("x.v").alias("a"), F.col("y.v").alias("b"))
            pairs = cut(_parities(_ordered(pairs), marks), "alike-pairs")
        release(docs.sparkSession)
        edges.append(_verified(pairs, one, docs))
        drop(now)
        drop(pairs)
        every = edges[0]
        for e in edges[1:]:
            every = every.unionByName(e)
        found = components(every, "alike-components")
        if last:
            break
    for done in (*parts, marks, one):
        drop(done)
    return found


def one_of_each(docs: DataFrame) -> DataFrame:
    """One row of each group of alike documents: the smallest doc_id's, a null one only if there is no other.

    Rows that repeat count as one. Of rows of one doc_id, the least hash of the text decides; null and
    empty texts are alike. Needs columns doc_id and text, none called _d, _h, _x or _z.
    """
    keyed = docs.withColumns({"_d": F.col("doc_id").cast("long"), "_h": F.xxhash64("text")})
    sketched = cut(sketches(keyed), "alike-sketches")
    found = alike(keyed, sketched)
    rows = sketched.select("_d", "_h", "v").join(found, "v", "left").select(F.coalesce("component", "v").alias("c"), F.struct(F.col("_d").isNull().alias("_z"), F.coalesce("_d", F.lit(0)).alias("_x"), "_h").alias("r"))
    kept = rows.groupBy("c").agg(F.min("r").alias("r")).select("r.*")
    full = keyed.withColumns({"_x": F.coalesce("_d", F.lit(0)), "_z": F.col("_d").isNull()})
    return full.join(kept, ["_x", "_z", "_h"], "left_semi").dropDuplicates(["_x", "_z", "_h"]).select(*docs.columns)
