"""Quality classifier: a linear-chain conditional random field labels lines good or bad."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm.common import buffers, cut, drop, hash_words, pieces, read, split_words

_CLASSES = 8  # other, lower, upper, digit, space, mark, sign, bar
_KIND = np.zeros(256, np.int64)
_KIND[ord("a") : ord("z") + 1] = 1
_KIND[0x80:] = 1
_KIND[ord("A") : ord("Z") + 1] = 2
_KIND[ord("0") : ord("9") + 1] = 3
_KIND[[9, 10, 11, 12, 13, 32]] = 4
_KIND[[ord(c) for c in ".,;:!?'\"()-"]] = 5
_KIND[[ord(c) for c in "#$%&*+<>=@[]\\^_`{}~/"]] = 6
_KIND[ord("|")] = 7
#: Upper ends of the bins of each ratio; the last bin is open.
BINS = np.array([0.0, 0.005, 0.01, 0.02, 0.04, 0.07, 0.1, 0.15, 0.2, 0.3, 0.45, 0.6, 0.8])
RATIOS = 11
FEATURES = RATIOS * (len(BINS) + 1)
#: Lines that one task learns from; texts of a label that each task gets at least, if there are so many.
LINES, TEXTS = 60_000, 200
#: Cells of a unit of the calibration's logits, whose texts count as one with their mean.
CELLS = 1024


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each line of each text: RATIOS feature numbers; its bytes; and n+1 offsets of each text's first line.

    A text has one line more than it has line feeds, so an empty one has an empty line.
    """
    n = len(offsets) - 1
    feeds = np.flatnonzero(data == 10)
    per = np.searchsorted(feeds, offsets)
    lines = np.concatenate([[0], np.cumsum(np.diff(per) + 1)])
    starts = np.empty(lines[-1], np.int64)
    starts[lines[:-1]] = offsets[:-1]
    inner = np.ones(lines[-1], bool)
    inner[lines[:-1]] = False
    starts[inner] = feeds + 1
    ends = np.empty_like(starts)
    last = np.zeros(lines[-1], bool)
    last[lines[1:] - 1] = True
    ends[last] = offsets[1:]
    ends[~last] = feeds
    size = ends - starts

    line_of = np.repeat(np.arange(lines[-1]), size + ~last)  # a feed counts with its line
    counts = np.bincount(line_of * _CLASSES + _KIND[data], minlength=lines[-1] * _CLASSES).reshape(-1, _CLASSES)
    ws, we, _ = split_words(data, offsets)
    h = hash_words(data, ws, we)
    wl = line_of[ws]
    words = np.bincount(wl, minlength=lines[-1])
    same_line = wl[1:] == wl[:-1]
    again = np.bincount(wl[1:][same_line & (h[1:] == h[:-1])], minlength=lines[-1])
    odd_end = np.bincount(wl[_KIND[data[we - 1]] >= 6], minlength=lines[-1])
    cries = np.bincount(wl[data[we - 1] == ord("!")], minlength=lines[-1])
    lh = hash_words(data, starts, ends)
    doc = np.repeat(np.arange(n), np.diff(lines))
    _, where, times = np.unique(np.stack([doc.astype(np.uint64), lh]), axis=1, return_inverse=True, return_counts=True) if len(lh) else (0, np.zeros(0, int), np.zeros(0, int))
    copies = times[where.reshape(-1)] - 1
    bytes_, words_ = np.maximum(size, 1), np.maximum(words, 1)
    ratios = np.stack(
        [
            counts[:, 2] / np.maximum(counts[:, 1] + counts[:, 2], 1),
            counts[:, 3] / bytes_,
            counts[:, 5] / bytes_,
            counts[:, 6] / bytes_,
            counts[:, 7] / bytes_,
            again / words_,
            odd_end / words_,
            cries / words_,
            copies / np.maximum(np.diff(lines)[doc], 1),
            np.minimum(size / 2000.0, 1),
            np.minimum(size / words_ / 20.0, 1),
        ],
        axis=1,
    )
    own = np.searchsorted(BINS, ratios, "left") + np.arange(RATIOS) * (len(BINS) + 1)
    return own, size, lines


@dataclass
class Chain:
    """Two states, 1 good: weights of own, previous and next line's features, state and transition scores."""

    near: np.ndarray  # 3 by FEATURES: score of good against bad
    bias: float
    step: np.ndarray  # 2 by 2
    scale: float = 1.0
    shift: float = 0.0

    def emissions(self, own: np.ndarray, lines: np.ndarray) -> np.ndarray:
        got = [w[own].sum(axis=1) for w in self.near]
        e = got[0] + self.bias
        first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
        first[lines[:-1]] = True
        last[lines[1:] - 1] = True
        e[~first] += got[1][:-1][~first[1:]]
        e[~last] += got[2][1:][~last[:-1]]
        return e


def marginals(e: np.ndarray, lines: np.ndarray, step: np.ndarray, weight: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, float, np.ndarray]:
    """Forward and backward over all texts at once: p(good) of each line, pair sums, log partition sum, its parts.

    weight: of each line in the pair sums, 1 if not given. Texts stand by length, so step t works on those that have a line t.
    """
    size = np.diff(lines)
    order = np.argsort(-size, kind="stable")
    start, top = lines[:-1][order], int(size.max(initial=0))
    alive = np.searchsorted(-size[order], -np.arange(1, top + 1), "right")  # texts with a line t
    psi = np.stack([np.zeros_like(e), e], axis=1)
    a, b = np.empty_like(psi), np.zeros_like(psi)
    if top:
        a[start] = psi[start]
    for t in range(1, top):
        at = start[: alive[t]] + t
        prev = a[at - 1]
        m = prev[:, :, None] + step[None]
        a[at] = np.logaddexp(m[:, 0], m[:, 1]) + psi[at]
    pair = np.zeros((2, 2))
    ends = lines[1:] - 1
    logz = np.logaddexp(a[ends, 0], a[ends, 1])
    z = np.repeat(logz, size)
    for t in range(top - 1, 0, -1):
        at = start[: alive[t]] + t
        nxt = (psi[at] + b[at])[:, None, :] + step[None]
        b[at - 1] = np.logaddexp(nxt[:, :, 0], nxt[:, :, 1])
        each = np.exp(a[at - 1][:, :, None] + nxt - z[at][:, None, None])
        pair += each.sum(axis=0) if weight is None else np.tensordot(weight[at], each, 1)
    p = np.exp(a[:, 1] + b[:, 1] - z)
    return p, pair, float(logz.sum()), logz


def train_chain(texts: list[tuple[np.ndarray, np.ndarray]], good: np.ndarray, rounds: int = 150, rate: float = 0.08, l2: float = 2e-4) -> Chain:
    """Adam on the conditional log-likelihood; each line carries the label of its text. texts: line features, sizes.

    The texts of both labels together weigh the same.
    """
    lines = np.concatenate([[0], np.cumsum([len(o) for o, _ in texts])])
    own = np.concatenate([o for o, _ in texts])
    y = np.repeat(good, np.diff(lines)).astype(float)
    weight = np.repeat(len(good) / 2 / np.maximum(np.bincount(good, minlength=2), 1)[good], np.diff(lines))
    first, last = np.zeros(len(own), bool), np.zeros(len(own), bool)
    first[lines[:-1]] = True
    last[lines[1:] - 1] = True
    inside = ~first
    gold = np.zeros((2, 2))
    np.add.at(gold, (y[:-1][inside[1:]].astype(int), y[1:][inside[1:]].astype(int)), weight[1:][inside[1:]])
    theta = np.zeros(3 * FEATURES + 1 + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    n, total = len(weight), weight.sum()
    flat = own.reshape(-1)
    for k in range(1, rounds + 1):
        chain = Chain(theta[: 3 * FEATURES].reshape(3, FEATURES), theta[3 * FEATURES], theta[-4:].reshape(2, 2))
        p, pair, _, _ = marginals(chain.emissions(own, lines), lines, chain.step, weight)
        d = (y - p) * weight
        g = np.zeros_like(theta)
        g[:FEATURES] = np.bincount(flat, np.repeat(d, RATIOS), FEATURES)
        of_prev = np.zeros(n)
        of_prev[:-1][inside[1:]] = d[1:][inside[1:]]  # the feature of line t feeds line t + 1
        of_next = np.zeros(n)
        of_next[1:][inside[1:]] = d[:-1][inside[1:]]
        g[FEATURES : 2 * FEATURES] = np.bincount(flat, np.repeat(of_prev, RATIOS), FEATURES)
        g[2 * FEATURES : 3 * FEATURES] = np.bincount(flat, np.repeat(of_next, RATIOS), FEATURES)
        g[3 * FEATURES] = d.sum()
        g[-4:] = (gold - pair).reshape(-1)
        g = g / total - l2 * theta
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        theta = theta + rate * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    return Chain(theta[: 3 * FEATURES].reshape(3, FEATURES), float(theta[3 * FEATURES]), theta[-4:].reshape(2, 2))


def raw_scores(chain: Chain, own: np.ndarray, size: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """Length-weighted mean marginal of good over each text's lines."""
    if len(lines) < 2:
        return np.zeros(0)
    p, _, _, _ = marginals(chain.emissions(own, lines), lines, chain.step)
    w = size + 1.0
    return np.add.reduceat(p * w, lines[:-1]) / np.add.reduceat(w, lines[:-1])


def _logit(s: np.ndarray) -> np.ndarray:
    s = np.clip(s, 1e-4, 1 - 1e-4)
    return np.log(s / (1 - s))


def _unpacked(own, size) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(own.as_py(), "<i2").astype(np.int64).reshape(-1, RATIOS), np.frombuffer(size.as_py(), "<i8")


def featured(docs: DataFrame) -> DataFrame:
    """(doc_id, quality, own, size) of docs' columns doc_id, quality, text: features and bytes of the lines of each text."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"), "text")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            data, offsets = buffers(batch.column(2))
            a, b = [], []
            for i, j in pieces(offsets, 4 << 20):
                own, size, lines = line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                a += [own[x:y].astype("<i2").tobytes() for x, y in zip(lines, lines[1:])]
                b += [size[x:y].astype("<i8").tobytes() for x, y in zip(lines, lines[1:])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["doc_id", "quality", "own", "size"])

    return rows.mapInArrow(run, "doc_id long, quality int, own binary, size binary")


def _learn(key, table):
    """The weights of a chain learnt from a task's texts; none if they have one label only."""
    import pyarrow as pa

    table = table.sort_by([("quality", "ascending"), ("own", "ascending"), ("size", "ascending")])  # reruns agree
    good = table.column("quality").to_numpy()
    found = []
    if len(set(good.tolist())) == 2:
        chain = train_chain([_unpacked(o, s) for o, s in zip(table.column("own"), table.column("size"))], good)
        found = [np.concatenate([chain.near.reshape(-1), [chain.bias], chain.step.reshape(-1)]).tolist()]
    return pa.table({"theta": pa.array(found, pa.list_(pa.float64()))})


def fit(train: DataFrame) -> Chain:
    """A chain learnt from all of train's columns doc_id, text, quality (0 or 1)."""
    return fit_featured(featured(train))


def fit_featured(rows: DataFrame) -> Chain:
    """A chain learnt from all rows of doc_id, quality and the features of a text.

    Four fifths of the texts, by a hash of doc_id, are dealt to tasks of about LINES lines. Each task learns
    the weights of its texts, and their mean over the tasks is the chain's. Where a label has fewer than
    TEXTS texts a task, each is dealt to several. The other fifth, all of it, sets the calibration of the
    text score. One label only, or no rows: a constant score of that label, 0.5 without any.
    """
    spark = rows.sparkSession
    u = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1_000_003)) / 1_000_003.0
    rows = cut(rows.withColumn("apart", F.pmod(u * 977, F.lit(1.0)) < 0.2), "quality-lines")
    found = {(r["quality"], r["apart"]): (r["n"], r["m"]) for r in rows.groupBy("quality", "apart").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("size") / 8).alias("m")).collect()}
    empty = Chain(np.zeros((3, FEATURES)), 0.0, np.zeros((2, 2)))
    labels = {q for q, _ in found}
    if labels != {0, 1}:
        empty.scale, empty.shift = 0.0, {0: -4.0, 1: 4.0}.get(next(iter(labels), -1), 0.0)
        drop(rows)
        return empty
    sides = [{a} if {(0, a), (1, a)} <= set(found) else {True, False} for a in (False, True)]  # a side without a label: all rows
    here = [(q, found[q, a]) for q, a in found if a in sides[0]]
    tasks = int(-(-sum(m for _, (_, m) in here) // LINES))
    texts = {q: sum(n for p, (n, _) in here if p == q) for q in (0, 1)}
    times = F.when(F.col("quality") == 1, min(tasks, -(-TEXTS * tasks // texts[1]))).otherwise(min(tasks, -(-TEXTS * tasks // texts[0])))
    dealt = rows.where(F.col("apart").isin(*sides[0])).withColumn("k", F.explode(F.sequence(F.lit(0), times - 1)))
    dealt = dealt.select(F.pmod(F.xxhash64(F.lit(13), "doc_id") + F.col("k"), F.lit(tasks)).alias("task"), "quality", "own", "size")
    thetas = [t for (t,) in sorted(map(tuple, dealt.repartitionByRange(max(tasks, 1), "task").groupBy("task").applyInArrow(_learn, "theta array<double>").collect()))]
    if not thetas:
        raise RuntimeError("no task had texts of both labels")
    theta = np.mean(thetas, axis=0)
    chain = Chain(theta[: 3 * FEATURES].reshape(3, FEATURES), float(theta[3 * FEATURES]), theta[-4:].reshape(2, 2))
    sent = spark.sparkContext.broadcast(chain)

    def logits(batches):
        import pyarrow as pa

        for batch in batches:
            x = [float(_logit(raw_scores(sent.value, *text, np.array([0, len(text[0])])))[0]) for text in map(_unpacked, batch.column(1), batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], names=["quality", "x"])

    scored = rows.where(F.col("apart").isin(*sides[1])).select("quality", "own", "size").mapInArrow(logits, "quality int, x double")
    cells = scored.groupBy("quality", F.floor(F.col("x") * CELLS).alias("c")).agg(F.avg("x").alias("x"), F.count(F.lit(1)).alias("n")).collect()
    drop(rows)
    y, _, x, n = np.array(sorted(map(tuple, cells)), float).T
    shares = [sum(k for (q, _), (k, _) in found.items() if q == label) for label in (0, 1)]
    w = n * np.where(y == 1, shares[1] / n[y == 1].sum(), shares[0] / n[y == 0].sum())
    mean = (n * x * x).sum() / n.sum()
    a, b = 1.0, 0.0
    for _ in range(400):  # a logistic curve by gradient, with the labels' true shares as weights
        p = 1 / (1 + np.exp(-np.clip(a * x + b, -30, 30)))
        d = w * (y - p) / w.sum()
        a, b = a + 0.5 * (d @ x) / max(1.0, mean * 0.25) + 0.002 * (1 - a), b + 0.5 * d.sum()
    chain.scale, chain.shift = float(a), float(b)
    return chain


def judge(docs: DataFrame, chain: Chain, *keep: Column, threshold: float = 0.7) -> DataFrame:
    """keep's columns, then score (0 to 1) and predicted (1 if score >= threshold), of every whole text.

    Null text counts as empty; an empty text is one empty line. Repeated rows: equal results. Lines of
    texts far longer than a batch are still scored together, from 16 bytes a byte of text.
    """
    sent = docs.sparkSession.sparkContext.broadcast(chain)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = rows.schema[:-1]

    def run(batches):
        import pyarrow as pa

        c = sent.value
        for batch in batches:
            data, offsets = buffers(batch.column(batch.num_columns - 1))
            out = []
            for i, j in pieces(offsets, 2 << 20):
                s = raw_scores(c, *line_features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]))
                out.append(1 / (1 + np.exp(-np.clip(c.scale * _logit(s) + c.shift, -30, 30))))
            score = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(score, pa.float64()), pa.array((score >= threshold).astype(np.int32), pa.int32())], names=[*batch.schema.names[:-1], "score", "predicted"])

    return rows.mapInArrow(run, schema.add("score", "double").add("predicted", "integer"))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def quality_model(spark: SparkSession, sf_dir: str) -> Chain:
    """Learnt from all labelled rows of documents that aren't held out; texts with clashing labels keep each.

    Features go through the join instead of texts, which are several times larger.
    """
    docs = featured(read(spark, sf_dir, "documents").where(~held_out() & F.col("doc_id").isNotNull()).select("doc_id", "text", F.lit(None).cast("int").alias("quality"))).drop("quality")
    marks = read(spark, sf_dir, "labels").where("quality IN (0, 1)").where(~held_out()).select(F.col("doc_id").cast("long").alias("_l"), F.col("quality").cast("int").alias("quality"))
    return fit_featured(docs.join(marks, docs["doc_id"] == F.col("_l")).select("doc_id", "quality", "own", "size"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    chain = quality_model(spark, sf_dir)
    return judge(read(spark, sf_dir, "documents"), chain, F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"))


QUERIES = {"op10_quality": op10_quality}
SQL: dict[str, str] = {}
