"""Language identification: multinomial logistic regression on TF-IDF character n-grams, by FTRL, calibrated."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm.common import read

BITS = 15
_PARTS = 1 << 20  # characters counted at once
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point whether it is a letter; made once by each worker."""
    if not _letters:
        _letters.append(np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000))
    return _letters[0]


def gram_counts(text: str | None) -> np.ndarray | None:
    """Counts of hashed 1-, 2- and 3-grams of the lower-cased text, other signs as spaces; None without a letter."""
    t = (text or "").lower()
    total, found = None, False
    shift = np.uint64(64 - BITS)
    for at in range(0, len(t), _PARTS):
        c = np.frombuffer(t[at : at + _PARTS + 2].encode("utf-32-le", "surrogatepass"), np.uint32)
        own = letters()[c]
        found = found or bool(own.any())
        x = np.where(own, c, 32).astype(np.uint64)
        n = min(len(x), _PARTS)
        part = np.bincount(((x[:n] * np.uint64(0x9E3779B97F4A7C15)) >> shift).view(np.int64), minlength=1 << BITS)
        if len(x) > 1:
            y = x[:-1] * np.uint64(0x1000003) + x[1:] + np.uint64(1 << 60)
            part += np.bincount(((y[:n] * np.uint64(0xC2B2AE3D27D4EB4F)) >> shift).view(np.int64), minlength=1 << BITS)
        if len(x) > 2:
            z = y[:-1] * np.uint64(0x1000003) + x[2:]
            part += np.bincount(((z[:n] * np.uint64(0x165667B19E3779F9)) >> shift).view(np.int64), minlength=1 << BITS)
        total = part if total is None else total + part
    return total if found else None


def vector(counts: np.ndarray, idf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features and their weights (1 + log count) * idf, of length one."""
    at = np.flatnonzero(counts)
    x = (1 + np.log(counts[at])) * idf[at]
    return at, x / max(np.sqrt(x @ x), 1e-12)


@dataclass
class Model:
    langs: list[str]
    weights: np.ndarray  # classes by features
    bias: np.ndarray
    idf: np.ndarray
    temperature: float = 1.0

    def logits(self, at: np.ndarray, x: np.ndarray) -> np.ndarray:
        return self.weights[:, at] @ x + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        counts = gram_counts(text) if self.langs else None
        if counts is None:
            return "und", 0.0
        z = self.logits(*vector(counts, self.idf)) / self.temperature
        p = np.exp(z - z.max())
        k = int(p.argmax())
        return self.langs[k], float(p[k] / p.sum())


def train_ftrl(rows, n_classes: int, alpha=0.3, beta=1.0, l1=1e-3, l2=1e-3, epochs=4, seed=7):
    """Follow the regularised leader with elastic net, one class against the others in one softmax.

    rows: (features, weights, class). Per-coordinate rates; a coordinate whose sum of gradients stays
    within l1 is exactly zero.
    """
    d = (1 << BITS) + 1  # the last is the bias
    z, n = np.zeros((n_classes, d)), np.zeros((n_classes, d))
    order = np.random.default_rng(seed)
    for _ in range(epochs):
        for r in order.permutation(len(rows)):
            at, x, k = rows[r]
            at, x = np.append(at, d - 1), np.append(x, 1.0)
            zi, ni = z[:, at], n[:, at]
            w = np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((beta + np.sqrt(ni)) / alpha + l2))
            s = w @ x
            p = np.exp(s - s.max())
            p /= p.sum()
            p[k] -= 1
            g = p[:, None] * x[None, :]
            step = (np.sqrt(ni + g * g) - np.sqrt(ni)) / alpha
            z[:, at] = zi + g - step * w
            n[:, at] = ni + g * g
    w = np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))
    return w[:, :-1].copy(), w[:, -1].copy()


def calibrate(logits: np.ndarray, classes: np.ndarray) -> float:
    """The temperature of least log-loss; each answer counts as right with odds of n + 1 to 1, so none is ever sure."""
    best, out = np.inf, 1.0
    n = len(logits)
    doubt = 1.0 / (n + 2)
    for t in np.geomspace(0.02, 10, 80):
        z = logits / t
        z -= z.max(axis=1, keepdims=True)
        z -= np.log(np.exp(z).sum(axis=1, keepdims=True))
        loss = -float(np.mean((1 - doubt) * z[np.arange(n), classes] + doubt * z.mean(axis=1)))
        if loss < best - 1e-9:
            best, out = loss, float(t)
    return out


def fit(train: DataFrame, per_language: int = 600) -> Model:
    """A model of train's columns doc_id, text, lang (none null).

    Document frequencies are counted over all of train. The weights learn from a sample of about
    per_language documents of each language, chosen by a hash of doc_id; a fifth of it is kept apart
    for the temperature, but for one document at least of each language. No rows: a model without languages, which answers und.
    """
    found = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(found)
    if not langs:
        return Model([], np.zeros((0, 1 << BITS)), np.zeros(0), np.zeros(1 << BITS))

    def frequencies(batches):
        import pyarrow as pa

        df = np.zeros((1 << BITS) + 1, np.int64)
        for batch in batches:
            for t in batch.column(0):
                c = gram_counts(t.as_py())
                if c is not None:
                    df[:-1] += c > 0
                    df[-1] += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(df[at], pa.int64())], names=["f", "n"])

    df = np.zeros((1 << BITS) + 1)
    for r in train.select("text").mapInArrow(frequencies, "f long, n long").groupBy("f").agg(F.sum("n").alias("n")).collect():  # at most 2**BITS + 1 rows
        df[r["f"]] = r["n"]
    idf = np.log((1 + df[-1]) / (1 + df[:-1])) + 1

    u = F.pmod(F.xxhash64(F.lit(3), "doc_id"), F.lit(1_000_003)) / 1_000_003.0
    below = F.lit(0.0)
    for lang, n in found.items():
        below = F.when(F.col("lang") == lang, min(1.0, per_language / n)).otherwise(below)

    def features(batches):
        import pyarrow as pa

        for batch in batches:
            out = []
            for t, lang, s in zip(batch.column(0), batch.column(1), batch.column(2)):
                c = gram_counts(t.as_py())
                if c is not None:
                    at = np.flatnonzero(c)
                    out.append((at.astype("<u4").tobytes(), c[at].astype("<u4").tobytes(), lang.as_py(), s.as_py()))
            cols = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.binary(), pa.binary(), pa.string(), pa.float64()))], names=["f", "n", "lang", "u"])

    sample = train.withColumn("_u", u).where(F.col("_u") < below).select("text", "lang", F.pmod(F.col("_u") * 977, F.lit(1.0)).alias("_v"), "_u")
    got = sorted(map(tuple, sample.select("text", "lang", "_v").mapInArrow(features, "f binary, n binary, lang string, u double").collect()))
    rows, kept = [], []
    most = {}
    for *_, lang, s in got:
        most[lang] = max(s, most.get(lang, s))
    for f, n, lang, s in got:
        at = np.frombuffer(f, "<u4").astype(np.int64)
        x = (1 + np.log(np.frombuffer(n, "<u4"))) * idf[at]
        (kept if s < 0.2 and s < most[lang] else rows).append((at, x / max(np.sqrt(x @ x), 1e-12), langs.index(lang)))
    w, b = train_ftrl(rows, len(langs))
    model = Model(langs, w.astype(np.float32), b, idf)
    if kept:
        model.temperature = calibrate(np.array([model.logits(at, x) for at, x, _ in kept]), np.array([k for _, _, k in kept]))
    return model


def identify(docs: DataFrame, model: Model, *keep: Column) -> DataFrame:
    """keep's columns, then lang_pred and score, for every row: each whole text alone decides.

    Null text, or a text without a letter: und with score 0. Repeated rows: equal results. Text of any
    length is counted in parts. The model goes to the workers as one broadcast of classes times 2**15.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)
    rows = docs.select(*keep, F.col("text").alias("_text"))
    schema = rows.schema[:-1]

    def run(batches):
        import pyarrow as pa

        m = sent.value
        for batch in batches:
            got = [m.predict(t.as_py()) for t in batch.column(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], names=[*batch.schema.names[:-1], "lang_pred", "score"])

    return rows.mapInArrow(run, schema.add("lang_pred", "string").add("score", "double"))


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    model = fit(docs.where(F.col("lang").isNotNull() & ~held).select("doc_id", "text", "lang"))
    return identify(docs, model, F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"))


QUERIES = {"op1_language_id": op1_language_id}
SQL: dict[str, str] = {}
