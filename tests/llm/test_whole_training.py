"""The quality model learns from and is calibrated on all labelled rows; near copies don't depend on the counted share."""

import random
import uuid
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from meterflow.llm import near_copies, op10_quality as o10


def texts(rng, n, bad):
    line = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(rng.randint(4, 12)))
    return ["\n".join(("#$ |" + line().upper() + " 1234 !!") if bad else line() + "." for _ in range(rng.randint(1, 4))) for _ in range(n)]


def test_all_labelled_rows_train_and_calibrate(spark, monkeypatch, tmp_path):
    rng = random.Random(5)
    rows = [(i, t, 1) for i, t in enumerate(texts(rng, 2600, False))] + [(10_000 + i, t, 0) for i, t in enumerate(texts(rng, 40, True))]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(3)
    folder = str(tmp_path)

    def counted(key, table):
        with open(f"{folder}/{uuid.uuid4().hex}", "w") as out:
            out.write(str(sum(table.column("quality").to_pylist())))
        assert len(set(table.column("quality").to_pylist())) == 2
        return o10._learn(key, table)  # a worker's own module, which is not patched

    monkeypatch.setattr(o10, "_learn", counted)
    monkeypatch.setattr(o10, "LINES", 1500)
    monkeypatch.setattr(o10, "TEXTS", 10)
    chain = o10.fit(df)
    u = F.pmod(F.xxhash64(F.lit(9), "doc_id"), F.lit(1_000_003)) / 1_000_003.0
    seen = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert len(seen) > 1 and sum(seen) == df.where((F.pmod(u * 977, F.lit(1.0)) >= 0.2) & (F.col("quality") == 1)).count() > 2000
    got = o10.judge(df, chain, F.col("quality")).collect()
    assert np.mean([r.predicted == r.quality for r in got]) >= 0.99


def test_order_of_shingles_changes_no_result(spark, monkeypatch):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdef") for _ in range(4))
    common = [word() for _ in range(30)]
    rows = []
    for i in range(60):
        own = [word() for _ in range(60)]
        rows += [(2 * i, " ".join(common + own)), (2 * i + 1, " ".join(common + own[:-1] + [word()]))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    want = Counter(r.doc_id for r in near_copies.one_of_each(df).collect())
    assert set(want) == {2 * i for i in range(60)}
    monkeypatch.setattr(near_copies, "_common", lambda docs: np.zeros(0, np.uint64))
    assert Counter(r.doc_id for r in near_copies.one_of_each(df).collect()) == want
