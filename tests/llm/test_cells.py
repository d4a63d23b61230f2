"""Operator 9's cells: near all links are found while each vector meets few of its label; cells dealt to several tasks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from meterflow.llm import op9_embeddings as o9


@pytest.mark.parametrize("chunk", (32768, 60))
def test_links_across_cells_without_all_pairs(spark, monkeypatch, chunk):
    rng = np.random.default_rng(7)
    x = rng.normal(size=(3000, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for i in range(600):  # partners just above the threshold
        u = rng.normal(size=32)
        u -= (u @ x[i + 600]) * x[i + 600]
        x[i] = 0.94 * x[i + 600] + np.sqrt(1 - 0.94**2) * u / np.linalg.norm(u)
    x[1500:1700] = x[1500] + 0.01 * rng.normal(size=(200, 32))  # one group of near copies
    df = spark.createDataFrame([(i, [float(c) for c in r], "a") for i, r in enumerate(x)], "vec_id long, embedding array<float>, label string").repartition(4)
    tables, cut = {}, o9.cut
    monkeypatch.setattr(o9, "cut", lambda d, name: tables.setdefault(name, cut(d, name)))
    monkeypatch.setattr(o9, "CHUNK", chunk)
    got = {r.vec_id: r.n_links for r in o9.near_vectors(df, shard=100).collect()}
    unit = x.astype(np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    want = (unit @ unit.T >= 0.93).sum(axis=1) - 1
    assert all(got[i] <= want[i] for i in range(len(x)))
    linked = np.flatnonzero(want)
    assert np.mean([got[i] / want[i] for i in linked]) >= 0.9
    assert all(got[i] == want[i] for i in range(1500, 1700))  # a group of near copies is at home in one cell
    assert tables["vectors-routed"].agg(F.sum(F.size("cells"))).first()[0] < 8 * len(x)  # of about 25 cells
