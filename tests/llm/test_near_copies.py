"""Near copies of the pipeline against brute force, and rows that repeat."""

import hashlib
import itertools
import random
from collections import Counter

import corpus_pipeline as P
from meterflow.llm import near_copies as N
from meterflow.llm import op4_mixing, op10_quality
from meterflow.llm.op2_suffix import PASSAGE
from test_operators import union, without_passages

SCHEMA = "doc_id long, text string, source string, n_chars long"


def words(rng, n):
    return ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(n)]


def edited(rng, w, n):
    w = list(w)
    for i in rng.sample(range(len(w)), n):
        w[i] = "x" + w[i]
    return w


def sets(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def kept(rows):
    s = [sets(t) for _, t in rows]
    near = [(i, j) for i, j in itertools.combinations(range(len(s)), 2) if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
    least = {}
    for (k, _), r in zip(rows, union(len(rows), near)):
        order = (k is None, k or 0)
        least[r] = min(least.get(r, order), order)
    return sorted(least.values())


def corpus():
    rng = random.Random(7)
    line, out = words(rng, 30), []
    for _ in range(30):
        base = words(rng, rng.randint(5, 200)) + line * rng.randint(0, 1)
        out.append(base)
        out += [edited(rng, base, rng.randint(1, max(1, len(base) // 25))) for _ in range(rng.randint(0, 4))]
    chain = words(rng, 150)
    for _ in range(12):
        chain = edited(rng, chain, 2)
        out.append(chain)
    hot = words(rng, 120)
    out += [edited(rng, hot, 2) for _ in range(60)] + [line, line + words(rng, 1)]
    texts = [" ".join(w) for w in out] + [None, "", " \n", "Aa bb", "aa  BB", "aa"]
    return [(i, t) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(k, t, "s", len(t or "")) for k, t in rows], SCHEMA).repartition(3)


def test_all_pairs_of_similarity(spark, monkeypatch):
    rows = corpus()
    random.Random(1).shuffle(rows)
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in P.near_duplicates(spark, frame(spark, rows), "").collect())
    assert got == kept(rows)
    monkeypatch.setattr(N, "MANY", 0)
    monkeypatch.setattr(N, "ROUNDS", 1)
    monkeypatch.setattr(N, "MOST_COMMON", 0)
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in P.near_duplicates(spark, frame(spark, rows), "").collect()) == got


def test_one_row_stays(spark):
    rng = random.Random(3)
    a, b, c = (" ".join(words(rng, 300)) for _ in range(3))
    rows = [(1, a), (1, a), (2, a), (7, b), (7, b), (None, c), (None, c), (None, b)]
    got = P.near_duplicates(spark, frame(spark, rows), "")
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=str) == sorted([(1, a), (7, b), (None, c)], key=str)
    after = P.repeated_bytes(spark, got, "").collect()
    assert sorted(r.text for r in after) == sorted([a, b, c])


def test_stages_on_the_small_table(spark, small, tmp_path):
    """Columns and decisions of each stage, against the operators and brute force."""
    seen = [spark.read.parquet(f"{small}/documents.parquet")]
    columns = seen[0].columns
    for i, (_, stage) in enumerate(P.STAGES):
        stage(spark, seen[-1], small).write.parquet(str(tmp_path / str(i)))
        seen.append(spark.read.parquet(str(tmp_path / str(i))))
    assert all(d.columns == columns for d in seen[:-1])
    good = op10_quality.judge(seen[0], op10_quality.quality_model(spark, small), seen[0]["doc_id"]).where("predicted = 1")
    assert {r.doc_id for r in seen[1].collect()} == {r.doc_id for r in good.collect()}
    assert sorted(((r.doc_id is None, r.doc_id or 0) for r in seen[2].collect())) == kept([(r.doc_id, r.text) for r in seen[1].collect()])
    want = {(k, h) for k, _, h in without_passages([(r.doc_id, r.text) for r in seen[2].collect()], 400, PASSAGE)}
    assert {(r.doc_id, hashlib.sha256(r.text.encode()).hexdigest()) for r in seen[3].collect() if r.text.isascii()} <= want
    assert seen[3].count() == seen[2].count() and all(r.n_chars == len(r.text) for r in seen[3].collect())
    copies = Counter({r.doc_id: r.copies for r in op4_mixing.mix_sources(seen[3]).collect()})
    assert Counter(r.doc_id for r in seen[4].collect()) == +copies
    assert Counter(r.doc_id for r in seen[5].collect()) == +copies
    key = lambda r: (r.doc_id, r.ids_sha256)
    assert sorted(map(key, P.run(spark, small).collect())) == sorted(map(key, seen[5].collect()))
