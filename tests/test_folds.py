"""Sequential operators against hand-made cases and plain folds."""

import math

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meterflow.functions import labels as L
from meterflow.functions.hashing import fnv1a32, fnv1a64
from meterflow.model import DAY, event_points
from meterflow.operators import control as C
from meterflow.operators import downsample as D
from meterflow.operators import exchange as X
from meterflow.operators import limits as A
from meterflow.operators import stats as T
from meterflow.operators import tenant as N
from meterflow.operators.sampling import numbered, probabilistic
from meterflow.plans import rules as R
from meterflow.queries import QUERIES as Q
from meterflow.queries import SQL
from meterflow.sources import remote_write as W


def door(values, deviation):
    d, out = None, []
    for i, v in enumerate(values):
        got, d = D.corridor([(i + 1) * 10**9], [v], deviation, d)
        out.append(got)
    whole, end = D.corridor([(i + 1) * 10**9 for i in range(len(values))], values, deviation)
    assert whole == [p for x in out for p in x] and end == d
    return out, D.closing(d)


def test_swinging_door_step_and_drift():
    out, end = door([10, 10, 10, 20], 0.5)
    assert [len(x) for x in out] == [1, 0, 0, 1] and out[3][0][1] == 10 and end[0][1] == 20
    out, _ = door([10.0, 10.1, 10.2, 10.3, 10.5], 1.0)
    assert [len(x) for x in out] == [1, 0, 0, 0, 0]


def test_swinging_door_ignores_late_points():
    _, d = D.corridor([100], [1.0], 1.0)
    assert D.corridor([50], [9.0], 1.0, d) == ([], d) and D.corridor([100], [9.0], 1.0, d) == ([], d)


@given(st.lists(st.integers(-50, 50), min_size=1, max_size=300), st.sampled_from([0.5, 3.0, 20.0]))
@settings(max_examples=40, deadline=None)
def test_corridor_holds_every_point(values, deviation):
    """Between two points emitted, a line from the first lies within the deviation of all points."""
    out, door = D.corridor(range(len(values)), values, deviation)
    kept = [t for t, _ in out + D.closing(door)]
    assert kept[0] == 0 and kept[-1] == len(values) - 1
    for a, b in zip(kept, kept[1:]):
        low = max(((values[t] - values[a] - deviation) / (t - a) for t in range(a + 1, b + 1)), default=0)
        high = min(((values[t] - values[a] + deviation) / (t - a) for t in range(a + 1, b + 1)), default=0)
        assert low <= high


def test_largest_triangles_keep_a_spike():
    rows = [(i * 10**9, 100.0 if i == 17 else 5.0) for i in range(40)]
    got = D.largest_triangles(rows, 10 * 10**9)
    assert len(got) == 4 and (17 * 10**9, 100.0) in got


@given(st.lists(st.floats(-1e6, 1e6), min_size=1, max_size=60), st.integers(1, 7))
@settings(max_examples=60, deadline=None)
def test_largest_triangles_take_one_point_a_bucket(values, width):
    rows = list(enumerate(values))
    got = D.largest_triangles(rows, width)
    assert len(got) == math.ceil(len(values) / width) and all(p in rows for p in got)


def test_greedy_admission_leaves_room():
    assert A.greedy([4, 5, 3, 1, 1], 10) == [True, True, False, True, False]


@given(st.lists(st.integers(1, 20), max_size=40), st.integers(0, 60))
def test_greedy_never_exceeds(sizes, most):
    assert sum(n for n, ok in zip(sizes, A.greedy(sizes, most)) if ok) <= most


def test_halving_by_bytes():
    assert X.halves([10, 10, 10, 10], 20) == [0, 0, 1, 1]
    assert X.halves([50, 1], 20) == [0, 1]
    assert X.halves([], 5) == []


def test_spill_modes():
    mode, seen = 0, []
    for used in (0.5, 0.82, 0.96, 0.92, 0.85, 0.75, 0.6):
        mode = C.spill_mode(mode, used)
        seen.append(mode)
    assert seen == [0, 1, 3, 2, 1, 1, 0]


def test_circuit_opens_probes_and_closes():
    c = C.Circuit(2, 10)
    c.record(False, 0)
    c.record(False, 1)
    assert c.state == "open" and not c.allow(5)
    assert c.allow(11) and c.state == "half_open" and not c.allow(11)
    c.record(True, 12)
    assert c.state == "closed" and c.allow(13)


def test_tuner_and_scaler():
    t = C.BatchTuner(now=1000, least=100, most=5000)
    for _ in range(10):
        t.success()
    assert t.now == 1250
    t.failure(True)
    assert (t.now, t.ceiling) == (625, 1000)
    w = C.Scaler(now=8, idle_s=10)
    w.decide(0, 0)
    w.decide(0, 10)
    assert w.now == 4
    w.decide(500, 11)
    assert w.now == 5


@given(st.lists(st.tuples(st.dictionaries(st.text(max_size=8), st.text(max_size=8), max_size=4), st.lists(st.tuples(st.floats(allow_nan=False), st.integers(-(2**62), 2**62)), max_size=3)), max_size=5))
@settings(max_examples=60, deadline=None)
def test_remote_write_round_trip(series):
    got = W.decode_request(W.encode_request([(list(m.items()), s) for m, s in series]))
    assert [(dict(a), b) for a, b, _, _ in got] == [(m, s) for m, s in series]


@pytest.mark.parametrize("encoding", ["none", "gzip", "zlib", "deflate", "zstd", "snappy"])
def test_compression_round_trip_and_limit(encoding):
    data = b"abc" * 1000
    packed = W.compress(data, encoding)
    assert W.decompress(packed, encoding) == data
    with pytest.raises(ValueError):
        W.decompress(packed, encoding, 100)


@pytest.mark.parametrize("encoding", ["gzip", "zlib", "deflate", "zstd"])
def test_cut_and_empty_bodies_are_refused(encoding):
    packed = W.compress(bytes(range(256)) * 20, encoding)
    for part in (packed[: len(packed) // 2], packed[:-1], b""):
        with pytest.raises(ValueError):
            W.decompress(part, encoding)


@pytest.mark.parametrize("encoding", ["gzip", "zstd"])
def test_members_of_a_body_follow_each_other(encoding):
    assert W.decompress(W.compress(b"one ", encoding) + W.compress(b"two", encoding), encoding) == b"one two"


def test_truncated_request_is_refused():
    data = W.encode_request([([("a", "b")], [(1.0, 2)])])
    with pytest.raises(ValueError):
        W.decode_request(data[:-1])


def test_fnv_of_known_strings(spark):
    got = spark.sql("SELECT 'hello' AS t UNION ALL SELECT '' UNION ALL SELECT 'žluť'").select("t", fnv1a32(F.col("t")).alias("a"), fnv1a64(F.col("t")).cast("string").alias("b")).collect()

    def plain(t, h, prime, bits):
        for b in t.encode():
            h = ((h ^ b) * prime) % (1 << bits)
        return h

    for r in got:
        assert r.a == plain(r.t, 2166136261, 16777619, 32)
        assert r.b == str(plain(r.t, 14695981039346656037, 1099511628211, 64))


@pytest.mark.parametrize("operation,operand,value,want", [("add", 10, "5", "15"), ("sub", 3, "10", "7"), ("mul", 3, "4", "12"), ("div", 2, "10", "5"), ("mod", 3, "10", "1"), ("div", 0, "10", None), ("add", 1, "x", None), ("div", 8, "1", "0.125"), ("mul", 1e20, "10", "1" + "0" * 21), ("add", 1, " 5", None), ("div", 3, "1", "0.3333333333333333"), ("mul", 1, "1e-13", "0.0000000000001"), ("mul", 1, "1e40", "1" + "0" * 40), ("add", 0, "-12.50", "-12.5"), ("add", 0, "0", "0"), ("mul", 1e300, "1e300", "+Inf"), ("add", 0, "123456789012345678901234567.5", "123456789012345680000000000")])
def test_math(spark, operation, operand, value, want):
    row = spark.createDataFrame([({"a": value},)], "labels map<string,string>").select(L.tf_math(F.col("labels"), "a", "r", operation, operand).alias("m")).first()
    assert row.m.get("r") == want


def test_labels_edge_cases(spark):
    df = spark.createDataFrame([({"a": "1", "b": "é"},), ({},)], "labels map<string,string>")
    m = F.col("labels")
    got = df.select(L.tf_rename(m, "a", "b").alias("r"), L.tf_copy(m, "none", "c").alias("c"), L.tf_set(m, "t", "${a}-${zz}").alias("s"), L.canonical(m).alias("k"), L.rl_labelmap(m, "(.)", "x").alias("x")).collect()
    assert got[0].r == {"b": "1"} and got[0].c == {"a": "1", "b": "é"} and got[0].s["t"] == "1-" and got[0].k == "a=1|b=é" and got[0].x["x"] == "é"
    assert got[1].r == {} and got[1].s == {"t": "-"} and got[1].k == "" and got[1].x == {}


def test_rule_validation():
    with pytest.raises(ValueError):
        R.rule({"name": "x", "action": "none"})
    with pytest.raises(ValueError):
        R.rule({"name": "x", "action": "aggregate", "input": "a.*", "interval": "1m", "functions": ["sum"]})
    with pytest.raises(ValueError):
        R.rule({"name": "x", "action": "aggregate", "input": "a", "interval": "1m", "functions": ["sum"], "group_by": ["a"], "drop_labels": ["b"]})
    with pytest.raises(ValueError):
        R.rule({"name": "x", "action": "transform", "operations": [{"set": {}, "copy": {}}]})
    with pytest.raises(ValueError):
        R.rule({"name": "x", "action": "downsample", "method": "sdt"})
    assert R.duration_ns("1m30s") == 90 * 10**9
    assert R.parse_functions(["quantiles(0.5, 0.9)"]) == [("quantiles", (0.5, 0.9))]


def test_yaml_and_older_form(spark, small):
    new = R.load("processing_rules:\n- {name: d, action: drop, input: click}\n")
    old = R.load("default_rate: 1.0\nrules:\n- {name: d, match: {__name__: click}, rate: 0}\n")
    p = event_points(spark, small)
    left = [R.route(p, r).where("terminal_action IS NULL").count() for r in (new, old)]
    assert left[0] == left[1] == p.where("name <> 'click'").count()
    assert len(new) == 1 and new[0].action == "drop"


def test_transforms_are_applied_once(spark, small):
    r = R.rule({"name": "m", "action": "transform", "operations": [{"math": {"source": "k", "target": "k", "operation": "add", "operand": 1}}]})
    p = event_points(spark, small)
    both = R.route(p, [r]).select("dp_id", L.get(F.col("labels"), "k").alias("new")).join(p.select("dp_id", L.get(F.col("labels"), "k").alias("old")), "dp_id")
    assert both.where("CAST(new AS int) <> CAST(old AS int) + 1").count() == 0


def test_numbering_matches_one_window(spark):
    df = spark.range(1000).selectExpr("(id * 7919) % 1000 AS a")
    assert [(r.a, r.n) for r in numbered(df, ["a"], "n", 7).orderBy("a").collect()] == [(i, i + 1) for i in range(1000)]


def test_probabilistic_sampling_is_repeatable(spark, small):
    p = event_points(spark, small)
    a = {r.dp_id for r in probabilistic(p, 0.3).select("dp_id").collect()}
    b = {r.dp_id for r in probabilistic(p.repartition(7), 0.3).select("dp_id").collect()}
    assert a == b and 0.2 < len(a) / p.count() < 0.4


def test_ring_is_stable_when_an_endpoint_leaves():
    three, two = X.Ring(["a", "b", "c"]), X.Ring(["a", "b"])
    keys = [f"k{i}" for i in range(5000)]
    moved = [k for k in keys if three.owner(k) != two.owner(k)]
    assert all(three.owner(k) == "c" for k in moved) and 0.2 < len(moved) / len(keys) < 0.5


def test_admission_equals_a_fold(spark, small):
    lim = A.Limit("l", window_ns=DAY, max_rate=30, max_cardinality=20)
    p = event_points(spark, small)
    got = {r.dp_id: r.within for r in A.admit(p, lim).select("dp_id", "within").collect()}
    rows = sorted(A.windows(p, lim).select("ts_ns", "dp_id", "_w", "_g", "_s").collect())
    used, seen, want = {}, {}, {}
    for r in rows:
        s = seen.setdefault(r._w, set())
        known = (r._g, r._s) in s
        if not known and len(s) >= 20:
            want[r.dp_id] = False
            continue
        s.add((r._g, r._s))
        ok = used.get(r._w, 0) < 30
        used[r._w] = used.get(r._w, 0) + ok
        want[r.dp_id] = ok
    assert got == want


def test_reservoir_and_approximate_quantiles(spark, small):
    from meterflow.operators.aggregate import aggregate
    from meterflow.operators.sampling import reservoir

    p = event_points(spark, small)
    n = {r.name: r["count"] for r in p.groupBy("name").count().collect()}
    got = {r.name: r["count"] for r in reservoir(p, ["name"], 50).groupBy("name").count().collect()}
    assert got == {k: min(50, v) for k, v in n.items()}
    spec = {"name": "r", "action": "aggregate", "input": "click", "interval": "30d", "functions": ["quantiles(0.5)"], "drop_labels": ["user", "k"]}
    exact, near = (aggregate(p, R.rule(spec | {"options": {"approximate": a}})).first().value for a in (False, True))
    assert abs(exact - near) <= 0.1 * exact


def test_ring_and_owner_agree(spark, small):
    """Each row of ex_ring and ex_split has the endpoint that the ring gives its key, and no row is lost."""
    ring = X.Ring([f"endpoint-{i}" for i in range(3)])
    points = event_points(spark, small)
    got = Q["ex_ring"](spark, small).collect()
    assert all(r.endpoint == ring.owner(r.shard_key) for r in got) and sum(r.n for r in got) == points.count()
    keys = {r.dp_id: r.shard_key for r in points.select("dp_id", X.shard_key(["user", "k"]).alias("shard_key")).collect()}
    split = Q["ex_split"](spark, small).collect()
    assert {r.dp_id: r.endpoint for r in split} == {k: ring.owner(v) for k, v in keys.items()}


def test_hybrid_on_both_sides_of_its_threshold(spark, small):
    exact = {r.name: r.c for r in event_points(spark, small).groupBy("name").agg(F.count_distinct(T.stat_series()).alias("c")).collect()}
    middle = sorted(exact.values())[len(exact) // 2]
    got = T.hybrid(event_points(spark, small), middle).collect()
    assert {r.mode for r in got} == {"exact", "hll"} and len(got) == len(exact)
    for r in got:
        assert r["mode"] == ("exact" if exact[r.name] <= middle else "hll")
        assert r.cardinality == exact[r.name] if r["mode"] == "exact" else abs(r.cardinality - exact[r.name]) <= 0.05 * exact[r.name]


def test_sketches_estimate(spark, small):
    exact = {r.name: r.c for r in event_points(spark, small).groupBy("name").agg(F.count_distinct(T.stat_series()).alias("c")).collect()}
    for name in ("card_hll", "card_persist"):
        got = {r.name: r.estimate for r in Q[name](spark, small).select("name", "estimate").collect()}
        assert set(got) == set(exact) and all(abs(got[k] - exact[k]) <= 0.05 * exact[k] for k in exact)


def test_hll_sample_counts_series_as_its_sql(spark):
    """On 100,000 events an estimate of a window's series is off and moves the fraction that stays."""
    con = duckdb.connect()
    con.sql("CREATE VIEW events AS SELECT * FROM '/root/testdata/sf0.1/events.parquet'")
    want = con.sql(SQL["lim_hll_sample"]).fetchall()
    got = Q["lim_hll_sample"](spark, "/root/testdata/sf0.1").collect()
    assert sorted(r.dp_id for r in got) == sorted(r[0] for r in want)


def test_reservoir_keeps_its_cap(spark, small):
    n = {r.name: r["count"] for r in event_points(spark, small).groupBy("name").count().collect()}
    got = Q["smp_reservoir"](spark, small)
    assert {r.name: r["count"] for r in got.groupBy("name").count().collect()} == {k: min(50, v) for k, v in n.items()}
    assert got.distinct().count() == got.count() and got.join(event_points(spark, small), ["dp_id", "name"], "left_anti").isEmpty()


@pytest.mark.parametrize("action", ["dorp", ""])
def test_unknown_actions_are_refused(action):
    for wrong in ({"action": action}, {"tiers": ((80, action),)}):
        with pytest.raises(ValueError):
            A.Limit("x", **wrong)


@pytest.mark.parametrize(
    ("how", "dropped"),
    [
        ({"most": 10}, {3}),
        ({"most": 6, "by": ["tenant"]}, {3, 5}),
        ({"most": 6, "action": "log"}, set()),
        ({"most": 8, "action": "adaptive", "weak": {"b"}}, {2}),
        ({"most": 0, "most_series": 2}, {3}),
    ],
)
def test_quotas_drop_whole_batches(spark, how, dropped):
    rows = [(0, "a", 1, 1, 5, ["x"]), (0, "b", 2, 2, 4, ["y"]), (0, "a", 3, 3, 2, ["x", "z"]), (0, "b", 4, 4, 1, ["y"]), (10, "a", 5, 11, 9, ["q"])]
    parts = spark.createDataFrame(rows, "w long, tenant string, batch_id long, ts_ns long, n long, series array<string>")
    got = N.quota(parts, **how).collect()
    assert len(got) == len(rows) and {r.batch_id for r in got if not r.kept} == dropped


def test_earlier_rules_stay_charged_when_a_later_one_refuses(spark):
    rows = [(1, 0, "cpu", 4), (2, 1, "cpu", 2), (3, 2, "mem", 4), (4, 3, "mem", 1), (5, 10**9, "cpu", 5)]
    series = spark.createDataFrame(rows, "dp_id long, ts_ns long, name string, n long")
    got = A.prw_rate(series, [A.Limit("all", ".*", max_rate=10), A.Limit("cpu", "^cpu", max_rate=5)]).collect()
    assert {r.dp_id for r in got if r.kept} == {1, 3, 5} and len(got) == len(rows)
