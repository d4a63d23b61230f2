"""Queries of aggregation, downsampling, sampling, statistics and cardinality over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterflow.functions import labels as L
from meterflow.model import DAY, DP, HOUR, event_points, window_start
from meterflow.operators import downsample as D
from meterflow.operators import sampling as S
from meterflow.operators import stats as T
from meterflow.operators.aggregate import aggregate
from meterflow.plans.rules import rule
from meterflow.queries.registry import Registry

Q = Registry()


def M():
    """The labels of a datapoint."""
    return F.col("labels")


def _agg(functions, **more):
    return rule({"name": "r", "action": "aggregate", "input": "(?:click|purchase)", "output": "out", "interval": "1d", "functions": functions, "group_by": ["user"], **more})


def _input(spark, sf_dir):
    return event_points(spark, sf_dir).where(F.col("name").isin("click", "purchase"))


_IN = DP + ", src AS (SELECT *, ts_ns // 86400000000000 AS w FROM dp WHERE name IN ('click', 'purchase'))"


def _one(name: str, function: str, sql: str) -> None:
    def run(spark, sf_dir):
        got = aggregate(_input(spark, sf_dir), _agg([function]))
        return got.select("name", L.get(M(), "user").alias("u"), "ts_ns", F.round("value", 6).alias("value"))

    Q(name, _IN + f" SELECT 'out' AS name, u, (w + 1) * {DAY} AS ts_ns, ROUND({sql}, 6) AS value FROM src GROUP BY u, w")(run)


_LAST, _FIRST = "arg_max(value, (ts_ns, dp_id))", "arg_min(value, (ts_ns, dp_id))"
for _f, _s in {"sum": "SUM(value)", "avg": "AVG(value)", "min": "MIN(value)", "max": "MAX(value)", "count": "COUNT(*)::DOUBLE", "last": _LAST, "increase": f"{_LAST} - {_FIRST}", "rate": f"({_LAST} - {_FIRST}) / 86400.0", "stddev": "STDDEV_POP(value)", "stdvar": "VAR_POP(value)"}.items():
    _one(f"agg_{_f}", _f, _s)


@Q("agg_quantiles", _IN + f""", g AS (SELECT u, w, quantile_cont(value, [0.5, 0.999]) AS qs FROM src GROUP BY u, w)
 SELECT 'out_p50' AS name, u, (w + 1) * {DAY} AS ts_ns, ROUND(qs[1], 6) AS value FROM g UNION ALL SELECT 'out_p99.9', u, (w + 1) * {DAY}, ROUND(qs[2], 6) FROM g""")
def agg_quantiles(spark, sf_dir):
    got = aggregate(_input(spark, sf_dir), _agg(["quantiles(0.5, 0.999)"]))
    return got.select("name", L.get(M(), "user").alias("u"), "ts_ns", F.round("value", 6).alias("value"))


@Q("agg_group_by", DP + f""", g AS (SELECT u, ts_ns // {HOUR} AS w, SUM(value) AS s, COUNT(*)::DOUBLE AS c FROM dp WHERE name IN ('click', 'purchase') GROUP BY 1, 2)
 SELECT 'rollup_sum' AS name, u, (w + 1) * {HOUR} AS ts_ns, ROUND(s, 6) AS value FROM g UNION ALL SELECT 'rollup_count', u, (w + 1) * {HOUR}, c FROM g""")
def agg_group_by(spark, sf_dir):
    r = rule({"name": "r", "action": "aggregate", "input": "(?:click|purchase)", "output": "rollup", "interval": "1h", "functions": ["sum", "count"], "group_by": ["user"]})
    return aggregate(_input(spark, sf_dir), r).select("name", L.get(M(), "user").alias("u"), "ts_ns", F.round("value", 6).alias("value"))


@Q("agg_drop_labels", _IN + f" SELECT k, (w + 1) * {DAY} AS ts_ns, ROUND(SUM(value), 6) AS value FROM src GROUP BY k, w")
def agg_drop_labels(spark, sf_dir):
    got = aggregate(_input(spark, sf_dir), _agg(["sum"], group_by=[], drop_labels=["user"]))
    return got.select(L.get(M(), "k").alias("k"), "ts_ns", F.round("value", 6).alias("value"))


@Q("agg_all_labels", _IN + f" SELECT u, k, (w + 1) * {DAY} AS ts_ns, ROUND(SUM(value), 6) AS value FROM src GROUP BY u, k, w")
def agg_all_labels(spark, sf_dir):
    got = aggregate(_input(spark, sf_dir), _agg(["sum"], group_by=[]))
    return got.select(L.get(M(), "user").alias("u"), L.get(M(), "k").alias("k"), "ts_ns", F.round("value", 6).alias("value"))


@Q("agg_naming", _IN + " SELECT unnest(['out_max', 'out_p25', 'out_p99.5', 'out_sum']) AS name, (SELECT COUNT(DISTINCT (u, w)) FROM src) AS n")
def agg_naming(spark, sf_dir):
    return aggregate(_input(spark, sf_dir), _agg(["sum", "max", "quantiles(0.25, 0.995)"])).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@Q("agg_keep_input", _IN + f" SELECT name, u, ts_ns, ROUND(value, 6) AS value FROM src UNION ALL SELECT 'out', u, (w + 1) * {DAY}, ROUND(SUM(value), 6) FROM src GROUP BY u, w")
def agg_keep_input(spark, sf_dir):
    p, cols = _input(spark, sf_dir), ["name", "labels", "ts_ns", "value"]
    both = p.select(*cols).unionByName(aggregate(p, _agg(["sum"], keep_input=True)).select(*cols))
    return both.select("name", L.get(M(), "user").alias("u"), "ts_ns", F.round("value", 6).alias("value"))


@Q("agg_reinject", DP + """, agg AS (SELECT u, ts_ns // 86400000000000 AS w, SUM(value) AS v FROM dp WHERE name = 'click' GROUP BY 1, 2), every AS (SELECT name, value FROM dp WHERE name NOT IN ('click', 'error') UNION ALL SELECT 'click_total', v FROM agg)
 SELECT name, COUNT(*) AS n, ROUND(SUM(value), 4) AS total FROM every GROUP BY 1""")
def agg_reinject(spark, sf_dir):
    """Outputs join after the processing stage: a later drop rule of processing doesn't see them."""
    p = event_points(spark, sf_dir)
    made = aggregate(p.where("name = 'click'"), rule({"name": "r", "action": "aggregate", "input": "click", "output": "click_total", "interval": "1d", "functions": ["sum"], "group_by": ["user"]}))
    left = p.where("name NOT IN ('click', 'error')").select("name", "value").unionByName(made.select("name", "value"))
    return left.groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))


@Q("agg_stale", DP + ", last AS (SELECT u, MAX(ts_ns) AS t FROM dp GROUP BY u) SELECT u FROM last WHERE t < (SELECT MAX(t) FROM last) - 86400000000000")
def agg_stale(spark, sf_dir):
    last = event_points(spark, sf_dir).groupBy(L.get(M(), "user").alias("u")).agg(F.max("ts_ns").alias("t"))
    return last.join(F.broadcast(last.agg(F.max("t").alias("now"))), F.col("t") < F.col("now") - DAY).select("u")


# -- downsampling ----------------------------------------------------------------------------------------


def _series(spark, sf_dir):
    """Series of name and service: datapoint labels go."""
    return event_points(spark, sf_dir).withColumn("labels", L.remove(M(), "user", "k"))


_KEY = "name || chr(31) || 'service.name=' || service || chr(31)"
for _m, _s in {"avg": "AVG(value)", "min": "MIN(value)", "max": "MAX(value)", "sum": "SUM(value)", "count": "COUNT(*)::DOUBLE", "last": _LAST, "first": _FIRST, "delta": f"{_LAST} - {_FIRST}"}.items():
    Q(f"ds_{_m}", DP + f"SELECT {_KEY} AS series, (ts_ns // {DAY} + 1) * {DAY} - 1 AS ts_ns, ROUND({_s}, 6) AS value FROM dp GROUP BY 1, 2")(
        lambda s, d, m=_m: D.windowed(_series(s, d), m, DAY).select("series", "ts_ns", F.round("value", 6).alias("value"))
    )

Q("ds_adaptive", DP + f""", r AS (SELECT {_KEY} AS series, ts_ns, value, ROW_NUMBER() OVER w AS n, AVG(value) OVER l AS m, STDDEV_POP(value) OVER l AS s FROM dp
 WINDOW w AS (PARTITION BY name, service ORDER BY ts_ns, dp_id), l AS (PARTITION BY name, service ORDER BY ts_ns, dp_id ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 c AS (SELECT *, CASE WHEN m = 0 THEN 0 ELSE s / ABS(m) END AS cv FROM r)
 SELECT series, ts_ns, value FROM c WHERE n % GREATEST(1, FLOOR(1.0::DOUBLE / CASE WHEN n < 2 OR cv >= 1 THEN 1.0::DOUBLE ELSE 0.1::DOUBLE + cv * (1.0::DOUBLE - 0.1::DOUBLE) END)::BIGINT) = 0""")(lambda s, d: D.adaptive(_series(s, d)))
Q("ds_lttb")(lambda s, d: D.lttb(_series(s, d), DAY, 4))
Q("ds_sdt")(lambda s, d: D.sdt(_series(s, d), 25.0))

# -- sampling --------------------------------------------------------------------------------------------

Q("smp_head", DP + "SELECT dp_id FROM (SELECT dp_id, ROW_NUMBER() OVER (ORDER BY ts_ns, dp_id) AS n FROM dp) WHERE n % 3 = 0")(lambda s, d: S.head(event_points(s, d), 0.3).select("dp_id"))
Q("smp_prob")(lambda s, d: S.probabilistic(event_points(s, d), 0.2).select("dp_id"))
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, strlen(s) + 1), lambda i: ascii(substr(s, i::INT, 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
Q("smp_hash", DP + f", k AS (SELECT dp_id, {_KEY} AS s FROM dp) SELECT dp_id FROM k WHERE {_FNV} % 10000 < 4000")(lambda s, d: S.by_series(_series(s, d), 0.4).select("dp_id"))
Q("smp_reservoir")(lambda s, d: S.reservoir(event_points(s, d), ["name"], 50).select("dp_id", "name"))

# -- statistics ------------------------------------------------------------------------------------------

_SER = "service || '|' || u || '|' || k"
Q("st_basic", DP + "SELECT name, COUNT(*) AS datapoints FROM dp GROUP BY 1")(lambda s, d: T.per_metric(event_points(s, d), False))
Q("st_full_metric", DP + f"SELECT name, COUNT(*) AS datapoints, COUNT(DISTINCT {_SER}) AS cardinality FROM dp GROUP BY 1")(lambda s, d: T.per_metric(event_points(s, d)))
Q("st_label", DP + f"SELECT 'service.name=' || service || ',k=' || k AS combination, COUNT(*) AS datapoints, COUNT(DISTINCT name || '|' || {_SER}) AS cardinality FROM dp GROUP BY 1")(lambda s, d: T.per_combination(event_points(s, d), ["service.name", "k"]))
Q("st_label_cap", DP + f"SELECT 'user=' || u AS combination, COUNT(*) AS datapoints, COUNT(DISTINCT name || '|' || {_SER}) AS cardinality FROM dp GROUP BY 1 ORDER BY MIN((ts_ns, dp_id)) LIMIT 20")(lambda s, d: T.per_combination(event_points(s, d), ["user"], 20))
Q("st_threshold", DP + f", b AS (SELECT name, batch_id, COUNT(*) AS n FROM dp GROUP BY 1, 2), f AS (SELECT name, arg_min(n, batch_id) AS b FROM b GROUP BY 1), m AS (SELECT name, COUNT(*) AS datapoints, COUNT(DISTINCT {_SER}) AS c FROM dp GROUP BY 1) SELECT name, datapoints, CASE WHEN b >= 20 THEN c END AS cardinality FROM m JOIN f USING (name)")(lambda s, d: T.with_threshold(event_points(s, d), 20))
Q("st_global", DP + f", m AS (SELECT name, COUNT(*) AS n, COUNT(DISTINCT {_SER}) AS c FROM dp GROUP BY 1) SELECT COUNT(*) AS metrics, SUM(n)::BIGINT AS datapoints, SUM(c)::BIGINT AS cardinality FROM m")(lambda s, d: T.totals(event_points(s, d)))
Q("st_reset", DP + f"SELECT ts_ns - ts_ns % 60000000000 AS window_ns, name, COUNT(*) AS datapoints, COUNT(DISTINCT {_SER}) AS cardinality FROM dp GROUP BY 1, 2")(lambda s, d: T.per_window(event_points(s, d), 60 * 10**9))
Q("st_counts", DP + "SELECT CASE WHEN dp_id % 4 = 0 THEN 'sum' ELSE 'gauge' END AS kind, COUNT(*) AS n FROM dp GROUP BY 1")(lambda s, d: event_points(s, d).groupBy(F.when(F.col("dp_id") % 4 == 0, "sum").otherwise("gauge").alias("kind")).agg(F.count(F.lit(1)).alias("n")))
Q("snk_metrics", DP + f", m AS (SELECT name, COUNT(*) AS n, COUNT(DISTINCT {_SER}) AS c FROM dp GROUP BY 1) SELECT 'datapoints_total' AS metric, name AS label, n::DOUBLE AS value FROM m UNION ALL SELECT 'cardinality', name, c::DOUBLE FROM m UNION ALL SELECT 'metrics_total', '', COUNT(*)::DOUBLE FROM m")(lambda s, d: T.exposition(event_points(s, d)))
Q("card_exact", DP + f"SELECT COUNT(DISTINCT name || '|' || {_SER}) AS cardinality FROM dp")(lambda s, d: event_points(s, d).agg(F.count_distinct("name", T.stat_series()).alias("cardinality")))
Q("card_bloom", DP + f", f AS (SELECT name, {_SER} AS s, MIN(batch_id) AS batch_id FROM dp GROUP BY 1, 2) SELECT name, batch_id, COUNT(*) AS new_series FROM f GROUP BY 1, 2")(lambda s, d: T.bloom_inserts(event_points(s, d)))
Q("card_hll")(lambda s, d: T.sketched(event_points(s, d)))
Q("card_hybrid")(lambda s, d: T.hybrid(event_points(s, d), 155))
Q("card_persist")(lambda s, d: T.merged(T.stored_sketches(event_points(s, d), DAY)))


@Q("rule_dead", DP + """, r(rule, pattern, loaded_ns) AS (VALUES ('a', 'click', 0::BIGINT), ('b', 'never', 0), ('c', 'error', 0), ('d', 'none', (SELECT MAX(ts_ns) FROM dp)))
 SELECT rule, MAX(dp.ts_ns) AS last_ns, (SELECT MAX(ts_ns) FROM dp) - COALESCE(MAX(dp.ts_ns), ANY_VALUE(loaded_ns)) > 3600000000000 AS dead FROM r LEFT JOIN dp ON dp.name = r.pattern GROUP BY rule""")
def rule_dead(spark, sf_dir):
    p = event_points(spark, sf_dir)
    now = p.agg(F.max("ts_ns")).first()[0]
    rules = spark.createDataFrame([("a", "click", 0), ("b", "never", 0), ("c", "error", 0), ("d", "none", now)], "rule string, pattern string, loaded_ns long")
    last = p.groupBy("name").agg(F.max("ts_ns").alias("ts_ns"))
    matched = rules.join(last, rules["pattern"] == last["name"]).select("rule", "ts_ns")
    return T.dead_rules(rules.select("rule", "loaded_ns"), matched, now, HOUR)


@Q("win_start", DP + "SELECT dp_id, ts_ns - ts_ns % 3600000000000 AS window_ns FROM dp")
def win_start(spark, sf_dir):
    return event_points(spark, sf_dir).select("dp_id", window_start(F.col("ts_ns"), HOUR).alias("window_ns"))
