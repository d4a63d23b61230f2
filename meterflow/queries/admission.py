"""Queries of limits, quotas, tenants, lookups and set operations over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterflow.functions import labels as L
from meterflow.model import DAY, DP, event_points, table, window_start
from meterflow.operators import limits as A
from meterflow.operators import tenant as T
from meterflow.operators.sli import glob
from meterflow.queries.registry import Registry

Q = Registry()


def M():
    """The labels of a datapoint."""
    return F.col("labels")


_KEYS = "service || '|' || CASE WHEN k <> '' THEN k ELSE '' END || '|' || u"


def _limit(**more) -> A.Limit:
    return A.Limit(**({"name": "lim", "window_ns": DAY} | more))


Q("flt_limit_match", DP + "SELECT dp_id, CASE WHEN regexp_matches(name, 'ick') AND service = 'svc-1' THEN 'a' WHEN name = 'view' THEN 'b' WHEN regexp_matches(name, 'e.*') THEN 'c' END AS rule FROM dp")(
    lambda s, d: event_points(s, d).select("dp_id", A.match_limit(F.col("name"), F.col("resource"), [A.Limit("a", "ick.*", (("service.name", "svc-1"),)), A.Limit("b", "view", (("service.name", "*"),)), A.Limit("c", "e.*")]).alias("rule"))
)
Q("lim_rate", DP + f"SELECT dp_id, ROW_NUMBER() OVER (PARTITION BY ts_ns // {DAY} ORDER BY ts_ns, dp_id) <= 100 AS within FROM dp")(lambda s, d: A.admit(event_points(s, d), _limit(max_rate=100)).select("dp_id", "within"))
_CARD = f""", s AS (SELECT dp_id, ts_ns, ts_ns // {DAY} AS w, name || '#' || {_KEYS} AS s FROM dp), f AS (SELECT w, s, MIN((ts_ns, dp_id)) AS f FROM s GROUP BY 1, 2),
 r AS (SELECT w, s, ROW_NUMBER() OVER (PARTITION BY w ORDER BY f) AS rank FROM f)"""
Q("lim_card", DP + _CARD + " SELECT dp_id, rank <= 60 AS within FROM s JOIN r USING (w, s)")(lambda s, d: A.admit(event_points(s, d), _limit(max_cardinality=60)).select("dp_id", "within"))
_BOTH = _CARD + ", b AS (SELECT dp_id, w, ts_ns, rank <= 200 AS c FROM s JOIN r USING (w, s)), n AS (SELECT *, SUM(c::INT) OVER (PARTITION BY w ORDER BY ts_ns, dp_id) AS nth FROM b), v AS (SELECT dp_id, CASE WHEN NOT c THEN 'cardinality' WHEN nth > 150 THEN 'rate' ELSE '' END AS reason FROM n)"
Q("lim_both", DP + _BOTH + " SELECT dp_id, reason FROM v")(lambda s, d: A.admit(event_points(s, d), _limit(max_cardinality=200, max_rate=150)).select("dp_id", "reason"))
Q("lim_window_reset", DP + f"SELECT ts_ns - ts_ns % {DAY} AS w, LEAST(COUNT(*), 100) AS admitted FROM dp GROUP BY 1")(lambda s, d: A.admit(event_points(s, d), _limit(max_rate=100)).where("within").groupBy(F.col("_w").alias("w")).agg(F.count(F.lit(1)).alias("admitted")))


def _acted(limit: A.Limit, dry_run: bool = False):
    def run(spark, sf_dir):
        got = A.act(A.admit(event_points(spark, sf_dir), limit), limit, dry_run)
        return got.select("dp_id", L.get(M(), "action").alias("action"), L.get(M(), "rule").alias("rule"), L.get(M(), "k").alias("k"))

    return run


_IN = DP + f", v AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ts_ns // {DAY} ORDER BY ts_ns, dp_id) <= 100 AS ok FROM dp) SELECT dp_id, "
Q("lim_log", _IN + "CASE WHEN ok THEN 'passed' ELSE 'log' END AS action, 'lim' AS rule, k FROM v")(_acted(_limit(max_rate=100, action="log")))
Q("lim_drop", _IN + "'passed' AS action, 'lim' AS rule, k FROM v WHERE ok")(_acted(_limit(max_rate=100, action="drop")))
Q("prj_dry_run", _IN + "CASE WHEN ok THEN 'passed' ELSE 'drop' END AS action, 'lim' AS rule, k FROM v")(_acted(_limit(max_rate=100, action="drop"), True))
Q("lim_strip", _IN + "CASE WHEN ok THEN 'passed' ELSE 'stripped' END AS action, 'lim' AS rule, CASE WHEN ok THEN k ELSE '' END AS k FROM v")(_acted(_limit(max_rate=100, action="strip", strip=("k",))))
_FNV = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, strlen(s) + 1), lambda i: ascii(substr(s, i::INT, 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
_SKEY = "'k=' || k || '|service.name=' || service || '|user=' || u"
Q("lim_sample", DP + f", v AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ts_ns // {DAY} ORDER BY ts_ns, dp_id) <= 100 AS ok, {_SKEY} AS s FROM dp) SELECT dp_id, CASE WHEN ok THEN 'passed' ELSE 'sampled_keep' END AS action, 'lim' AS rule, k FROM v WHERE ok OR {_FNV} % 10000 < 2500")(_acted(_limit(max_rate=100, action="sample", options={"rate": 0.25})))
_GRP = f", g AS (SELECT ts_ns - ts_ns % {DAY} AS w, 'user=' || u AS g, COUNT(*) AS n FROM dp GROUP BY 1, 2), o AS (SELECT *, COALESCE(SUM(n) OVER (PARTITION BY w ORDER BY n DESC, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, SUM(n) OVER (PARTITION BY w) - 250 AS x FROM g), dropped AS (SELECT w, g FROM o WHERE x > 0 AND before < x)"
Q("lim_adaptive", DP + _GRP + f" SELECT dp_id FROM dp WHERE NOT EXISTS (SELECT 1 FROM dropped WHERE dropped.w = ts_ns - ts_ns % {DAY} AND dropped.g = 'user=' || u)")(lambda s, d: A.adaptive(event_points(s, d), _limit(max_rate=250, group_by=("user",))).select("dp_id"))
Q("lim_adaptive_card", DP + f", g AS (SELECT ts_ns - ts_ns % {DAY} AS w, name AS g, COUNT(DISTINCT {_SKEY}) AS n FROM dp GROUP BY 1, 2), o AS (SELECT *, COALESCE(SUM(n) OVER (PARTITION BY w ORDER BY n DESC, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, SUM(n) OVER (PARTITION BY w) - 200 AS x FROM g) SELECT w, g, n AS contribution FROM o WHERE x > 0 AND before < x")(
    lambda s, d: A.dropped_groups(event_points(s, d), _limit(max_cardinality=200), "cardinality").select(F.col("_w").alias("w"), F.col("_g").alias("g"), "contribution")
)
Q(
    "lim_priority",
    DP + f", g AS (SELECT ts_ns - ts_ns % {DAY} AS w, 'service.name=' || service AS g, CASE service WHEN 'svc-3' THEN 2 WHEN 'svc-5' THEN 1 ELSE 0 END AS p, COUNT(*) AS n FROM dp GROUP BY 1, 2, 3), o AS (SELECT *, COALESCE(SUM(n) OVER (PARTITION BY w ORDER BY p, n DESC, g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, SUM(n) OVER (PARTITION BY w) - 120 AS x FROM g) SELECT w, g, n AS contribution FROM o WHERE x > 0 AND before < x",
)(lambda s, d: A.dropped_groups(event_points(s, d), _limit(max_rate=120, group_by=("service.name",), priority_label="service.name", priority_order=("svc-3", "svc-5"))).select(F.col("_w").alias("w"), F.col("_g").alias("g"), "contribution"))
Q("lim_hll_sample", DP + f", s AS (SELECT dp_id, ts_ns // {DAY} AS w, {_SKEY} AS s FROM dp), n AS (SELECT w, COUNT(DISTINCT s) AS n FROM s GROUP BY 1) SELECT dp_id FROM s JOIN n USING (w) WHERE {_FNV} % 10000 < FLOOR(LEAST(1.0::DOUBLE, 100.0::DOUBLE / n) * 10000)")(lambda s, d: A.hll_rate(event_points(s, d), _limit(max_cardinality=100)).select("dp_id"))
Q("lim_tiers", DP + f", g AS (SELECT ts_ns - ts_ns % {DAY} AS w, COUNT(*) / 400.0::DOUBLE AS used FROM dp GROUP BY 1) SELECT w, CASE WHEN used * 100 >= 95 THEN 'drop' WHEN used * 100 >= 80 THEN 'sample' ELSE 'log' END AS action FROM g")(
    lambda s, d: event_points(s, d).groupBy(window_start(F.col("ts_ns"), DAY).alias("w")).agg((F.count(F.lit(1)) / F.lit(400.0)).alias("used")).select("w", A.tiered("log", ((80, "sample"), (95, "drop")), F.col("used")).alias("action"))
)
_CAP = f", f AS (SELECT ts_ns // {DAY} AS w, u, MIN((ts_ns, dp_id)) AS f FROM dp GROUP BY 1, 2), r AS (SELECT w, u, ROW_NUMBER() OVER (PARTITION BY w ORDER BY f) AS rank FROM f)"
Q("lim_label", DP + _CAP + f" SELECT dp_id, CASE WHEN rank > 40 THEN '' ELSE dp.u END AS u FROM dp JOIN r ON r.w = ts_ns // {DAY} AND r.u = dp.u")(lambda s, d: A.cap_label(event_points(s, d), _limit(), "user", 40).select("dp_id", L.get(M(), "user").alias("u")))
Q("lim_label_drop", DP + _CAP + f" SELECT dp_id FROM dp JOIN r ON r.w = ts_ns // {DAY} AND r.u = dp.u WHERE rank <= 40")(lambda s, d: A.cap_label(event_points(s, d), _limit(), "user", 40, True).select("dp_id"))
Q("lim_group_cap", DP + _CAP + f" SELECT dp_id, rank <= 25 AS tracked FROM dp JOIN r ON r.w = ts_ns // {DAY} AND r.u = dp.u")(lambda s, d: A.cap_groups(event_points(s, d), _limit(), "user", 25).select("dp_id", "tracked"))
Q(
    "lim_act_tiers",
    DP + f", k AS (SELECT *, ts_ns // {DAY} AS w, COUNT(*) OVER (PARTITION BY ts_ns // {DAY}) / 250.0::DOUBLE AS used, ROW_NUMBER() OVER (PARTITION BY ts_ns // {DAY} ORDER BY ts_ns, dp_id) AS nth FROM dp) SELECT dp_id, CASE WHEN nth <= 250 THEN 'passed' WHEN used * 100 >= 130 THEN 'drop' ELSE 'log' END AS action FROM k WHERE nth <= 250 OR used * 100 < 130",
)(lambda s, d: (lambda l: A.act(A.admit(event_points(s, d), l), l).select("dp_id", L.get(M(), "action").alias("action")))(_limit(max_rate=250, action="log", tiers=((130, "drop"),))))
Q(
    "lim_act_adaptive",
    DP + f", g AS (SELECT ts_ns // {DAY} AS w, service, COUNT(*) AS n FROM dp GROUP BY 1, 2), o AS (SELECT *, COALESCE(SUM(n) OVER (PARTITION BY w ORDER BY n DESC, service ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, SUM(n) OVER (PARTITION BY w) - 120 AS x FROM g) SELECT dp_id FROM dp JOIN o ON o.w = ts_ns // {DAY} AND o.service = dp.service WHERE NOT (x > 0 AND before < x)",
)(lambda s, d: (lambda l: A.act(A.admit(event_points(s, d), l), l).select("dp_id"))(_limit(max_rate=120, group_by=("service.name",), action="adaptive")))
Q("lim_greedy")(lambda s, d: A.admit_metrics(event_points(s, d).withColumn("metric_id", F.col("rm_id")), _limit(max_rate=150)))
Q("prw_rate")(lambda s, d: A.prw_rate(event_points(s, d).select("dp_id", (F.col("ts_ns") % 10**10).alias("ts_ns"), "name", (F.col("dp_id") % 3 + 1).alias("n")), [A.Limit("a", "i", max_rate=400), A.Limit("b", "view", max_rate=100)]))
Q("prw_card", DP + ", f AS (SELECT name || '|' || u || '|' || k AS s, MIN((ts_ns, dp_id)) AS f FROM dp GROUP BY 1), r AS (SELECT s FROM f QUALIFY ROW_NUMBER() OVER (ORDER BY f) <= 500) SELECT dp_id FROM dp WHERE name || '|' || u || '|' || k IN (SELECT s FROM r)")(lambda s, d: A.prw_cardinality(event_points(s, d), 500).select("dp_id"))

# -- tenants ---------------------------------------------------------------------------------------------


def _tenants(spark, sf_dir):
    return T.detect(event_points(spark, sf_dir), "attribute", "service.name")


Q("ten_detect", DP + "SELECT dp_id, COALESCE(header_tenant, 'default') AS header, service AS attribute FROM dp")(
    lambda s, d: T.detect(T.detect(event_points(s, d), "header").withColumnRenamed("tenant", "header"), "attribute", "service.name").select("dp_id", "header", F.col("tenant").alias("attribute"))
)
Q("ten_detect_label", DP + ", f AS (SELECT rm_id, arg_min(u, dp_id) AS t FROM dp WHERE u <> '' GROUP BY 1) SELECT dp_id, COALESCE(t, 'default') AS tenant FROM dp LEFT JOIN f USING (rm_id)")(lambda s, d: T.detect(event_points(s, d), "label", "user").select("dp_id", "tenant"))
Q("ten_inject", DP + "SELECT dp_id, service AS t, u FROM dp")(lambda s, d: T.inject(_tenants(s, d)).select("dp_id", L.get(M(), "tenant").alias("t"), L.get(M(), "user").alias("u")))
Q("ten_strip", DP + "SELECT dp_id, '' AS u, k FROM dp")(lambda s, d: T.strip(event_points(s, d), "user").select("dp_id", L.get(M(), "user").alias("u"), L.get(M(), "k").alias("k")))
Q("ten_bucket", DP + "SELECT service AS tenant, COUNT(DISTINCT rm_id) AS resources, COUNT(*) AS datapoints FROM dp GROUP BY 1")(lambda s, d: _tenants(s, d).groupBy("tenant").agg(F.count_distinct("rm_id").alias("resources"), F.count(F.lit(1)).alias("datapoints")))
Q("quota_lookup", DP + "SELECT service AS tenant, CASE service WHEN 'svc-1' THEN 10 WHEN 'svc-2' THEN 20 ELSE 1000 END::BIGINT AS max_datapoints, COUNT(*) AS n FROM dp GROUP BY 1, 2")(
    lambda s, d: T.quota_table(_tenants(s, d), s.createDataFrame([("svc-1", 10), ("svc-2", 20)], "tenant string, max_datapoints long"), 1000).groupBy("tenant", "max_datapoints").agg(F.count(F.lit(1)).alias("n"))
)
Q("quota_global")(lambda s, d: T.quota(T.batches(_tenants(s, d), DAY, True), 250, 200, "adaptive", None, {"svc-0", "svc-4"}))
Q("quota_tenant")(lambda s, d: T.quota(T.batches(_tenants(s, d), DAY), 40, 0, "drop", ["tenant"]))
Q("quota_prefix", DP + f", rm AS (SELECT service AS tenant, rm_id, MIN(ts_ns) AS t, COUNT(*) AS n FROM dp GROUP BY 1, 2), r AS (SELECT tenant, t - t % {DAY} AS w, rm_id, n, SUM(n) OVER (PARTITION BY tenant, t // {DAY} ORDER BY t, rm_id ROWS UNBOUNDED PRECEDING) AS c FROM rm) SELECT tenant, w, rm_id, n FROM r WHERE c <= 30")(lambda s, d: T.quota_prefix(_tenants(s, d), 30, DAY))
Q("quota_newseries", DP + ", s AS (SELECT service AS tenant, batch_id, name || '{' || u || '|' || k AS s FROM dp) SELECT tenant, COUNT(DISTINCT s) AS new_series FROM s WHERE batch_id = 40 AND NOT EXISTS (SELECT 1 FROM s AS o WHERE o.batch_id < 40 AND o.tenant = s.tenant AND o.s = s.s) GROUP BY 1")(lambda s, d: T.new_series(_tenants(s, d), 40))

# -- lookups and sets --------------------------------------------------------------------------------------


@Q("join_rule_match", DP + ", r(i, pattern, rule) AS (VALUES (1, 'cl.*', 'a'), (2, '.*i.*', 'b'), (3, '.*', 'c')), n AS (SELECT DISTINCT name FROM dp) SELECT name, arg_min(rule, i) AS rule FROM n JOIN r ON regexp_full_match(name, pattern) GROUP BY 1")
def join_rule_match(spark, sf_dir):
    """Distinct names meet the rule table once; the first rule that matches stays."""
    rules = spark.createDataFrame([(1, "cl.*", "a"), (2, ".*i.*", "b"), (3, ".*", "c")], "i int, pattern string, rule string")
    names = event_points(spark, sf_dir).select("name").distinct()
    return names.join(F.broadcast(rules), F.expr("name RLIKE concat('^(?:', pattern, ')$')")).groupBy("name").agg(F.min_by("rule", "i").alias("rule"))


Q("join_glob", "SELECT n_name FROM nation WHERE regexp_full_match(n_name, 'NATION_1[^/]*') OR regexp_full_match(n_name, '[A-I][^/]*[AN]')")(lambda s, d: table(s, d, "nation").where(F.col("n_name").rlike(glob("NATION_1*")) | F.col("n_name").rlike(glob("[A-I]*[AN]"))).select("n_name"))
Q("join_metadata", "SELECT c_custkey, n_name FROM customer LEFT JOIN nation ON c_nationkey = n_nationkey")(lambda s, d: table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"), "left").select("c_custkey", "n_name"))
Q("join_drop_groups", DP + ", g AS (SELECT u FROM dp GROUP BY 1 HAVING COUNT(*) > 70) SELECT dp_id FROM dp WHERE u NOT IN (SELECT u FROM g)")(
    lambda s, d: (lambda p: p.join(p.groupBy("u").agg(F.count(F.lit(1)).alias("c")).where("c > 70"), "u", "left_anti").select("dp_id"))(event_points(s, d).withColumn("u", L.get(M(), "user")))
)
Q("set_union_last", DP + ", m AS (SELECT name, arg_max(u, (ts_ns, dp_id)) AS u FROM dp GROUP BY 1) SELECT name, u FROM m")(lambda s, d: event_points(s, d).groupBy("name").agg(F.max_by(L.get(M(), "user"), F.struct("ts_ns", "dp_id")).alias("u")))
