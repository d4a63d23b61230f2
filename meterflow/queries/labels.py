"""Queries of predicates, label transforms, classification and relabelling over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterflow.functions import labels as L
from meterflow.functions.hashing import fnv1a32, fnv1a64, sha256_head
from meterflow.model import DP, event_points, table
from meterflow.plans.rules import matches, name_matches, route, rule
from meterflow.queries.registry import Registry
from meterflow.sources import sinks

Q = Registry()


def M():
    """The labels of a datapoint."""
    return F.col("labels")


def _where(name: str, cond, sql_cond: str) -> None:
    Q(name, DP + f"SELECT dp_id, name FROM dp WHERE {sql_cond}")(lambda s, d: event_points(s, d).where(cond()).select("dp_id", "name"))


_where("flt_name_regex", lambda: name_matches(F.col("name"), "(?:cl|vi).*"), "regexp_full_match(name, '(?:cl|vi).*')")
_where("flt_input_labels", lambda: matches(rule({"name": "r", "action": "drop", "input": ".*", "input_labels": {"user": "1[0-9]", "k": "[0-4].*"}}), F.col("name"), M()), "regexp_full_match(u, '1[0-9]') AND regexp_full_match(k, '[0-4].*')")
_where("flt_when_equals", lambda: L.conditions(M(), [{"label": "k", "equals": "7"}]), "k = '7'")
_where("flt_when_contains", lambda: L.conditions(M(), [{"label": "user", "contains": "3"}]), "contains(u, '3')")
_where("flt_when_matches", lambda: L.conditions(M(), [{"label": "user", "matches": "[1-3]."}]), "regexp_full_match(u, '[1-3].')")
_where("flt_when_not_matches", lambda: L.conditions(M(), [{"label": "user", "not_matches": "[1-3]."}, {"label": "none", "not_matches": "x+"}]), "NOT regexp_full_match(u, '[1-3].')")
_where("flt_drop", lambda: ~matches(rule({"name": "r", "action": "drop", "input": "click"}), F.col("name"), M()), "name <> 'click'")
_where("flt_relabel_keep", lambda: L.joined(M(), ["user", "k"]).rlike(L.full("1.*;.*5")), "regexp_full_match(u || ';' || k, '1.*;.*5')")
_where("flt_relabel_drop", lambda: ~L.joined(M(), ["user", "k"]).rlike(L.full("1.*;.*5")), "NOT regexp_full_match(u || ';' || k, '1.*;.*5')")
_where("flt_prw_match", lambda: F.col("name").rlike("i") & L.get(M(), "k").rlike("9"), "regexp_matches(name, 'i') AND regexp_matches(k, '9')")

RULES = (
    {"name": "tag", "action": "transform", "input": ".*", "when": [{"label": "user", "matches": "1.*"}], "operations": [{"set": {"label": "team", "value": "t-${k}"}}]},
    {"name": "noise", "action": "drop", "input": "error", "input_labels": {"k": "[0-4].*"}},
    {"name": "thin", "action": "sample", "input": "view", "rate": 0.25},
    {"name": "roll", "action": "aggregate", "input": "click", "interval": "1h", "output": "click", "functions": ["sum"]},
)


@Q("flt_multitouch", DP + """SELECT dp_id, name, COALESCE(CASE WHEN regexp_full_match(u, '1.*') THEN 't-' || k END, '') AS team,
 CASE WHEN name = 'error' AND regexp_full_match(k, '[0-4].*') THEN 'noise' WHEN name = 'view' THEN 'thin' WHEN name = 'click' THEN 'roll' END AS terminal_rule,
 CASE WHEN name = 'error' AND regexp_full_match(k, '[0-4].*') THEN 'drop' WHEN name = 'view' THEN 'sample' WHEN name = 'click' THEN 'aggregate' END AS terminal_action FROM dp""")
def flt_multitouch(spark, sf_dir):
    return route(event_points(spark, sf_dir), [rule(r) for r in RULES]).select("dp_id", "name", L.get(M(), "team").alias("team"), "terminal_rule", "terminal_action")


@Q("flt_generic", DP + "SELECT kind, terminal_rule, COUNT(*) AS n FROM (SELECT CASE WHEN dp_id % 3 = 0 THEN 'histogram' ELSE 'gauge' END AS kind, CASE WHEN name = 'error' AND regexp_full_match(k, '[0-4].*') THEN 'noise' WHEN name = 'view' THEN 'thin' WHEN name = 'click' AND dp_id % 3 <> 0 THEN 'roll' END AS terminal_rule FROM dp) GROUP BY 1, 2")
def flt_generic(spark, sf_dir):
    p = event_points(spark, sf_dir).withColumn("kind", F.when(F.col("dp_id") % 3 == 0, "histogram").otherwise("gauge"))
    return route(p, [rule(r) for r in RULES]).groupBy("kind", "terminal_rule").agg(F.count(F.lit(1)).alias("n"))


@Q("flt_prune", DP + "SELECT batch_id, COUNT(*) AS n FROM dp WHERE name = 'click' GROUP BY 1")
def flt_prune(spark, sf_dir):
    return event_points(spark, sf_dir).where("name = 'click'").groupBy("batch_id").agg(F.count(F.lit(1)).alias("n"))


@Q("st_rules", DP + """SELECT rule, action, COUNT(*) AS rows FROM (SELECT
 CASE WHEN name = 'error' AND regexp_full_match(k, '[0-4].*') THEN 'noise' WHEN name = 'view' THEN 'thin' WHEN name = 'click' THEN 'roll' ELSE '' END AS rule,
 CASE WHEN name = 'error' AND regexp_full_match(k, '[0-4].*') THEN 'drop' WHEN name = 'view' THEN 'sample' WHEN name = 'click' THEN 'aggregate' ELSE 'pass' END AS action FROM dp) GROUP BY 1, 2""")
def st_rules(spark, sf_dir):
    from meterflow.operators.stats import rule_counters

    return rule_counters(route(event_points(spark, sf_dir), [rule(r) for r in RULES]))


def _labels(name: str, edit, sql: str, **want: str) -> None:
    """A query of some labels after an edit; want maps output columns to labels."""

    def run(spark, sf_dir):
        out = event_points(spark, sf_dir).withColumn("labels", edit(M()))
        return out.select("dp_id", *[L.get(M(), label).alias(col) for col, label in want.items()], F.size(F.map_keys("labels")).cast("long").alias("n_labels"))

    Q(name, DP + f"SELECT dp_id, {sql} FROM dp")(run)


_labels("tf_remove", lambda m: L.remove(m, "k"), "'' AS a, u AS b, 1::BIGINT AS n_labels", a="k", b="user")
_labels("tf_set", lambda m: L.tf_set(m, "t", "u=${user}/${none}/${k}"), "'u=' || u || '//' || k AS a, 3::BIGINT AS n_labels", a="t")
_labels("tf_rename", lambda m: L.tf_rename(m, "k", "user"), "k AS a, '' AS b, 1::BIGINT AS n_labels", a="user", b="k")
_labels("tf_copy", lambda m: L.tf_copy(m, "k", "c"), "k AS a, (CASE WHEN k = '' THEN 2 ELSE 3 END)::BIGINT AS n_labels", a="c")
_labels("tf_replace", lambda m: L.tf_replace(m, "user", "([0-9])([0-9])", "${2}-$1"), "regexp_replace(u, '([0-9])([0-9])', '\\2-\\1', 'g') AS a, 2::BIGINT AS n_labels", a="user")
_labels("tf_extract", lambda m: L.tf_extract(m, "user", "d", "([0-9])[5-9]", 1), "CASE WHEN regexp_matches(u, '([0-9])[5-9]') THEN regexp_extract(u, '([0-9])[5-9]', 1) ELSE '' END AS a, (CASE WHEN regexp_matches(u, '([0-9])[5-9]') THEN 3 ELSE 2 END)::BIGINT AS n_labels", a="d")
_FNV32 = "list_reduce(list_prepend(2166136261::BIGINT, list_transform(range(1, strlen({0}) + 1), lambda i: ascii(substr({0}, i::INT, 1))::BIGINT)), lambda h, b: (xor(h, b) * 16777619) % 4294967296)"
_FNV64 = "list_reduce(list_prepend(14695981039346656037::UHUGEINT, list_transform(range(1, strlen({0}) + 1), lambda i: ascii(substr({0}, i::INT, 1))::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT)"
_labels("tf_hash_mod", lambda m: L.tf_hash_mod(m, "user", "h", 16), f"CAST({_FNV64.format('u')} % 16 AS VARCHAR) AS a, 3::BIGINT AS n_labels", a="h")
_labels("tf_lower", lambda m: L.tf_lower(L.tf_set(m, "x", "User-${user}"), "x"), "'user-' || u AS a, 3::BIGINT AS n_labels", a="x")
_labels("tf_upper", lambda m: L.tf_upper(L.tf_set(m, "x", "User-${user}"), "x"), "'USER-' || u AS a, 3::BIGINT AS n_labels", a="x")
_labels("tf_concat", lambda m: L.tf_concat(m, ["user", "none", "k"], "c", "/"), "u || '//' || k AS a, 3::BIGINT AS n_labels", a="c")
_labels("tf_map", lambda m: L.tf_map(m, "user", "tier", [("1.*", "gold"), ("[2-4].*", "silver")], "bronze"), "CASE WHEN regexp_full_match(u, '1.*') THEN 'gold' WHEN regexp_full_match(u, '[2-4].*') THEN 'silver' ELSE 'bronze' END AS a, 3::BIGINT AS n_labels", a="tier")
_labels("tf_math", lambda m: L.tf_math(L.tf_math(m, "k", "q", "div", 8), "user", "r", "mod", 7), "CAST(TRY_CAST(k AS DOUBLE) / 8 AS VARCHAR) AS a, CAST(CAST(u AS BIGINT) % 7 AS VARCHAR) AS b, 4::BIGINT AS n_labels".replace("CAST(TRY_CAST(k AS DOUBLE) / 8 AS VARCHAR)", "CASE WHEN CAST(k AS BIGINT) % 8 = 0 THEN CAST(CAST(k AS BIGINT) // 8 AS VARCHAR) ELSE CAST(CAST(k AS DOUBLE) / 8 AS VARCHAR) END"), a="q", b="r")
_labels(
    "cl_chain",
    lambda m: L.cl_chain(m, [([{"label": "user", "matches": "1.*"}], {"team": "one-${k}", "tier": "a"}), ([{"label": "k", "contains": "5"}], {"team": "five"})]),
    "CASE WHEN regexp_full_match(u, '1.*') THEN 'one-' || k WHEN contains(k, '5') THEN 'five' ELSE '' END AS a, CASE WHEN regexp_full_match(u, '1.*') THEN 'a' ELSE '' END AS b, (CASE WHEN regexp_full_match(u, '1.*') THEN 4 WHEN contains(k, '5') THEN 3 ELSE 2 END)::BIGINT AS n_labels",
    a="team", b="tier",
)
_labels("cl_mapping", lambda m: L.cl_mapping(m, ["user", "k"], "c", [("1.*:.*0", "x"), (".*:9.*", "y")]), "CASE WHEN regexp_full_match(u || ':' || k, '1.*:.*0') THEN 'x' WHEN regexp_full_match(u || ':' || k, '.*:9.*') THEN 'y' ELSE '' END AS a, (CASE WHEN regexp_full_match(u || ':' || k, '1.*:.*0|.*:9.*') THEN 3 ELSE 2 END)::BIGINT AS n_labels", a="c")
_labels("cl_remove_after", lambda m: L.remove(L.cl_chain(m, [([{"label": "k", "equals": "3"}], {"c": "three"})]), "k"), "CASE WHEN k = '3' THEN 'three' ELSE '' END AS a, (CASE WHEN k = '3' THEN 2 ELSE 1 END)::BIGINT AS n_labels", a="c")
_labels("rl_replace", lambda m: L.rl_replace(m, ["user", "k"], "p", "([0-9]+);([0-9]).*", "$2:${1}"), "CASE WHEN regexp_full_match(u || ';' || k, '([0-9]+);([0-9]).*') THEN regexp_replace(u || ';' || k, '^(?:([0-9]+);([0-9]).*)$', '\\2:\\1') ELSE '' END AS a, (CASE WHEN regexp_full_match(u || ';' || k, '([0-9]+);([0-9]).*') THEN 3 ELSE 2 END)::BIGINT AS n_labels", a="p")
_labels("rl_labelmap", lambda m: L.rl_labelmap(m, "(us)er", "x_$1"), "u AS a, u AS b, 3::BIGINT AS n_labels", a="x_us", b="user")
_labels("rl_labeldrop", lambda m: L.rl_labeldrop(m, "u.*"), "'' AS a, k AS b, 1::BIGINT AS n_labels", a="user", b="k")
_labels("rl_labelkeep", lambda m: L.rl_labelkeep(L.put(m, "__name__", F.col("name")), "u.*"), "name AS a, u AS b, '' AS c, 2::BIGINT AS n_labels", a="__name__", b="user", c="k")
_labels("snk_extra_labels", lambda m: F.map_concat(L.remove(m, "k", "env"), F.create_map(F.lit("k"), F.lit("0"), F.lit("env"), F.lit("prod"))), "'0' AS a, 'prod' AS b, 3::BIGINT AS n_labels", a="k", b="env")
_labels("prj_action_labels", lambda m: L.put(L.put(m, "action", F.lit("passed")), "rule", F.col("name")), "'passed' AS a, name AS b, 4::BIGINT AS n_labels", a="action", b="rule")


@Q("rl_hashmod", "SELECT p_partkey AS id, CAST(('0x' || substr(sha256(p_brand), 1, 16))::UBIGINT % 8 AS VARCHAR) AS a FROM part")
def rl_hashmod(spark, sf_dir):
    p = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.create_map(F.lit("brand"), F.col("p_brand")).alias("labels"))
    return p.select("id", L.get(L.rl_hashmod(M(), ["brand"], "h", 8), "h").alias("a"))


@Q("rl_name", DP + "SELECT dp_id, 'x_' || name AS name, u AS a FROM dp")
def rl_name(spark, sf_dir):
    p = event_points(spark, sf_dir).withColumn("labels", L.put(M(), "__name__", F.concat(F.lit("x_"), F.col("name"))))
    return p.select("dp_id", L.get(M(), "__name__").alias("name"), L.get(L.remove(M(), "__name__"), "user").alias("a"))


@Q("fn_fnv1a32", DP + f"SELECT DISTINCT u, {_FNV32.format('u')} AS h FROM dp")
def fn_fnv1a32(spark, sf_dir):
    return event_points(spark, sf_dir).select(L.get(M(), "user").alias("u")).distinct().select("u", fnv1a32(F.col("u")).alias("h"))


@Q("fn_fnv1a64", DP + f"SELECT DISTINCT u, CAST({_FNV64.format('u')} AS VARCHAR) AS h FROM dp")
def fn_fnv1a64(spark, sf_dir):
    return event_points(spark, sf_dir).select(L.get(M(), "user").alias("u")).distinct().select("u", fnv1a64(F.col("u")).cast("string").alias("h"))


@Q("fn_sha256_head", "SELECT n_name, CAST(('0x' || substr(sha256(n_name), 1, 16))::UBIGINT AS VARCHAR) AS h FROM nation")
def fn_sha256_head(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_name", sha256_head(F.col("n_name")).cast("string").alias("h"))


@Q("src_body_limit", "SELECT event_id FROM events WHERE strlen(props) <= 8")
def src_body_limit(spark, sf_dir):
    return table(spark, sf_dir, "events").where(F.octet_length("props") <= 8).select("event_id")


@Q("snk_version", DP + "SELECT dp_id, CASE WHEN dp_id % 5 = 0 OR dp_id % 7 = 0 THEN '2.0' ELSE '1.0' END AS version FROM dp")
def snk_version(spark, sf_dir):
    from meterflow.sources.remote_write import version

    return event_points(spark, sf_dir).select("dp_id", version((F.col("dp_id") % 5 == 0).cast("int"), (F.col("dp_id") % 7 == 0).cast("int")).alias("version"))


@Q("snk_labels_kept", DP + "SELECT dp_id, 'eu' AS region, u FROM dp")
def snk_labels_kept(spark, sf_dir):
    return sinks.extra_labels(event_points(spark, sf_dir), {"region": "eu"}).select("dp_id", L.get(M(), "region").alias("region"), L.get(M(), "user").alias("u"))
