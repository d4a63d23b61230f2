"""Queries of service levels, token usage, exchange, batching, controllers, sources and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from meterflow.functions import labels as L
from meterflow.model import DAY, DP, event_points, table
from meterflow.operators import control as C
from meterflow.operators import exchange as X
from meterflow.operators import limits as A
from meterflow.operators import sli as S
from meterflow.operators import tenant as T
from meterflow.operators.stats import per_metric
from meterflow.plans.rules import load, route
from meterflow.queries.registry import Registry
from meterflow.sources import otlp, otlp_proto, remote_write

Q = Registry()


def M():
    """The labels of a datapoint."""
    return F.col("labels")


# -- service levels: cumulative counters by half-hour slot of events, by service ---------------------------

_SLOTS = DP + """, c AS (SELECT service, ts_ns // 1800000000000 AS slot, COUNT(*) AS r, COUNT(*) FILTER (name <> 'error') AS s, COUNT(*) FILTER (k = '0') AS dr, COUNT(*) FILTER (name <> 'view') AS b, COUNT(*) FILTER (name = 'view') AS e FROM dp GROUP BY 1, 2),
 t AS (SELECT service, slot, SUM(r) OVER w AS received, SUM(s) OVER w AS sent, SUM(dr) OVER w AS drops, SUM(b) OVER w AS batches, SUM(e) OVER w AS errors FROM c WINDOW w AS (PARTITION BY service ORDER BY slot)),
 d AS (SELECT *, received - COALESCE(LAG(received, 9) OVER w, FIRST(received) OVER w) AS r10, sent - COALESCE(LAG(sent, 9) OVER w, FIRST(sent) OVER w) AS s10, drops - COALESCE(LAG(drops, 9) OVER w, FIRST(drops) OVER w) AS d10,
 batches - COALESCE(LAG(batches, 9) OVER w, FIRST(batches) OVER w) AS b10, errors - COALESCE(LAG(errors, 9) OVER w, FIRST(errors) OVER w) AS e10 FROM t WINDOW w AS (PARTITION BY service ORDER BY slot)),
 x AS (SELECT service, slot, CASE WHEN r10 - d10 <= 0 THEN 1.0::DOUBLE ELSE GREATEST(0, LEAST(1, s10::DOUBLE / (r10 - d10)))::DOUBLE END AS delivery, CASE WHEN b10 + e10 <= 0 THEN 1.0::DOUBLE ELSE b10::DOUBLE / (b10 + e10) END AS export FROM d)
"""


def _slots(spark, sf_dir):
    from pyspark.sql import Window

    one = lambda c: F.sum(F.when(c, 1).otherwise(0))
    p = event_points(spark, sf_dir).withColumn("service", L.get(F.col("resource"), "service.name")).withColumn("slot", F.expr("ts_ns div 1800000000000"))
    c = p.groupBy("service", "slot").agg(F.count(F.lit(1)).alias("received"), one(F.col("name") != "error").alias("sent"), one(L.get(M(), "k") == "0").alias("drops"), one(F.col("name") != "view").alias("batches"), one(F.col("name") == "view").alias("errors"))
    w = Window.partitionBy("service").orderBy("slot")
    return c.withColumns({k: F.sum(k).over(w) for k in ("received", "sent", "drops", "batches", "errors")})


def _ratios(spark, sf_dir):
    return _slots(spark, sf_dir).select("service", "slot", S.delivery(10, ["service"]).alias("delivery"), S.export(10, ["service"]).alias("export"))


Q("sli_delivery", _SLOTS + "SELECT service, slot, ROUND(delivery, 9) AS ratio FROM x")(lambda s, d: _ratios(s, d).select("service", "slot", F.round("delivery", 9).alias("ratio")))
Q("sli_export", _SLOTS + "SELECT service, slot, ROUND(export, 9) AS ratio FROM x")(lambda s, d: _ratios(s, d).select("service", "slot", F.round("export", 9).alias("ratio")))
Q("sli_burn", _SLOTS + "SELECT service, slot, ROUND((1 - delivery) / (1 - 0.999::DOUBLE), 5) AS burn FROM x")(lambda s, d: _ratios(s, d).select("service", "slot", F.round(S.burn(F.col("delivery"), 0.999), 5).alias("burn")))
Q("sli_budget", _SLOTS + "SELECT service, slot, ROUND(GREATEST(0, LEAST(1, 1 - (1 - export) / (1 - 0.5::DOUBLE)))::DOUBLE, 9) AS budget FROM x")(lambda s, d: _ratios(s, d).select("service", "slot", F.round(S.budget(F.col("export"), 0.5, F.lit(3600)), 9).alias("budget")))
Q("sli_promql", _SLOTS + ", p AS (SELECT service, slot, (MAX(sent) OVER w - MIN(sent) OVER w)::DOUBLE / GREATEST(MAX(received) OVER w - MIN(received) OVER w, 1) AS ratio FROM t WINDOW w AS (PARTITION BY service ORDER BY slot RANGE BETWEEN 12 PRECEDING AND CURRENT ROW)) SELECT service, slot, ROUND(ratio, 9) AS ratio FROM p")(
    lambda s, d: S.windowed_ratio(_slots(s, d), "sent", "received", 12, ["service"], "slot").select("service", "slot", F.round("ratio", 9).alias("ratio"))
)
Q("sli_alerts", _SLOTS + ", b AS (SELECT service, slot, (1 - delivery) / 0.1::DOUBLE AS b1, (1 - export) / 0.1::DOUBLE AS b2 FROM x) SELECT service, slot, CASE WHEN b1 > 2.5 AND b2 > 2.5 THEN 'page' ELSE 'ticket' END AS severity FROM b WHERE b1 > 1.5 AND b2 > 1.5")(
    lambda s, d: S.alerts(_ratios(s, d).select("service", "slot", ((1 - F.col("delivery")) / F.lit(0.1)).alias("burn_1h"), ((1 - F.col("export")) / F.lit(0.1)).alias("burn_5m")), [("1h", "5m", 2.5, "page"), ("1h", "5m", 1.5, "ticket")]).select("service", "slot", "severity")
)
Q("health_score", "SELECT event_id, ROUND(GREATEST(0, LEAST(1, LEAST(1, value / 500) * 0.35 + (user_id % 10) / 10.0 * 0.30 + LEAST(1, value * 10 / 2000) * 0.20 + CASE WHEN event_type = 'error' THEN 0.15 ELSE 0 END))::DOUBLE, 6) AS score FROM events")(
    lambda s, d: table(s, d, "events").select("event_id", F.round(S.health(S.clamp01(F.col("value") / 500), (F.col("user_id") % 10) / 10.0, F.col("value") * 10, F.col("event_type") == "error"), 6).alias("score"))
)


# -- token usage of conversations --------------------------------------------------------------------------


def _usage(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    kind = F.when(F.col("role") == "assistant", "output").otherwise(F.col("role"))
    return c.select(F.concat(F.lit("p"), (F.col("conv_id") % 3).cast("string")).alias("provider"), F.concat(F.lit("m/"), (F.col("conv_id") % 8).cast("string")).alias("model"), kind.alias("type"), F.coalesce(F.length("text"), F.lit(0)).cast("double").alias("value"), (F.col("conv_id") * 1000 + F.col("turn")).alias("ts_ns"))


_USE = """WITH u AS (SELECT 'p' || (conv_id % 3) AS provider, 'm/' || (conv_id % 8) AS model, role, LENGTH(text) AS n FROM conversations WHERE LENGTH(text) > 0),
 t AS (SELECT provider, model, COALESCE(SUM(n) FILTER (role <> 'assistant'), 0)::BIGINT AS input, COALESCE(SUM(n) FILTER (role = 'assistant'), 0)::BIGINT AS output FROM u GROUP BY 1, 2)
"""
Q("llm_tokens", _USE + "SELECT provider, model, input, output FROM t")(lambda s, d: S.tokens(_usage(s, d)))
Q("llm_budget", _USE + "SELECT provider, model, CASE WHEN regexp_full_match(model, 'm/[1-3]') THEN 'low' ELSE 'rest' END AS rule, ROUND(GREATEST(0, LEAST(1, 1 - (input + output) / (CASE WHEN regexp_full_match(model, 'm/[1-3]') THEN 5000.0::DOUBLE ELSE 20000.0::DOUBLE END)))::DOUBLE, 9) AS remaining FROM t")(
    lambda s, d: S.token_budgets(S.tokens(_usage(s, d)), [("low", "m/[1-3]", 5000), ("none", "*", 1), ("rest", "m/*", 20000)]).select("provider", "model", "rule", F.round("remaining", 9).alias("remaining"))
)


@Q("llm_rate", "WITH c AS (SELECT 'm/' || (conv_id % 8) AS model, conv_id // 8 AS slot, SUM(LENGTH(text)) AS n FROM conversations GROUP BY 1, 2), t AS (SELECT model, slot, SUM(n) OVER (PARTITION BY model ORDER BY slot) AS total FROM c), r AS (SELECT model, slot, total, COALESCE(LAG(total, 3) OVER w, FIRST(total) OVER w) AS o, COALESCE(LAG(slot, 3) OVER w, FIRST(slot) OVER w) AS os FROM t WINDOW w AS (PARTITION BY model ORDER BY slot)) SELECT model, slot, ROUND(CASE WHEN slot > os THEN (total - o)::DOUBLE / ((slot - os) * 30) ELSE 0 END, 9) AS rate FROM r")
def llm_rate(spark, sf_dir):
    from pyspark.sql import Window

    c = table(spark, sf_dir, "conversations").groupBy(F.concat(F.lit("m/"), (F.col("conv_id") % 8).cast("string")).alias("model"), F.expr("conv_id div 8").alias("slot")).agg(F.sum(F.length("text")).alias("n"))
    t = c.withColumn("total", F.sum("n").over(Window.partitionBy("model").orderBy("slot")))
    return S.token_rate(t, 3, 30).select("model", "slot", F.round("rate", 9).alias("rate"))


# -- exchange and batches ------------------------------------------------------------------------------------

Q("ex_shardkey", DP + "SELECT dp_id, name || CASE WHEN k <> '' THEN '|k=' || k ELSE '' END || '|service.name=' || service AS shard_key FROM dp")(lambda s, d: event_points(s, d).select("dp_id", X.shard_key(["service.name", "none", "k"]).alias("shard_key")))
_RING = X.Ring([f"endpoint-{i}" for i in range(3)])
Q("ex_ring")(lambda s, d: X.with_owner(event_points(s, d), ["user"], _RING).groupBy("shard_key", "endpoint").agg(F.count(F.lit(1)).alias("n")))
Q("ex_split")(lambda s, d: X.with_owner(event_points(s, d), ["user", "k"], _RING).select("dp_id", "batch_id", "endpoint"))
_SHARD = "name || CASE WHEN u <> '' THEN '|user=' || u ELSE '' END"
Q("ex_prw_split", DP + f"SELECT 'series' AS part, {_SHARD} AS what, COUNT(*) AS n, 1::BIGINT AS endpoints FROM dp GROUP BY 1, 2 UNION ALL SELECT 'metadata', name, COUNT(*), 3 FROM dp GROUP BY 1, 2")(
    lambda s, d: X.split_request(event_points(s, d), ["user"], _RING).groupBy("part", "what").agg(F.count_distinct("dp_id").alias("n"), F.count_distinct("endpoint").alias("endpoints"))
)
Q("snk_sharded", DP + f"SELECT {_SHARD} AS shard_key, COUNT(*) AS n, 1::BIGINT AS endpoints FROM dp GROUP BY 1")(lambda s, d: X.with_owner(event_points(s, d), ["user"], _RING).groupBy("shard_key").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("endpoint").alias("endpoints")))
Q("bt_count", DP + "SELECT dp_id, ((ROW_NUMBER() OVER (ORDER BY ts_ns, dp_id) - 1) // 512)::BIGINT AS batch FROM dp")(lambda s, d: X.by_count(event_points(s, d), 512, ["ts_ns", "dp_id"]).select("dp_id", "batch"))
Q("bt_bytes")(lambda s, d: X.by_bytes(event_points(s, d).withColumn("bytes", F.octet_length(L.canonical(M())) + 16), "batch_id", "dp_id", "bytes", 600))
Q("bt_capacity", DP + ", b AS (SELECT *, LENGTH(u) + LENGTH(k) AS bytes FROM dp), r AS (SELECT *, SUM(bytes) OVER (PARTITION BY service ORDER BY ts_ns DESC, dp_id DESC ROWS UNBOUNDED PRECEDING) AS c FROM b) SELECT dp_id FROM r WHERE c <= 900")(
    lambda s, d: X.newest_within(event_points(s, d).withColumn("service", L.get(F.col("resource"), "service.name")).withColumn("bytes", F.octet_length(L.get(M(), "user")) + F.octet_length(L.get(M(), "k"))), ["service"], ["ts_ns", "dp_id"], "bytes", 900).select("dp_id")
)
Q("bt_prw", DP + ", b AS (SELECT name AS family, MIN((dp_id // 512)) AS batch FROM dp GROUP BY 1) SELECT family, batch, 'help ' || family AS help FROM b")(
    lambda s, d: X.with_metadata_first(event_points(s, d).select(F.col("name").alias("family"), F.expr("dp_id div 512").alias("batch")), event_points(s, d).select(F.col("name").alias("family"), F.concat(F.lit("help "), "name").alias("help")).distinct()).select("family", "batch", "help")
)

# -- controllers -----------------------------------------------------------------------------------------------

Q("snk_backoff", "SELECT event_id, CASE WHEN user_id % 12 - 2 <= 0 THEN 0.0::DOUBLE ELSE LEAST(100.0 * POW(2, user_id % 12 - 2), 5000.0)::DOUBLE END AS wait_ms FROM events")(lambda s, d: table(s, d, "events").select("event_id", C.backoff(F.col("user_id") % 12 - 2, 100, 5000).alias("wait_ms")))
Q("snk_errors", "WITH e AS (SELECT event_id, [200, 400, 401, 403, 404, 413, 429, 500, 503][1 + event_id % 9] AS status, CASE WHEN event_id % 2 = 0 THEN 'Body TOO LARGE' ELSE 'no' END AS m FROM events) SELECT event_id, CASE WHEN status IN (401, 403) THEN 'auth' WHEN status = 429 THEN 'rate_limit' WHEN status BETWEEN 400 AND 499 THEN 'client_error' WHEN status >= 500 THEN 'server_error' ELSE 'unknown' END AS kind, status >= 500 OR status = 429 AS retryable, status = 413 OR (status IN (400, 404) AND m = 'Body TOO LARGE') AS splittable FROM e")(
    lambda s, d: table(s, d, "events").select("event_id", F.element_at(F.array(*[F.lit(x) for x in (200, 400, 401, 403, 404, 413, 429, 500, 503)]), (F.col("event_id") % 9 + 1).cast("int")).alias("status"), F.when(F.col("event_id") % 2 == 0, "Body TOO LARGE").otherwise("no").alias("m")).select("event_id", C.error_class(F.col("status")).alias("kind"), C.retryable(C.error_class(F.col("status"))).alias("retryable"), C.splittable(F.col("status"), F.col("m")).alias("splittable"))
)


def _observed(spark, sf_dir):
    return table(spark, sf_dir, "events").select((F.col("user_id") % 20).alias("queue"), F.col("event_id").alias("seq"), F.col("value"), (F.col("event_type") != "error").alias("ok"))


Q("snk_spill_fsm")(lambda s, d: C.folded(_observed(s, d), "queue", "seq", C.spill_modes, "mode string"))
Q("snk_circuit")(lambda s, d: C.folded(_observed(s, d), "queue", "seq", C.circuit_states, "state string"))
Q("tuner_aimd")(lambda s, d: C.folded(_observed(s, d), "queue", "seq", C.tuned_bytes, "bytes long"))
Q("scaler_aimd")(lambda s, d: C.folded(_observed(s, d), "queue", "seq", C.scaled_workers, "workers long"))

# -- sources -----------------------------------------------------------------------------------------------------

_ROWS = DP + "SELECT name, service, u, k, ts_ns, value FROM dp"
Q("src_otlp_http", _ROWS)(lambda s, d: otlp.decode(otlp.encode(event_points(s, d))).select("name", L.get(F.col("resource"), "service.name").alias("service"), L.get(M(), "user").alias("u"), L.get(M(), "k").alias("k"), "ts_ns", "value"))
Q("src_prw", DP + "SELECT name, u, k, ts_ns - ts_ns % 1000000 AS ts_ns, value FROM dp")(lambda s, d: remote_write.samples(remote_write.decode(remote_write.encode(event_points(s, d)))).select("name", L.get(M(), "user").alias("u"), L.get(M(), "k").alias("k"), "ts_ns", "value"))
for _e in ("gzip", "zlib", "deflate", "zstd", "none"):
    Q(f"src_decompress_{_e}", DP + "SELECT name, COUNT(*) AS n FROM dp GROUP BY 1")(lambda s, d, e=_e: remote_write.decode(remote_write.encode(event_points(s, d), "batch_id", e)).groupBy("name").agg(F.count(F.lit(1)).alias("n")))
Q("src_codec_otlp", _ROWS)(lambda s, d: otlp_proto.decode(otlp_proto.encode(event_points(s, d))).select("name", L.get(F.col("resource"), "service.name").alias("service"), L.get(M(), "user").alias("u"), L.get(M(), "k").alias("k"), "ts_ns", "value"))
Q("src_codec_prw", DP + "SELECT name, 0::BIGINT AS exemplars, COUNT(*) AS samples FROM dp GROUP BY 1")(lambda s, d: remote_write.decode(remote_write.encode(event_points(s, d), "batch_id", "none")).groupBy("name", "exemplars").agg(F.sum(F.size("samples")).alias("samples")))

_YAML = """
processing_rules:
- {name: no-errors, action: drop, input: error}
- name: tiers
  action: classify
  input: ".*"
  mappings:
  - {sources: [user], target: tier, values: [["1.*", gold], [".*", other]]}
"""
_OLDER = """
default_rate: 1.0
rules:
- {name: quiet, match: {__name__: view, k: "[0-4].*"}, rate: 0}
"""


def _routed(text):
    return lambda s, d: route(event_points(s, d), load(text)).where("terminal_action IS NULL").select("dp_id", L.get(M(), "tier").alias("tier"))


Q("src_config", DP + "SELECT dp_id, CASE WHEN regexp_full_match(u, '1.*') THEN 'gold' ELSE 'other' END AS tier FROM dp WHERE name <> 'error'")(_routed(_YAML))
Q("flt_legacy", DP + "SELECT dp_id, '' AS tier FROM dp WHERE NOT (name = 'view' AND regexp_full_match(k, '[0-4].*'))")(_routed(_OLDER))
Q("fused", DP + ", v AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY ts_ns // 86400000000000 ORDER BY ts_ns, dp_id) <= 100 AS ok FROM dp) SELECT dp_id, service AS tenant FROM v WHERE ok")(
    lambda s, d: (lambda lim: A.act(A.admit(T.inject(T.detect(event_points(s, d), "attribute", "service.name")), lim), lim))(A.Limit("lim", window_ns=DAY, max_rate=100, action="drop")).select("dp_id", L.get(M(), "tenant").alias("tenant"))
)
Q("st_degrade", DP + "SELECT name, COUNT(*) AS datapoints FROM dp GROUP BY 1")(lambda s, d: per_metric(event_points(s, d), full=False))
Q("snk_prw_sharded")(lambda s, d: X.with_owner(event_points(s, d), ["user"], _RING).groupBy("endpoint").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("shard_key").alias("keys")))
