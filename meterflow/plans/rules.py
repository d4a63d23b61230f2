"""Processing rules: YAML or dicts to frozen dataclasses, validated and compiled once."""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterflow.functions import labels as L

ACTIONS = ("sample", "downsample", "aggregate", "transform", "classify", "drop")
AGGREGATES = ("sum", "avg", "min", "max", "count", "last", "increase", "rate", "stddev", "stdvar")
DOWNSAMPLES = ("avg", "min", "max", "sum", "count", "last", "first", "delta", "lttb", "sdt", "adaptive")
DURATION = {"ns": 1, "us": 10**3, "ms": 10**6, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9}


def duration_ns(text: str) -> int:
    """'1m30s' in nanoseconds."""
    found = re.findall(r"(\d+(?:\.\d+)?)(ns|us|ms|s|m|h|d)", text)
    if not found or "".join(a + b for a, b in found) != text:
        raise ValueError(f"not a duration: {text!r}")
    return int(sum(float(a) * DURATION[b] for a, b in found))


def parse_functions(functions: list[str]) -> list[tuple[str, tuple[float, ...]]]:
    """Names and, for quantiles(0.5, ...), their points."""
    out = []
    for f in functions:
        m = re.fullmatch(r"\s*quantiles\((.*)\)\s*", f)
        if m:
            q = tuple(float(x) for x in m[1].split(",") if x.strip())
            if not q or any(not 0 <= x <= 1 for x in q):
                raise ValueError(f"quantiles lie between 0 and 1: {f}")
            out.append(("quantiles", q))
        elif f in AGGREGATES:
            out.append((f, ()))
        else:
            raise ValueError(f"unknown function {f!r}")
    return out


@dataclass(frozen=True)
class Rule:
    name: str
    action: str
    input: str = ".*"
    input_labels: tuple[tuple[str, str], ...] = ()
    output: str = ""
    rate: float = 1.0
    method: str = "head"
    interval_ns: int = 0
    functions: tuple = ()
    group_by: tuple[str, ...] = ()
    drop_labels: tuple[str, ...] = ()
    keep_input: bool = False
    when: tuple = ()
    operations: tuple = ()
    chains: tuple = ()
    mappings: tuple = ()
    remove_after: tuple[str, ...] = ()
    options: dict = field(default_factory=dict, hash=False)


def rule(spec: dict) -> Rule:
    """A validated rule. Keys are those of the YAML form."""
    action = spec.get("action")
    if not spec.get("name"):
        raise ValueError("a rule needs a name")
    if action not in ACTIONS:
        raise ValueError(f"rule {spec['name']}: unknown action {action!r}")
    re.compile(spec.get("input", ".*"))
    s = dict(spec)
    s["input_labels"] = tuple(sorted((spec.get("input_labels") or {}).items()))
    s["interval_ns"] = duration_ns(s.pop("interval")) if "interval" in s else 0
    if action == "sample" and not 0 <= float(s.get("rate", 1.0)) <= 1:
        raise ValueError(f"rule {s['name']}: rate lies between 0 and 1")
    if action == "aggregate":
        if not s["interval_ns"]:
            raise ValueError(f"rule {s['name']}: aggregate needs an interval")
        if s.get("group_by") and s.get("drop_labels"):
            raise ValueError(f"rule {s['name']}: group_by and drop_labels exclude each other")
        if not s.get("output") and re.escape(s.get("input", ".*")) != s.get("input", ".*"):
            raise ValueError(f"rule {s['name']}: a pattern as input needs an output name")
        s["functions"] = tuple(parse_functions(list(s.get("functions") or [])))
        if not s["functions"]:
            raise ValueError(f"rule {s['name']}: aggregate needs a function")
    if action == "downsample" and s.get("method") not in DOWNSAMPLES:
        raise ValueError(f"rule {s['name']}: unknown method {s.get('method')!r}")
    if action == "downsample" and s["method"] == "sdt" and s.get("options", {}).get("deviation", 0) <= 0:
        raise ValueError(f"rule {s['name']}: sdt needs a deviation above 0")
    for key in ("group_by", "drop_labels", "when", "operations", "chains", "mappings", "remove_after"):
        s[key] = tuple(s.get(key) or ())
    for op in s["operations"]:
        if len(op) != 1 or next(iter(op)) not in OPERATIONS:
            raise ValueError(f"rule {s['name']}: one known operation each, not {sorted(op)}")
    return Rule(**s)


def load(text: str) -> list[Rule]:
    """Rules of a YAML text, of the present form or the older default_rate form."""
    import yaml

    got = yaml.safe_load(text) or {}
    if "rules" in got and any("match" in r for r in got["rules"]) or "default_rate" in got:
        return [rule(r) for r in from_older(got)]
    return [rule(r) for r in got.get("processing_rules", got.get("rules", []))]


def from_older(got: dict) -> list[dict]:
    """The older form: first matching rate rule, then a default rate for all that is left."""
    out = []
    for i, r in enumerate(got.get("rules") or []):
        labels = {k: v for k, v in (r.get("match") or {}).items() if k != "__name__"}
        rate = float(r.get("rate", 1.0))
        out.append({"name": r.get("name", f"older-{i}"), "input": (r.get("match") or {}).get("__name__", ".*"), "input_labels": labels, **({"action": "drop"} if rate <= 0 else {"action": "sample", "rate": rate, "method": r.get("strategy", got.get("strategy", "head"))})})
    default = float(got.get("default_rate", 1.0))
    if default < 1:
        out.append({"name": "older-default", "input": ".*", **({"action": "drop"} if default <= 0 else {"action": "sample", "rate": default, "method": got.get("strategy", "head")})})
    return out


#: Transform operations by their YAML name.
OPERATIONS: dict[str, Callable[..., Column]] = {
    "remove": lambda m, labels: L.remove(m, *labels),
    "set": lambda m, label, value: L.tf_set(m, label, value),
    "rename": lambda m, source, target: L.tf_rename(m, source, target),
    "copy": lambda m, source, target: L.tf_copy(m, source, target),
    "replace": lambda m, label, pattern, replacement: L.tf_replace(m, label, pattern, replacement),
    "extract": lambda m, source, target, pattern, group=1: L.tf_extract(m, source, target, pattern, group),
    "hash_mod": lambda m, source, target, modulus: L.tf_hash_mod(m, source, target, modulus),
    "lower": lambda m, label: L.tf_lower(m, label),
    "upper": lambda m, label: L.tf_upper(m, label),
    "concat": lambda m, sources, target, separator="": L.tf_concat(m, sources, target, separator),
    "map": lambda m, source, target, values, default=None: L.tf_map(m, source, target, list(values.items()), default),
    "math": lambda m, source, target, operation, operand: L.tf_math(m, source, target, operation, operand),
}


def literal_prefix(pattern: str) -> str:
    """Letters that every match starts with, for a cheap test before the pattern itself."""
    m = re.match(r"[A-Za-z0-9_:\- ]+", pattern)
    if not m or "|" in pattern:
        return ""
    head, rest = m[0], pattern[m.end() :]
    return head[:-1] if rest[:1] in ("*", "?", "{") else head


def name_matches(name: Column, pattern: str) -> Column:
    if re.escape(pattern) == pattern or re.fullmatch(r"[A-Za-z0-9_:]+", pattern):
        return name == pattern
    head = literal_prefix(pattern)
    test = name.rlike(L.full(pattern))
    return name.startswith(head) & test if head else test


def matches(r: Rule, name: Column, labels: Column) -> Column:
    """Whole-match of the name and of every input label, which must be there."""
    out = name_matches(name, r.input)
    for k, p in r.input_labels:
        out = out & L.has(labels, k) & L.get(labels, k).rlike(L.full(p))
    return out


def edited(r: Rule, labels: Column) -> Column:
    """The labels after a transform or classify rule whose conditions hold."""
    new = labels
    if r.action == "transform":
        for op in r.operations:
            kind, args = next(iter(op.items()))
            new = OPERATIONS[kind](new, **args)
        return L.when(L.conditions(labels, r.when), new, labels) if r.when else new
    new = L.cl_chain(new, r.chains) if r.chains else new
    for m in r.mappings:
        new = L.cl_mapping(new, **m)
    return L.remove(new, *r.remove_after)


def route(points: DataFrame, rules: list[Rule]) -> DataFrame:
    """points with labels edited, and terminal_rule and terminal_action of the rule that ends each row's way.

    Rules apply in order; transform and classify rules edit labels and go on, all others end. Rows that
    no rule ends pass. Downsampling and aggregation apply to gauges and sums only. A projection for each
    editing rule keeps the expressions small; Catalyst joins what is cheap to join.
    """
    df = points.withColumns({"terminal_rule": F.lit(None).cast("string"), "terminal_action": F.lit(None).cast("string")})
    for r in rules:
        hit = F.col("terminal_rule").isNull() & matches(r, F.col("name"), F.col("labels"))
        if r.action in ("downsample", "aggregate"):
            hit = hit & F.col("kind").isin("gauge", "sum")
        if r.action in ("transform", "classify"):
            df = df.withColumn("labels", F.when(hit, edited(r, F.col("labels"))).otherwise(F.col("labels")))
        else:
            df = df.withColumn("_hit", hit)
            df = df.withColumns({"terminal_action": F.when(F.col("_hit"), r.action).otherwise(F.col("terminal_action")), "terminal_rule": F.when(F.col("_hit"), r.name).otherwise(F.col("terminal_rule"))}).drop("_hit")
    return df
