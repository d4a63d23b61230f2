"""Label maps: reading, editing, and the transform, classify and relabel operations on them.

A missing label reads as the empty string. Each operation takes and returns a map column, so a chain
of rules is one expression that stays in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from meterflow.functions.hashing import fnv1a64, sha256_head


def get(labels: Column, key: str) -> Column:
    return F.coalesce(F.try_element_at(labels, F.lit(key)), F.lit(""))


def has(labels: Column, key: str) -> Column:
    return F.map_contains_key(labels, key)


def remove(labels: Column, *keys: str) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.isin(*keys)) if keys else labels


def keep(labels: Column, *keys: str) -> Column:
    return F.map_filter(labels, lambda k, v: k.isin(*keys))


def put(labels: Column, key: str, value: Column) -> Column:
    return F.map_concat(remove(labels, key), F.create_map(F.lit(key), value))


def full(pattern: str) -> str:
    return f"^(?:{pattern})$"


def canonical(labels: Column) -> Column:
    """Sorted k=v pairs joined by '|'; the same for equal maps."""
    pairs = F.array_sort(F.map_entries(labels))
    return F.array_join(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("="), e["value"])), "|")


def template(text: str, labels: Column) -> Column:
    """Text with ${label} replaced."""
    parts = re.split(r"\$\{([^}]*)\}", text)
    cols = [get(labels, p) if i % 2 else F.lit(p) for i, p in enumerate(parts) if i % 2 or p]
    return F.concat(*cols) if cols else F.lit("")


def java_replacement(text: str) -> str:
    """A replacement with $1 or ${1} groups in the form of java.util.regex; unknown names are empty."""
    out, at = [], 0
    for m in re.finditer(r"\$(?:\{(\w+)\}|(\w+)|\$)", text):
        out.append(re.sub(r"([\\$])", r"\\\1", text[at : m.start()]))
        name = m[1] or m[2]
        out.append(r"\$" if name is None else f"${name}" if name.isdigit() else "")
        at = m.end()
    out.append(re.sub(r"([\\$])", r"\\\1", text[at:]))
    return "".join(out)


def number_text(x: Column) -> Column:
    """A double as text, by its own shortest digits and without an exponent; infinities are +Inf and -Inf."""
    text = x.cast("string")
    part = lambda i: F.regexp_extract(text, r"^(-?)(\d+)\.(\d+)(?:E(-?\d+))?$", i)
    fraction = F.regexp_replace(part(3), "0+$", "")
    digits, power = F.concat(part(2), fraction), F.coalesce(part(4).try_cast("int"), F.lit(0))
    point = F.length(part(2)) + power  # digits before the point
    padded = F.rpad(digits, F.greatest(point, F.length(digits)), F.lit("0"))
    large = F.concat(F.substring(padded, F.lit(1), point), F.when(F.length(padded) > point, F.concat(F.lit("."), F.substring(padded, point + 1, F.length(padded)))).otherwise(""))
    small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -point), digits)
    plain = F.concat(part(1), F.when(point > 0, large).otherwise(small))
    return F.when(x == float("inf"), "+Inf").when(x == float("-inf"), "-Inf").when(F.isnan(x), "NaN").otherwise(plain)


def when(cond: Column, then: Column, labels: Column) -> Column:
    return F.when(cond, then).otherwise(labels)


# -- transform -------------------------------------------------------------------------------------------


def tf_set(labels: Column, target: str, value: str) -> Column:
    return put(labels, target, template(value, labels))


def tf_rename(labels: Column, source: str, target: str) -> Column:
    return when(has(labels, source), put(remove(labels, source), target, get(labels, source)), labels)


def tf_copy(labels: Column, source: str, target: str) -> Column:
    return when(get(labels, source) != "", put(labels, target, get(labels, source)), labels)


def tf_replace(labels: Column, source: str, pattern: str, replacement: str) -> Column:
    return when(has(labels, source), put(labels, source, F.regexp_replace(get(labels, source), F.lit(pattern), F.lit(java_replacement(replacement)))), labels)


def tf_extract(labels: Column, source: str, target: str, pattern: str, group: int = 1) -> Column:
    if group > re.compile(pattern).groups:
        return labels
    v = get(labels, source)
    return when(v.rlike(pattern), put(labels, target, F.regexp_extract(v, pattern, group)), labels)


def tf_hash_mod(labels: Column, source: str, target: str, modulus: int) -> Column:
    v = get(labels, source)
    return when(v != "", put(labels, target, F.pmod(fnv1a64(v), F.lit(modulus).cast("decimal(20,0)")).cast("long").cast("string")), labels)


def tf_lower(labels: Column, source: str) -> Column:
    return when(has(labels, source), put(labels, source, F.lower(get(labels, source))), labels)


def tf_upper(labels: Column, source: str) -> Column:
    return when(has(labels, source), put(labels, source, F.upper(get(labels, source))), labels)


def tf_concat(labels: Column, sources: Sequence[str], target: str, separator: str = "") -> Column:
    return put(labels, target, F.concat_ws(separator, *[get(labels, s) for s in sources]))


def tf_map(labels: Column, source: str, target: str, values: Sequence[tuple[str, str]], default: str | None = None) -> Column:
    """The first pattern that matches the whole value decides."""
    v, out = get(labels, source), F.lit(default)
    for pattern, says in reversed(list(values)):
        out = F.when(v.rlike(full(pattern)), F.lit(says)).otherwise(out)
    return when(out.isNotNull(), put(labels, target, out), labels)


def tf_math(labels: Column, source: str, target: str, operation: str, operand: float) -> Column:
    text = get(labels, source)
    x = F.when(text.rlike(r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"), text.try_cast("double"))
    y = F.lit(float(operand))
    ops = {"add": x + y, "sub": x - y, "mul": x * y}
    if operand:
        ops |= {"div": x / y, "mod": x % y}
    got = ops.get(operation)
    return labels if got is None else when(got.isNotNull(), put(labels, target, number_text(got)), labels)


# -- classify --------------------------------------------------------------------------------------------


def conditions(labels: Column, when_: Sequence[dict]) -> Column:
    """All of equals, contains, matches and not_matches conditions; the last two match whole values."""
    out = F.lit(True)
    for c in when_:
        v = get(labels, c["label"])
        if c.get("equals"):
            out = out & (v == c["equals"])
        if c.get("contains"):
            out = out & v.contains(c["contains"])
        if c.get("matches"):
            out = out & v.rlike(full(c["matches"]))
        if c.get("not_matches"):
            out = out & ~v.rlike(full(c["not_matches"]))
    return out


def cl_chain(labels: Column, chains: Sequence[tuple[Sequence[dict], dict[str, str]]]) -> Column:
    """The first chain whose conditions hold sets its labels, all read from the labels as they were."""
    out = labels
    for cond, sets in reversed(list(chains)):
        new = remove(labels, *sets)
        new = F.map_concat(new, F.create_map(*[c for k, v in sets.items() for c in (F.lit(k), template(v, labels))]))
        out = F.when(conditions(labels, cond), new).otherwise(out)
    return out


def cl_mapping(labels: Column, sources: Sequence[str], target: str, values: Sequence[tuple[str, str]], default: str | None = None, separator: str = ":") -> Column:
    v = F.concat_ws(separator, *[get(labels, s) for s in sources])
    out = F.lit(default)
    for pattern, says in reversed(list(values)):
        out = F.when(v.rlike(full(pattern)), F.lit(says)).otherwise(out)
    return when(out.isNotNull(), put(labels, target, out), labels)


# -- relabel (labels hold the pseudo label __name__) ------------------------------------------------------


def joined(labels: Column, sources: Sequence[str], separator: str = ";") -> Column:
    return F.concat_ws(separator, *[get(labels, s) for s in sources])


def rl_replace(labels: Column, sources, target: str, regex: str = "(.*)", replacement: str = "$1", separator: str = ";") -> Column:
    v = joined(labels, sources, separator)
    new = F.regexp_replace(v, F.lit(f"^(?:{regex})$"), F.lit(java_replacement(replacement or "$1")))
    return when(v.rlike(full(regex)), put(labels, target, new), labels)


def rl_labelmap(labels: Column, regex: str, replacement: str = "$1") -> Column:
    """Copies of matching labels under rewritten names; a copy wins over a label of its new name."""
    hit = F.map_filter(labels, lambda k, v: k.rlike(full(regex)))
    new = F.transform(F.array_sort(F.map_entries(hit)), lambda e: F.struct(F.regexp_replace(e["key"], F.lit(full(regex)), F.lit(java_replacement(replacement))).alias("key"), e["value"].alias("value")))
    last = F.filter(new, lambda e, i: ~F.exists(F.slice(new, i + 2, F.size(new)), lambda o: o["key"] == e["key"]))
    rest = F.map_filter(labels, lambda k, v: ~F.exists(new, lambda e: e["key"] == k))
    return F.map_concat(rest, F.map_from_entries(last))


def rl_labeldrop(labels: Column, regex: str) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.rlike(full(regex)))


def rl_labelkeep(labels: Column, regex: str) -> Column:
    return F.map_filter(labels, lambda k, v: k.rlike(full(regex)) | (k == "__name__"))


def rl_hashmod(labels: Column, sources, target: str, modulus: int, separator: str = ";") -> Column:
    return put(labels, target, F.pmod(sha256_head(joined(labels, sources, separator)), F.lit(modulus).cast("decimal(20,0)")).cast("long").cast("string"))
