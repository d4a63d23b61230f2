"""Document fingerprints: invertible Bloom lookup sketches of paragraph digests, subtracted and peeled; DataFrame functions only."""

from __future__ import annotations

from functools import reduce
from math import isqrt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterflow.llm.common import cut, read, release

#: A paragraph is a line; a longer line is cut after the word that holds its 200th character.
PARAGRAPH = r"[^\n]{1,200}\S*"
#: Cells of each of a sketch's three tables, from the fingerprint's own to the largest retry.
TABLES = (8, 64, 512, 4096, 32768, 262144)
#: Peeling rounds over the three tables before a sketch counts as stuck.
ROUNDS = 5


def digests(text: Column) -> Column:
    """Distinct 64-bit digests of a text's paragraphs."""
    return F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.xxhash64(p)))


def _cell_of(k: Column, t: int, size: Column) -> Column:
    """The cell of digest k in table t; the tables of a sketch follow each other."""
    return (F.pmod(F.shiftrightunsigned(k, 21 * t).bitwiseAND(F.lit(0x1FFFFF)), size) + size * t).cast("int")


def _entries(found: Column, size: Column, count: int) -> Column:
    """The three cells of each digest, with the count it adds to them."""

    def of(k):
        c = F.xxhash64(k)
        return F.array(*[F.struct(_cell_of(k, t, size).alias("i"), F.lit(count).alias("n"), k.alias("k"), c.alias("c")) for t in range(3)])

    return F.flatten(F.transform(found, of))


def _summed(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, s, i, n, k, c): the cells of each key's sketch that aren't empty; sums of signed entries subtract sketches.

    Cells lie with their first key, and stay: the sums need no exchange.
    """
    got = cells.groupBy(*keys, "s", "i").agg(F.sum("n").cast("int").alias("n"), F.bit_xor("k").alias("k"), F.bit_xor("c").alias("c"))
    return got.where("n <> 0 OR k <> 0 OR c <> 0")


def peeled(cells: DataFrame, keys: list[str], rounds: int = ROUNDS) -> DataFrame:
    """(keys, left, got): cells that peeling couldn't empty, and digests it recovered, of each difference with any.

    A cell that holds one digest gives it away, and the digest leaves its other two cells. Tables take
    turns, so that no digest is given away twice at once. What was recovered is counted in a cell of
    number -1. All of a key's cells stay in one task.
    """
    for r in range(rounds * 3):
        t = r % 3
        pure = (F.col("i") >= 0) & (F.expr("i div s") == t) & (F.abs("n") == 1) & (F.xxhash64("k") == F.col("c"))
        same = F.struct("i", "n", "k", "c")
        gone = [F.struct(_cell_of(F.col("k"), u, F.col("s")).alias("i"), (-F.col("n")).alias("n"), F.col("k").alias("k"), F.col("c").alias("c")) for u in range(3) if u != t]
        got = F.struct(F.lit(-1).alias("i"), F.lit(1).alias("n"), F.lit(0).cast("long").alias("k"), F.lit(0).cast("long").alias("c"))
        cells = _summed(cells.select(*keys, "s", F.explode(F.when(pure, F.array(got, *gone)).otherwise(F.array(same))).alias("e")).select(*keys, "s", "e.*"), keys)
    return cells.groupBy(*keys).agg(F.sum(F.when(F.col("i") >= 0, 1).otherwise(0)).alias("left"), F.sum(F.when(F.col("i") < 0, F.col("n")).otherwise(0)).alias("got"))


def _dealt(rows: DataFrame, key: str, digests_: Column, each: int = 150_000) -> DataFrame:
    """rows dealt by key to so many tasks that each gets about each digests: their cells then fit in memory.

    The number is given, as rows grow tenfold once their digests are exploded, which adaptive execution
    can't see when it merges small partitions.
    """
    total = rows.agg(F.sum(digests_)).first()[0] or 0
    return rows.repartition(max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-total // each)), key)


def first_size(bound: Column, tables: tuple[int, ...] = TABLES) -> Column:
    """The smallest table that peels a difference of bound digests at once, but for chance: three cells a digest."""
    out = F.lit(tables[-1])
    for size in reversed(tables[:-1]):
        out = F.when(bound <= size, size).otherwise(out)
    return out


def _tagged(which: str, entries: Column, size: Column) -> Column:
    return F.transform(entries, lambda e: F.struct(F.lit(which).alias("which"), size.cast("int").alias("s"), e["i"].alias("i"), e["n"].alias("n"), e["k"].alias("k"), e["c"].alias("c")))


def _tried(rows: DataFrame, versions: dict[str, str], sizes: dict[str, Column]) -> DataFrame:
    """(row, left_w, got_w of each version w): sketches of found and each version, subtracted and peeled where rows lie."""
    entries = [_tagged(w, _entries(F.col(c), sizes[w], n), sizes[w]) for w, other in versions.items() for c, n in (("found", 1), (other, -1))]
    cells = _summed(rows.select("row", F.explode(F.concat(*entries)).alias("e")).select("row", "e.*"), ["row", "which"])
    out = peeled(cells, ["row", "which"])
    side = lambda w, c: F.coalesce(F.sum(F.when(F.col("which") == w, F.col(c))), F.lit(0))
    return out.groupBy("row").agg(*[side(w, c).alias(f"{c}_{w}") for w in versions for c in ("left", "got")])


def differing(rows: DataFrame, versions: dict[str, str], tables: tuple[int, ...] = TABLES) -> DataFrame:
    """(row, d_w of each version w): the number of digests that found and the version's column don't share.

    rows: row, found and the versions' columns, arrays of distinct digests. The first table follows the
    numbers of digests; rows whose peeling gets stuck are tried again with tables eight times larger, and so
    on. Rows beyond the largest are compared digest by digest.
    """
    rows = rows.select("row", "found", *versions.values())
    size = {w: first_size(F.size("found") + F.size(c), tables) for w, c in versions.items()}
    names = [f"{c}_{w}" for w in versions for c in ("left", "got")]
    stuck = reduce(Column.__or__, [F.col(f"left_{w}") > 0 for w in versions])
    parts, open_ = [], rows
    for turn in range(len(tables)):
        dealt = _dealt(open_, "row", F.size("found") + sum(F.size(c) for c in versions.values()))
        out = _tried(dealt, versions, {w: F.least(size[w] * 8**turn, F.lit(tables[-1])) for w in versions})
        tried = cut(dealt.select("row").join(out, "row", "left").select("row", *[F.coalesce(n, F.lit(0)).alias(n) for n in names]), "sketch-peeled")
        parts.append(tried.where(~stuck))
        left = tried.where(stuck).select("row")
        if left.isEmpty():
            break
        open_ = rows.join(left, "row")
    else:
        exact = lambda c: (F.size(F.array_except("found", c)) + F.size(F.array_except(c, "found"))).cast("long")
        parts.append(open_.select("row", *[x for w, c in versions.items() for x in (F.lit(0).cast("long").alias(f"left_{w}"), exact(c).alias(f"got_{w}"))]))
    return reduce(DataFrame.unionByName, parts).select("row", *[F.col(f"got_{w}").alias(f"d_{w}") for w in versions])


def shown(cells: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, shown): a sketch as text: cell number, count, and both sums in hexadecimal of each cell that isn't empty."""
    one = F.concat_ws(":", F.col("i").cast("string"), F.col("n").cast("string"), F.hex("k"), F.hex("c"))
    got = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", one.alias("text")))).alias("all"))
    return got.select(*keys, F.array_join(F.transform("all", lambda x: x["text"]), " ").alias("shown"))


def with_next(docs: DataFrame, order: str, ranges: int) -> DataFrame:
    """docs with column next: the struct of the row that follows by order (ties by a hash of text); after the last, the first.

    Rows are dealt by ranges of order, whose bounds are approximate quantiles of all rows, so no task gets
    them all; the first row of the next range (one row a range, which bounds the broadcast) joins each
    range as its last.
    """
    cols = docs.columns
    # Rows of one id don't stand apart: any share of them may lie in one range, which spills but stays whole.
    bounds = sorted(set(docs.stat.approxQuantile(order, [i / ranges for i in range(1, ranges)], 0.2 / ranges))) if ranges > 1 else []
    g = max(1, isqrt(len(bounds)) + 1)
    groups = [bounds[i : i + g] for i in range(0, len(bounds), g)] or [[]]
    heads = F.array(*[F.lit(float(x[0])) for x in groups[1:]]).cast("array<double>")
    fine = F.array(*[F.array(*[F.lit(float(y)) for y in x]).cast("array<double>") for x in groups])
    at = F.coalesce(F.col(order).cast("double"), F.lit(float("-inf")))
    coarse = F.size(F.filter(heads, lambda x: x < at))
    rid = coarse * (g + 1) + F.size(F.filter(F.element_at(fine, coarse + 1), lambda x: x < at))
    tie = F.xxhash64("text")
    rows = docs.withColumn("_r", rid.cast("int")).withColumn("_t", tie)
    first = cut(rows.groupBy("_r").agg(F.min(F.struct(F.col(order).isNotNull().alias("z"), F.col(order).alias("o"), F.col("_t").alias("t"))).alias("f")), "ranges")
    w = Window.orderBy("_r")  # one row a range
    wrap = F.first("f").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    heir = first.select("_r", F.coalesce(F.lead("f").over(w), wrap).alias("f")).select(F.col("_r").alias("_to"), F.col("f.o").alias("_o"), F.col("f.t").alias("_ft"))
    guests = rows.join(F.broadcast(heir), F.col(order).eqNullSafe(F.col("_o")) & (F.col("_t") == F.col("_ft"))).select(*cols, F.col("_to").alias("_r"), "_t", F.lit(1).alias("_guest"))
    every = rows.withColumn("_guest", F.lit(0)).unionByName(guests)
    by = Window.partitionBy("_r").orderBy("_guest", F.col(order).asc_nulls_first(), "_t")
    return every.withColumn("next", F.lead(F.struct(*cols)).over(by)).where("_guest = 0").select(*cols, "next")


def fingerprint_versions(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every whole text.

    The edited text is the text with its last quarter (code points, rounded down) replaced by as many
    first ones of the next document by doc_id, or all it has; the first follows the last. A
    fingerprint is the smallest sketch of the paragraphs' digests; equal texts have equal ones.

    Null text: empty; no paragraph at all: an empty fingerprint, of likeness 1 to another such. Null
    doc_id: before all others. Rows with one doc_id: in an order that only their texts decide. One row:
    it follows itself. Other columns are not read.
    """
    spark = docs.sparkSession
    ranges = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    text = F.coalesce("text", F.lit(""))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("found", digests(F.col("text")))
    rows = with_next(base, "doc_id", ranges)
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), n - part), F.col("next.text").substr(F.lit(1), part))
    rows = rows.select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "found", F.col("next.found").alias("next_found"))
    rows = rows.select(
        F.monotonically_increasing_id().alias("row"), "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "found", digests(F.col("edited")).alias("edited_found"), "next_found"
    )
    rows = cut(rows, "sketch-rows")
    release(spark)
    differ = differing(rows, {"e": "edited_found", "n": "next_found"})
    own = F.concat(*[_tagged(w, _entries(F.col(c), F.lit(TABLES[0]), 1), F.lit(TABLES[0])) for w, c in (("o", "found"), ("e", "edited_found"))])
    dealt = _dealt(rows, "row", F.size("found") + F.size("edited_found"))
    prints = _summed(dealt.select("row", F.explode(own).alias("e")).select("row", "e.*"), ["row", "which"])
    prints = shown(prints, ["row", "which"])
    prints = prints.groupBy("row").agg(*[F.coalesce(F.max(F.when(F.col("which") == w, F.col("shown"))), F.lit("")).alias(f"p_{w}") for w in "oe"])

    def likeness(d: str, b: str) -> Column:
        total = F.size("found") + F.size(b)
        return F.when(total == 0, F.lit(1.0)).otherwise(1.0 - F.col(d) / total)

    out = dealt.join(prints, "row", "left").join(differ, "row")
    return out.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.coalesce("p_o", F.lit("")).alias("fingerprint"),
        F.coalesce("p_e", F.lit("")).alias("edited_fingerprint"),
        likeness("d_e", "edited_found").alias("near_edited"),
        likeness("d_n", "next_found").alias("near_next"),
    )


def op3_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 3: every document against its edited text and the next document."""
    return fingerprint_versions(read(spark, sf_dir, "documents"))


QUERIES = {"op3_fingerprints": op3_fingerprints}
SQL: dict[str, str] = {}
