"""Mixing sources to target weights by hash-threshold histograms, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from meterflow.llm.common import WORD, cut, read

#: Hash bits of each histogram level: the second and third only look at the boundary bucket above.
LEVELS = (12, 14, 16)


def word_count(text):
    """Number of words of a text; null: 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """(source, source_size, target): shares of all words by weight, none above most times its size.

    Sources stand by code point, null last, and take the weights in turn. The excess of capped
    sources is shared by weight until none is above: sources fill in order of size by weight, so one
    running sum over that order finds them all at once. One row a source is ranked here, not documents.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    turn = sizes.withColumn("_k", (F.row_number().over(by_name) - 1) % n)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") + 1).cast("int"))
    x = turn.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy((F.col("_cap") / F.col("_w")).asc(), F.col("_k"), F.col("source").asc_nulls_last())
    every = Window.partitionBy().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    x = (
        x.withColumn("_all", F.sum("source_size").over(every) * F.lit(float(share)))
        .withColumn("_capped", F.coalesce(F.sum("_cap").over(before), F.lit(0.0)))
        .withColumn("_rest_w", F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        .withColumn("_level", F.greatest(F.lit(0.0), (F.col("_all") - F.col("_capped")) / F.col("_rest_w")))
        .withColumn("_full", F.col("_cap") <= F.col("_w") * F.col("_level"))
        .withColumn("_first", F.max(F.when(~F.col("_full"), F.col("_level"))).over(every))
    )
    target = F.when(F.col("_full") | F.col("_first").isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), F.col("_w") * F.col("_first")))
    return x.select("source", "source_size", target.alias("target"))


def mix_plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11) -> tuple[DataFrame, DataFrame]:
    """(documents, plan): doc_id, source, size, _u of each row; and _whole, _under and targets of each source."""
    used = docs.select(F.col("doc_id"), F.col("source"), word_count(F.col("text")).alias("size"))
    base = cut(used.withColumn("_u", _draw(F.col("doc_id"), seed)), "mixing")
    sums = base.groupBy("source").agg(F.sum("size").alias("source_size"))
    goal = cut(targets(sums, tuple(weights), share, most), "mixing-targets")
    goal = goal.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long"))
    goal = goal.withColumn("_left", F.col("target") - F.col("_whole") * F.col("source_size"))

    # _lo: words below the boundary bucket; _at: that bucket's number among all of its level.
    bound = goal.select("source", F.col("_left"), F.lit(0.0).alias("_lo"), F.lit(0).cast("long").alias("_at"))
    shift = sum(LEVELS)
    for bits in LEVELS:
        above, shift = shift, shift - bits
        rows = base.join(bound, base["source"].eqNullSafe(bound["source"]) & (F.shiftright(base["_u"], above) == bound["_at"]))
        cells = rows.groupBy(base["source"].alias("source"), F.shiftright("_u", shift).alias("_b")).agg(F.sum("size").alias("_n"), F.first("_left").alias("_left"), F.first("_lo").alias("_lo"))
        up = Window.partitionBy("source").orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
        run = cells.withColumn("_hi", F.col("_lo") + F.sum("_n").over(up))
        edge = run.where("_hi > _left").groupBy("source").agg(
            F.min_by(F.struct((F.col("_hi") - F.col("_n")).alias("_lo"), F.col("_b").alias("_at"), F.col("_hi"), F.col("_left")), "_b").alias("e")
        )
        last = cut(edge.select("source", "e.*"), "mixing-bound")
        bound = last.select("source", "_left", F.col("_lo").cast("double").alias("_lo"), "_at")
    # Of the last bucket, all or nothing, whichever ends nearer to the budget.
    cutoff = last.select("source", (F.col("_at") + F.when(F.col("_hi") - F.col("_left") < F.col("_left") - F.col("_lo"), 1).otherwise(0)).alias("_under"))
    plan = goal.alias("g").join(cutoff.alias("c"), F.col("g.source").eqNullSafe(F.col("c.source")), "left").select("g.source", "g.source_size", "g.target", "g._whole", F.coalesce("c._under", F.when(F.col("g._left") > 0, F.lit(1 << sum(LEVELS))).otherwise(0)).alias("_under"))
    return base, cut(plan, "mixing-plan")


def _draw(doc_id, seed: int):
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), doc_id), 64 - sum(LEVELS))


def mix_sources(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """One row a document: its doc_id and source, and size, source_size, target, copies, taken.

    Each source takes its documents floor(target / source_size) times whole, and once more those whose
    hash lies below the source's threshold. The threshold comes from word sums by source and hash
    bucket: a running sum over at most 2**bits buckets of a source finds the bucket where the budget
    ends, and only that bucket's documents enter the next, finer histogram. Larger budgets keep all
    that smaller ones take. Nothing is sorted but buckets; a hot source is summed before it is dealt.

    Null source: a source of its own, last. Null or empty text: size 0, taken 0. Equal doc_id: equal
    decision. Empty table: no rows. A null doc_id hashes like any value. Other columns are not read.
    """
    base, plan = mix_plan(docs, weights, share, most, seed)
    b, p = base.alias("b"), plan.alias("p")
    out = b.join(p, F.col("b.source").eqNullSafe(F.col("p.source")))
    copies = F.col("p._whole") + F.when(F.col("b._u") < F.col("p._under"), 1).otherwise(0)
    return out.select("b.doc_id", "b.source", "b.size", "p.source_size", "p.target", F.least(copies, F.lit(int(most))).alias("copies")).withColumn("taken", F.col("size") * F.col("copies"))


def apply_mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 11) -> DataFrame:
    """docs' own columns, each row as often as the mix takes it; a row taken no time goes.

    Thresholds are applied to each row by its source, without a join of documents. Rows without words
    are taken like others of their hash. Columns of docs may have any names.
    """
    _, plan = mix_plan(docs, weights, share, most, seed)
    small = plan.select(F.col("source").alias("_mix_s"), F.col("_whole").alias("_mix_w"), F.col("_under").alias("_mix_u"))
    joined = docs.join(small, docs["source"].eqNullSafe(small["_mix_s"]))
    copies = F.least(F.col("_mix_w") + F.when(_draw(docs["doc_id"], seed) < F.col("_mix_u"), 1).otherwise(0), F.lit(int(most)))
    times = F.explode(F.when(copies > 0, F.array_repeat(F.lit(0), copies.cast("int"))).otherwise(F.array().cast("array<int>")))
    return joined.select(*[docs[c] for c in docs.columns], times.alias("_mix_t")).drop("_mix_t")


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


QUERIES = {"op4_mixing": op4_mixing}
SQL: dict[str, str] = {}
