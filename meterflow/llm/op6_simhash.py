"""SimHash near-duplicates: pigeonhole blocks, a join on blocks, verified Hamming distance, components."""

from __future__ import annotations

from itertools import combinations, repeat

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm.common import cut, read
from meterflow.llm.graph import components

#: Distinct fingerprints that a block bucket holds at most to be joined pair by pair; larger buckets
#: are linked exactly by one-bit neighbours, which is linear in their size.
PAIRWISE = 48


def simhash(text: str | None, width: int = 3, seed: int = 42) -> bytes:
    """Fingerprint of a text as 8 bytes, highest bit first; zero if it has no words."""
    import xxhash

    words = (text or "").encode().lower().split()  # bytes: A-Z only, and splits at space and 9 to 13 only
    if not words:
        return bytes(8)
    if len(words) < width:
        words, n = [b" ".join(words)], 1
        rows = iter([(words[0],)])
    else:
        n = len(words) - width + 1
        rows = zip(*[words[i:] for i in range(width)])
    digests = b"".join(map(xxhash.xxh64_digest, map(b" ".join, rows), repeat(seed)))
    ones = np.zeros(64, np.int64)
    each = np.frombuffer(digests, np.uint8).reshape(n, 8)
    for at in range(0, n, 1 << 16):
        ones += np.unpackbits(each[at : at + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(ones * 2 > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): 64-bit SimHash of every whole text, as a signed long."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            got = [int.from_bytes(simhash(t.as_py(), width), "big", signed=True) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got, pa.int64())], names=["doc_id", "fp"])

    return docs.selectExpr("CAST(doc_id AS long) AS doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _keys(fp, distance: int):
    """distance+2 blocks; fingerprints within distance share two blocks at least, so a key is a pair of blocks."""
    n = distance + 2
    edges = [64 * i // n for i in range(n + 1)]
    block = [F.shiftrightunsigned(fp, edges[i]).bitwiseAND(F.lit((1 << (edges[i + 1] - edges[i])) - 1)) for i in range(n)]
    return F.array(*[F.struct(F.lit(k).alias("t"), block[i].alias("x"), block[j].alias("y")) for k, (i, j) in enumerate(combinations(range(n), 2))])


def links(prints: DataFrame, distance: int = 2, pairwise: int = PAIRWISE) -> DataFrame:
    """(a, b) pairs of rep among distinct fingerprints within distance bits; chains may stand for cliques.

    prints: fp, rep, one row a fingerprint. A bucket of at most pairwise fingerprints is joined with
    itself on its key and verified. Fingerprints in larger buckets meet at values one bit away
    instead: two within 2 bits have such a value in common, and all that meet at one are within 2
    bits of each other, at most 65 of them; so no bucket yields pairs with the square of its size.
    """
    if distance != 2:
        raise ValueError("buckets beyond the pairwise bound are linked for a distance of 2")
    rows = prints.select("fp", "rep", F.explode(_keys(F.col("fp"), distance)).alias("k")).select("fp", "rep", "k.*")
    sizes = cut(rows.groupBy("t", "x", "y").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "simhash-buckets")
    small = rows.join(sizes.where(F.col("n") <= pairwise), ["t", "x", "y"])
    a, b = small.select("t", "x", "y", F.col("fp").alias("fa"), F.col("rep").alias("a")), small.select("t", "x", "y", F.col("fp").alias("fb"), F.col("rep").alias("b"))
    close = F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= distance
    pairs = a.join(b, ["t", "x", "y"]).where((F.col("a") < F.col("b")) & close).select("a", "b")
    large = rows.join(sizes.where(F.col("n") > pairwise), ["t", "x", "y"], "left_semi").select("fp", "rep").distinct()
    near = F.array(F.col("fp"), *[F.col("fp").bitwiseXOR(F.lit((1 << i) - (1 << 64) * (i == 63))) for i in range(64)])
    meet = large.select("rep", F.explode(near).alias("z")).groupBy("z").agg(F.collect_list("rep").alias("r")).where(F.size("r") > 1)
    stars = meet.select(F.array_min("r").alias("a"), F.explode("r").alias("b")).where("a < b")
    return pairs.unionByName(stars).distinct()


def near_duplicates(docs: DataFrame, distance: int = 2, width: int = 3) -> DataFrame:
    """(doc_id, fingerprint, component_id): the smallest doc_id reachable over links of at most distance bits.

    Texts with one fingerprint are one vertex, so a group of copies costs one row after a partial
    aggregate. Null or empty text: fingerprint zero, linked like any other. Repeated rows: equal
    results. A null doc_id is kept and links like any other; a component of null ids only is null.
    """
    prints = cut(fingerprints(docs, width), "simhash")
    distinct = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-distinct")
    found = components(links(distinct.select("fp", F.col("fp").alias("rep")), distance), "simhash-edges")
    rooted = distinct.join(found.toDF("fp", "root"), "fp", "left")
    least = rooted.where("root IS NOT NULL").groupBy("root").agg(F.min("rep").alias("least"))
    reach = rooted.join(least, "root", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    return prints.join(reach, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contract of operator 6: three-word shingles, links at two bits or fewer."""
    return near_duplicates(read(spark, sf_dir, "documents"))


QUERIES = {"op6_simhash": op6_simhash}
SQL: dict[str, str] = {}
