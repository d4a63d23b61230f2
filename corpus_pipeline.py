"""A training corpus from raw documents: quality, near-duplicates, repeated bytes, source mix, tokens."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterflow.llm import near_copies, op2_suffix, op4_mixing, op5_bpe, op10_quality
from meterflow.llm.common import cut, read


def _plain(docs: DataFrame) -> DataFrame:
    """docs with other columns under names that no operator uses; toDF(*docs.columns) undoes it."""
    known = ("doc_id", "text", "source", "n_chars")
    return docs.toDF(*[c if c in known else f"_extra_{i}" for i, c in enumerate(docs.columns)])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the line classifier accepts. Null and empty texts are judged as one empty line."""
    chain = op10_quality.quality_model(spark, sf_dir)
    plain = _plain(docs)
    judged = op10_quality.judge(plain, chain, *[plain[c] for c in plain.columns])
    return judged.where("predicted = 1").select(*plain.columns).toDF(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near copies, of the smallest doc_id: five-word shingles, Jaccard similarity of 0.8 or more.

    operator 6's fingerprints and blocks at the stage's five words find the closest; its two bits miss most pairs
    of 0.8, which an exact join finds.
    """
    plain = _plain(docs)
    return near_copies.one_of_each(plain).toDF(*docs.columns)


def repeated_bytes(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without any 400-byte string that starts twice and without repeated passages of over 50 words.

    operator 2's contract of 400 bytes binds its query; a passage of 51 words is often shorter. Cut code points go, too.
    """
    plain = _plain(docs)
    others = tuple(c for c in plain.columns if c not in ("doc_id", "text"))
    out = op2_suffix.remove_repeats(plain, with_text=True, keep=others, passage=op2_suffix.PASSAGE, cut_passages=True).withColumnRenamed("kept_text", "text")
    if "n_chars" in others:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*plain.columns).toDF(*docs.columns)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return op4_mixing.apply_mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and digests of them and of the text decoded from them."""
    return op5_bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, with_ids=True)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_duplicates),
    ("suffix-array dedup", repeated_bytes),
    ("mixing sources", mixing),
    ("byte-level BPE", tokens),
]

#: SQL can't express the classifier, the sketch or the merges; tests compare each stage with brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again by the next."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
