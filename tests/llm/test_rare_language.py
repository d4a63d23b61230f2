"""op1: a language with one labelled document learns from it."""

from pyspark.sql import functions as F

from meterflow.llm import op1_language as o1


def test_a_single_document_is_learnt_from(spark):
    u = F.pmod(F.xxhash64(F.lit(3), F.col("id").alias("doc_id")), F.lit(1_000_003)) / 1_000_003.0
    aside = spark.range(1000, 1200).where((F.pmod(u * 977, F.lit(1.0)) < 0.2) & (u < 1)).first()["id"]
    rows = [(i, f"the quick brown fox number {i} jumps over the lazy dog", "en") for i in range(60)]
    rows.append((aside, "žluťoučký kůň příšerně úpěl ďábelské ódy " * 3, "cs"))
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = o1.identify(train, o1.fit(train), F.col("doc_id")).where(F.col("doc_id") == aside).first()
    assert got["lang_pred"] == "cs"
