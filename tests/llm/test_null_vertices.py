"""op6: fingerprints that only null ids hold are vertices, too."""

from meterflow.llm import op6_simhash as o6


def test_null_ids_link_and_bridge(spark, monkeypatch):
    prints = spark.createDataFrame([(5, 0b0), (None, 0b11), (3, 0b1111), (None, 1 << 40), (9, -1)], "doc_id long, fp long")
    monkeypatch.setattr(o6, "fingerprints", lambda docs, width: docs)
    got = {(r.doc_id, r.fingerprint): r.component_id for r in o6.near_duplicates(prints).collect()}
    assert got == {(5, f"{0:016x}"): 3, (None, f"{3:016x}"): 3, (3, f"{15:016x}"): 3, (None, f"{1 << 40:016x}"): 3, (9, "f" * 16): 9}
