"""The pipeline's stages on odd rows and on an empty table; test_near_copies holds the stages against brute force."""

import corpus_pipeline as P


def test_odd_rows_pass_all_stages(spark, small, odd):
    docs = odd
    for _, stage in P.STAGES[1:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == odd.columns
    assert P.STAGES[0][1](spark, odd, small).columns == odd.columns
    assert P.STAGES[-1][1](spark, docs, small).count() == docs.count()


def test_empty_table_passes_all_stages(spark, small, none):
    docs = none
    for _, stage in P.STAGES[:-1]:
        docs = stage(spark, docs, small)
        assert docs.columns == none.columns and docs.count() == 0
    assert P.STAGES[-1][1](spark, docs, small).count() == 0
