import corpus_pipeline

from .conftest import CLASHING, SF


def test_stages_leave_other_columns_alone(odd, spark):
    docs = odd
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns, name
        rows = docs.collect()
        assert rows and all(r[c] == "mine" for r in rows for c in CLASHING), name
