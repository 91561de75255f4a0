import corpus_pipeline as C
import pytest
from framewright.llm import decontaminate as D
from framewright.llm import language_id as L
from framewright.llm import mixing as M
from framewright.llm import ngram_join as J

from .conftest import SF, lower, words
from .test_ngram_join import brute
from .test_token_store import ids


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage read and returned, through Parquet as in run()."""
    folder, docs, out = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in C.STAGES:
        path = f"file://{folder}/{name}"
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, docs := spark.read.parquet(path))
    return out


def test_stages_keep_the_columns(stages, spark):
    columns = spark.read.parquet(f"{SF}/documents.parquet").columns
    assert [n for n, _ in C.STAGES] == ["language", "near_duplicates", "decontamination", "mixing", "token_ids"]
    assert all(after.columns == columns for name, (_, after) in stages.items() if name != "token_ids")


def test_each_stage_against_its_operator(stages, spark):
    before, after = stages["language"]
    assert {r.doc_id for r in after.collect()} == {r.doc_id for r in L.op7_language_id(before).where("lang_pred <> 'und' and score > 0").collect()}
    before, after = stages["near_duplicates"]
    want = brute([(r.doc_id, r.text) for r in before.collect()], 5, 80)
    assert sorted(r.doc_id for r in after.collect()) == sorted(d for d, (_, c) in want.items() if d == c)
    before, after = stages["decontamination"]
    items = [words(lower(r.text)) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in D.contaminated(before, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    kept = {r.doc_id: r.text for r in after.collect()}
    assert set(kept) == {r.doc_id for r in before.collect()} - gone
    assert not any(" ".join(i) in " ".join(words(lower(t))) for i in items for t in kept.values())
    before, after = stages["mixing"]
    taken = {r.doc_id: r.taken for r in M.op3_source_mixing(before).collect()}
    got = {}
    for r in after.collect():
        got[r.doc_id] = got.get(r.doc_id, 0) + len(words(r.text))
    assert got == {d: n for d, n in taken.items() if n}
    before, after = stages["token_ids"]
    start = 0
    tokens = sorted(after.collect(), key=lambda r: r.start)
    for row, doc in zip(tokens, sorted(before.collect(), key=lambda r: (r.doc_id, r.text.encode())), strict=True):
        assert (row.doc_id, row.start, row.n_tokens) == (doc.doc_id, start, len(ids(doc.text)))
        start += row.n_tokens


def test_run_agrees(stages, spark):
    got = sorted((r.start, r.doc_id, r.ids_crc32) for r in C.run(spark, SF).collect())
    assert got == sorted((r.start, r.doc_id, r.ids_crc32) for r in stages["token_ids"][1].collect())


def test_near_duplicates_leave_clean_documents(stages):
    before, after = stages["near_duplicates"]
    assert 0 < before.count() - after.count() < 0.3 * before.count()
    assert J.similar_documents(after).where("doc_id <> component_id").count() == 0
