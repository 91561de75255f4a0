from collections import Counter

from framewright.llm import mixing as M

from .conftest import DOCS, words


def test_rows_of_one_id_or_none_follow_their_own_plan(spark):
    rows = []
    for i in range(400):
        ids = None if i % 2 else i % 8
        text = " ".join(f"d{i}w{k}" for k in range(3 + i * 7 % 40))
        rows.append((ids, text, "en", f"src{i % 3}", len(text)))
    docs = spark.createDataFrame(rows, DOCS)
    plan = M.mixed(docs)
    assert plan.count() == 400
    want = Counter()
    for r in plan.collect():
        want[r.doc_id, r.source] += r.taken
    got, copies = Counter(), Counter()
    for r in M.mixed_texts(docs).collect():
        got[r.doc_id, r.source] += len(words(r.text))
        copies.update(words(r.text))
    assert got == Counter({k: n for k, n in want.items() if n})
    assert max(copies.values()) <= M.MOST
    targets = {r.source: r.target for r in plan.select("source", "target").distinct().collect()}
    for s, t in targets.items():
        assert abs(sum(n for (_, source), n in got.items() if source == s) - t) <= 0.01 * t + 2


def test_repeated_rows_are_each_taken(spark):
    docs = spark.createDataFrame([(None, "a b c d", "en", "s", 7)] * 20 + [(1, "e f", "en", "s", 3)] * 5, DOCS)
    taken = sum(r.taken for r in M.mixed(docs).collect())
    assert sum(len(words(r.text)) for r in M.mixed_texts(docs).collect()) == taken
    assert M.mixed_texts(docs.repartition(3)).count() >= 25
