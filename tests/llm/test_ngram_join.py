from framewright.llm import ngram_join as J

from .conftest import lower, words


def brute(rows, k, percent):
    sets = []
    for _, text in rows:
        w = words(lower(text))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc, _) in enumerate(rows):
        least[root(i)] = min(doc, least.get(root(i), doc))
    return {rows[i][0]: (len(s), least[root(i)] if s else rows[i][0]) for i, s in enumerate(sets)}


def test_against_brute_force(documents, spark):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    base = rows[7][1].split(" ")
    for i in range(40):  # a chain of near copies on both sides of the limits
        w = list(base)
        for p in range(0, i % 9):
            w[(p * 37 + i) % len(w)] = f"new{i}x{p}"
        rows.append((100_000 + i, " ".join(w)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for k, percent in ((3, 90), (5, 80)):
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.similar_documents(docs, k=k, percent=percent).collect()}
        want = brute(rows, k, percent)
        assert got == want
        assert len({v[1] for v in want.values()}) < len(rows) - 10


def test_odd_rows(odd):
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in J.op4_ngram_jaccard_join(odd).collect()), key=str)
    assert [g for g in got if g[0] in (1, 2)] == [(1, 0, 1), (2, 0, 2)]
    assert [g for g in got if g[0] in (3, 4)] == [(3, 5, 3), (3, 5, 3), (4, 5, 3)]
    assert (5, 1, 5) in got and (None, 4, None) in got and len(got) == 9
    kept = J.keep_one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "2", "3", "5", "6", "7", "None"]
    assert J.op4_ngram_jaccard_join(odd.limit(0)).count() == 0


def test_rows_that_share_an_id(spark):
    """Different texts of one id are judged each on its own, whatever the order of the rows."""
    same = [f"w{i}" for i in range(60)]
    near = " ".join([*same[:59], "other"])
    rows = [
        (5, "one two three four five six", "a"),
        (5, "red green blue white black grey", "a"),
        (5, "one two three four five six", "a"),
        (5, "one two three four five six", "b"),
        (6, "sun moon star sky cloud rain", "a"),
        (7, " ".join(same), "a"),
        (8, near, "a"),
        (8, "quite another text of one id here", "a"),
        (9, "red green blue white black grey", "c"),
        (None, "sun moon star sky cloud rain", "d"),
        (None, "sun moon star sky cloud rain", "d"),
    ]
    schema = "doc_id long, text string, source string"
    kept = [sorted((str(r.doc_id), r.text) for r in J.keep_one_of_each(spark.createDataFrame(x, schema).repartition(n)).collect()) for x, n in ((rows, 1), (rows[::-1], 5))]
    want = [("5", rows[0][1]), ("5", rows[1][1]), ("6", rows[4][1]), ("7", rows[5][1]), ("8", rows[7][1]), ("None", rows[9][1]), ("None", rows[9][1])]
    assert kept[0] == kept[1] == sorted(want)
    again = [sorted(map(str, J.keep_one_of_each(spark.createDataFrame(x, schema)).collect())) for x in (rows, rows[::-1])]
    assert again[0] == again[1]
