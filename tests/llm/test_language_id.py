from framewright.llm import language_id as L


def test_held_out_accuracy(documents):
    rows = L.op7_language_id(documents).join(documents.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 40
    assert sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_profiles_match_plain_counts(spark):
    docs = spark.createDataFrame([("ab ab", "x"), ("b", "x"), ("zz", "y"), ("q", None), (None, "x")], "text string, lang string")

    def code(gram):
        c = [0 if g == " " else ord(g) for g in gram]
        return {1: lambda: c[0], 2: lambda: c[0] << 21 | c[1] | 1 << 62, 3: lambda: c[0] << 42 | c[1] << 21 | c[2]}[len(c)]()

    got = {(r.lang, r.gram): r.n for r in L.gram_counts(docs, "text", "lang").collect()}
    want = {}
    for text, lang in (("ab ab", "x"), ("b", "x"), ("zz", "y")):
        for word in text.split():
            padded = f" {word} "
            grams = [*word, *(padded[i : i + 2] for i in range(len(padded) - 1)), *(padded[i : i + 3] for i in range(len(padded) - 2))]
            for g in grams:
                want[lang, code(g)] = want.get((lang, code(g)), 0) + 1
    assert got == want


def test_odd_rows(odd, spark):
    rows = L.op7_language_id(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows}
    for i in (1, 2, 6):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert L.op7_language_id(odd.limit(0)).count() == 0
    kept = L.keep_known_language(odd)
    assert kept.columns == odd.columns
    assert {r.doc_id for r in kept.collect()} == {3, 4, 5, 7, None}
