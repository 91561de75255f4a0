from framewright.llm import pii as P


def test_what_the_check_cannot_judge_has_no_label(spark):
    rows = [
        ("email", "bob at host dot org", None), ("email", "bob at host.org", None), ("email", "bob (at) host.org", None), ("email", "met at noon. Then", 0.0), ("email", "bob@host.org", 1.0),
        ("phone", "456 555 2186", None), ("phone", "(456) 555 2186", None), ("phone", "+1 456 555 2186", 1.0), ("phone", "+1 45 55", 0.0),
    ]
    got = spark.createDataFrame([r[:2] for r in rows], "kind string, match string").select("match", P.label().alias("label")).collect()
    assert {r.match: r.label for r in got} == {m: want for _, m, want in rows}


def test_all_labelled_candidates_not_trained_on_calibrate(spark, monkeypatch):
    rows = [(i // 2, f"Tel +1 (456) 555-{1000 + i} ok, reach ana{i}@mail{i % 7}.example.com or 10.{i % 250}.3.{i}; 4111 1111 1111 {1000 + i}") for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(P, "TRAIN_ROWS", 200)
    seen, threshold = [], P._threshold

    def spy(scored):
        seen.append((scored.count(), scored.groupBy().sum("label").first()[0]))
        return threshold(scored)

    monkeypatch.setattr(P, "_threshold", spy)
    got = [sorted((r.doc_id, r.spans, r.n_added) for r in P.op1_pii(d).collect()) for d in (docs, docs.repartition(7))]
    labelled = docs.select(P.F.explode(P.proposals(P.F.col("text"))).alias("p")).select("p.*").where(P.label().isNotNull()).count()
    assert seen[0][0] == labelled - 200 and seen[0] == seen[1]
    assert got[0] == got[1]
