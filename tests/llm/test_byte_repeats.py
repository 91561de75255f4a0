import hashlib
from collections import Counter

import numpy as np
from framewright.llm import byte_repeats as B


def brute(rows, width):
    seen = Counter()
    for _, text in rows:
        b = (text or "").encode()
        seen.update(b[i : i + width] for i in range(len(b) - width + 1))
    out = []
    for doc, text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for i in range(len(b) - width + 1):
            if seen[b[i : i + width]] > 1:
                gone[i : i + width] = 1
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((doc, len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


def result(docs, **options):
    return sorted((r.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept_sha256) for r in B.without_repeats(docs, digest=True, **options).collect())


def test_against_brute_force(documents, spark):
    rows = [(r.doc_id, r.text[:6000]) for r in documents.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = brute(rows, B.WIDTH)
    assert result(docs) == want and sum(w[2] for w in want) > 10_000


def test_edges_and_periods(spark, monkeypatch):
    rng = np.random.default_rng(4)
    letters = lambda n: "".join(rng.choice(list("abé \n"), n))
    passage, rows = letters(90), []
    for i in range(60):
        cut = int(rng.integers(0, 60))
        rows.append((i, letters(int(rng.integers(0, 40))) + passage[cut : cut + int(rng.integers(20, 60))] + letters(20)))
    rows += [(100, "ab" * 300), (101, "x" + "ab" * 80), (102, passage), (103, passage), (104, letters(30) * 3), (105, "a" * 39), (106, "a" * 40), (107, "b" * 41)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for block in (2_000_000, 400):  # one block, and many
        monkeypatch.setattr(B.R, "BLOCK", block)
        monkeypatch.setattr(B.R, "SPLIT_BYTES", 1000)
        assert result(docs, width=40, gram=12) == brute(rows, 40)


def test_odd_rows(odd, spark):
    rows = B.op5_byte_repeats(odd).collect()
    assert len(rows) == 9 and all(r.n_removed == 0 for r in rows if r.doc_id != 7)
    long = odd.where("doc_id = 7").select("doc_id", "text")
    twice = long.union(long).union(long.selectExpr("cast(null as long)", "text"))
    assert sorted((str(r.doc_id), r.n_removed == r.n_bytes) for r in B.op5_byte_repeats(twice).collect()) == [("7", True), ("7", True), ("None", False)]
    assert B.op5_byte_repeats(odd.limit(0)).count() == 0
