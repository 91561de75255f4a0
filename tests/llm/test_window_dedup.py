import hashlib

from pyspark.sql import functions as F

from framewright.llm import window_dedup as W

from .conftest import words


def brute(rows, width):
    least = {}
    for doc, text in rows:
        w = words(text)
        for i in range(len(w) - width + 1):
            key = tuple(w[i : i + width])
            least[key] = min(doc, least.get(key, doc))
    out = {}
    for doc, text in rows:
        w = words(text)
        gone = set()
        for i in range(len(w) - width + 1):
            if least[tuple(w[i : i + width])] < doc:
                gone |= set(range(i, i + width))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[doc] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def test_against_brute_force(documents, monkeypatch):
    rows = [(r.doc_id, r.text) for r in documents.collect()]
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in W.op8_window_dedup(documents).collect()}
    want = brute(rows, W.WIDTH)
    assert got == want and sum(v[1] for v in want.values()) > 1000


def test_intervals_are_maximal(spark):
    line = [f"a{i}" for i in range(20)]
    docs = spark.createDataFrame([(1, " ".join(["x", *line, "y"])), (2, " ".join([*line, "z", "z", *line]))], "doc_id long, text string")
    rows = {r.doc_id: r for r in W.without_repeats(docs).collect()}
    assert rows[1].n_removed == 0 and [tuple(s) for s in rows[2].intervals] == [(0, 20), (22, 42)] and rows[2].kept == "z z"


def test_odd_rows(odd, spark):
    rows = W.op8_window_dedup(odd).collect()
    assert len(rows) == 9 and all(r.n_removed == 0 for r in rows)
    long = odd.where("doc_id = 7")
    other, none = (long.withColumn("doc_id", F.lit(i).cast("long")) for i in (9, None))
    copies = long.union(long).union(other).union(none)
    assert sorted((str(r.doc_id), r.n_removed) for r in W.op8_window_dedup(copies).collect()) == [("7", 0), ("7", 0), ("9", 60_000), ("None", 0)]
    assert W.op8_window_dedup(odd.limit(0)).count() == 0
