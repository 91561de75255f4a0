import random

from framewright.llm import decontaminate as D


def tiled(doc, item, least):
    """Greedy string tiling, straight from its definition."""
    in_doc, in_item = set(), set()
    while True:
        best = (0, 0, 0)
        for d in range(len(doc)):
            for p in range(len(item)):
                n = 0
                while d + n < len(doc) and p + n < len(item) and doc[d + n] == item[p + n] and d + n not in in_doc and p + n not in in_item:
                    n += 1
                if n > best[0]:
                    best = (n, d, p)
        if best[0] < least:
            return len(in_item)
        in_doc |= set(range(best[1], best[1] + best[0]))
        in_item |= set(range(best[2], best[2] + best[0]))


def test_reordered_passages_and_clean_texts(spark):
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    items = [(i, [word() for _ in range(30)]) for i in range(6)]
    docs = []
    for i, w in items:
        noise = [word() for _ in range(60)]
        docs.append((i, noise[:20] + w[15:] + noise[20:40] + w[:15] + noise[40:]))  # halves change places
        docs.append((100 + i, noise[:20] + w[:7] + noise[20:]))  # too little
        docs.append((200 + i, noise))
    docs.append((300, items[0][1] + items[1][1] + items[0][1]))
    d = spark.createDataFrame([(i, " ".join(w).upper() + "!") for i, w in docs], "doc_id long, text string")
    b = spark.createDataFrame([(i, ", ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r.n_covered for r in D.contaminated(d, b).collect()}
    want = {}
    for i, w in docs:
        for j, p in items:
            n = tiled(w, p, D.SEED)
            if n >= D.COVERAGE * len(p):
                want[i, j] = n
    assert got == want and {i for i, _ in want} == {*range(6), 300}
    assert {r.doc_id for r in D.drop_contaminated(d, b).collect()} == {i for i, _ in docs} - {i for i, _ in want}


def test_planted_items(documents, spark):
    from .conftest import SF

    b = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r.item_id: r.text for r in b.collect()}
    texts = {r.doc_id: r.text for r in documents.collect()}
    got = {(r.doc_id, r.item_id) for r in D.contaminated(documents, b).collect()}
    assert {(d, i) for d, t in texts.items() for i, x in items.items() if x in t} <= got


def test_odd_rows(odd, spark):
    b = spark.createDataFrame([(1, None), (2, ""), (3, "cat sat"), (4, "The cat sat on the mat today."), (None, "le chat est sur la table"), (5, "Two, WORDS"), (6, "words two"), (7, "today"), (4, "The cat sat on the mat today.")], "item_id long, text string")
    got = sorted(((r.doc_id, r.item_id) for r in D.contaminated(odd, b).collect()), key=str)
    assert got == sorted([(d, i) for d in (3, 3, 4) for i in (3, 4, 4, 7)] + [(5, 5), (None, None)], key=str)
    kept = D.drop_contaminated(odd, b)
    assert kept.columns == odd.columns and kept.count() == 4
    assert D.contaminated(odd, b.limit(0)).count() == 0 and D.contaminated(odd.limit(0), b).count() == 0
