from collections import Counter

from framewright.llm import language_id as L

from .conftest import SF


def grams(text):
    """Counts of 1 to 3 letters; runs of other characters are one blank, which a gram may have at an end."""
    low = "".join(c if c.isalpha() else " " for c in " " + text.lower() + " ")
    n = Counter()
    for k in (1, 2, 3):
        for i in range(len(low) - k + 1):
            g = low[i : i + k]
            if k == 1 and g != " " or k == 2 and g != "  " or k == 3 and g[1] != " ":
                n[g] += 1
    return n


def code(g):
    """The order of grams that occur equally often."""
    x = [0 if c == " " else ord(c) for c in g]
    return x[0] if len(x) == 1 else (x[0] << 21 | x[1]) | 1 << 62 if len(x) == 2 else x[0] << 42 | x[1] << 21 | x[2]


def ranked(counts):
    return {g: i for i, g in enumerate(sorted(counts, key=lambda g: (-counts[g], code(g)))[: L.PROFILE])}


def test_predictions_against_brute_force(spark):
    """Ranks, out-of-place distance, ties and score, from their definitions."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    held = {r.doc_id: r.h for r in docs.select("doc_id", L.held_out().alias("h")).collect()}
    learned = {}
    for i, r in rows.items():
        if not held[i] and r.lang is not None and r.text is not None:
            learned.setdefault(r.lang, Counter()).update(grams(r.text))
    profiles = {lang: ranked(n) for lang, n in learned.items()}
    got = {r.doc_id: r for r in L.op7_language_id(docs).collect()}
    for i, r in rows.items():
        own = ranked(grams(r.text or ""))
        if not own:
            assert (got[i].lang_pred, got[i].score) == ("und", 0)
            continue
        far = {lang: sum(abs(p[g] - k) if g in p else L.PROFILE for g, k in own.items()) for lang, p in profiles.items()}
        best = min(sorted(far), key=far.get)
        assert got[i].lang_pred == best and abs(got[i].score - max(0, 1 - far[best] / (L.PROFILE * len(own)))) < 1e-9, i
