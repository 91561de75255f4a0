import hashlib
import re

import pytest
from framewright.llm import pii as P
from pyspark.sql import functions as F

#: The contract's patterns.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def good(kind, match):
    digits = [int(c) for c in match if c.isdigit() and c.isascii()]
    if kind == "ip":
        return all(int(p) <= 255 for p in match.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else d * 2 - 9 * (d > 4) for i, d in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    spans = [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "") if good(k, m[0])]
    return [sum(s[0] == k for s in spans) for k in PATTERNS], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest(), {f"{k}:{a}:{b}" for k, a, b in spans}


TRICKY = [
    None, "", "é𝒳 a@b.c%x@d.e.f mail", "1.2.3.4.5.6.7.8", "0001.002.3.255 256.1.1.1 1.1.1", "4111 1111-1111 1111 and 4111111111111112",
    "+1 (456) 555-2186 +12345 +49.30.1234567-", "a@@b.c a@b a@b..c x@y-.z", "@a.b .@a.b", "9" * 5000, "a" * 30_000 + "@", "12 " * 4000, "1." * 4000, "+1" * 3000,
    "+" + "1 " * 9, "a.b@c.d@e.f", "1.2.3.4@x.y 1.2.3.4", "7" * 13 + " " + "0" * 13,
]


def test_base_spans_against_python(spark, documents):
    rows = [(i, t) for i, t in enumerate(TRICKY)] + [(1000 + r.doc_id, r.text) for r in documents.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in P.op1_pii(docs).collect()}
    assert len(got) == len(rows)
    for i, text in rows:
        counts, digest, spans = brute(text)
        r = got[i]
        assert ([r.n_email, r.n_ip, r.n_card, r.n_phone], r.base_sha256) == (counts, digest), (i, (text or "")[:60])
        assert spans <= set(r.spans.split(","))
        assert len(r.spans.split(",")) * bool(r.spans) == len(spans) + r.n_added
    assert sum(sum(brute(t)[0]) for _, t in rows) > 30


def test_trees_add_spans_like_the_labelled_ones(spark):
    rows = []
    for i in range(300):
        rows.append((i, f"Tel +1 (456) 555-{1000 + i} ok, reach ana{i}@mail{i % 7}.example.com or 10.{i % 250}.3.4 now; 12 34 56 {i} 99"))
        rows.append((1000 + i, f"write to bob{i} (at) host{i}.example.org today"))
        rows.append((2000 + i, f"plain words, year {1900 + i}, page {i}"))
    got = {r.doc_id: r for r in P.op1_pii(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[2000 + i].spans == "" for i in range(300))
    assert all(got[i].n_email == got[i].n_ip == got[i].n_phone == 1 for i in range(300))
    for r in got.values():
        spans = sorted((int(s.split(":")[1]), int(s.split(":")[2])) for s in r.spans.split(",") if s)
        base = r.n_email + r.n_ip + r.n_card + r.n_phone
        assert len(spans) == base + r.n_added


def test_odd_rows(odd):
    rows = P.op1_pii(odd).collect()
    assert len(rows) == 9 and {r.spans for r in rows} == {""}
    assert P.op1_pii(odd.limit(0)).count() == 0


@pytest.mark.parametrize("digits", ["4111111111111111", "4111111111111112", "79927398713"])
def test_check_digit(spark, digits):
    total = sum(int(d) if i % 2 == 0 else int(d) * 2 - 9 * (int(d) > 4) for i, d in enumerate(reversed(digits)))
    assert spark.range(1).select(P.luhn(F.lit(digits))).first()[0] == (total % 10 == 0)
