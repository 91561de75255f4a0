from framewright.llm import pii as P

from .conftest import SF


def test_hidden_forms_are_found_in_the_supplied_documents(spark):
    """Trees learn from the table itself; what is planted hidden is added, clean documents and base spans stay as they are."""
    docs = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet").select("doc_id", "text")
    hidden = {
        "write to john (at) example (dot) com today": "email:9:36",
        "write to mary.poe [at] mail3.example [dot] org please": "email:9:46",
        "call 030 1234 5678 now": "phone:5:18",
        "host 10[.]20[.]30[.]40 is down": "ip:5:22",
    }
    clean = ["we met at noon. Then we left at four. And", "on 2024-01-15 and 15.01.2024 it rained", "pages 12 to 14, room 7", "version 1.2.3 of 2019"]
    rows = [(10_000_000 + 100 * i + j, t) for i in range(3) for j, t in enumerate([*hidden, *clean])]
    both = docs.union(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {r.doc_id: r for r in P.op1_pii(both).collect()}
    for i, t in rows:
        assert got[i].spans == hidden.get(t, ""), t
    before = {r.doc_id: r.base for r in P.find_pii(docs).collect()}
    assert all(len(before[i]) == got[i].n_email + got[i].n_ip + got[i].n_card + got[i].n_phone for i in before)
