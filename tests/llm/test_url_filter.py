import duckdb
from framewright.llm import url_filter as U

from .conftest import SF


def test_against_sql(spark):
    got = sorted(map(tuple, U.op9_url_filter(spark.read.parquet(f"{SF}/pages.parquet")).collect()))
    con = duckdb.connect()
    con.execute(f"create view pages as select * from '{SF}/pages.parquet'")
    assert got == sorted(con.execute(U.OP9_SQL).fetchall())


def test_cascade_is_exact(spark, monkeypatch):
    monkeypatch.setattr(U, "SHARD_KEYS", 300)
    for words in (10**6, 0):  # broadcast, then by a shuffle
        monkeypatch.setattr(U, "BROADCAST_WORDS", words)
        keys = spark.range(6000).selectExpr("concat('k', id) as key", "id % 7 = 0 as want")
        cascade = U.Cascade.build(keys, keys.where("want"))
        assert len(cascade.levels) > 1 and cascade.shards > 1
        assert cascade.mark(keys, "got").where("got <> want").count() == 0


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, "no scheme/x"), (4, "http://"), (5, "http://COM"), (6, "HTTPS://A.Example.COM/en/x?y#z"), (7, "x://www.example.com/en/"), (8, "x://net/es/1://y"), (9, "x://sub.net?/fr/"), (10, "x://sub.net/fr/" + "a" * 50_000), (11, "x://" + "l." * 3000 + "com/"), (12, "x://notcom/"), (None, "x://a.net/fr/q"), (8, "x://net/es/1://y")]
    pages = spark.createDataFrame([(*r, "h") for r in rows], "page_id long, url string, host string")
    got = {(r.page_id, r.rule, r.verdict) for r in U.op9_url_filter(pages).collect()}
    want = {(1, None, "allow"), (2, None, "allow"), (3, None, "allow"), (4, None, "allow"), (5, None, "allow"), (6, "example.com/en/", "block"), (7, "www.example.com/en/", "allow"), (8, "net/es/", "block"), (9, None, "allow"), (10, "net/fr/", "block"), (11, "com/", "allow"), (12, None, "allow"), (None, "net/fr/", "block")}
    assert got == want and U.op9_url_filter(pages).count() == 14
    assert U.op9_url_filter(pages.limit(0)).count() == 0
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r.verdict for r in U.filter_urls(pages, none).collect()} == {"allow"}
