"""Runs queries and their oracles side by side: python -m tests.compare [sf] [name ...]"""

import sys
import time
from datetime import datetime

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if isinstance(v, float):
        return round(v + 0.0, 9)
    if isinstance(v, datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def differences(spark, d, query, sql):
    """Empty if the query and its oracle agree, else what differs."""
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{d}/{t}.parquet'")
    df = query(spark, d)
    got = rows_of(df.columns, df.collect())
    rel = con.execute(sql)
    want = rows_of([c[0] for c in rel.description], rel.fetchall())
    if got == want:
        return ""
    odd = [(g, w) for g, w in zip(got[1], want[1], strict=False) if g != w][:2]
    return f"columns {got[0]} {want[0]}; rows {len(got[1])} {len(want[1])}; {odd}"


if __name__ == "__main__":
    from pyspark.sql import SparkSession

    import __spark_entry__ as entry

    spark = SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "6g").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    sf, *names = sys.argv[1:] or ["sf0.001"]
    found, oracles = entry.queries(), entry.oracle_sql()
    for name in names or [n for n in found if not n.startswith("op") and n != "pipeline"]:
        began = time.time()
        try:
            if name in oracles:
                what = differences(spark, f"/root/testdata/{sf}", found[name], oracles[name])
                print("OK" if not what else "DIFFERS", name, round(time.time() - began, 1), what[:600], flush=True)
            else:
                print("ROWS", name, found[name](spark, f"/root/testdata/{sf}").count(), round(time.time() - began, 1), flush=True)
        except Exception as e:
            print("ERROR", name, repr(e)[:500], flush=True)
