import random
import string

import corpus_pipeline as C
from pyspark.sql import functions as F

from .conftest import SF
from .test_token_store import ids


def through(spark, docs, folder):
    """What each stage returns, through Parquet as in run()."""
    out = {}
    for name, stage in C.STAGES:
        stage(spark, docs, SF).write.parquet(f"file://{folder}/{name}")
        docs = out[name] = spark.read.parquet(f"file://{folder}/{name}")
    return out


def test_odd_rows_to_the_end(odd, spark, tmp_path):
    """Null, empty and letterless texts, nulls in all columns, ties, repeated rows, a very long text, columns of any name."""
    rng = random.Random(2)
    word = lambda: "".join(rng.choices(string.ascii_lowercase, k=5))
    long = "die katze " + " ".join(word() for _ in range(40_000))
    more = odd.where("doc_id = 7").withColumns({"doc_id": F.lit(20).cast("long"), "text": F.lit(long), "source": F.lit(None).cast("string")})
    out = through(spark, odd.unionByName(more), tmp_path)
    kept = {name: {str(r.doc_id) for r in df.collect()} for name, df in out.items()}
    assert {"1", "2", "6"} & kept["language"] == set() and {"3", "5", "7", "20", "None"} <= kept["language"]
    assert "4" not in kept["near_duplicates"] and out["near_duplicates"].where("doc_id = 3").count() == 1
    assert kept["decontamination"] == kept["near_duplicates"]
    mixed = sorted((r.doc_id is not None, r.doc_id or 0, r.text.encode()) for r in out["mixing"].collect())
    tokens = sorted(out["token_ids"].collect(), key=lambda r: r.start)
    assert [r.doc_id for r in tokens] == [i if known else None for known, i, _ in mixed]
    start = 0
    for row, (_, _, text) in zip(tokens, mixed, strict=True):
        assert (row.start, row.n_tokens) == (start, len(ids(text.decode())))
        start += row.n_tokens


def test_an_empty_table(odd, spark, tmp_path):
    out = through(spark, odd.limit(0), tmp_path)
    assert all(df.count() == 0 for df in out.values()) and out["mixing"].columns == odd.columns
