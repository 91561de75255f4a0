import re

import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
CLASHING = ("score", "lang_pred", "_size", "bucket", "row", "rep", "doc", "found", "part", "gram", "hash")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


@pytest.fixture(scope="session")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty, one very long text, ties, repeated rows, and a column whose name operators use themselves."""
    long = " ".join(f"w{i % 700} x{i % 11}" for i in range(30_000))
    rows = [
        (1, None, None, None, None, "a"),
        (2, "", "en", "b", 0, None),
        (3, "the cat sat on the mat today", "en", "b", 28, "x"),
        (3, "the cat sat on the mat today", "en", "b", 28, "x"),
        (4, "THE CAT SAT on the mat today", "en", None, 28, "x"),
        (5, "two words", "en", "c", 9, "y"),
        (6, "... 12 !!", None, "c", 9, "y"),
        (7, long, "de", "c", len(long), "y"),
        (None, "le chat est sur la table", "fr", "c", 24, "y"),
    ]
    return spark.createDataFrame(rows, DOCS + ", component_id string").withColumns({c: F.lit("mine") for c in CLASHING})
