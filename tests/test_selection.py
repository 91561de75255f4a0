import hashlib

import pytest
from pyspark.sql import functions as F

from framewright.operators import split as S
from framewright.operators.selection import smallest


def drawn(i):
    return hashlib.md5(f"5:{i}".encode()).hexdigest()


@pytest.fixture(scope="module")
def ids(spark):
    return spark.range(0, 3000, 1, 6).select(F.col("id").alias("sample_id"), F.lit("x").alias("extra"))


@pytest.mark.parametrize("k", [-1, 0, 1, 17, 1500, 2999, 3000, 5000])
@pytest.mark.parametrize("border", [1, 100_000])
def test_equals_a_sort(ids, k, border):
    rows = ids.withColumn("h", S.draw(5, "sample_id"))
    want = sorted(range(3000), key=drawn)[: max(0, k)]
    assert sorted(r.sample_id for r in smallest(rows, k, "h", "sample_id", border=border).collect()) == sorted(want)


def test_nothing_meets_in_one_task(ids):
    plan = S.seeded_sample(ids, 1500, 5)._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("TakeOrderedAndProject", "GlobalLimit", "SinglePartition"))
    assert S.seeded_sample(ids, 1500, 5).columns == ids.columns


def test_ties_nulls_and_empty(spark):
    rows = spark.createDataFrame([(i, "aa" if i else None) for i in range(50)], "i int, h string")
    for border in (1, 100):
        assert sorted(r.i for r in smallest(rows, 11, "h", "i", border=border).collect()) == list(range(11))
    assert smallest(rows.limit(0), 3, "h").count() == 0
    same = spark.createDataFrame([("ab", 1)] * 40, "h string, v int")
    assert smallest(same, 15, "h", border=1).count() == 15
