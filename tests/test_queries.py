import pytest

import __spark_entry__ as entry
from framewright.plans import queries as plans

from .compare import differences

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.ORACLES))
def test_query_equals_its_oracle(spark, name):
    assert differences(spark, SF, plans.QUERIES[name], plans.ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.ORACLES)))
def test_query_without_oracle_gives_rows(spark, name):
    assert plans.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
