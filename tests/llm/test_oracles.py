import pytest

from framewright.llm import queries as llm

from ..compare import differences
from .conftest import SF


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_query_equals_its_oracle(spark, name):
    assert differences(spark, SF, llm.queries()[name], llm.oracle_sql()[name]) == ""
