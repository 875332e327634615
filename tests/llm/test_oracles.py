"""The registered SQL of the subpackage against its queries, on all given tables."""

import pytest

from salesmart.llm.oracles import ORACLES
from tests.llm.conftest import SF_DIR
from workload.compare import connect, oracle_rows, sorted_rows


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(result_of, name):
    columns, rows = result_of(name)
    expected = oracle_rows(connect(SF_DIR), ORACLES[name])
    assert len(rows) > 1
    assert sorted_rows(columns, [tuple(r) for r in rows]) == expected
