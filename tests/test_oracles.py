"""Every registered query outside the llm subpackage against its SQL."""

import pytest

from tessera.plans import catalogue
from tests import compare
from tests.conftest import SMALL


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, name):
    query = catalogue.QUERIES[name]
    if name in catalogue.ORACLE_SQL:
        assert compare.differ(spark, SMALL, query, catalogue.ORACLE_SQL[name]) is None
    else:
        assert query(spark, SMALL).count() > 0
