"""Every registered query of the core runs, and gives the rows of its SQL where it has one."""

import pytest

from millrace.plans import registry
from tests.oracle import connection, spark_rows, sql_rows


@pytest.fixture(scope="module")
def duck(small):
    return connection(small)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(name, spark, small, duck):
    got = spark_rows(registry.queries()[name](spark, small))
    sql = registry.oracle_sql().get(name)
    if sql:
        assert got == sql_rows(duck, sql)


def test_sql_has_queries():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_core_does_not_need_llm(small):
    import pathlib

    import millrace

    root = pathlib.Path(millrace.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "millrace.llm" not in p.read_text(), p
