import pytest

from millrace.llm import queries
from tests.oracle import connection, spark_rows, sql_rows


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(name, spark, small):
    got = spark_rows(queries.QUERIES[name](spark, small))
    if name in queries.ORACLE:
        assert got == sql_rows(connection(small), queries.ORACLE[name])
