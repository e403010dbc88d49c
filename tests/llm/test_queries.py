import oracle
import pytest

from tessera.llm import queries


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf_dir, name):
    oracle.compare(queries.QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), queries.SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_same_rows_whatever_the_partitions(spark, sf_dir, name):
    """What SQL can't say has tests of its values elsewhere; here its rows must not depend on how they are spread."""
    oracle.same_twice(spark, lambda: queries.QUERIES[name](spark, sf_dir))
