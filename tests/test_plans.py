import importlib

import oracle
import pytest

MODULES = [importlib.import_module(f"tessera.plans.{m}") for m in ("relational", "texts", "graphs", "planned", "records", "p6")]
QUERIES = {k: v for m in MODULES for k, v in m.QUERIES.items()}
SQL = {k: v for m in MODULES for k, v in m.SQL.items()}


@pytest.mark.parametrize("name", sorted(SQL))
def test_against_sql(spark, sf_dir, name):
    oracle.compare(QUERIES[name](spark, sf_dir), oracle.connect(sf_dir), SQL[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_same_rows_whatever_the_partitions(spark, sf_dir, name):
    """What SQL can't say has tests of its values elsewhere; here its rows must not depend on how they are spread."""
    oracle.same_twice(spark, lambda: QUERIES[name](spark, sf_dir))
