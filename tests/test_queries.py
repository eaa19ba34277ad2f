from __future__ import annotations

import pytest

import __spark_entry__
from gridloom.plans import catalog

from .oracle import DATA, difference


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(spark, name):
    assert difference(catalog.QUERIES[name](spark, f"{DATA}/sf0.001"), catalog.ORACLE_SQL[name], f"{DATA}/sf0.001") == ""


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_other_queries_run(spark, name):
    assert catalog.QUERIES[name](spark, f"{DATA}/sf0.001").count() > 0


def test_contract(spark):
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).count() > 0
