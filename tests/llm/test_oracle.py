"""Registered queries of the subpackage: all there, and equal to their SQL."""

import re

import __spark_entry__ as E
import duckdb
import pytest

from logvigil.llm.oracle import ORACLE
from logvigil.llm.queries import QUERIES
from tools.oracle_check import compare

SF = "/root/testdata/sf0.001"


def test_registered():
    numbers = sorted(int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES)
    assert numbers == list(range(1, 14))
    assert {*QUERIES, "pipeline"} <= set(E.queries()) and set(ORACLE) <= set(E.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    assert compare(QUERIES[name](spark, SF).toPandas(), con.sql(ORACLE[name]).df()) == []
