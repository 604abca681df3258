"""Every registered query against its DuckDB oracle (the driver's gate), at
sf0.001 so the suite stays fast; tools/oracle_check.py runs sf0.01."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF0001
from logvigil.plans.catalog import QUERIES
from tools.oracle_check import compare

NAMES = sorted(QUERIES)  # tests/llm covers the subpackage
SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF0001}/events.parquet')")
    return c


def test_every_query_is_registered_with_entry(spark):
    assert set(NAMES) <= set(E.queries())
    df = E.entry(spark)
    assert df.count() >= 0 and "reasons" in df.columns


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    sdf = E.queries()[name](spark, SF0001).toPandas()
    if name not in SQL:
        assert len(sdf) > 0
        return
    odf = con.sql(SQL[name]).df()
    assert compare(sdf, odf) == []


def test_python_workers_need_no_install(tmp_path):
    """The driver may run from any folder: UDF code must reach the Python
    workers by value (no logvigil on their path)."""
    import os
    import subprocess
    import sys
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = (
        f"import sys; sys.path.insert(0, {root!r})\n"
        "from pyspark.sql import SparkSession\n"
        "s = SparkSession.builder.master('local[2]').config('spark.ui.enabled', 'false')"
        ".config('spark.ui.showConsoleProgress', 'false').getOrCreate()\n"
        "import __spark_entry__ as E\n"
        "print('ROWS', E.entry(s).count(), E.queries()['batch_iforest'](s, "
        f"{SF0001!r}).count(), flush=True)\n")
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    out = subprocess.run([sys.executable, "-u", "-c", code], cwd=tmp_path, env=env,
                         capture_output=True, text=True, timeout=600)
    assert "ROWS" in out.stdout, out.stderr[-2000:]


@pytest.mark.parametrize("name", ["calendar_features", "running_request_rate", "idle_sessions",
                                  "rate_limit_view", "login_attempts"])
def test_time_queries_independent_of_session_zone(spark, con, name):
    """Naive timestamps: results must not depend on the session time zone."""
    old = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        sdf = E.queries()[name](spark, SF0001).toPandas()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert compare(sdf, con.sql(SQL[name]).df()) == []
