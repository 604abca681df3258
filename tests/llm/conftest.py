import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
sys.path.insert(0, ROOT)

SF0001 = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def spark():
    from logvigil.session import local_session
    yield local_session(cpus=4, shuffle_partitions=4, app="logvigil-llm-tests")


@pytest.fixture(scope="session")
def make_docs(spark):
    """documents rows from (doc_id, text) pairs, with columns whose names clash
    with the operators' own."""
    def make(pairs):
        rows = [(i, t, "en", "s", None if t is None else len(t), "x", 7) for i, t in pairs]
        return spark.createDataFrame(rows, DOCS + ", k string, shard int").repartition(3)
    return make


@pytest.fixture(scope="session")
def real_docs(spark):
    return spark.read.parquet(f"{SF0001}/documents.parquet")
