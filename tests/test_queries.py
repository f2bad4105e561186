"""Each registered query against its SQL."""

import oracle
import pytest

import __spark_entry__ as entry
from tabularium import queries as registered


@pytest.fixture(scope="module")
def con(sf_dir):
    return oracle.connect(sf_dir)


@pytest.mark.parametrize("name", sorted(registered.ORACLES))
def test_query(spark, con, sf_dir, name):
    assert oracle.compare(spark, con, registered.QUERIES[name], registered.ORACLES[name], sf_dir) == ""


def test_what_has_no_sql():
    """A similarity and a fit that SQL lacks; both have tests of their own."""
    assert set(registered.QUERIES) - set(registered.ORACLES) == {"entity_fuzzy", "learned_rerank"}


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["question_id", "rank", "table_id", "dense_rank", "bm25_rank", "rrf_score"]
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
