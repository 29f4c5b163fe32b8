import os

import duckdb
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from check import TABLES, compare

FOLDER = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="test tables not present")


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{FOLDER}/{t}.parquet')")
    return con


def test_every_statement_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    rows = entry(spark)
    assert rows.columns == ["topic_id", "rank", "term", "weight"] and rows.count() == 150


@pytest.mark.parametrize(
    "name",
    [
        "read_delimited_docs", "tokenize_alnum_dash", "token_bigrams", "build_vocab", "transform_with_vocab",
        "lda_fit", "lda_trace", "lda_partial_fit", "hdp_token_conditional", "heldout_perplexity",
        "path_posterior", "tree_report",
    ],
)
def test_query_equals_sql(spark, sql, name):
    ours = queries()[name](spark, FOLDER).toPandas()
    assert compare(ours, sql.sql(oracle_sql()[name]).df()).startswith("OK")
