import duckdb
import pytest

LONG = "Überall steht ein Wort neben dem anderen, and 7 more follow.\n" * 3000
ROWS = [
    (1, None, None, None),
    (2, "", "en", "a"),
    (3, " \t\r\n ", "en", "b"),
    (4, "one two three four", "en", None),
    (5, "one two three four", "en", "a"),
    (5, "one two three four", "en", "a"),
    (None, "a row without a key", "en", "c"),
    (None, "a row without a key", None, "c"),
    (6, "12345 !!! 67", None, "b"),
    (7, LONG, "de", "a"),
    (8, "x" * 5000, "en", "a"),
    (9, "same line here\nsame line here\n\nsame line here\nIs it? Yes $$$ <b>&</b>", "en", "d"),
    (10, "Licensed under the Apache License, Version 2.0.\nreleased under the mit license", "en", "d"),
    (11, "ÉCOLE İstanbul ΣΟΦΟΣ, don't we'll x<|endoftext|>y 日本語 👍🏽 ½ e\u0301", "fr", "d"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, null keys, and columns named like results."""
    plain = spark.createDataFrame(ROWS, SCHEMA)
    extra = "-1 AS size, 'x' AS shard, 'x' AS slot, 'x' AS kept, 'x' AS score, 'x' AS n_words, 'x' AS taken, 'x' AS matches, 'x' AS id, 'x' AS n"
    return plain.selectExpr("*", *extra.split(", ")).repartition(3).persist()


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)


@pytest.fixture(scope="session")
def odd_tables(spark, tmp_path_factory):
    """A folder with the odd rows, and a DuckDB connection that sees it."""
    folder = str(tmp_path_factory.mktemp("odd"))
    spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "length(text) AS n_chars").write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{folder}/documents.parquet/*.parquet')")
    return folder, con
