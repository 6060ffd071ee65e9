import duckdb
import pytest

TEXT_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="session")
def texts(sf):
    return dict(duckdb.sql(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall())


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, and columns whose names the operators use themselves."""
    long = " ".join(f"word{k * 7919 % 5000}" for k in range(60_000))
    rows = [(1, "one two three four five six", "en", "a", 27), (2, "ONE two three four five six", "en", "b", 27), (3, None, None, None, None), (4, "", "de", "a", 0), (5, long, "en", "a", len(long)), (5, long, "en", "a", len(long)), (None, "no id here at all", "fr", "c", 17), (7, "x", "fr", None, 1), (8, " \t\n ", "en", "a", 4), (9, "naïve Ünïcode – 漢字 🙂 <|endoftext|> tail", "en", "z", 40), (10, "a" * 5000, "en", "a", 5000)]
    df = spark.createDataFrame([(*r, "clash", 99, 0, "k") for r in rows], TEXT_SCHEMA + ", size string, row int, fp int, node string")
    return df.withColumnsRenamed({"node": "component"})


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
