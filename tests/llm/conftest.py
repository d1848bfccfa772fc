import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture()
def frame(spark):
    """Documents from (doc_id, text) rows; extra columns clash with names that operators use inside."""

    def make(rows, **extra):
        df = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], SCHEMA)
        for name in ("key", "doc", "fp", "part", "node", "whole", "a", "length"):
            df = df.selectExpr("*", f"'x' AS `{name}`")
        return df

    return make


@pytest.fixture(scope="session")
def texts(spark, sf):
    """The documents of the smallest tables: {doc_id: text}."""
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
