import pytest
from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"

SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names the operators use inside
        T.StructField("size", T.StringType()),
        T.StructField("_row", T.StringType()),
        T.StructField("label", T.StringType()),
    ]
)


@pytest.fixture(scope="session")
def make_docs(spark):
    """Documents with clashing extra columns from (doc_id, text, source) tuples."""

    def make(rows):
        return spark.createDataFrame([(i, t, "en", s, None if t is None else len(t), "x", "y", "z") for i, t, s in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and very long texts, ties and repeated rows."""
    long = " ".join(f"w{i % 997}" for i in range(60_000))
    return [
        (1, "The cat sat on the mat.", "a"),
        (2, "the CAT sat on the mat.", "a"),
        (2, "the CAT sat on the mat.", "a"),
        (3, "", "b"),
        (4, None, "b"),
        (None, "no identifier here", None),
        (None, None, None),
        (5, long, "b"),
        (6, "   \n\t ", "c"),
        (7, "É à ñ ß 漢字 😀 x", "é"),
    ]


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").limit(1_000)
