import pytest
from conftest_llm import prose

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def make(spark):
    """A table of documents from (doc_id, text) pairs, with columns whose names the operators use inside."""

    def build(rows, clashing=False):
        df = spark.createDataFrame([(i, t, "en", "src", None if t is None else len(t)) for i, t in rows], DOCS)
        if clashing:
            from pyspark.sql import functions as F

            for c in ("d", "code", "a", "b", "key", "quality", "fertility_0", "band_0", "gone_id", "cuts_key", "d_key", "component", "band_key", "x.y"):
                df = df.withColumn(c, F.lit("kept"))
        return df

    return build


@pytest.fixture(scope="session")
def odd():
    """Rows that every operator must bear: nulls, empty and blank texts, repeated rows and ids, a very long text."""
    same = prose(1, 120)
    return [(1, same), (1, same), (2, None), (None, prose(2, 80)), (None, None), (3, ""), (4, "  \n \t "), (5, "one"), (6, prose(3, 40_000)), (7, prose(4, 90)), (7, prose(5, 90)), (8, "!!! ??? ***"), (9, "日本語のテキスト です")]
