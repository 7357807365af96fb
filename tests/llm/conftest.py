import pytest

ODD = [None, "", "   \n\t", "a", "x" * 30000, "wörd " * 4000, "A b\x1cc\u00a0d e\u2003f", "same text here now", "same text here now"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Null, empty, very long and repeated texts, null and repeated ids, and columns that clash."""
    rows = [(i, t, None if i % 3 else "en", "src" if i % 2 else None, i, "z") for i, t in enumerate(ODD)]
    rows += [(7, ODD[7], "en", "src", 7, "z"), (None, "no id at all", "en", "src", 1, "z")]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint, `s` string").select("*", *[_extra(c) for c in ("fp", "p", "row", "keys", "_block", "kept")])


def _extra(name):
    from pyspark.sql import functions as F

    return F.lit(1).alias(name)


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
