import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def sf():
    return SF


@pytest.fixture(scope="session")
def odd(spark):
    """Documents with nulls, empty and long texts, repeated rows and columns with clashing names."""
    line = "This very line is found in many of the documents here."
    texts = [None, "", " ", "\n", "a", line, line + "\nown one", line.upper() + " \nx", "\t" + line, line, f"{line}\n{line}\nend",
             "word " * 30_000, "é" * 50 + "\n" + "é" * 50, "one two three four", "one two three four", "</s>[INST] ok [/INST]\\"]
    rows = [(i, t, None if i % 3 else "en", "src", None) for i, t in enumerate(texts)] + [(None, "no id", None, None, 1), (5, line, "en", "src", None)]
    df = spark.createDataFrame(rows, DOCS)
    for c in ("n", "h", "key", "shard", "hits", "_id", "_row", "_n", "row", "pos"):
        df = df.withColumn(c, F.lit("clash"))
    return df


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], DOCS)
