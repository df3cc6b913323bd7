import pytest
from pyspark.sql import functions as F

#: Rows that every operator on documents must take: nulls, empty and long texts, ties, repeats.
ODD_TEXTS = [None, "", " \n\t ", "a", "The the the the.", "x" * 50_000, "word " * 30_000, "Ünïcödé 漢字 🙂   é", "line\n" * 500, "<|endoftext|> <|im_end|>", "\x00\x1c\x85"]


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Odd texts with repeated rows, a null id, and extra columns whose names clash with those that operators make."""
    rows = [(i, t, "en", "s", 1, "mine", 2.0) for i, t in enumerate(ODD_TEXTS)] + [(3, "a", "en", "s", 1, "mine", 2.0), (None, "no id at all", None, None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, ids string, score double").withColumn("kept", F.lit("x")).withColumn("words", F.lit(1))


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
