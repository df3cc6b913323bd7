"""From raw documents to packed sequences: four stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes it as
Parquet and gives the reread table to the next one. The first three return the columns
of their input; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberlane.llm import near_dup, packing, quality, toxicity
from emberlane.llm.common import materialize, table

VOCABULARY = "byte_bpe_50k.json"


def _held(docs: DataFrame) -> DataFrame:
    """doc_id, text, and the other columns in one beside them, so that columns of any name come through and each text is sent once."""
    return docs.select("doc_id", "text", F.struct(F.col("doc_id"), *(F.col(c) for c in docs.columns if c not in ("doc_id", "text"))).alias("_row"))


def _released(held: DataFrame, columns: list[str]) -> DataFrame:
    return held.select(*(F.col("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in columns))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not predicted toxic; the model is learned from the labelled ones of the input. Null and empty texts stay."""
    model = toxicity.fit(toxicity.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return _released(toxicity.score(_held(docs), model).where("predicted = 0"), docs.columns)


def drop_poor(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; null and empty texts go."""
    field = quality.fit(quality.labelled_rows(docs, table(spark, sf_dir, "labels")))
    return _released(quality.measure(_held(docs), field, carry=("_row", "text")).where("kept"), docs.columns)


def _keyed(docs: DataFrame) -> DataFrame:
    """Rows with an id, equal ones of an id and text folded, with ``_key``: doc_id, or for the rows of an id that has several texts a number of each row beyond all ids.

    Only rows of ids that occur more than once are dealt out by id; where there are none, no text moves.
    """
    again = materialize(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), name="ids-again")
    if again.isEmpty():
        return docs.withColumn("_key", F.col("doc_id"))
    once = docs.join(again, "doc_id", "left_anti").withColumn("_key", F.col("doc_id"))
    return materialize(once.unionByName(_told_apart(docs.join(again, "doc_id", "left_semi"), docs.agg(F.max("doc_id")).first()[0])), name="keyed")


def _told_apart(docs: DataFrame, most: int) -> DataFrame:
    """The rows of ids that occur more than once, folded and with ``_key``; ``most`` is the largest of all ids."""
    texts = docs.groupBy("doc_id").agg(F.min(F.sha2("text", 256)).alias("a"), F.max(F.sha2("text", 256)).alias("b"), F.count_if(F.col("text").isNull()).alias("nulls"))
    several = materialize(texts.where("a <> b or (nulls > 0 and a is not null)").select("doc_id"), name="several-texts")
    if several.isEmpty():
        return docs.dropDuplicates(["doc_id"]).withColumn("_key", F.col("doc_id"))
    one = docs.join(several, "doc_id", "left_anti").dropDuplicates(["doc_id"]).withColumn("_key", F.col("doc_id"))
    more = docs.join(several, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"]).withColumn("_key", F.monotonically_increasing_id() + most + 1)
    return one.unionByName(more.select(one.columns))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the one with the least doc_id.

    Rows without an id stay. Rows that are equal in doc_id and text are one document; other
    texts of an id are documents of their own, which stand behind all ids that have one text.
    """
    names = {c: c if c in ("doc_id", "text") else f"c{i}" for i, c in enumerate(docs.columns)}
    own = docs.select(*(F.col(c).alias(n) for c, n in names.items()))
    keyed = _keyed(own.where("doc_id is not null"))
    kept = near_dup.near_duplicates(keyed, key="_key").where("kept").select("_key").distinct()
    named = keyed.join(kept, "_key", "left_semi")
    return named.select(*own.columns).unionByName(own.where("doc_id is null")).select(*(F.col(n).alias(c) for c, n in names.items()))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 2048 tokens and their places in sequences."""
    return packing.packed_digests(docs, VOCABULARY)


STAGES = [("toxicity", drop_toxic), ("quality rules", drop_poor), ("near-dedup", drop_near_duplicates), ("packing", pack)]

#: Tokens, Viterbi labels and the grammar have no SQL; tests/llm hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name=name.replace(" ", "-"))
    return docs
