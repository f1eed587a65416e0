"""A training corpus from `documents`: toxic documents go, one document of each near-duplicate group stays, repeated
passages go, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import bpe, neardup, packing, suffix, toxicity
from paperloom.llm._tables import drop, perhaps, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Score from which a document is rejected.
TOXIC = 0.3


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC. The model learns from labelled documents that are not held out.

    A null or empty text has the score of no evidence and is judged as any other; rows with a null or a repeated id are each
    judged by their text. Columns other than COLUMNS go, here and in the next stages. An empty table gives an empty one."""
    model = toxicity.fit(toxicity.sample(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return toxicity.score(docs, model, keep=COLUMNS).where(F.col("score") < TOXIC).select(*COLUMNS)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near duplicates (five words, similarity 0.8).

    Documents without words are linked with nothing and stay. Rows with one id are one document here: they stay or go
    together. Rows with a null id are in no group that could name one to keep, and stay."""
    gone = stored(neardup.near_duplicates(docs, words=5, percent=80).where("NOT kept").select("doc_id").distinct(), "gone")
    docs = perhaps(docs, "doc_id", gone)
    stay = docs.where("perhaps").join(gone, "doc_id", "left_anti")
    return docs.where("NOT perhaps").unionByName(stay).select(*COLUMNS)


def unrepeated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the characters that a 50-byte string of an earlier document covers. All documents stay.

    Null texts become empty ones, and n_chars is that of what is left. Rows with equal ids take nothing from each other."""
    kept = suffix.remove_repeats(docs, length=50, whole_characters=True, keep=["lang", "source"])
    text = F.col("kept").cast("string")
    return kept.select("doc_id", text.alias("text"), "lang", "source", F.length(text).cast("long").alias("n_chars"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents, packed into sequences of 2048 tokens.

    An empty text is its end token alone. Each row is packed, repeated ids and null ones too."""
    return packing.pack(docs, bpe.named("byte_bpe_50k.json"))


STAGES = [("toxicity", clean), ("near_duplicates", distinct), ("repeats", unrepeated), ("packing", packed)]

#: A trained model and a subword vocabulary can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
        if before is not None:
            drop(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
