"""From raw documents to token ids in five stages.

Each stage is a function (spark, docs, sf_dir) -> DataFrame; its result is
written and read again as the next one's docs. All but the last return the
columns of documents, and every decision takes effect on the rows or the text:
toxic documents go, one document of each near-duplicate group stays, personal
data is replaced in the text, documents are repeated or left out as the mix
takes them, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from touchline.llm import bpe, minhash, mixing, pii, toxicity
from touchline.llm.vocabulary import vocabulary_path
from touchline.session import ship_package
from touchline.sources.store import materialize

#: Hash samples, banding and merges have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    labels = toxicity.training_rows(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.without_toxic(docs, toxicity.fit(docs, labels))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, overlap of 0.8; the smallest id of each group stays, as do rows without an id.

    Nearly all rows stay, so the ids that go are looked up and the texts are not exchanged.
    """
    ship_package(spark)
    found = minhash.near_duplicates(docs).filter("doc_id IS NOT NULL")
    least = found.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("stays"))
    return minhash.without(docs, materialize(least.filter("NOT stays").select("doc_id")))


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """n_chars follows the new text."""
    ship_package(spark)
    return pii.redacted(docs).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return mixing.mixed(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ship_package(spark)
    return bpe.tokenized(docs, vocabulary_path(), bpe.build_lexicon(docs, vocabulary_path()))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", replace_personal_data),
    ("mix", mix_sources),
    ("bpe", encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a table folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
