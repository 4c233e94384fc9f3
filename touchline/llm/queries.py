"""The registered queries of this subpackage: (session, table folder) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from touchline.llm import ann, bpe, html_text, manifest, minhash, mixing, oracles, pii, quality, secret_scan, suffix, toxicity, warc, whitening
from touchline.llm.vocabulary import vocabulary_path
from touchline.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = dict(oracles.ORACLE_SQL)


def query(build):
    """Register under the function's name; the package goes to the workers first."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return build(spark, sf_dir)

    QUERIES[build.__name__] = run
    return run


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op3_bpe(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return bpe.digests(docs, vocabulary_path(), bpe.build_lexicon(docs, vocabulary_path()))


@query
def op4_near_duplicates(spark, sf_dir):
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), size=2)
    return found.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


@query
def op5_personal_data(spark, sf_dir):
    return pii.digests(pii.personal_data(table(spark, sf_dir, "documents")))


@query
def op6_mix(spark, sf_dir):
    rows = mixing.mix(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query
def op9_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = toxicity.fit(docs, toxicity.training_rows(table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    scored = toxicity.scores(docs, model)
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.7).cast("int").alias("predicted"))


@query
def op1_quality(spark, sf_dir):
    found = quality.quality(table(spark, sf_dir, "documents"))
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return found.select("doc_id", *counts, "base_failed", "words_left", "kept")


@query
def op7_repeats(spark, sf_dir):
    return suffix.digests(suffix.without_repeats(table(spark, sf_dir, "documents")))


@query
def op8_main_text(spark, sf_dir):
    return html_text.main_text(table(spark, sf_dir, "pages"))


@query
def op2_warc(spark, sf_dir):
    index, folder = warc.archive_pages(table(spark, sf_dir, "pages"))
    return warc.read_back(index, folder)


@query
def op10_neighbours(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return ann.nearest_neighbours(vectors, vectors.filter("vec_id % 20 = 0"))


@query
def op11_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


@query
def op12_secrets(spark, sf_dir):
    return secret_scan.digests(secret_scan.find_secrets(table(spark, sf_dir, "documents")))


@query
def op13_manifest(spark, sf_dir):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return manifest.documents_manifest(table(spark, sf_dir, "documents"), tampered)


@query
def pipeline(spark, sf_dir):
    return corpus_pipeline.run(spark, sf_dir)


if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
