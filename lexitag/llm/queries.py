"""One query per operator, over its whole table, with its SQL where SQL can express it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitag.llm import bpe, collocations, kdtree, langid, linededup, merkle, mixing, ordering, quality, secrets, simhash, toxicity, warc
from lexitag.llm.shared import new_folder

VOCABULARY = "byte_bpe_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = _table(spark, sf_dir, "documents"), new_folder(spark, "training-order")
    vocabulary = public_tokenizers.path(VOCABULARY)
    order, index = ordering.write(docs, "doc_id", "text", folder, vocabulary, public_tokenizers.PATTERN)
    return ordering.read_back(index, order, folder).withColumnRenamed("id", "doc_id")


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return mixing.taken(mixing.plan(docs, "doc_id", "text", "source")).withColumnRenamed("id", "doc_id")


def op3_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").select("vec_id", kdtree.scaled(F.col("embedding")).alias("v"))
    return kdtree.top_k(vectors, vectors.filter("vec_id % 50 = 0"), "vec_id", "v", 5)


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = linededup.report(_table(spark, sf_dir, "documents"), "doc_id", "text")
    digest = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256)
    return rows.select(F.col("id").alias("doc_id"), "n_lines", "n_dropped", digest.alias("kept_sha256"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return simhash.near_duplicates(docs, "doc_id", "text").withColumnRenamed("id", "doc_id")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = toxicity.train(docs, _table(spark, sf_dir, "labels"), "doc_id", "text", "doc_id", "toxic")
    return toxicity.score(docs, model, "doc_id", "text").withColumnRenamed("id", "doc_id")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"), "page_id", "url", "html").withColumnRenamed("id", "page_id")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    vocabulary = public_tokenizers.path(VOCABULARY)
    rows = bpe.digests(docs, "doc_id", "text", vocabulary, public_tokenizers.PATTERN)
    return rows.withColumnRenamed("id", "doc_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.decide(docs, "doc_id", "text", "lang", "source").withColumnRenamed("id", "doc_id")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = langid.train(docs, "doc_id", "text", "lang")
    return langid.predict(docs, model, "doc_id", "text").withColumnRenamed("id", "doc_id")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = ["doc_id", "source", "lang", "n_chars", "text"]
    rows = merkle.report(_table(spark, sf_dir, "documents"), columns, "doc_id", "source", "text")
    return rows.withColumnRenamed("id", "doc_id")


def op12_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.report(_table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.phrases(_table(spark, sf_dir, "documents"), "text", "lang")


QUERIES = {
    "op1_training_order": op1_training_order,
    "op2_mixing": op2_mixing,
    "op3_top_k": op3_top_k,
    "op4_line_dedup": op4_line_dedup,
    "op5_simhash": op5_simhash,
    "op6_toxicity": op6_toxicity,
    "op7_warc": op7_warc,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_quality": op9_quality,
    "op10_language_id": op10_language_id,
    "op11_merkle": op11_merkle,
    "op12_secrets": op12_secrets,
    "op13_collocations": op13_collocations,
}
ORACLES = {
    "op2_mixing": mixing.SQL,
    "op3_top_k": kdtree.SQL,
    "op4_line_dedup": linededup.SQL,
    "op7_warc": warc.SQL,
    "op9_quality": quality.SQL,
    "op11_merkle": merkle.SQL,
    "op12_secrets": secrets.SQL,
    "op13_collocations": collocations.SQL,
}
