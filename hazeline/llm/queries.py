"""Registered queries of the operators, with their DuckDB statements where SQL says it."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm import (
    alignment,
    batch_encoder,
    decontamination,
    embedding_dedup,
    imatch,
    language_id,
    licenses,
    mixing,
    ngram_join,
    substring_dedup,
    token_counts,
    token_files,
    whitening,
)
from hazeline.llm.oracle import ORACLES as ORACLES
from hazeline.session import scratch_path

BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")
PIECE_BPE = public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return token_counts.token_counts(table(spark, d, "documents"), PIECE_BPE)


def op2_license_scan(spark: SparkSession, d: str) -> DataFrame:
    files = licenses.page_files(table(spark, d, "pages"))
    found = licenses.scan(files.select(F.col("file").alias("path"), "text")).withColumnRenamed("path", "file")
    return files.select("path", "page_id", "file").join(found, "file").drop("file")


def op3_mixing(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"))


def op4_embedding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, d, "embeddings"))


def op5_substring_dedup(spark: SparkSession, d: str) -> DataFrame:
    kept = substring_dedup.remove_repeats(table(spark, d, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_token_files(spark: SparkSession, d: str) -> DataFrame:
    folder = scratch_path(spark, "tokens")
    token_files.write(table(spark, d, "documents"), folder, BYTE_BPE, end_id=0)
    return token_files.read(folder, spark, ids=False)


def held_out() -> F.Column:
    return F.crc32(F.col("doc_id").cast("string")) % 4 == 2


def op7_language_id(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    filters = language_id.learn(docs.where(~held_out()))
    found = language_id.predict(docs, filters)
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op8_imatch(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    return imatch.compared(docs, imatch.lexicon(docs))


def op9_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.similarity_classes(table(spark, d, "documents"))


def op10_bpe_automaton(spark: SparkSession, d: str) -> DataFrame:
    return batch_encoder.digests(table(spark, d, "documents"), BYTE_BPE)


def op11_whitening(spark: SparkSession, d: str) -> DataFrame:
    return whitening.whiten(table(spark, d, "embeddings"), components=8)


def op12_alignment(spark: SparkSession, d: str) -> DataFrame:
    return alignment.align(table(spark, d, "documents"), BYTE_BPE, PIECE_BPE)


def op13_decontamination(spark: SparkSession, d: str) -> DataFrame:
    return decontamination.report(decontamination.scan(table(spark, d, "documents"), table(spark, d, "benchmark")))


QUERIES = {
    f.__name__: f
    for f in (
        op1_token_counts, op2_license_scan, op3_mixing, op4_embedding_dedup, op5_substring_dedup,
        op6_token_files, op7_language_id, op8_imatch, op9_ngram_join, op10_bpe_automaton,
        op11_whitening, op12_alignment, op13_decontamination,
    )
}
