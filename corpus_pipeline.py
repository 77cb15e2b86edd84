"""The corpus pipeline: documents to token ids, in five stages.

Each stage is ``(name, function)``; a function takes the session, the documents its
predecessor kept, and the folder of the tables, and returns a DataFrame. ``run`` writes
every stage's rows to the shared folder as Parquet and reads them again for the next."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazeline.llm import batch_encoder, language_id, mixing, ngram_join, substring_dedup
from hazeline.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Language ID: documents without a letter, null and empty texts among them, go
    (``und``); the others get the language found in their text where none is given. Rows
    are judged one by one, also those that share an id or have none."""
    found = language_id.predict(docs, language_id.learn(docs), keep=COLUMNS[1:])
    return (
        found.where(F.col("lang_pred") != language_id.NO_LETTER)
        .withColumn("lang", F.coalesce("lang", "lang_pred"))
        .select(COLUMNS)
    )


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """N-gram Jaccard join: of each group of near copies the document with the smallest id
    stays. Rows that share an id are one document to the groups and stay or go together;
    rows without an id go."""
    kept = ngram_join.similarity_classes(docs).where("doc_id = component_id").select("doc_id")
    return docs.select(COLUMNS).join(kept, "doc_id", "left_semi")


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Substring dedup: passages of 20 words or more that stand earlier are cut out.
    Texts that lose nothing stay as they are; documents that lose all their words go.
    Rows that share an id, or have none, are cut one by one."""
    cut = substring_dedup.remove_repeats(docs, keep=COLUMNS[1:])
    lost = F.col("n_removed") > 0
    return (
        cut.where("n_removed = 0 OR n_removed < n_words")
        .withColumn("n_chars", F.when(lost, F.length("kept").cast("long")).otherwise(F.col("n_chars")))
        .withColumn("text", F.when(lost, F.col("kept")).otherwise(F.col("text")))
        .select(COLUMNS)
    )


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing: documents stay whole and stand so often that the words of every source
    come near its target; documents that are not taken go. Rows that share an id stand
    as often as the one of them that stands most often."""
    times = mixing.whole_documents(docs).groupBy("doc_id").agg(F.max("times").alias("times")).where("times > 0")
    return (
        docs.select(COLUMNS).join(times, "doc_id")
        .withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("times"))))
        .select(COLUMNS)
    )


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """BPE: the ids of every text, with digests of them and of what they decode to."""
    return batch_encoder.digests(docs, TOKENIZER)


STAGES = [
    ("language_id", languages),
    ("ngram_join", near_duplicates),
    ("substring_dedup", repeated_passages),
    ("mixing", mixture),
    ("bpe", tokens),
]
#: Language ID and BPE have no SQL form; the tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
