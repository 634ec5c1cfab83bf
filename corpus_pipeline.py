"""The training-data pipeline: language ID, near-dedup, decontamination, PII, encoding. Each stage's rows are written and reread as the next one's.

Every stage decides row by row: rows that share a doc_id, or have none, each stand for their own text. All but the last return the columns of docs,
whatever their names and however many; empty tables stay empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinforge.llm import bpe_transducer, decontaminate, feistel_pii, near_copies, unigram_langid
from kinforge.llm.common import NULL_ID, free_name, written
from kinforge.llm.queries import pii_key, vocabulary


#: Rows that Spark hands to a Python worker at a time, where the session has its default of 10,000: whole documents are large rows.
BATCH_ROWS = 2000


def _small_batches(spark: SparkSession) -> None:
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(BATCH_ROWS))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a language (9): null, empty and letterless texts go. A missing lang is filled with the prediction; a given one stays. Ties: the language first in order."""
    _small_batches(spark)
    path = vocabulary("piece_bpe_32k.model")
    names, log_probs = unigram_langid.learn(docs.select("doc_id", "text", "lang").filter(~unigram_langid.held_out()), path)
    judged = unigram_langid.identified(docs, names, log_probs, path, keep=True)
    found = F.col(f"`{judged.columns[-2]}`")
    filled = {"lang": F.coalesce(F.col("lang"), found).cast(docs.schema["lang"].dataType)}
    return judged.filter(found != "und").select(*[filled.get(c, F.col(f"`{c}`")).alias(c) for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (8), 5-word shingles at a similarity of 0.8 or more: the one of least doc_id (null ids last, ties by a hash of the row). Null, empty and blank texts are one group."""
    _small_batches(spark)
    return near_copies.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that benchmark passages don't contaminate (3); null and empty texts stay. Rows of equal id and text go or stay together."""
    _small_batches(spark)
    found = decontaminate.judged(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    key, salt = free_name(docs.columns, "_key"), free_name(docs.columns, "_salt")
    id_key = F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias(key)
    bad = near_copies.small_side(found.filter("contaminated").select(id_key, F.col("salt").alias(salt)).distinct())
    return docs.select("*", id_key, F.xxhash64("text").alias(salt)).join(bad, [key, salt], "left_anti").select(*docs.columns)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by pseudonyms (5), equal values alike in all of them; n_chars follows the text. Null text stays null."""
    _small_batches(spark)
    done = feistel_pii.pseudonymised(docs, pii_key(spark))
    if "n_chars" in docs.columns:
        changed = F.size(F.col(f"`{done.columns[-1]}`")) > 0
        done = done.withColumn("n_chars", F.when(changed, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return done.select(*docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its token count, the digests of its ids and of the text decoded from them, and the ids (7). Null text: no ids. A column of docs that has one of these names stays, the result gets a `_`."""
    _small_batches(spark)
    return bpe_transducer.encoded(docs, vocabulary("word_bpe_49k.json"), keep_ids=True)


STAGES = [("language", language), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("encoding", encoding)]
#: Language models, SimHash and BPE can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
