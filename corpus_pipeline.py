"""The corpus pipeline: quality filter, near-duplicate join, repeat removal, decontamination, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each stage's rows
to the shared folder and reads them again for the next, so a stage's work is never repeated and
its decisions are fixed. The tables that a stage's operators leave behind are deleted then, too.

Defined results, stage by stage as in their operators: null and empty texts have no quality to keep and go
with the classifier's verdict on an empty text, link with nothing, have no bytes to cut and no tokens; rows that repeat are
near duplicates of each other, and one of them stays (of equal ids, an arbitrary one, as they are alike); ties go to
the smaller id; very long texts are read whole; an empty table gives no rows; extra columns, also ones named like an operator's
own, pass through all stages but the last.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stationflow.llm import byte_bpe, decontaminate, jaccard_join, quality_crf, run_index
from stationflow.llm.common import discard, forget, shared_dir, table, written

#: Near duplicates: five-word shingles, similarity 0.8 or more.
WORDS, SIMILARITY = 5, (80, 100)
#: Repeats across documents from this many bytes on go; fifty words of prose are longer, a common line is shorter.
REPEAT_BYTES = 160
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return quality_crf.keep_good(docs, quality_crf.learn(docs, table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates stays."""
    return jaccard_join.keep_one(docs, WORDS, SIMILARITY)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Long strings that a document with a smaller id has are cut out of the text."""
    return run_index.remove_repeats(docs, REPEAT_BYTES)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item in them go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and token_ids of what is left."""
    coded = byte_bpe.encode_texts(docs.select("doc_id", "text"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("decontamination", decontamination), ("tokens", tokens)]

#: No SQL form: the classifier, the verified join and the tokenizer are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; a stage's rows are deleted once the next one's are written."""
    docs, folder, before = table(spark, sf_dir, "documents"), f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}", None
    for name, stage in STAGES:
        tables = written(spark)
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        forget(spark, tables)
        docs = spark.read.parquet(f"{folder}/{name}")
        if before:
            discard(spark, before)
        before = f"{folder}/{name}"
    return docs
