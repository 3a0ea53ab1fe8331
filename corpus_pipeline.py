"""The corpus pipeline: five stages over ``documents``, each by one operator of lamina.llm.

Every stage but the last returns the columns of ``documents``.  Its decisions take effect:
language ID drops documents without a language; the n-gram join keeps the least document of
each group; decontamination drops contaminated documents and cuts benchmark passages from
the others; the secret scan masks live credentials; BPE encodes what is left.

Rows whose texts are null or without a letter leave in the first stage; rows that repeat id and
text count once from the second on; extra columns of any name pass through the first four; an
empty table gives no rows.  The folder of the newest stage stays, for the result reads it.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from lamina.llm import bpe, decontam, jaccard, langid, secrets
from lamina.llm import textkit as tk
from lamina.llm.queries import fold, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text has a language."""
    return langid.keep_known(docs, langid.train(docs, fold(3) != 1))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of each group of near copies (five-word shingles, Jaccard 0.8; op3 as a query has three and 0.9); documents without an id stay."""
    return jaccard.keep_first(docs, words=5, percent=80)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without benchmark passages."""
    return decontam.scan(docs, table(spark, sf_dir, "benchmark"), clean=True)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with live credentials masked."""
    return secrets.redact(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of what is left."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("mask_secrets", mask_secrets), ("encode", encode)]

#: SQL can't express string kernels and BPE; tests/llm checks the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each result but the last is written as Parquet in the shared folder and read again; only the newest is kept."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{tk.checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path
    files = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    last = None
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last is not None:
            files.delete(path(last), True)
        last = f"{folder}/{name}"
    return STAGES[-1][1](spark, docs, sf_dir)
