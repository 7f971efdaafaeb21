"""A corpus pipeline of the operators in ``tessera.llm``: language ID, near-duplicates, decontamination, mix, token files.

A stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; it is written as Parquet and read again as the ``docs``
of the next. All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, language_id, mixing, near_dedup, token_binary
from tessera.llm.common import cut, numbered, table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOKENIZER = "byte_bpe_50k.json"


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters (null and empty texts too) or of uncertain language go; labels train the classifier.

    Each row is judged alone, whether its id is null, repeated or its own."""
    docs = docs.select(*COLUMNS)
    return language_id.identified(docs, language_id.fit(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.75 similar five-word shingle sets, the one of the smallest doc_id stays."""
    docs = docs.select(*COLUMNS)
    return near_dedup.deduplicated(docs, near_dedup.near_duplicates(docs))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words or more inside benchmark passages of 13 words go, each row judged alone."""
    rows = numbered(docs.select(*COLUMNS), "decontamination-rows")
    return decontaminate.decontaminated(rows, table(spark, sf_dir, "benchmark"), key="row_key").drop("row_key")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts become the words that the mix takes of them; documents of which it takes nothing go."""
    return mixing.mixed_documents(docs.select(*COLUMNS))


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token files, read back: ``doc_id, start, n_tokens, ids_crc32``."""
    return token_binary.token_files(docs, public_tokenizers.path(TOKENIZER))


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_files", token_files),
]

#: A learned classifier, a pseudorandom mix and a tokenizer are not SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result but the last written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
