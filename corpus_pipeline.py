"""The corpus pipeline: language, near duplicates, benchmark leaks, personal data, packing.

Each stage takes the documents that the one before it kept and works on all of them. All but the
last return documents with the columns they came with; the last returns the packed pieces.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame, SparkSession

from loomcast.llm import decontaminate, langid, nearduplicates, packing, pii
from loomcast.llm.common import discard, materialize, small_batches
from loomcast.llm.queries import WORD_TOKENIZER, table, tokenizer_path


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents mostly in one of the languages learned from them."""
    small_batches(spark)
    return langid.keep_identified(docs, langid.train(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return nearduplicates.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


#: Setting of the session that holds the key of the surrogates, as text.
KEY_SETTING = "spark.loomcast.surrogateKey"


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates for personal data under the session's key. Without one the public
    default serves, which anyone can undo: that is for tests, and is warned of."""
    key = spark.conf.get(KEY_SETTING, None)
    if not key:
        warnings.warn(f"{KEY_SETTING} is not set: surrogates are made with a public key and can be undone", stacklevel=2)
    return pii.replace_texts(docs, key.encode() if key else pii.DEFAULT_KEY)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, placed in sequences of 2048."""
    return packing.pack_documents(docs, tokenizer_path(WORD_TOKENIZER), 2048)


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("personal_data", personal_data),
    ("packing", packed),
]

#: A random field, sketches and a tokenizer are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents table; each is written and read again for the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialize(stage(spark, docs, sf_dir), name)
        discard(before)  # the documents table is none of ours and stays
    return STAGES[-1][1](spark, docs, sf_dir)
