"""A corpus pipeline: five stages from raw documents to packed sequences.

Each stage takes (spark, docs, sf_dir) and returns a table, which is written as Parquet in the shared
folder and read again as the next stage's docs. All but the last return the columns of documents.

Null and empty texts, and those without a letter, go in the first stage. Of rows with equal texts that
with the largest id stays, of each class of near copies that with the smallest; rows that repeat id and
text are one. The mix may repeat a row, or cut its text. Texts of any length are taken whole, an empty
table gives an empty result, and extra columns are kept by all stages but the last.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from verdigrain.llm import exact_dedup, jaccard_join, language_id, mixing, packing
from verdigrain.llm.shared import stored
from verdigrain.session import table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told; those that are null or have no letter go."""
    return language_id.identified_rows(docs, language_id.fit(docs))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of identical texts."""
    return exact_dedup.kept_rows(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class linked by a similarity of at least 0.8 on five-word shingles."""
    return jaccard_join.kept_rows(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What each source gives to the mix; repeated documents are rows each."""
    return mixing.mixed_rows(docs, weights=(5, 2, 1))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2,048 tokens."""
    return packing.pack(docs, tokenizer_file=public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", identify_language), ("exact_dedup", drop_copies), ("jaccard_join", drop_near_copies), ("source_mixing", mix_sources), ("vector_packing", pack_sequences)]

#: Language models, similarity classes and token ids have no SQL; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
