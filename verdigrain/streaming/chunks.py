"""Cleaning and chunking of a stream of documents: each row goes its way alone, so there is no state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrain.functions import text as tx
from verdigrain.operators.chunking import fixed_chunks


def chunk_stream(documents: DataFrame, words: int = 150, overlap: int = 30, *, clean: bool = True) -> DataFrame:
    """Word windows of a stream (or table) of document_id and text."""
    text = tx.cleaned(F.col("text")) if clean else F.col("text")
    return fixed_chunks(documents.select("document_id", text.alias("text")), words, overlap)


def chunk_files(spark: SparkSession, source: str, target: str, checkpoint: str, schema: str = "document_id string, text string"):
    """Chunk JSON-lines files as they arrive; gives the running query, which ends when all are done."""
    stream = spark.readStream.schema(schema).json(source)
    return chunk_stream(stream).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
