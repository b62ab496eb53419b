"""Vectors of texts: a hashing embedder, windows for late chunking, pooling, and checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigrain.functions import text as tx
from verdigrain.functions.arrays import let
from verdigrain.operators.retrieval import dot, normalized
from verdigrain.session import on_workers


class Embedder(Protocol):
    """What a model has to offer; documents and queries may differ."""

    model_name: str

    def embed_documents(self, texts: list[str]) -> np.ndarray: ...

    def embed_queries(self, texts: list[str]) -> np.ndarray: ...


def text_to_embed() -> Column:
    return F.coalesce(F.when(F.col("embedding_text") != "", F.col("embedding_text")), F.col("text"))


def hashed_vectors(df: DataFrame, keys: list[str], text: Column, *, dimension: int = 256, out: str = "embedding") -> DataFrame:
    """keys and a vector of norm 1 by feature hashing: each token adds plus or minus one to a place.

    Tokens are summed by place, so at most `dimension` rows of a text are shuffled. Texts without a token,
    or whose tokens cancel out, have no row.
    """
    digits = lambda first: F.conv(F.substring(F.md5(F.col("_t").cast("binary")), first, 8), 16, 10).cast("bigint")
    each = df.select(*keys, F.explode(tx.tokens(text)).alias("_t")).select(*keys, (digits(1) % dimension).cast("int").alias("_at"), F.when(digits(9) % 2 == 0, 1.0).otherwise(-1.0).alias("_w"))
    places = each.groupBy(*keys, "_at").agg(F.sum("_w").alias("_w"))
    by = places.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("_at", "_w"))).alias("_p"))
    vector = F.transform(F.sequence(F.lit(0), F.lit(dimension - 1)), lambda i: F.coalesce(F.try_element_at("_p", i), F.lit(0.0)))
    return by.select(*keys, normalized(vector).alias(out)).where(F.col(out).isNotNull())


def embedded(df: DataFrame, load: Callable[[], Embedder], text: Column, *, queries: bool = False, prefix: str = "", out: str = "embedding") -> DataFrame:
    """Vectors by a model that each Python worker loads once; every distinct text is encoded once."""
    on_workers(df.sparkSession)

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = load()
        run = model.embed_queries if queries else model.embed_documents
        for batch in batches:
            matrix = np.asarray(run([prefix + t for t in batch]), np.float32)
            if matrix.shape[0] != len(batch) or not np.isfinite(matrix).all():
                raise ValueError("the model gave a matrix of another shape or values that aren't finite")
            yield pd.Series(list(matrix))

    rows = df.withColumn("_text", text)
    return rows.join(rows.select("_text").distinct().withColumn(out, encode("_text")), "_text").drop("_text")


def reused(df: DataFrame, cache: DataFrame, encode: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(rows with vectors, the grown cache): df has text, cache text and embedding; only texts not in the cache are encoded."""
    new = encode(df.select("text").distinct().join(cache.select("text"), "text", "left_anti"))
    grown = cache.select("text", "embedding").unionByName(new.select("text", "embedding"))
    return df.join(grown.dropDuplicates(["text"]), "text"), grown


def cache_conflicts(cache: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Texts with two vectors that differ by more than a tolerance somewhere."""
    by = cache.select("text", F.posexplode("embedding").alias("i", "x")).groupBy("text", "i").agg((F.max("x") - F.min("x")).alias("d"))
    return by.groupBy("text").agg(F.max("d").alias("difference")).where(F.col("difference") > tolerance)


def equivalence(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row comparing two tables of key and embedding: min and mean cosine, largest difference, accepted."""
    met = a.select("key", F.col("embedding").alias("_a")).join(b.select("key", F.col("embedding").alias("_b")), "key")
    cosine = dot(normalized(F.col("_a")), normalized(F.col("_b")))
    apart = F.array_max(F.zip_with("_a", "_b", lambda x, y: F.abs(x - y)))
    by = met.agg(F.min(cosine).alias("min_cosine"), F.avg(cosine).alias("mean_cosine"), F.max(apart).alias("max_difference"))
    return by.withColumn("accepted", (F.col("min_cosine") >= 0.999999) & (F.col("mean_cosine") >= 0.999999) & (F.col("max_difference") <= 1e-5))


def context_windows(documents: DataFrame, spans: DataFrame, *, capacity: int, overlap: int) -> DataFrame:
    """document_id, start, end of token windows: documents has tokens; spans (document_id, start, end) must each lie in one.

    Windows step through a text and end with one flush right; a span that none holds gets its own,
    as central as the text's ends allow.
    """
    if capacity <= 0 or not 0 <= overlap < capacity:
        raise ValueError("capacity must be positive and overlap at least 0 and below it")
    n = F.col("tokens")
    last = n - capacity
    starts = F.when(n <= capacity, F.array(F.lit(0).cast("bigint"))).otherwise(F.array_distinct(F.concat(F.sequence(F.lit(0).cast("bigint"), F.greatest(last, F.lit(0)).cast("bigint"), F.lit(capacity - overlap).cast("bigint")), F.array(last.cast("bigint")))))
    base = documents.where("tokens > 0").select("document_id", F.explode(starts).alias("start"), F.least(n, F.lit(capacity)).cast("bigint").alias("_w")).select("document_id", "start", (F.col("start") + F.col("_w")).alias("end"))
    s, w = spans.alias("s"), base.alias("w")
    bare = s.join(w, (F.col("s.document_id") == F.col("w.document_id")) & (F.col("w.start") <= F.col("s.start")) & (F.col("s.end") <= F.col("w.end")), "left_anti")
    own = bare.join(documents.select("document_id", "tokens"), "document_id").where(F.col("end") - F.col("start") <= capacity)
    low, high = F.greatest(F.lit(0), F.col("end") - capacity), F.least(F.col("start"), F.col("tokens") - capacity)
    begin = F.greatest(low, F.least(F.floor((F.col("start") + F.col("end") - capacity) / 2), high)).cast("bigint")
    return base.unionByName(own.select("document_id", begin.alias("start")).withColumn("end", F.col("start") + capacity)).distinct()


def window_of_span(spans: DataFrame, windows: DataFrame) -> DataFrame:
    """Each span (document_id, span_id, start, end) with the window in which it is most central: the wider smaller margin, then the wider total, then the first."""
    order = Window.partitionBy("document_id").orderBy("start", "end")
    w = windows.withColumn("window_index", F.row_number().over(order) - 1).alias("w")
    s = spans.alias("s")
    met = s.join(w, (F.col("s.document_id") == F.col("w.document_id")) & (F.col("w.start") <= F.col("s.start")) & (F.col("s.end") <= F.col("w.end")))
    left, right = F.col("s.start") - F.col("w.start"), F.col("w.end") - F.col("s.end")
    best = F.max_by(F.struct("w.window_index", F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end")), F.struct(F.least(left, right), left + right, -F.col("w.window_index")))
    return met.groupBy(F.col("s.document_id").alias("document_id"), "s.span_id").agg(best.alias("b")).select("document_id", "span_id", "b.*")


def token_spans(spans: DataFrame, offsets: DataFrame) -> DataFrame:
    """Character spans as token spans: offsets has document_id, token, start, end; null where none overlaps."""
    s, o = spans.alias("s"), offsets.alias("o")
    met = s.join(o, (F.col("s.document_id") == F.col("o.document_id")) & (F.col("o.start") < F.col("s.end")) & (F.col("s.start") < F.col("o.end")), "left")
    return met.groupBy(F.col("s.document_id").alias("document_id"), "s.span_id").agg(F.min("o.token").alias("start"), (F.max("o.token") + 1).alias("end"))


def pooled(tokens: DataFrame, spans: DataFrame, *, floor: float = 0.0) -> DataFrame:
    """document_id, span_id, embedding: the mean of a span's token vectors, at norm 1.

    tokens: document_id, token, vector [, mask]; a mask of 0 leaves a token out. `floor` bounds the norm
    from below.
    """
    s, t = spans.alias("s"), tokens.alias("t")
    met = s.join(t, (F.col("s.document_id") == F.col("t.document_id")) & (F.col("s.start") <= F.col("t.token")) & (F.col("t.token") < F.col("s.end")))
    if "mask" in tokens.columns:
        met = met.where("t.mask = 1")
    each = met.select(F.col("s.document_id").alias("document_id"), "s.span_id", F.posexplode("t.vector").alias("i", "x")).groupBy("document_id", "span_id", "i").agg(F.avg("x").alias("x"))
    by = each.groupBy("document_id", "span_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("v"))
    norm = F.greatest(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)), F.lit(floor))
    return by.select("document_id", "span_id", F.transform("v", lambda x: x / norm).alias("embedding"))


def index_differences(whole: DataFrame, parts: DataFrame) -> DataFrame:
    """chunk_id of chunks that only one side has, or whose text differs."""
    a, b = whole.select("chunk_id", F.col("text").alias("_a")), parts.select("chunk_id", F.col("text").alias("_b"))
    return a.join(b, "chunk_id", "full_outer").where(~F.col("_a").eqNullSafe(F.col("_b"))).select("chunk_id")


def checkpointed(items: DataFrame, path: str, encode: Callable[[DataFrame], DataFrame], *, dimension: int, batches: int = 16) -> DataFrame:
    """chunk_id and embedding of all items (chunk_id, text), made in batches that are each appended to a table.

    After a failure only items that the table lacks are encoded. Vectors of another size, or with values
    that aren't finite, are an error before their batch is written.
    """
    spark = items.sparkSession
    schema = f"chunk_id {dict(items.dtypes)['chunk_id']}, embedding array<double>"
    spark.createDataFrame([], schema).write.mode("append").parquet(path)
    numbered_items = items.withColumn("_batch", F.pmod(F.xxhash64("chunk_id"), F.lit(batches)))
    done = lambda: spark.read.schema(schema).parquet(path)
    for k in range(batches):
        todo = numbered_items.where(F.col("_batch") == k).drop("_batch").join(done().select("chunk_id"), "chunk_id", "left_anti")
        vector = F.col("embedding").cast("array<double>")
        good = (F.size(vector) == dimension) & F.forall(vector, lambda x: F.abs(x) < F.lit(float("inf")))
        checked = F.when(F.coalesce(good, F.lit(False)), vector).otherwise(F.raise_error(F.concat(F.lit("bad vector of "), F.col("chunk_id").cast("string"))))
        made = encode(todo).select("chunk_id", checked.alias("embedding"))
        if not made.isEmpty():
            made.write.mode("append").parquet(path)
    return done()


def contextual_embeddings(documents: DataFrame, chunks: DataFrame, tokens: DataFrame, encode: Callable[[DataFrame], DataFrame], *, capacity: int = 512, overlap: int = 128) -> DataFrame:
    """chunk_id and embedding by late chunking: windows of a document's tokens are encoded, and each chunk is the mean of its tokens in its best window.

    documents: document_id, text; chunks: chunk_id, document_id, start_position, end_position, text; tokens:
    document_id, token, start, end. encode maps windows (document_id, window_start, window_end) to token
    vectors (document_id, window_start, token, vector). Chunks whose offsets don't fit their document's
    text are in offset_violations; those without a token, or longer than a window, have no row.
    """
    spans = token_spans(chunks.select("document_id", F.col("chunk_id").alias("span_id"), F.col("start_position").alias("start"), F.col("end_position").alias("end")), tokens).where("start IS NOT NULL")
    sizes = tokens.groupBy("document_id").agg((F.max("token") + 1).alias("tokens"))
    windows = context_windows(sizes, spans, capacity=capacity, overlap=overlap)
    chosen = window_of_span(spans, windows)
    vectors = encode(windows.select("document_id", F.col("start").alias("window_start"), F.col("end").alias("window_end")))
    wanted = spans.join(chosen.select("document_id", "span_id", "window_start"), ["document_id", "span_id"])
    # a document and window are one key, so that pooling meets only the window's own vectors
    key = F.concat_ws("|", F.col("document_id").cast("string"), F.col("window_start").cast("string"))
    return pooled(vectors.withColumn("document_id", key), wanted.withColumn("document_id", key)).select(F.col("span_id").alias("chunk_id"), "embedding")


def offset_violations(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks whose text isn't what their document has at their offsets."""
    met = chunks.join(documents.select("document_id", F.col("text").alias("_doc")), "document_id", "left")
    own = F.substring("_doc", (F.col("start_position") + 1).cast("int"), (F.col("end_position") - F.col("start_position")).cast("int"))
    return met.where(~own.eqNullSafe(F.col("text"))).select("chunk_id")
