"""Exact dedup by a persistent index of digests.

The index is a table bucketed and sorted by SHA-256 digest. A batch of rows is first reduced to one
row for each digest (partial aggregation before the shuffle, so that a digest with any number of
copies sends one row a task), then joined against the index by a sort-merge anti-join that needs no
shuffle of the index, and what is new is appended. All steps are DataFrame functions.

Texts are equal when they are identical; null counts as empty. Of equal rows in a batch the largest
id stays; an id that the index has stays for good. Rows with the same id and text are copies too, and
one of them stays. Null ids come before all others; where all copies have one, keep_id is null and
one of them stays. An empty batch adds nothing. Extra columns are ignored by the index. Ids may have
any type that sorts; the index keeps the type of its first batch. A digest that holds over a thousandth
of a batch's rows, such as that of empty texts, is broadcast back to them.

Every batch adds a file to each bucket; ``compact`` brings them back to one. Choose `buckets` for the
size that the index will have, at some millions of digests each. An index that isn't named is
temporary: it leaves the catalogue once its rows are added, and its files stay for the lazy result.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigrain.llm.shared import dropped_tables, hot_keys, join_hot, shared_dir, stored, text_or_empty



def digest(text_column: str = "text") -> Column:
    return F.unhex(F.sha2(text_or_empty(text_column), 256))


class DigestIndex:
    """digest binary, keep_id, group_size (of the batch that brought it)."""

    def __init__(self, spark: SparkSession, *, name: str | None = None, path: str | None = None, buckets: int | None = None, id_type: str = "bigint") -> None:
        self.spark = spark
        self.temporary = name is None
        self.name = name or f"digest_index_{uuid.uuid4().hex}"
        self.path = path or f"{shared_dir(spark)}/{self.name}"
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        if spark.catalog.tableExists(self.name):
            id_type = dict(spark.table(self.name).dtypes)["keep_id"]
        self.id_type, self.schema = id_type, f"digest binary, keep_id {id_type}, group_size bigint"
        if not spark.catalog.tableExists(self.name):
            self._append(spark.createDataFrame([], self.schema))

    def table(self) -> DataFrame:
        """The index with its buckets, for joins that needn't move it."""
        return self.spark.table(self.name)

    def rows(self) -> DataFrame:
        """The same files without buckets: a join can split a hot digest of the other side."""
        return self.spark.read.schema(self.schema).parquet(self.path)

    def add(self, batch: DataFrame, *, id_column: str = "doc_id") -> DataFrame:
        """Append the digests of (digest, id, copies) rows that the index doesn't have; gives the batch's groups."""
        # stored: else the optimiser moves the anti-join below the aggregation, and all copies of a digest meet in one task
        found = stored(batch.groupBy("digest").agg(F.max(id_column).alias("keep_id"), F.sum("copies").alias("group_size")), "dedup-new")
        self._append(found.join(self.table().hint("merge"), "digest", "left_anti").select("digest", F.col("keep_id").cast(self.id_type), "group_size"))
        return found

    def compact(self) -> None:
        """Rewrite the index with one sorted file for each bucket."""
        new = DigestIndex(self.spark, buckets=self.buckets, id_type=self.id_type)
        new._append(self.rows())
        self.forget()
        self.spark.sql(f"ALTER TABLE {new.name} RENAME TO {self.name}")
        dropped_tables(self.spark, [self.path])
        self.path = new.path

    def forget(self) -> None:
        """Take the table out of the catalogue; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def _append(self, rows: DataFrame) -> None:
        (rows.repartition(self.buckets, "digest").sortWithinPartitions("digest")
            .write.mode("append").format("parquet").option("path", self.path)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name))


def _index_for(df: DataFrame, id_column: str) -> DigestIndex:
    return DigestIndex(df.sparkSession, id_type=dict(df.dtypes)[id_column])


def counted(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """digest, id and how many rows have both."""
    return df.select(digest(text_column).alias("digest"), id_column).groupBy("digest", id_column).agg(F.count(F.lit(1)).alias("copies"))


def dedup(df: DataFrame, index: DigestIndex | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's id, keep_id, group_size, kept, text_sha256, after adding the rows to the index."""
    index = index or _index_for(df, id_column)
    # stored: the text is hashed once
    rows = stored(counted(df, id_column=id_column, text_column=text_column), "dedup-rows")
    groups = index.add(rows, id_column=id_column)
    joined = join_hot(rows, index.rows(), ["digest"], hot_keys(groups, "group_size"))
    if index.temporary:
        index.forget()
    return joined.select(id_column, "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("_copy"), F.lower(F.hex("digest")).alias("text_sha256")).select(
        id_column, "keep_id", "group_size", (F.col(id_column).eqNullSafe(F.col("keep_id")) & (F.col("_copy") == 1)).alias("kept"), "text_sha256",
    )


def kept_rows(df: DataFrame, index: DigestIndex | None = None, *, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of a batch that stay, with all their columns."""
    index = index or _index_for(df, id_column)
    # each task sends one row for each of its digests
    index.add(df.select(digest(text_column).alias("digest"), id_column, F.lit(1).alias("copies")), id_column=id_column)
    keep = index.rows().select(F.col("digest").alias("__index_digest"), F.col("keep_id").alias("__index_keep_id"))
    if index.temporary:
        index.forget()
    rows = df.withColumn("__index_digest", digest(text_column))
    met = rows.join(keep.hint("merge"), (rows["__index_digest"] == keep["__index_digest"]) & rows[id_column].eqNullSafe(keep["__index_keep_id"]), "left_semi")
    # rows that repeat both id and text
    order = Window.partitionBy("__index_digest", id_column).orderBy(id_column)
    return met.withColumn("__index_copy", F.row_number().over(order)).where("__index_copy = 1").select(*df.columns)
