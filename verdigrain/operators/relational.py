"""Shapes of relational work that recur: caps for each group, group-disjoint splits, comparison of tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigrain.session import dealt_by_range


def numbered(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """Rows numbered from 1 in an order, without a task that sees them all: ranges are numbered each, after the counts of those before.

    Give it narrow rows, such as ids: they are sorted and stored.
    """
    ranged = dealt_by_range(df, *order)
    counts = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n"))
    # one row for each range
    before = counts.select("_range", F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_range").orderBy(*order))
    return ranged.withColumn(name, own).join(F.broadcast(before), "_range").withColumn(name, (F.col("_before") + F.col(name)).cast("bigint")).drop("_range", "_before")


def seeded(seed: int, *columns: str) -> Column:
    """An order that depends on the seed and the columns alone."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]).cast("binary"))


def capped(df: DataFrame, group: str, key: str, per_group: int, total: int, *, seed: int = 42) -> DataFrame:
    """At most so many rows of each group and in all, in a seeded order."""
    order = seeded(seed, key)
    ranked = df.withColumn("_o", order).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_o", key)))
    return ranked.where(F.col("_r") <= per_group).orderBy("_o", key).limit(total).drop("_o", "_r")


def disjoint_split(df: DataFrame, group: str, target: int, *, seed: int = 42, exact: bool = False) -> DataFrame:
    """The groups of one side: in seeded order each group is added if the side then has at most `target` rows.

    Groups with their sizes are folded in one expression, as each step depends on all before; the table
    of groups is an aggregate of the rows. Gives group and size; sizes sum to `target` or less, and with
    `exact` a sum below it is an error when the result is read.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("size")).withColumn("_o", seeded(seed, group))
    folded = sizes.agg(F.array_sort(F.collect_list(F.struct("_o", F.col(group).alias("g"), "size"))).alias("a"))
    kind = dict(folded.dtypes)["a"]
    start = F.struct(F.lit(0).cast("bigint").alias("n"), F.array().cast(kind).alias("taken"))
    step = lambda s, x: F.when(s["n"] + x["size"] <= target, F.struct((s["n"] + x["size"]).alias("n"), F.concat(s["taken"], F.array(x)).alias("taken"))).otherwise(s)
    folded = folded.select(F.aggregate("a", start, step).alias("s"))
    if exact:
        short = F.raise_error(F.concat(F.lit(f"groups don't fill {target} rows, but "), F.col("s.n").cast("string"))).cast("boolean")
        folded = folded.where(F.when(F.col("s.n") != target, short).otherwise(F.lit(True)))
    return folded.select(F.explode("s.taken").alias("t")).select(F.col("t.g").alias(group), F.col("t.size").alias("size"))


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one of two tables has, counting repeats, with the side that has them."""
    columns = sorted(a.columns)
    a, b = a.select(columns), b.select(columns)
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def holdout_candidate(excluded_courts: list[str], *, classification: str, subclassification: str, lengths: Column | None = None) -> Column:
    """Whether a record is of one class from a court not yet used, with an address, a year and no empty section (lengths: those of other sections)."""
    full = F.forall(F.map_values(F.col("section_lengths") if lengths is None else lengths), lambda n: n > 0)
    return (F.lower("classification") == classification.lower()) & (F.lower("subclassification") == subclassification.lower()) & ~F.col("court").isin(excluded_courts) & (F.coalesce("source_url", F.lit("")) != "") & F.col("case_year").isNotNull() & full


def holdout_candidates(manifest: DataFrame, excluded_courts: list[str], *, classification: str, subclassification: str) -> DataFrame:
    """Records of one class from courts not yet used, with an address, a year and no empty section."""
    return manifest.where(holdout_candidate(excluded_courts, classification=classification, subclassification=subclassification))


def unapproved(questions: DataFrame) -> DataFrame:
    """Questions that may not be used yet."""
    return questions.where(F.lower(F.trim(F.coalesce("review_status", F.lit("")))) != "approved")
