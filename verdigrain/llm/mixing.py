"""Mixing sources to target weights by histograms over hash thresholds.

Every document has a hash. A source that is to give `taken` of its `size` words repeats all documents
whole times, and takes those below a hash threshold once more. The threshold is found without a sort:
words are summed by source and by the leading hash digits, the bucket in which the budget runs out is
found, and only that bucket is summed again by the next digits, and so on to the whole hash. Documents
at the very threshold share what is left, so a source's words meet its target to within a word for
each of them. All steps are DataFrame functions on a table of ids, sizes and hashes; texts stay put.

The hash is 60 bits of the MD5 of the id. Null sources are a source of their own, the last. Null texts
have size 0. If all sizes are 0, so are all targets. Repeated rows have equal hashes and share alike.
Extra columns are ignored. Null ids hash as an empty id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigrain.llm.shared import dropped_tables, stored, text_or_empty
from verdigrain.session import dealt_by_range

DIGITS = 3
LEVELS = 5


def size_of(text_column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(text_column), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def hash_of(id_column: str) -> Column:
    """The first 15 hexadecimal digits of the MD5 of the id."""
    return F.substring(F.md5(F.coalesce(F.col(id_column).cast("string"), F.lit("")).cast("binary")), 1, DIGITS * LEVELS)


def _running(ranged: DataFrame, order: list[Column], sums: dict[str, Column]) -> DataFrame:
    """Rows of dealt_by_range with the sums of all rows before them (``_before_``) and of all rows (``_all_``).

    A range is summed in one task; of all ranges only their totals meet.
    """
    by = ranged.groupBy("_range").agg(*[F.sum(c).alias(f"_sum_{n}") for n, c in sums.items()])
    earlier, whole = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    totals = by.select("_range", *[F.coalesce(F.sum(f"_sum_{n}").over(earlier), F.lit(0)).alias(f"_early_{n}") for n in sums], *[F.sum(f"_sum_{n}").over(whole).alias(f"_all_{n}") for n in sums])
    own = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    met = ranged.withColumns({f"_own_{n}": F.coalesce(F.sum(c).over(own), F.lit(0)) for n, c in sums.items()}).join(F.broadcast(totals), "_range")
    return met.withColumns({f"_before_{n}": F.col(f"_early_{n}") + F.col(f"_own_{n}") for n in sums}).drop("_range", *[f"_{k}_{n}" for n in sums for k in ("early", "own")])


def targets(sizes: DataFrame, weights: tuple[float, ...], most: float = 3.0, held: list[str] | None = None) -> DataFrame:
    """Of a table of source and source_size: target, by water-filling under `most` times the size.

    Sources are numbered and accumulated by ranges of their names and needs, so that any number of them
    is shared out among tasks.
    """
    by_name = [F.col("source").isNull(), F.col("source").cast("binary")]
    named = _running(dealt_by_range(sizes, *by_name, held=held), by_name, {"place": F.lit(1)})
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("_before_place") % len(weights) + 1).cast("int")).cast("long")
    # sources that reach their cap first have the smallest size for their weight
    rows = named.select("source", "source_size", weight.alias("weight"))
    by_need = [F.col("source_size") / F.col("weight"), *by_name]
    rows = _running(dealt_by_range(rows, *by_need, held=held), by_need, {"place": F.lit(1), "size": F.col("source_size"), "weight": F.col("weight")})
    rows = rows.withColumns({"rest": F.col("_all_size") - F.lit(int(most)) * F.col("_before_size"), "weights": F.col("_all_weight") - F.col("_before_weight")})
    cap = (F.lit(int(most)) * F.col("source_size")).cast("double")
    above = F.col("rest").cast("double") * F.col("weight") / F.col("weights") > cap
    # the first source that isn't above its cap sets the level for all that follow it
    level = rows.agg(F.min(F.when(~above, F.struct("_before_place", "rest", "weights")))).first()[0]
    if level is None:
        return rows.select("source", "source_size", cap.alias("target"))
    share = F.lit(float(level.rest)) * F.col("weight") / F.lit(level.weights)
    target = F.when(F.col("_before_place") < level["_before_place"], cap).otherwise(share)
    return rows.select("source", "source_size", F.when(F.col("_all_size") == 0, F.lit(0.0)).otherwise(target).alias("target"))


def _small(df: DataFrame, most: int = 20_000) -> DataFrame:
    """Broadcast a table of at most so many rows; beyond that Spark joins it by shuffle and splits hot keys."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def _thresholds(rows: DataFrame, weights: tuple[float, ...], most: float) -> DataFrame:
    """Of rows of source, size and hash: by source, its target, whole repeats, the hash at which the budget runs out, and the words left there."""
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    held: list[str] = []
    plan = stored(targets(stored(sizes, "mix-sources", held), weights, most, held), "mix-targets", held)
    goal = F.floor("target").cast("long")
    repeats = F.when(F.col("source_size") == 0, F.lit(0)).otherwise(F.floor(goal / F.col("source_size"))).cast("long")
    state = plan.withColumn("repeats", repeats).withColumn("budget", goal - F.col("repeats") * F.col("source_size")).withColumn("prefix", F.lit(""))
    level = _small(state)
    for k in range(1, LEVELS + 1):
        cut = k * DIGITS
        # only rows of the bucket in which the budget runs out are summed again
        bucket = rows.alias("r").join(level.alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")) & F.col("r.hash").startswith(F.col("s.prefix")))
        sums = bucket.groupBy(F.col("s.source").alias("source"), F.substring("r.hash", 1, cut).alias("prefix")).agg(F.sum("r.size").alias("words"))
        run = Window.partitionBy("source").orderBy("prefix").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        sums = sums.withColumn("upto", F.sum("words").over(run))
        joined = sums.alias("b").join(level.drop("prefix").alias("s"), F.col("b.source").eqNullSafe(F.col("s.source")))
        # the budget runs out in the first bucket whose running sum exceeds it
        crossing = joined.where(F.col("b.upto") > F.col("s.budget")).groupBy(F.col("s.source").alias("source")).agg(F.min(F.struct("b.prefix", "b.words", "b.upto")).alias("b"))
        after = state.drop("prefix").alias("s").join(crossing.alias("c"), F.col("s.source").eqNullSafe(F.col("c.source")), "left")
        state = stored(after.select("s.source", "source_size", "target", "repeats", (F.col("budget") - F.coalesce(F.col("c.b.upto") - F.col("c.b.words"), F.lit(0))).alias("budget"), F.coalesce("c.b.prefix", F.lit("g")).alias("prefix"), F.coalesce("c.b.words", F.lit(0)).alias("words")), "mix-level", held)
        level = _small(state)
    # the last level has all that is needed
    dropped_tables(rows.sparkSession, held[:-1])
    return level


def _taken(size: Column, digits: Column) -> Column:
    """Words taken of a row that has met its source's thresholds."""
    share = F.when(F.col("words") == 0, F.lit(0)).otherwise(F.floor(size * F.col("budget").cast("decimal(20,0)") / F.col("words"))).cast("long")
    extra = F.when(digits < F.col("prefix"), size).when(digits == F.col("prefix"), share).otherwise(F.lit(0))
    return (size * F.col("repeats") + extra).cast("long")


def _measured(df: DataFrame, id_column: str, source_column: str, text_column: str) -> DataFrame:
    return stored(df.select(F.col(id_column).alias("id"), F.col(source_column).cast("string").alias("source"), size_of(text_column).alias("size"), hash_of(id_column).alias("hash")), "mix-sizes")


def mix(df: DataFrame, *, weights: tuple[float, ...], id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", most: float = 3.0) -> DataFrame:
    """Each row's id, size, source_size, target, taken (words, with repeats)."""
    rows = _measured(df, id_column, source_column, text_column)
    met = rows.alias("r").join(_thresholds(rows, weights, most).alias("s"), F.col("r.source").eqNullSafe(F.col("s.source")))
    return met.select(F.col("id").alias(id_column), "size", "source_size", "target", _taken(F.col("size"), F.col("hash")).alias("taken"))


def mixed_rows(df: DataFrame, *, weights: tuple[float, ...], id_column: str = "doc_id", source_column: str = "source", text_column: str = "text", most: float = 3.0) -> DataFrame:
    """The rows that the mix takes, with all their columns: one for each repeat; a document taken in part has its first words.

    Texts aren't shuffled: each row meets its source's thresholds where it is.
    """
    level = _thresholds(_measured(df, id_column, source_column, text_column), weights, most)
    level = level.select(F.col("source").alias("__mix_source"), *["repeats", "budget", "prefix", "words"])
    inner = {c: f"__own_{k}" for k, c in enumerate(df.columns)}
    rows = df.toDF(*inner.values())
    text, source = inner[text_column], inner[source_column]
    met = rows.join(level, rows[source].cast("string").eqNullSafe(level["__mix_source"]))
    met = met.withColumn("__size", size_of(text)).withColumn("__taken", _taken(F.col("__size"), hash_of(inner[id_column]))).where("__taken > 0")
    each = met.withColumn("__repeat", F.explode(F.sequence(F.lit(1), F.ceil(F.col("__taken") / F.col("__size")).cast("int"))))
    left = F.least(F.col("__size"), F.col("__taken") - (F.col("__repeat") - 1) * F.col("__size"))
    part = F.array_join(F.slice(F.regexp_extract_all(F.col(text), F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0)), F.lit(1), left.cast("int")), "")
    return each.select(*[(F.when(left == F.col("__size"), F.col(text)).otherwise(part) if c == text_column else F.col(own)).alias(c) for c, own in inner.items()])
