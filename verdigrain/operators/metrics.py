"""Ranking metrics, document fidelity, latency summaries and error classes, as long tables.

Metric rows are query_id, metric, k, value. A query without a run counts with zeros (drm with one)
unless ``on_missing="error"`` asks for a check first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


KS = (1, 3, 5, 10)


def deduplicated(run: DataFrame) -> DataFrame:
    """A run with each chunk at its first rank only, renumbered."""
    first = run.groupBy("query_id", "chunk_id").agg(F.min("rank").alias("_r"))
    return first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("_r"))).drop("_r")


def cutoffs(df: DataFrame, ks: tuple[int, ...]) -> DataFrame:
    """Every row for each cutoff k."""
    return df.withColumn("k", F.explode(F.array(*[F.lit(int(k)) for k in ks])))


def missing_runs(qrels: DataFrame, run: DataFrame) -> DataFrame:
    return qrels.select("query_id").distinct().join(run.select("query_id").distinct(), "query_id", "left_anti")


def _long(wide: DataFrame, names: list[str], keys: list[str]) -> DataFrame:
    return wide.select(*keys, F.explode(F.array(*[F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("value")) for n in names])).alias("m")).select(*keys, "m.metric", "m.value")


def ranking_metrics(qrels: DataFrame, run: DataFrame, evidence: DataFrame | None = None, ks: tuple[int, ...] = KS, *, dedupe: bool = True) -> DataFrame:
    """recall, mrr and ndcg of every query at every k.

    qrels: query_id, chunk_id, grade; of repeated ones the highest counts. evidence: query_id,
    evidence_id, chunk_id; without it recall is by chunks. One join brings grades to the ranks; ideal
    gains come from one window over the positive grades.
    """
    grades = qrels.groupBy("query_id", "chunk_id").agg(F.max("grade").alias("grade")).where("grade > 0")
    ranked = (deduplicated(run) if dedupe else run).where(F.col("rank") <= max(ks)).select("query_id", "chunk_id", "rank")
    gain = lambda g, r: (F.pow(F.lit(2.0), g) - 1) / F.log2(r + 1.0)
    hits = cutoffs(ranked.join(grades, ["query_id", "chunk_id"]), ks).where(F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(F.min("rank").alias("first"), F.sum(gain(F.col("grade"), F.col("rank"))).alias("dcg"), F.count(F.lit(1)).alias("found"))
    best = grades.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("grade")))).where(F.col("place") <= max(ks))
    ideal = cutoffs(best, ks).where(F.col("place") <= F.col("k")).groupBy("query_id", "k").agg(F.sum(gain(F.col("grade"), F.col("place"))).alias("ideal"))
    units = qrels.where("grade > 0").select("query_id", F.col("chunk_id").alias("evidence_id"), "chunk_id") if evidence is None else evidence
    total = units.groupBy("query_id").agg(F.count_distinct("evidence_id").alias("units"))
    covered = cutoffs(units.join(ranked, ["query_id", "chunk_id"]), ks).where(F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(F.count_distinct("evidence_id").alias("covered"))
    wide = ideal.join(total, "query_id", "left").join(hits, ["query_id", "k"], "left").join(covered, ["query_id", "k"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    wide = wide.select("query_id", "k", zero(F.col("covered") / F.col("units")).alias("recall"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / F.col("ideal")).alias("ndcg"))
    return _long(wide, ["recall", "mrr", "ndcg"], ["query_id", "k"])


def document_metrics(expected: DataFrame, run: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """drm (1 - correct/k), hit and document_mrr: expected is query_id and document_id; run has document_id and rank."""
    good = run.join(expected.distinct(), ["query_id", "document_id"], "left_semi").select("query_id", "rank")
    by = cutoffs(good, ks).where(F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(F.count(F.lit(1)).alias("n"), F.min("rank").alias("first"))
    every = cutoffs(expected.select("query_id").distinct(), ks)
    wide = every.join(by, ["query_id", "k"], "left").select("query_id", "k", (1 - F.coalesce("n", F.lit(0)) / F.col("k")).alias("drm"), F.when(F.col("n") > 0, 1.0).otherwise(0.0).alias("hit"), F.coalesce(1 / F.col("first"), F.lit(0.0)).alias("document_mrr"))
    return _long(wide, ["drm", "hit", "document_mrr"], ["query_id", "k"])


def returned_drm(expected: DataFrame, run: DataFrame, ks: tuple[int, ...] = KS) -> DataFrame:
    """The other drm: wrong documents among those returned, 1 where nothing is."""
    marked = run.join(expected.distinct().withColumn("_ok", F.lit(1)), ["query_id", "document_id"], "left")
    by = cutoffs(marked, ks).where(F.col("rank") <= F.col("k")).groupBy("query_id", "k").agg(F.avg(F.when(F.col("_ok").isNull(), 1.0).otherwise(0.0)).alias("v"))
    return cutoffs(expected.select("query_id").distinct(), ks).join(by, ["query_id", "k"], "left").select("query_id", "k", F.lit("drm_returned").alias("metric"), F.coalesce("v", F.lit(1.0)).alias("value"))


def gold_documents(questions: DataFrame) -> DataFrame:
    """query_id and document_id of all valid documents: relevant_document_ids (an array, or text with bars) or else document_id."""
    kind = dict(questions.dtypes).get("relevant_document_ids")
    own = F.array(F.col("document_id").cast("string"))
    if kind is None:
        many = own
    else:
        given = F.col("relevant_document_ids") if kind.startswith("array") else F.filter(F.transform(F.split("relevant_document_ids", "\\|"), lambda x: F.trim(x)), lambda x: x != "")
        many = F.when(F.size(F.coalesce(given, F.array().cast("array<string>"))) > 0, given).otherwise(own)
    return questions.select("query_id", F.explode(F.array_distinct(many)).alias("document_id"))


def summarized(metrics: DataFrame, strata: DataFrame) -> DataFrame:
    """Means over all queries (level micro), by stratum, and over strata (level macro): strata is query_id, stratum.

    One aggregation with grouping sets gives the first two.
    """
    met = metrics.join(strata, "query_id")
    sets = met.groupingSets([["metric", "k"], ["metric", "k", "stratum"]], "metric", "k", "stratum").agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("queries"), F.grouping("stratum").alias("_g"))
    two = sets.select(F.when(F.col("_g") == 1, "micro").otherwise("stratum").alias("level"), "metric", "k", "stratum", "value", "queries")
    macro = two.where("level = 'stratum'").groupBy("metric", "k").agg(F.avg("value").alias("value"), F.sum("queries").alias("queries")).select(F.lit("macro").alias("level"), "metric", "k", F.lit(None).cast("string").alias("stratum"), "value", "queries")
    return two.unionByName(macro)


def wide_metrics(metrics: DataFrame, keys: list[str], names: list[str] | None = None) -> DataFrame:
    """metric@k as columns."""
    named = metrics.withColumn("_m", F.concat_ws("@", "metric", "k"))
    return named.groupBy(*keys).pivot("_m", names).agg(F.first("value"))


def latency_summary(latencies: DataFrame, column: str = "latency_ms", keys: list[str] | None = None) -> DataFrame:
    x = F.col(column)
    return latencies.groupBy(*(keys or [])).agg(F.count(x).alias("count"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.95)).alias("p95"), F.min(x).alias("minimum"), F.max(x).alias("maximum"))


def first_relevant(qrels: DataFrame, run: DataFrame) -> DataFrame:
    """query_id and the first rank of a relevant chunk; null if there is none."""
    good = run.join(qrels.where("grade > 0").select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_relevant_rank"))
    return qrels.select("query_id").distinct().join(good, "query_id", "left")


def rank_summary(ranks: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Of the ranks that aren't null: count, mean, median, and the nearest-rank 90th percentile."""
    return ranks.where("first_relevant_rank IS NOT NULL").groupBy(*(keys or [])).agg(F.count(F.lit(1)).alias("found"), F.avg("first_relevant_rank").alias("mean_rank"), F.percentile("first_relevant_rank", F.lit(0.5)).alias("median_rank"), F.expr("percentile_disc(0.9) WITHIN GROUP (ORDER BY first_relevant_rank)").alias("p90_rank"))


def retrieval_status(qrels: DataFrame, run: DataFrame, expected: DataFrame, k: int) -> DataFrame:
    """query_id and status: relevant_found, document_found_chunk_miss or document_miss within k."""
    chunk = first_relevant(qrels, run.where(F.col("rank") <= k))
    document = run.where(F.col("rank") <= k).join(expected.distinct(), ["query_id", "document_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first_document_rank"))
    status = F.when(F.col("first_relevant_rank").isNotNull(), "relevant_found").when(F.col("first_document_rank").isNotNull(), "document_found_chunk_miss").otherwise("document_miss")
    return chunk.join(document, "query_id", "left").select("query_id", "first_relevant_rank", "first_document_rank", status.alias("status"))


def paired_outcomes(a: DataFrame, b: DataFrame, names: tuple[str, str]) -> DataFrame:
    """outcome (both, one arm only, neither) and its number of queries, of two status tables."""
    found = lambda c: F.col(c) == "relevant_found"
    met = a.select("query_id", F.col("status").alias("_a")).join(b.select("query_id", F.col("status").alias("_b")), "query_id")
    outcome = F.when(found("_a") & found("_b"), "both").when(found("_a"), f"{names[0]}_only").when(found("_b"), f"{names[1]}_only").otherwise("neither")
    return met.groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("queries"))


def failure_classes(qrels: DataFrame, run: DataFrame, questions: DataFrame, chunks: DataFrame, k: int = 5) -> DataFrame:
    """query_id, category, first_relevant_rank: what stands in the way of a query's evidence in the top k."""
    first = first_relevant(qrels, run)
    gold = gold_documents(questions)
    top = run.where(F.col("rank") <= k).withColumn("document_id", F.col("document_id").cast("string")).join(gold, ["query_id", "document_id"], "left_semi").join(chunks.select("chunk_id", F.col("section_label").alias("_label")), "chunk_id", "left")
    by = top.join(questions.select("query_id", "target_section_label"), "query_id").groupBy("query_id").agg(F.lit(True).alias("_document"), F.max(F.col("_label").eqNullSafe(F.col("target_section_label"))).alias("_section"))
    base = F.when(F.col("_document").isNull(), "wrong_source_document").when(~F.col("_section"), "correct_document_wrong_section").otherwise("correct_document_and_section_wrong_passage")
    beyond = F.when(F.col("first_relevant_rank") > k, "+evidence_beyond_top_k").otherwise("")
    category = F.when(F.col("first_relevant_rank") <= k, "relevant_evidence_in_top_k").otherwise(F.concat(base, beyond))
    return first.join(by, "query_id", "left").select("query_id", category.alias("category"), "first_relevant_rank")


def depth_classes(qrels: DataFrame, run: DataFrame, questions: DataFrame, chunks: DataFrame, sections: DataFrame, k: int = 5, depth: int = 50) -> DataFrame:
    """query_id and class: success within k, wrong document, wrong section (by overlap of spans), found by depth, or not found."""
    first = first_relevant(qrels, run.where(F.col("rank") <= depth))
    gold = gold_documents(questions)
    top = run.where(F.col("rank") <= k).withColumn("document_id", F.col("document_id").cast("string")).join(gold, ["query_id", "document_id"], "left_semi").join(chunks.select("chunk_id", "start_position", "end_position"), "chunk_id").join(questions.select("query_id", "target_section_label"), "query_id")
    t, s = top.alias("t"), sections.select(F.col("document_id").cast("string").alias("document_id"), "section_label", F.col("start_position").alias("s"), F.col("end_position").alias("e")).alias("s")
    inside = t.join(s, (F.col("t.document_id") == F.col("s.document_id")) & (F.col("t.target_section_label") == F.col("s.section_label")) & (F.col("s.s") < F.col("t.end_position")) & (F.col("t.start_position") < F.col("s.e")), "left_semi").select("query_id").distinct().withColumn("_section", F.lit(True))
    met = first.join(top.select("query_id").distinct().withColumn("_document", F.lit(True)), "query_id", "left").join(inside, "query_id", "left")
    r = F.col("first_relevant_rank")
    return met.select("query_id", F.when(r <= k, f"success_top{k}").when(F.col("_document").isNull(), "wrong_document").when(F.col("_section").isNull(), "wrong_section").when(r.isNotNull(), f"rank_{k + 1}_to_{depth}").otherwise(f"not_in_top{depth}").alias("class"), "first_relevant_rank")


def context_delivery(included: DataFrame, questions: DataFrame) -> DataFrame:
    """query_id and whether its context holds all its evidence: included has document_id, start_position, included_end_position."""
    q, i = questions.alias("q"), included.alias("i")
    held = q.join(i, (F.col("q.query_id") == F.col("i.query_id")) & (F.col("q.document_id") == F.col("i.document_id")) & (F.col("i.start_position") <= F.col("q.evidence_start")) & (F.col("q.evidence_end") <= F.col("i.included_end_position")), "left_semi").select("query_id").distinct().withColumn("_held", F.lit(True))
    sizes = included.groupBy("query_id").agg(F.sum("included_words").alias("words"), F.count(F.lit(1)).alias("units"))
    return questions.select("query_id").join(held, "query_id", "left").join(sizes, "query_id", "left").select("query_id", F.coalesce("_held", F.lit(False)).alias("evidence_hit"), F.coalesce("words", F.lit(0)).alias("words"), F.coalesce("units", F.lit(0)).alias("units"))


def context_summary(delivery: DataFrame, strata: DataFrame) -> DataFrame:
    """By stratum, and for all (null): questions, hit rate, mean and median words, mean units of delivered contexts."""
    met = delivery.join(strata, "query_id")
    return met.groupingSets([[], ["stratum"]], "stratum").agg(F.count(F.lit(1)).alias("queries"), F.avg(F.col("evidence_hit").cast("int")).alias("hit_rate"), F.avg("words").alias("mean_words"), F.percentile("words", F.lit(0.5)).alias("median_words"), F.avg("units").alias("mean_units"), F.grouping("stratum").cast("int").alias("level"))


def rounded(value: Column, digits: int = 6) -> Column:
    return F.round(value, digits)
