"""Paired comparisons: differences, cluster bootstrap, sign flips, factorial contrasts, sample sizes.

Draws come from MD5 of seed, replicate and position, so they are the same on every engine and after
every retry. Clusters are summed before they are drawn.
"""

from __future__ import annotations

import math
import statistics

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


TOLERANCE = 1e-12

# Planned contrasts of a two by two design, by the weight of each arm.
CONTRASTS = {
    "contextual_effect_within_fixed": {"fixed_contextual": 1.0, "fixed_independent": -1.0},
    "contextual_effect_within_sac": {"sac_contextual": 1.0, "sac_independent": -1.0},
    "sac_effect_with_independent": {"sac_independent": 1.0, "fixed_independent": -1.0},
    "sac_effect_with_contextual": {"sac_contextual": 1.0, "fixed_contextual": -1.0},
    "combined_vs_conventional_baseline": {"sac_contextual": 1.0, "fixed_independent": -1.0},
    "contextual_marginal_effect": {"fixed_contextual": 0.5, "sac_contextual": 0.5, "fixed_independent": -0.5, "sac_independent": -0.5},
    "sac_marginal_effect": {"sac_independent": 0.5, "sac_contextual": 0.5, "fixed_independent": -0.5, "fixed_contextual": -0.5},
    "chunking_embedding_interaction": {"sac_contextual": 1.0, "sac_independent": -1.0, "fixed_contextual": -1.0, "fixed_independent": 1.0},
}


def draw(*parts: Column | str | int) -> Column:
    """A whole number below 2^32 that depends on the parts alone."""
    columns = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *columns).cast("binary")), 1, 8), 16, 10).cast("bigint")


def paired(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """query_id, metric, k, baseline, candidate, difference of two metric tables."""
    b, c = baseline.withColumnRenamed("value", "baseline"), candidate.withColumnRenamed("value", "candidate")
    return b.join(c, ["query_id", "metric", "k"]).withColumn("difference", F.col("candidate") - F.col("baseline"))


def unpaired(baseline: DataFrame, candidate: DataFrame) -> DataFrame:
    """Queries that only one of two tables has."""
    a, b = baseline.select("query_id").distinct(), candidate.select("query_id").distinct()
    return a.join(b, "query_id", "left_anti").unionByName(b.join(a, "query_id", "left_anti"))


def outcomes(pairs: DataFrame, lower_is_better: tuple[str, ...] = ("drm", "drm_returned"), keys: tuple[str, ...] = ("metric", "k")) -> DataFrame:
    """keys, means, difference, relative difference (null if the baseline's mean is 0), wins, ties, losses."""
    way = F.when(F.col("metric").isin(*lower_is_better), -F.col("difference")).otherwise(F.col("difference"))
    by = pairs.withColumn("_d", way).groupBy(*keys).agg(F.count(F.lit(1)).alias("queries"), F.avg("baseline").alias("baseline_mean"), F.avg("candidate").alias("candidate_mean"), F.avg("difference").alias("difference"), F.count_if(F.col("_d") > TOLERANCE).alias("wins"), F.count_if(F.abs("_d") <= TOLERANCE).alias("ties"), F.count_if(F.col("_d") < -TOLERANCE).alias("losses"))
    return by.withColumn("relative_difference", F.when(F.col("baseline_mean") != 0, F.col("difference") / F.abs("baseline_mean")))


def clustered(values: DataFrame, clusters: DataFrame, keys: list[str]) -> DataFrame:
    """keys, place (clusters in order of their id, from 0), s (sum), n (count), clusters (how many): values has query_id and difference."""
    sums = values.join(clusters, "query_id").groupBy(*keys, "cluster").agg(F.sum("difference").alias("s"), F.count(F.lit(1)).alias("n"))
    order = Window.partitionBy(*keys).orderBy("cluster")
    whole = Window.partitionBy(*keys)
    return sums.select(*keys, "cluster", (F.row_number().over(order) - 1).cast("bigint").alias("place"), F.count(F.lit(1)).over(whole).alias("clusters"), "s", "n")


def cluster_bootstrap(sums: DataFrame, keys: list[str], *, samples: int = 2000, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """keys, ci_low, ci_high: whole clusters drawn with replacement, means over all their queries.

    One row for each replicate and position is made from a range and joined to the cluster it draws.
    """
    table = sums.select(*keys, "place", "clusters", "s", "n")
    sized = table.select(*keys, "clusters").distinct()
    draws = sized.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(samples)))).withColumn("i", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("clusters") - 1)))
    draws = draws.withColumn("place", F.pmod(draw(seed, F.col("replicate"), F.col("i")), F.col("clusters"))).drop("clusters", "i")
    means = draws.join(table.drop("clusters"), [*keys, "place"]).groupBy(*keys, "replicate").agg((F.sum("s") / F.sum("n")).alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", F.lit(low)).alias("ci_low"), F.percentile("m", F.lit(high)).alias("ci_high"))


def iid_bootstrap(values: DataFrame, keys: list[str], **parameters) -> DataFrame:
    """keys, ci_low, ci_high: single queries drawn with replacement. values has query_id and difference."""
    alone = values.select("query_id", F.col("query_id").alias("cluster")).distinct()
    return cluster_bootstrap(clustered(values, alone, keys), keys, **parameters)


def weight_bootstrap(values: DataFrame, keys: list[str], *, samples: int = 2000, seed: int = 42, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """keys, ci_low, ci_high: how often each query is drawn is one weight in each replicate, the same for all keys.

    One table of weights serves all metrics: it is joined by query, and means are weighted sums.
    """
    queries = values.select("query_id").distinct()
    places = queries.withColumn("place", F.row_number().over(Window.orderBy("query_id")) - 1)
    sized = queries.agg(F.count(F.lit(1)).alias("n"))
    draws = sized.select("n", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("replicate")).select("n", "replicate", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)).alias("i"))
    weights = draws.groupBy("replicate", F.pmod(draw(seed, F.col("replicate"), F.col("i")), F.col("n")).alias("place")).agg(F.count(F.lit(1)).alias("w"))
    met = weights.join(places, "place").join(values.select(*keys, "query_id", "difference"), "query_id")
    means = met.groupBy(*keys, "replicate").agg((F.sum(F.col("w") * F.col("difference")) / F.sum("w")).alias("m"))
    return means.groupBy(*keys).agg(F.percentile("m", F.lit(low)).alias("ci_low"), F.percentile("m", F.lit(high)).alias("ci_high"))


def paired_arms(scores: DataFrame, pairs: DataFrame) -> DataFrame:
    """baseline_arm, candidate_arm, query_id, metric, k, baseline, candidate, difference: scores has arm, pairs the names of two arms each."""
    b = scores.select(F.col("arm").alias("baseline_arm"), "query_id", "metric", "k", F.col("value").alias("baseline"))
    c = scores.select(F.col("arm").alias("candidate_arm"), "query_id", "metric", "k", F.col("value").alias("candidate"))
    met = pairs.select("baseline_arm", "candidate_arm").join(b, "baseline_arm").join(c, ["candidate_arm", "query_id", "metric", "k"])
    return met.withColumn("difference", F.col("candidate") - F.col("baseline"))


def all_pairs(arms: DataFrame) -> DataFrame:
    """Every two arms once, in the order of their names."""
    a = arms.select("arm").distinct()
    return a.select(F.col("arm").alias("baseline_arm")).join(a.select(F.col("arm").alias("candidate_arm")), F.col("baseline_arm") < F.col("candidate_arm"))


def comparison_table(scores: DataFrame, pairs: DataFrame, clusters: DataFrame, *, strata: DataFrame | None = None, bootstrap: int = 2000, permutations: int = 10_000) -> DataFrame:
    """For each pair of arms [, stratum], metric and k: means, differences, wins, confidence interval by clusters, and p by sign flips."""
    rows = paired_arms(scores, pairs)
    keys = ["baseline_arm", "candidate_arm", "metric", "k"]
    if strata is not None:
        rows, keys = rows.join(strata, "query_id"), [*keys, "stratum"]
    sums = clustered(rows, clusters, keys)
    out = outcomes(rows, keys=tuple(keys)).join(cluster_bootstrap(sums, keys, samples=bootstrap), keys)
    return out.join(sign_flip(sums, keys, samples=permutations).select(*keys, "p_value"), keys)


def sign_flip(sums: DataFrame, keys: list[str], *, samples: int = 10_000, seed: int = 42, digits: int = 12) -> DataFrame:
    """keys, observed, p_value = (extreme + 1) / (samples + 1) when clusters' signs are drawn."""
    total = sums.groupBy(*keys).agg(F.sum("n").alias("_n"), F.sum("s").alias("_s"))
    flips = sums.select(*keys, "place", "s", F.explode(F.sequence(F.lit(1), F.lit(samples))).alias("replicate"))
    signed = F.when(draw(seed, F.col("replicate"), F.col("place")) % 2 == 0, F.col("s")).otherwise(-F.col("s"))
    by = flips.groupBy(*keys, "replicate").agg(F.sum(signed).alias("p"))
    met = by.join(total, keys)
    extreme = F.round(F.abs(F.col("p") / F.col("_n")), digits) >= F.round(F.abs(F.col("_s") / F.col("_n")), digits)
    return met.groupBy(*keys).agg((F.max("_s") / F.max("_n")).alias("observed"), ((F.count_if(extreme) + 1) / (F.lit(samples) + 1)).alias("p_value"))


def contrasts(arms: DataFrame, planned: dict[str, dict[str, float]] | None = None) -> DataFrame:
    """contrast, query_id, metric, k, difference: arms has arm, query_id, metric, k, value; weights are joined by arm."""
    rows = [(name, arm, float(w)) for name, weights in (planned or CONTRASTS).items() for arm, w in weights.items()]
    table = arms.sparkSession.createDataFrame(rows, "contrast string, arm string, weight double")
    return arms.join(F.broadcast(table), "arm").groupBy("contrast", "query_id", "metric", "k").agg(F.sum(F.col("weight") * F.col("value")).alias("difference"))


def contrast_outcomes(differences: DataFrame, lower_is_better: tuple[str, ...] = ("drm", "drm_returned")) -> DataFrame:
    """contrast, metric, k, mean, wins, ties, losses."""
    way = F.when(F.col("metric").isin(*lower_is_better), -F.col("difference")).otherwise(F.col("difference"))
    return differences.withColumn("_d", way).groupBy("contrast", "metric", "k").agg(F.avg("difference").alias("mean_difference"), F.count_if(F.col("_d") > TOLERANCE).alias("wins"), F.count_if(F.abs("_d") <= TOLERANCE).alias("ties"), F.count_if(F.col("_d") < -TOLERANCE).alias("losses"))


def arm_violations(arms: DataFrame) -> DataFrame:
    """(query_id, metric, k) that not every arm has exactly once."""
    n = arms.select("arm").distinct().select(F.count(F.lit(1)).alias("_arms"))
    by = arms.groupBy("query_id", "metric", "k").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("arm").alias("a"))
    return by.crossJoin(F.broadcast(n)).where((F.col("n") != F.col("_arms")) | (F.col("a") != F.col("_arms"))).select("query_id", "metric", "k")


def intraclass_correlation(values: DataFrame, cluster: str, value: str) -> DataFrame:
    """One row, icc: ICC(1,1) of clusters of equal size, between 0 and 1; null unless there are two clusters of two."""
    by = values.groupBy(cluster).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    all_ = by.agg(F.count(F.lit(1)).alias("k"), F.min("n").alias("n"), F.max("n").alias("n2"), F.var_samp("m").alias("between"), F.sum(F.col("v") * F.col("n")).alias("within"))
    between, within = F.col("n") * F.col("between"), F.col("within") / (F.col("k") * (F.col("n") - 1))
    bottom = between + (F.col("n") - 1) * within
    icc = F.when(bottom == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (between - within) / bottom)))
    return all_.select(F.when((F.col("k") >= 2) & (F.col("n") == F.col("n2")) & (F.col("n") >= 2), icc).alias("icc"))


def intraclass_correlations(values: DataFrame, cluster: str, value: str) -> DataFrame:
    """n, clusters, icc: intraclass_correlation of the clusters of each size; null where there aren't two clusters of two.

    All values count: a cluster belongs to the set of its own size.
    """
    by = values.groupBy(cluster).agg(F.count(value).alias("n"), F.avg(value).alias("m"), F.var_pop(value).alias("v"))
    sets = by.groupBy("n").agg(F.count(F.lit(1)).alias("clusters"), F.var_samp("m").alias("between"), F.sum("v").alias("v"))
    between, within = F.col("n") * F.col("between"), F.try_divide(F.col("n") * F.col("v"), F.col("clusters") * (F.col("n") - 1))
    bottom = between + (F.col("n") - 1) * within
    icc = F.when(bottom == 0, 0.0).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.try_divide(between - within, bottom))))
    return sets.select("n", "clusters", F.when((F.col("clusters") >= 2) & (F.col("n") >= 2), icc).alias("icc"))


def paired_sample_size(effect: float, deviation: float, *, alpha: float = 0.05, power: float = 0.8) -> int:
    """Pairs for a two-sided test of a mean difference, by the normal approximation."""
    effect = abs(effect)
    if effect <= 0 or deviation <= 0 or not 0 < alpha < 1 or not 0 < power < 1:
        raise ValueError("effect and deviation must be positive, alpha and power between 0 and 1")
    normal = statistics.NormalDist()
    return math.ceil(((normal.inv_cdf(1 - alpha / 2) + normal.inv_cdf(power)) * deviation / effect) ** 2)


def cluster_plan(queries: int, per_document: int, icc: float) -> dict[str, float]:
    """design_effect, documents and queries once clusters are allowed for."""
    if queries <= 0 or per_document <= 0 or not 0 <= icc < 1:
        raise ValueError("numbers must be positive and the correlation at least 0 and below 1")
    effect = 1 + (per_document - 1) * icc
    documents = math.ceil(math.ceil(queries * effect) / per_document)
    return {"design_effect": effect, "documents": documents, "queries": documents * per_document}


def plan_grid(spark, effects: list[float], correlations: list[float], deviation: float, per_document: int) -> DataFrame:
    """A row for each effect and correlation: pairs, design_effect, documents, queries."""
    rows = []
    for effect in effects:
        n = paired_sample_size(effect, deviation)
        rows += [(float(effect), float(icc), n, float(p["design_effect"]), p["documents"], p["queries"]) for icc in correlations for p in [cluster_plan(n, per_document, icc)]]
    return spark.createDataFrame(rows, "effect double, icc double, pairs int, design_effect double, documents int, queries int")


def pilot_summary(pairs: DataFrame) -> DataFrame:
    """metric, k: means and the standard deviation of differences."""
    return pairs.groupBy("metric", "k").agg(F.avg("baseline").alias("baseline_mean"), F.avg("candidate").alias("candidate_mean"), F.avg("difference").alias("difference"), F.stddev_samp("difference").alias("difference_sd"))


def selected(designs: DataFrame, by: list[str], family: str = "family") -> DataFrame:
    """The best design of each family: largest by columns in order; a leading minus means smallest; then the first by ord."""
    order = [F.asc(c[1:]) if c.startswith("-") else F.desc(c) for c in by]
    return designs.withColumn("_r", F.row_number().over(Window.partitionBy(family).orderBy(*order, "ord"))).where("_r = 1").drop("_r")
