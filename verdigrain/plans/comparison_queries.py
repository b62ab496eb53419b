"""Queries that compare several retrieval settings, and classify what they miss."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrain.operators import inference, metrics, retrieval
from verdigrain.plans import derived as d
from verdigrain.plans.catalogue import register
from verdigrain.plans.retrieval_queries import SQL_METRICS, _clusters, _expected, _graded, _metrics, _ranking, _rounded, _strata, _two_runs, context_delivery, factorial_contrasts, failure_classes
from verdigrain.session import dropped_tables

#: Arms by their name: k1 and b.
ARMS = {"fixed_independent": (1.2, 0.75), "fixed_contextual": (0.2, 0.0), "sac_independent": (1.2, 0.0), "sac_contextual": (0.2, 0.75)}
THREE = ("fixed_contextual", "fixed_independent", "sac_independent")


def _scores(spark: SparkSession, sf_dir: str, names: tuple[str, ...] = tuple(ARMS), documents: bool = False) -> DataFrame:
    """arm, query_id, metric, k, value at 5, of postings that are made once."""
    held: list[str] = []
    own, qrels, out = d.postings(spark, sf_dir, held), _graded(spark, sf_dir), None
    for arm in names:
        run = d.run(spark, sf_dir, 10, own, k1=ARMS[arm][0], b=ARMS[arm][1])
        found = _metrics(spark, sf_dir, run, qrels).where("k = 5")
        if documents:
            found = found.unionByName(metrics.document_metrics(_expected(spark, sf_dir), run, (5,)))
        found = found.withColumn("arm", F.lit(arm))
        out = found if out is None else out.unionByName(found)
    # the runs are stored
    dropped_tables(spark, held)
    return out


def sql_arms(names: tuple[str, ...], tail: str, documents: bool = False) -> str:
    runs = "".join(d.sql_run(f"r{i}", 10, *ARMS[arm]) for i, arm in enumerate(names))
    r = " UNION ALL ".join(f"SELECT '{arm}' AS arm, query_id, chunk_id, document_id, rank FROM r{i}" for i, arm in enumerate(names))
    arms = ", ".join(f"'{arm}'" for arm in names)
    more = """ UNION ALL SELECT arm, query_id, 5, unnest(['drm', 'hit', 'document_mrr']), unnest([1 - n / 5, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END, coalesce(1 / f, 0)]) FROM (SELECT a.arm, q.query_id, coalesce(n, 0) AS n, f FROM (SELECT DISTINCT query_id FROM ev) q CROSS JOIN (SELECT unnest([{arms}]) AS arm) a LEFT JOIN (SELECT arm, r.query_id, count(*) AS n, min(rank) AS f FROM r JOIN ev ON ev.query_id = r.query_id AND ev.document_id = r.document_id WHERE rank <= 5 GROUP BY 1, 2) USING (arm, query_id))""".replace("{arms}", arms)
    return f"""WITH {d.SQL_BM25}{runs},{d.SQL_EVIDENCE}, r AS ({r}){SQL_METRICS.format("arm, ", "r")},
wide AS (SELECT arm, idl.query_id, coalesce(c / u, 0) AS recall, coalesce(1 / f, 0) AS mrr, coalesce(dcg / ideal, 0) AS ndcg FROM idl JOIN un USING (query_id) CROSS JOIN (SELECT unnest([{arms}]) AS arm) LEFT JOIN hit USING (arm, query_id, k) LEFT JOIN cov USING (arm, query_id, k) WHERE k = 5),
m AS (SELECT arm, query_id, 5 AS k, 'recall' AS metric, CAST(recall AS DOUBLE) AS value FROM wide UNION ALL SELECT arm, query_id, 5, 'mrr', mrr FROM wide UNION ALL SELECT arm, query_id, 5, 'ndcg', ndcg FROM wide{more if documents else ""}),
p AS (SELECT b.arm AS baseline_arm, c.arm AS candidate_arm, query_id, metric, k, b.value AS baseline, c.value AS candidate, c.value - b.value AS difference FROM m b JOIN m c USING (query_id, metric, k) WHERE b.arm < c.arm),
cl AS (SELECT query_id, min(document_id) AS cluster FROM ev GROUP BY 1),
sr AS (SELECT query_id, arg_min(lang, document_id) AS stratum FROM ev JOIN documents ON doc_id = document_id GROUP BY 1){tail}"""


def sql_comparison(keys: str, source: str = "p") -> str:
    """The comparison table of pairs, by keys."""
    return f""",
cs AS (SELECT {keys}, cluster, sum(difference) AS s, count(*) AS n FROM {source} JOIN cl USING (query_id) GROUP BY ALL),
c2 AS (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY cluster) - 1 AS place, count(*) OVER (PARTITION BY {keys}) AS cn FROM cs),
dr AS (SELECT {keys}, rep, CAST(('0x' || substr(md5('42|' || rep || '|' || i), 1, 8)) AS BIGINT) % cn AS place FROM (SELECT DISTINCT {keys}, cn FROM c2) CROSS JOIN (SELECT unnest(range(1, 2001)) AS rep) CROSS JOIN LATERAL (SELECT unnest(range(0, cn)) AS i)),
me AS (SELECT {keys}, rep, sum(s) / sum(n) AS v FROM dr JOIN c2 USING ({keys}, place) GROUP BY ALL),
ci AS (SELECT {keys}, quantile_cont(v, 0.025) AS ci_low, quantile_cont(v, 0.975) AS ci_high FROM me GROUP BY ALL),
fl AS (SELECT {keys}, rep, sum(CASE WHEN CAST(('0x' || substr(md5('42|' || rep || '|' || place), 1, 8)) AS BIGINT) % 2 = 0 THEN s ELSE -s END) AS v FROM c2 CROSS JOIN (SELECT unnest(range(1, 10001)) AS rep) GROUP BY ALL),
ob AS (SELECT {keys}, sum(s) AS s, sum(n) AS n FROM c2 GROUP BY ALL),
pv AS (SELECT {keys}, (count(*) FILTER (round(abs(v / ob.n), 12) >= round(abs(ob.s / ob.n), 12)) + 1) / 10001 AS p_value FROM fl JOIN ob USING ({keys}) GROUP BY ALL),
oc AS (SELECT {keys}, count(*) AS queries, avg(baseline) AS baseline_mean, avg(candidate) AS candidate_mean, avg(difference) AS difference, count(*) FILTER (CASE WHEN metric = 'drm' THEN -difference ELSE difference END > 1e-12) AS wins, count(*) FILTER (abs(difference) <= 1e-12) AS ties, count(*) FILTER (CASE WHEN metric = 'drm' THEN -difference ELSE difference END < -1e-12) AS losses FROM {source} GROUP BY ALL)
SELECT {keys}, queries, round(baseline_mean, 6) AS baseline_mean, round(candidate_mean, 6) AS candidate_mean, round(difference, 6) + 0.0 AS difference, wins, ties, losses, CASE WHEN baseline_mean <> 0 THEN round(difference / abs(baseline_mean), 6) + 0.0 END AS relative_difference, round(ci_low, 6) + 0.0 AS ci_low, round(ci_high, 6) + 0.0 AS ci_high, round(p_value, 6) AS p_value FROM oc JOIN ci USING ({keys}) JOIN pv USING ({keys})"""


_NUMBERS = ("baseline_mean", "candidate_mean", "difference", "relative_difference", "ci_low", "ci_high", "p_value")
_KEYS = "baseline_arm, candidate_arm, metric, k"


def comparison_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pairs of three arms, with intervals and p values."""
    scores = _scores(spark, sf_dir, THREE)
    return _rounded(inference.comparison_table(scores, inference.all_pairs(scores), _clusters(spark, sf_dir)), *_NUMBERS)


register("comparison_table", comparison_table, sql_arms(THREE, sql_comparison(_KEYS)))


def comparison_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms by the language of the document that holds the evidence."""
    scores = _scores(spark, sf_dir, THREE[:2])
    return _rounded(inference.comparison_table(scores, inference.all_pairs(scores), _clusters(spark, sf_dir), strata=_strata(spark, sf_dir).where("stratum IS NOT NULL")), *_NUMBERS)


register("comparison_by_stratum", comparison_by_stratum, sql_arms(THREE[:2], ", ps AS (SELECT p.*, stratum FROM p JOIN sr USING (query_id) WHERE stratum IS NOT NULL)" + sql_comparison(_KEYS + ", stratum", "ps")))


def document_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two arms over the metrics of chunks and of documents; of drm less is better."""
    scores = _scores(spark, sf_dir, THREE[:2], documents=True)
    return _rounded(inference.comparison_table(scores, inference.all_pairs(scores), _clusters(spark, sf_dir)), *_NUMBERS)


register("document_comparison", document_comparison, sql_arms(THREE[:2], sql_comparison(_KEYS), documents=True))


def iid_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = inference.paired(*_two_runs(spark, sf_dir)).where("k = 5")
    return _rounded(inference.iid_bootstrap(pairs, ["metric", "k"]), "ci_low", "ci_high")


_TWO = ("fixed_contextual", "fixed_independent")
# the pair's baseline is the first run, whose arm comes second by name
_DRAWN = """, v AS (SELECT metric, k, query_id, -difference AS difference, row_number() OVER (PARTITION BY metric, k ORDER BY query_id) - 1 AS place, count(*) OVER (PARTITION BY metric, k) AS n FROM p),
dr AS (SELECT metric, k, rep, CAST(('0x' || substr(md5('42|' || rep || '|' || i), 1, 8)) AS BIGINT) % n AS place FROM (SELECT DISTINCT metric, k, n FROM v) CROSS JOIN (SELECT unnest(range(1, 2001)) AS rep) CROSS JOIN LATERAL (SELECT unnest(range(0, n)) AS i)),
me AS (SELECT metric, k, rep, avg(difference) AS x FROM dr JOIN v USING (metric, k, place) GROUP BY ALL) SELECT metric, k, round(quantile_cont(x, 0.025), 6) + 0.0 AS ci_low, round(quantile_cont(x, 0.975), 6) + 0.0 AS ci_high FROM me GROUP BY ALL"""
register("iid_bootstrap_ci", iid_bootstrap_ci, sql_arms(_TWO, _DRAWN))


def weight_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same draws as weights of all metrics at once."""
    pairs = inference.paired(*_two_runs(spark, sf_dir)).where("k = 5")
    return _rounded(inference.weight_bootstrap(pairs, ["metric", "k"]), "ci_low", "ci_high")


register("weight_bootstrap_ci", weight_bootstrap_ci, sql_arms(_TWO, _DRAWN))


def pilot_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(inference.pilot_summary(inference.paired(*_two_runs(spark, sf_dir)).where("k = 5")), "baseline_mean", "candidate_mean", "difference", "difference_sd")


register("pilot_summary", pilot_summary, sql_arms(_TWO, " SELECT metric, k, round(avg(candidate), 6) AS baseline_mean, round(avg(baseline), 6) AS candidate_mean, round(-avg(difference), 6) + 0.0 AS difference, round(stddev_samp(difference), 6) AS difference_sd FROM p GROUP BY ALL"))


def arm_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What not every arm has exactly once, after some scores were left out or repeated."""
    q = F.col("query_id") % 4
    scores = _scores(spark, sf_dir, THREE)
    scores = scores.where(~((q == 1) & (F.col("arm") == THREE[0]) & (F.col("metric") == "mrr")))
    scores = scores.withColumn("_k", F.explode(F.when((q == 2) & (F.col("arm") == THREE[1]) & (F.col("metric") == "ndcg"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_k")
    return inference.arm_violations(scores)


register("arm_faults", arm_faults, f"WITH {d.SQL_CHUNKS},{d.SQL_EVIDENCE}, q AS (SELECT DISTINCT query_id FROM qrels) SELECT query_id, 'mrr' AS metric, 5 AS k FROM q WHERE query_id % 4 = 1 UNION ALL SELECT query_id, 'ndcg', 5 FROM q WHERE query_id % 4 = 2")


def _designs(scores: DataFrame) -> DataFrame:
    """Mean metrics of every arm, its family (the part before the line) and its place among all."""
    means = scores.groupBy("arm").agg(*[F.round(F.avg(F.when(F.col("metric") == m, F.col("value"))), 9).alias(m) for m in ("ndcg", "mrr", "recall")])
    return means.withColumn("family", F.substring_index("arm", "_", 1)).withColumn("chunks", F.length("arm")).withColumn("ord", F.col("arm"))


def selected_designs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best arm of each family: by ndcg, mrr, recall, the shorter name, then the name."""
    out = inference.selected(_designs(_scores(spark, sf_dir)), ["ndcg", "mrr", "recall", "-chunks"])
    return out.select("family", "arm", *[F.round(c, 6).alias(c) for c in ("ndcg", "mrr", "recall")])


_SELECTED = ", de AS (SELECT arm, string_split(arm, '_')[1] AS family, round(avg(value) FILTER (metric = 'ndcg'), 9) AS ndcg, round(avg(value) FILTER (metric = 'mrr'), 9) AS mrr, round(avg(value) FILTER (metric = 'recall'), 9) AS recall FROM m GROUP BY 1), se AS (SELECT * FROM de QUALIFY row_number() OVER (PARTITION BY family ORDER BY ndcg DESC, mrr DESC, recall DESC, length(arm), arm) = 1)"
register("selected_designs", selected_designs, sql_arms(tuple(ARMS), _SELECTED + " SELECT family, arm, round(ndcg, 6) AS ndcg, round(mrr, 6) AS mrr, round(recall, 6) AS recall FROM se"))


def selected_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best arm of one family against that of the other."""
    from verdigrain.session import stored

    scores = stored(_scores(spark, sf_dir), "scores")
    best = inference.selected(_designs(scores), ["ndcg", "mrr", "recall", "-chunks"])
    return _rounded(inference.comparison_table(scores, inference.all_pairs(best), _clusters(spark, sf_dir)), *_NUMBERS)


register("selected_comparison", selected_comparison, sql_arms(tuple(ARMS), _SELECTED + ", ps AS (SELECT p.* FROM p JOIN se a ON a.arm = baseline_arm JOIN se b ON b.arm = candidate_arm)" + sql_comparison(_KEYS, "ps")))

from verdigrain.operators.inference import CONTRASTS  # noqa: E402

_WEIGHTS = ", ".join(f"('{c}', '{arm}', {w})" for c, weights in CONTRASTS.items() for arm, w in weights.items())
register("factorial_contrasts", factorial_contrasts, sql_arms(tuple(ARMS), f", wt AS (SELECT * FROM (VALUES {_WEIGHTS}) v(contrast, arm, weight)), dif AS (SELECT contrast, query_id, metric, k, sum(weight * value) AS x FROM m JOIN wt USING (arm) GROUP BY ALL) SELECT contrast, metric, k, round(avg(x), 6) + 0.0 AS mean_difference, count(*) FILTER (x > 1e-12) AS wins, count(*) FILTER (abs(x) <= 1e-12) AS ties, count(*) FILTER (x < -1e-12) AS losses FROM dif GROUP BY ALL"))

_FIRST = """, fq AS (SELECT query_id, document_id, chunk_id FROM qrels QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY document_id, chunk_start) = 1), q AS (SELECT fq.query_id, fq.document_id, CASE WHEN chunk_index = 0 THEN 'first' ELSE 'later' END AS label FROM fq JOIN chunks USING (chunk_id)),
fr AS (SELECT query_id, min(rank) AS f FROM r JOIN (SELECT DISTINCT query_id, chunk_id FROM qrels) USING (query_id, chunk_id) GROUP BY 1)"""
register("failure_classes", failure_classes, f"""WITH {d.SQL_BM25}{d.sql_run('r')},{d.SQL_EVIDENCE}{_FIRST},
t AS (SELECT q.query_id, bool_or(CASE WHEN c.chunk_index = 0 THEN 'first' ELSE 'later' END = q.label) AS s FROM r JOIN q ON q.query_id = r.query_id AND q.document_id = r.document_id JOIN chunks c USING (chunk_id) WHERE rank <= 3 GROUP BY 1)
SELECT CASE WHEN f <= 3 THEN 'relevant_evidence_in_top_k' ELSE CASE WHEN s IS NULL THEN 'wrong_source_document' WHEN NOT s THEN 'correct_document_wrong_section' ELSE 'correct_document_and_section_wrong_passage' END || CASE WHEN f > 3 THEN '+evidence_beyond_top_k' ELSE '' END END AS category, count(*) AS queries FROM q LEFT JOIN fr USING (query_id) LEFT JOIN t USING (query_id) GROUP BY 1""")


def depth_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes by depth, with the halves of documents as sections and questions on the half in which their evidence begins."""
    own, docs = d.chunks(spark, sf_dir), d.documents(spark, sf_dir)
    half = F.floor(F.length("text") / 2).cast("bigint")
    parts = docs.select("document_id", F.explode(F.array(F.struct(F.lit("a").alias("g"), F.lit(0).cast("bigint").alias("s"), half.alias("e")), F.struct(F.lit("b").alias("g"), half.alias("s"), F.length("text").cast("bigint").alias("e")))).alias("p")).select("document_id", F.col("p.g").alias("section_label"), F.col("p.s").alias("start_position"), F.col("p.e").alias("end_position"))
    first = d.evidence(spark, sf_dir).groupBy("query_id").agg(F.min(F.struct("document_id", "evidence_start")).alias("e")).select("query_id", "e.*")
    asked = first.join(docs, "document_id").select("query_id", "document_id", F.when(F.col("evidence_start") < half, "a").otherwise("b").alias("target_section_label"))
    qrels = _graded(spark, sf_dir).select("query_id", "chunk_id", "grade")
    out = metrics.depth_classes(qrels, d.run(spark, sf_dir), asked, own, parts, 2, 10)
    return out.select("query_id", "class", F.col("first_relevant_rank").cast("bigint").alias("first_relevant_rank"))


register("depth_classes", depth_classes, f"""WITH {d.SQL_BM25}{d.sql_run('r')},{d.SQL_EVIDENCE}, e1 AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY document_id, evidence_start) = 1),
q AS (SELECT query_id, e1.document_id, floor(length(text) / 2) AS h, length(text) AS n, evidence_start < floor(length(text) / 2) AS a FROM e1 JOIN documents ON doc_id = e1.document_id),
fr AS (SELECT query_id, min(rank) AS f FROM r JOIN (SELECT DISTINCT query_id, chunk_id FROM qrels) USING (query_id, chunk_id) GROUP BY 1), qs AS (SELECT DISTINCT query_id FROM qrels),
t AS (SELECT q.query_id, bool_or(CASE WHEN a THEN c.start_position < h AND h > 0 ELSE c.end_position > h END) AS s FROM r JOIN q ON q.query_id = r.query_id AND q.document_id = r.document_id JOIN chunks c USING (chunk_id) WHERE rank <= 2 GROUP BY 1)
SELECT query_id, CASE WHEN f <= 2 THEN 'success_top2' WHEN s IS NULL THEN 'wrong_document' WHEN NOT s THEN 'wrong_section' WHEN f IS NOT NULL THEN 'rank_3_to_10' ELSE 'not_in_top10' END AS class, f AS first_relevant_rank FROM qs LEFT JOIN fr USING (query_id) LEFT JOIN t USING (query_id)""")


def chunk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall by chunks instead of evidence, as columns by cutoff."""
    qrels = _graded(spark, sf_dir).select("query_id", "chunk_id", "grade")
    found = metrics.ranking_metrics(qrels, d.run(spark, sf_dir)).where("metric = 'recall'")
    wide = metrics.wide_metrics(found, ["query_id"], [f"recall@{k}" for k in metrics.KS])
    return wide.select("query_id", *[F.round(F.col(f"`recall@{k}`"), 6).alias(f"recall_{k}") for k in metrics.KS])


register("chunk_recall", chunk_recall, f"""WITH {d.SQL_BM25}{d.sql_run('r')},{d.SQL_EVIDENCE}, g AS (SELECT DISTINCT query_id, chunk_id FROM qrels), n AS (SELECT query_id, count(*) AS n FROM g GROUP BY 1), h AS (SELECT query_id, rank FROM r JOIN g USING (query_id, chunk_id))
SELECT n.query_id, {", ".join(f"round(count(rank) FILTER (rank <= {k}) / max(n), 6) AS recall_{k}" for k in metrics.KS)} FROM n LEFT JOIN h USING (query_id) GROUP BY 1""")


def relevant_rank_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranks of the first relevant chunk, by language: mean, median and the nearest-rank 90th percentile."""
    ranks = metrics.first_relevant(_graded(spark, sf_dir), d.run(spark, sf_dir)).join(_strata(spark, sf_dir), "query_id")
    return _rounded(metrics.rank_summary(ranks, ["stratum"]), "mean_rank", "median_rank").withColumn("p90_rank", F.col("p90_rank").cast("bigint"))


register("relevant_rank_summary", relevant_rank_summary, f"""WITH {d.SQL_BM25}{d.sql_run('r')},{d.SQL_EVIDENCE}, sr AS (SELECT query_id, arg_min(lang, document_id) AS stratum FROM ev JOIN documents ON doc_id = document_id GROUP BY 1),
f AS (SELECT query_id, min(rank) AS f FROM r JOIN (SELECT DISTINCT query_id, chunk_id FROM qrels) USING (query_id, chunk_id) GROUP BY 1)
SELECT stratum, count(*) AS found, round(avg(f), 6) AS mean_rank, round(quantile_cont(CAST(f AS DOUBLE), 0.5), 6) AS median_rank, list_sort(list(f))[CAST(ceil(0.9 * count(*)) AS BIGINT)] AS p90_rank FROM f JOIN sr USING (query_id) GROUP BY 1""")

_DELIVERY = f"""WITH {d.SQL_BM25}{d.sql_run('r')},{d.SQL_EVIDENCE}, e1 AS (SELECT * FROM ev QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY document_id, evidence_start, evidence_end) = 1),
x AS (SELECT r.query_id, r.rank, c.document_id, c.start_position, c.end_position, regexp_extract_all(c.text, '\\s*\\S+') AS w FROM r JOIN chunks c USING (chunk_id)),
y AS (SELECT *, least(len(w), greatest(0, 400 - coalesce(sum(len(w)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS t FROM x WHERE len(w) > 0),
z AS (SELECT *, CASE WHEN t < len(w) THEN start_position + length(array_to_string(list_slice(w, 1, CAST(t AS BIGINT)), '')) ELSE end_position END AS stop FROM y WHERE t > 0),
dl AS (SELECT e1.query_id, coalesce(bool_or(z.document_id = e1.document_id AND z.start_position <= evidence_start AND evidence_end <= stop), false) AS evidence_hit, CAST(coalesce(sum(t), 0) AS BIGINT) AS words, count(t) AS units FROM e1 LEFT JOIN z USING (query_id) GROUP BY 1)"""
register("context_delivery", context_delivery, _DELIVERY + " SELECT * FROM dl")


def context_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Delivered contexts by the language of the evidence, and in all."""
    strata = _strata(spark, sf_dir).withColumn("stratum", F.coalesce("stratum", F.lit("none")))
    return _rounded(metrics.context_summary(context_delivery(spark, sf_dir), strata), "hit_rate", "mean_words", "median_words", "mean_units")


register("context_summary", context_summary, _DELIVERY + """, sr AS (SELECT query_id, coalesce(arg_min(lang, document_id), 'none') AS stratum FROM ev JOIN documents ON doc_id = document_id GROUP BY 1)
SELECT stratum, count(*) AS queries, round(avg(CAST(evidence_hit AS INT)), 6) AS hit_rate, round(avg(words), 6) AS mean_words, round(quantile_cont(CAST(words AS DOUBLE), 0.5), 6) AS median_words, round(avg(units), 6) AS mean_units, grouping(stratum) AS level FROM dl JOIN sr USING (query_id) GROUP BY GROUPING SETS ((), (stratum))""")


def timed_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a run that was timed, and whether each question took some time."""
    found, each = retrieval.timed(lambda: _ranking(spark, sf_dir).select("query_id", "chunk_id", "rank"), max(1, d.questions(spark, sf_dir).count()))
    return found.withColumn("rank", F.col("rank").cast("bigint")).withColumn("timed", F.lit(each > 0))


register("timed_run", timed_run, f"WITH {d.SQL_BM25}{d.sql_run('r')} SELECT query_id, chunk_id, rank, true AS timed FROM r")
