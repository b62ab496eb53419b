"""Queries on chunks, retrieval, ground truth and metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigrain.functions import text as tx
from verdigrain.operators import chunking, embedding, inference, metrics, retrieval
from verdigrain.plans import derived as d
from verdigrain.plans.catalogue import register
from verdigrain.session import dropped_tables, stored, table



def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def fixed_word_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.chunks(spark, sf_dir).select("chunk_id", "document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "start_position", "end_position", F.md5(F.col("text").cast("binary")).alias("text_md5"))


register("fixed_word_chunks", fixed_word_chunks, f"WITH {d.SQL_CHUNKS} SELECT chunk_id, document_id, chunk_index, start_position, end_position, md5(text) AS text_md5 FROM chunks")


def chunk_length_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = d.chunks(spark, sf_dir).withColumn("words", tx.word_count(F.col("text")).cast("double"))
    stats = chunking.length_distribution(words, "words")
    short = words.agg(F.count_if(F.col("words") < 50).alias("short"))
    return _rounded(stats.crossJoin(short), "mean")


register("chunk_length_stats", chunk_length_stats, f"WITH {d.SQL_CHUNKS}, x AS (SELECT CAST(len(regexp_extract_all(text, '\\S+')) AS DOUBLE) AS words FROM chunks) SELECT count(*) AS count, min(words) AS minimum, round(avg(words), 6) AS mean, quantile_cont(words, 0.5) AS median, quantile_cont(words, 0.95) AS p95, max(words) AS maximum, count(*) FILTER (words < 50) AS short FROM x")


def parent_child_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, children = chunking.parent_child_chunks(d.documents(spark, sf_dir))
    return children.select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "start_position", "end_position", "parent_start_position", "parent_end_position", "chunk_id", "parent_id")


register("parent_child_chunks", parent_child_chunks, r"""
WITH w AS (SELECT document_id, i, piece, sum(length(piece)) OVER (PARTITION BY document_id ORDER BY i) AS en FROM (
  SELECT doc_id AS document_id, unnest(regexp_extract_all(text, '\s*\S+')) AS piece, unnest(range(1, len(regexp_extract_all(text, '\s*\S+')) + 1)) AS i FROM documents)),
ws AS (SELECT document_id, i, CAST(en - length(regexp_extract(piece, '\S+')) AS BIGINT) AS st, CAST(en AS BIGINT) AS en FROM w),
nw AS (SELECT document_id, max(i) AS n FROM w GROUP BY 1),
p AS (SELECT document_id, j, j * 400 + 1 AS a, least(j * 400 + 500, n) AS b FROM (SELECT document_id, n, unnest(range(0, CASE WHEN n <= 500 THEN 1 ELSE CAST(ceil((n - 500) / 400.0) AS BIGINT) + 1 END)) AS j FROM nw)),
c AS (SELECT document_id, j, a, b, h, a + h * 120 AS ca, least(a + h * 120 + 149, b) AS cb FROM (SELECT *, unnest(range(0, CASE WHEN b - a + 1 <= 150 THEN 1 ELSE CAST(ceil((b - a + 1 - 150) / 120.0) AS BIGINT) + 1 END)) AS h FROM p)),
s AS (SELECT c.document_id, j, row_number() OVER (PARTITION BY c.document_id ORDER BY j, h) - 1 AS chunk_index, x.st AS start_position, y.en AS end_position, pa.st AS parent_start_position, pb.en AS parent_end_position FROM c
  JOIN ws x ON x.document_id = c.document_id AND x.i = ca JOIN ws y ON y.document_id = c.document_id AND y.i = cb JOIN ws pa ON pa.document_id = c.document_id AND pa.i = a JOIN ws pb ON pb.document_id = c.document_id AND pb.i = b),
n AS (SELECT *, document_id || '-hierarchical-parent-' || substr(sha1('hierarchical|parent|' || document_id || '|' || j || '|' || parent_start_position || '|' || parent_end_position || '|'), 1, 12) AS parent_id FROM s)
SELECT document_id, chunk_index, start_position, end_position, parent_start_position, parent_end_position, document_id || '-hierarchical-child-' || substr(sha1('hierarchical|child|' || document_id || '|' || chunk_index || '|' || start_position || '|' || end_position || '|' || parent_id), 1, 12) AS chunk_id, parent_id FROM n""")


def token_document_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = d.documents(spark, sf_dir)
    return retrieval.document_frequency(docs.select(F.col("document_id").alias("chunk_id"), "text"))


register("token_document_frequency", token_document_frequency, f"SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct({d.SQL_TOKENS.format('text')})) AS term FROM documents) GROUP BY 1")


def bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(d.run(spark, sf_dir).select("query_id", "chunk_id", "document_id", F.col("rank").cast("bigint").alias("rank"), "score"), "score")


register("bm25_topk", bm25_topk, f"WITH {d.SQL_BM25}{d.sql_run('r')} SELECT query_id, chunk_id, document_id, rank, round(score, 6) AS score FROM r")


def _vectors(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Every embedding whose id is divisible by 20 as a query, and all of them as the index."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("vec_id").alias("chunk_ord"), F.col("embedding").alias("vector"), "label")
    return rows.where(F.col("chunk_id") % 20 == 0).select(F.col("chunk_id").alias("query_id"), "vector", "label"), rows


def dense_topk_cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, index = _vectors(spark, sf_dir)
    return _rounded(retrieval.dense_topk(queries, index, 10).withColumn("rank", F.col("rank").cast("bigint")), "score")


_SQL_DENSE = "WITH e AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), n AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e), s AS (SELECT q.vec_id AS query_id, c.vec_id AS chunk_id, round(list_dot_product(q.v, c.v), 9) AS score FROM n q JOIN n c ON {0} WHERE q.vec_id % 20 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM s) SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10"
register("dense_topk_cosine", dense_topk_cosine, _SQL_DENSE.format("true"))


def dense_topk_filtered(spark: SparkSession, sf_dir: str) -> DataFrame:
    queries, index = _vectors(spark, sf_dir)
    return _rounded(retrieval.dense_topk(queries, index, 10, on="label").withColumn("rank", F.col("rank").cast("bigint")), "score")


register("dense_topk_filtered", dense_topk_filtered, _SQL_DENSE.format("q.label = c.label"))

#: Weights of the sweep, from lexical matches only to the first run only.
SWEEP = [1.0, 0.75, 0.5, 0.25, 0.0]


def _ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A first run by term presence, with BM25 ranks of its candidates."""
    own = d.postings(spark, sf_dir)
    first = d.run(spark, sf_dir, 20, own, k1=0.2, b=0.0)
    return retrieval.lexical_ranks(first, retrieval.bm25_scores(d.questions(spark, sf_dir), own))


_SQL_RANKS = f"""{d.SQL_BM25}{d.sql_run("f", 20, 0.2, 0.0)}{d.sql_scores("g")},
rk AS (SELECT f.query_id, f.chunk_id, f.document_id, f.rank AS dense_rank, row_number() OVER (PARTITION BY f.query_id ORDER BY coalesce(g_score.score, 0) DESC, f.rank) AS bm25_rank FROM f LEFT JOIN g_score ON g_score.query_id = f.query_id AND g_score.chunk_id = f.chunk_id),
fu AS (SELECT w AS dense_weight, query_id, chunk_id, document_id, dense_rank, bm25_rank, score, row_number() OVER (PARTITION BY w, query_id ORDER BY score DESC, dense_rank) AS rank FROM (SELECT *, round(w / (60 + dense_rank) + (1 - w) / (60 + bm25_rank), 12) AS score FROM rk CROSS JOIN (SELECT unnest([1.0, 0.75, 0.5, 0.25, 0.0]::DOUBLE[]) AS w)))"""


def hybrid_rrf_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.fused(_ranks(spark, sf_dir), [0.5])
    return out.select("query_id", "chunk_id", *[F.col(c).cast("bigint").alias(c) for c in ("dense_rank", "bm25_rank", "rank")], F.round("score", 9).alias("score"))


register("hybrid_rrf_rerank", hybrid_rrf_rerank, f"WITH {_SQL_RANKS} SELECT query_id, chunk_id, dense_rank, bm25_rank, rank, round(score, 9) AS score FROM fu WHERE dense_weight = 0.5")

SQL_METRICS = """,
best AS (SELECT query_id, chunk_id, max(auto_grade) AS grade FROM qrels GROUP BY 1, 2),
ks AS (SELECT unnest([1, 3, 5, 10]) AS k),
idl AS (SELECT query_id, k, sum((pow(2, grade) - 1) / log2(p + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS p FROM best) JOIN ks ON p <= k GROUP BY 1, 2),
hit AS (SELECT {0}query_id, k, min(rank) AS f, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM {1} JOIN best USING (query_id, chunk_id) JOIN ks ON rank <= k GROUP BY ALL),
cov AS (SELECT {0}query_id, k, count(DISTINCT evidence_id) AS c FROM {1} JOIN qrels USING (query_id, chunk_id) JOIN ks ON rank <= k GROUP BY ALL),
un AS (SELECT query_id, count(DISTINCT evidence_id) AS u FROM qrels GROUP BY 1)"""

_SQL_WIDE = """,
wide AS (SELECT idl.query_id, idl.k, coalesce(c / u, 0) AS recall, coalesce(1 / f, 0) AS mrr, coalesce(dcg / ideal, 0) AS ndcg FROM idl JOIN un USING (query_id) LEFT JOIN hit USING (query_id, k) LEFT JOIN cov USING (query_id, k)),
m AS (SELECT query_id, k, 'recall' AS metric, CAST(recall AS DOUBLE) AS value FROM wide UNION ALL SELECT query_id, k, 'mrr', mrr FROM wide UNION ALL SELECT query_id, k, 'ndcg', ndcg FROM wide)"""


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.qrels(spark, sf_dir).select("query_id", "chunk_id", "evidence_id", F.col("auto_grade").alias("grade"))


def _metrics(spark: SparkSession, sf_dir: str, run: DataFrame, qrels: DataFrame | None = None) -> DataFrame:
    qrels = _graded(spark, sf_dir) if qrels is None else qrels
    return metrics.ranking_metrics(qrels, run, qrels.select("query_id", "evidence_id", "chunk_id"))


def retrieval_metrics_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(_metrics(spark, sf_dir, d.run(spark, sf_dir)), "value")


_SQL_M = f"{d.SQL_BM25}{d.sql_run('r')},{d.SQL_EVIDENCE}{SQL_METRICS.format('', 'r')}{_SQL_WIDE}"
register("retrieval_metrics_at_k", retrieval_metrics_at_k, f"WITH {_SQL_M} SELECT query_id, k, metric, round(value, 6) AS value FROM m")


def evidence_span_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(d.qrels(spark, sf_dir).drop("relevance_grade"), "evidence_coverage")


register("evidence_span_qrels", evidence_span_qrels, f"WITH {d.SQL_CHUNKS},{d.SQL_EVIDENCE} SELECT query_id, document_id, evidence_id, chunk_id, chunk_start, chunk_end, evidence_start, evidence_end, round(evidence_coverage, 6) AS evidence_coverage, auto_grade FROM qrels")


def rrf_weight_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean metrics at 5 of every weight, and which weight is chosen."""
    fused = retrieval.fused(_ranks(spark, sf_dir), SWEEP)
    keyed = fused.select(F.concat_ws("|", F.col("dense_weight").cast("string"), F.col("query_id").cast("string")).alias("query_id"), "chunk_id", "rank")
    weights = F.explode(F.array(*[F.lit(str(w)) for w in SWEEP])).alias("w")
    qrels = d.qrels(spark, sf_dir).select("query_id", "chunk_id", "evidence_id", F.col("auto_grade").alias("grade")).select("*", weights).withColumn("query_id", F.concat_ws("|", "w", F.col("query_id").cast("string"))).drop("w")
    found = metrics.ranking_metrics(qrels, keyed, qrels.select("query_id", "evidence_id", "chunk_id"), (5,)).withColumn("dense_weight", F.substring_index("query_id", "|", 1).cast("double"))
    means = found.groupBy("dense_weight").agg(*[F.round(F.avg(F.when(F.col("metric") == m, F.col("value"))), 6).alias(m) for m in ("ndcg", "mrr", "recall")])
    chosen = F.row_number().over(Window.orderBy(F.desc("ndcg"), F.desc("mrr"), F.desc("recall"), F.desc("dense_weight"))) == 1
    return means.withColumn("chosen", chosen)


register("rrf_weight_sweep", rrf_weight_sweep, f"""WITH {_SQL_RANKS},{d.SQL_EVIDENCE},
best AS (SELECT query_id, chunk_id, max(auto_grade) AS grade FROM qrels GROUP BY 1, 2),
idl AS (SELECT query_id, sum((pow(2, grade) - 1) / log2(p + 1)) AS ideal FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY grade DESC) AS p FROM best) WHERE p <= 5 GROUP BY 1),
un AS (SELECT query_id, count(DISTINCT evidence_id) AS u FROM qrels GROUP BY 1),
ws2 AS (SELECT unnest([1.0, 0.75, 0.5, 0.25, 0.0]::DOUBLE[]) AS dense_weight),
hit AS (SELECT dense_weight, query_id, min(rank) AS f, sum((pow(2, grade) - 1) / log2(rank + 1)) AS dcg FROM fu JOIN best USING (query_id, chunk_id) WHERE rank <= 5 GROUP BY 1, 2),
cov AS (SELECT dense_weight, query_id, count(DISTINCT evidence_id) AS c FROM fu JOIN qrels USING (query_id, chunk_id) WHERE rank <= 5 GROUP BY 1, 2),
mean AS (SELECT dense_weight, round(avg(coalesce(dcg / ideal, 0)), 6) AS ndcg, round(avg(coalesce(1 / f, 0)), 6) AS mrr, round(avg(coalesce(c / u, 0)), 6) AS recall FROM idl JOIN un USING (query_id) CROSS JOIN ws2 LEFT JOIN hit USING (dense_weight, query_id) LEFT JOIN cov USING (dense_weight, query_id) GROUP BY 1)
SELECT *, row_number() OVER (ORDER BY ndcg DESC, mrr DESC, recall DESC, dense_weight DESC) = 1 AS chosen FROM mean""")


def _expected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.evidence(spark, sf_dir).select("query_id", "document_id")


def document_fidelity_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    run, expected = d.run(spark, sf_dir), _expected(spark, sf_dir)
    return _rounded(metrics.document_metrics(expected, run).unionByName(metrics.returned_drm(expected, run)), "value")


_SQL_FIDELITY = """,
ks AS (SELECT unnest([1, 3, 5, 10]) AS k), q AS (SELECT DISTINCT query_id FROM ev),
ok AS (SELECT query_id, k, count(*) AS n, min(rank) AS f FROM r JOIN ks ON rank <= k WHERE EXISTS (SELECT 1 FROM ev WHERE ev.query_id = r.query_id AND ev.document_id = r.document_id) GROUP BY 1, 2),
top AS (SELECT query_id, k, count(*) AS t FROM r JOIN ks ON rank <= k GROUP BY 1, 2),
fid AS (SELECT q.query_id, ks.k, 1 - coalesce(n, 0) / ks.k AS drm, CASE WHEN n > 0 THEN 1.0 ELSE 0.0 END AS hit, coalesce(1 / f, 0) AS document_mrr, coalesce((t - coalesce(n, 0)) / t, 1) AS drm_returned FROM q CROSS JOIN ks LEFT JOIN ok USING (query_id, k) LEFT JOIN top USING (query_id, k))"""
register("document_fidelity_at_k", document_fidelity_at_k, f"WITH {d.SQL_BM25}{d.sql_run('r')},{d.SQL_EVIDENCE}{_SQL_FIDELITY} " + " UNION ALL ".join(f"SELECT query_id, k, '{m}' AS metric, CAST(round({m}, 6) AS DOUBLE) AS value FROM fid" for m in ("drm", "hit", "document_mrr", "drm_returned")))


def _strata(spark: SparkSession, sf_dir: str) -> DataFrame:
    lang = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "lang")
    return d.evidence(spark, sf_dir).join(lang, "document_id").groupBy("query_id").agg(F.min_by("lang", "document_id").alias("stratum"))


def metrics_by_stratum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(metrics.summarized(_metrics(spark, sf_dir, d.run(spark, sf_dir)), _strata(spark, sf_dir)), "value")


register("metrics_by_stratum_grouping_sets", metrics_by_stratum, f"""WITH {_SQL_M},
sr AS (SELECT query_id, arg_min(lang, document_id) AS stratum FROM ev JOIN documents ON doc_id = document_id GROUP BY 1),
g AS (SELECT metric, k, stratum, avg(value) AS value, count(*) AS queries, grouping(stratum) AS z FROM m JOIN sr USING (query_id) GROUP BY GROUPING SETS ((metric, k), (metric, k, stratum)))
SELECT CASE WHEN z = 1 THEN 'micro' ELSE 'stratum' END AS level, metric, k, stratum, round(value, 6) AS value, queries FROM g
UNION ALL SELECT 'macro', metric, k, NULL, round(avg(value), 6), CAST(sum(queries) AS BIGINT) FROM g WHERE z = 0 GROUP BY metric, k""")


def error_taxonomy(spark: SparkSession, sf_dir: str) -> DataFrame:
    qrels = d.qrels(spark, sf_dir).select("query_id", "chunk_id", F.col("auto_grade").alias("grade"))
    expected = _expected(spark, sf_dir)
    own = d.postings(spark, sf_dir)
    a = metrics.retrieval_status(qrels, d.run(spark, sf_dir, own=own), expected, 3)
    b = metrics.retrieval_status(qrels, d.run(spark, sf_dir, own=own, k1=0.2, b=0.0), expected, 3)
    return metrics.paired_outcomes(a, b, ("bm25", "presence"))


register("error_taxonomy", error_taxonomy, f"""WITH {d.SQL_BM25}{d.sql_run("r")}{d.sql_run("s", 10, 0.2, 0.0)},{d.SQL_EVIDENCE},
q AS (SELECT DISTINCT query_id FROM qrels),
a AS (SELECT DISTINCT query_id FROM r JOIN qrels USING (query_id, chunk_id) WHERE rank <= 3), b AS (SELECT DISTINCT query_id FROM s JOIN qrels USING (query_id, chunk_id) WHERE rank <= 3)
SELECT CASE WHEN a.query_id IS NOT NULL AND b.query_id IS NOT NULL THEN 'both' WHEN a.query_id IS NOT NULL THEN 'bm25_only' WHEN b.query_id IS NOT NULL THEN 'presence_only' ELSE 'neither' END AS outcome, count(*) AS queries FROM q LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id) GROUP BY 1""")


def retrieval_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    qrels = d.qrels(spark, sf_dir).select("query_id", "chunk_id", F.col("auto_grade").alias("grade"))
    out = metrics.retrieval_status(qrels, d.run(spark, sf_dir), _expected(spark, sf_dir), 3)
    return out.select("query_id", "status", *[F.col(c).cast("bigint").alias(c) for c in ("first_relevant_rank", "first_document_rank")])


register("retrieval_status", retrieval_status, f"""WITH {d.SQL_BM25}{d.sql_run("r")},{d.SQL_EVIDENCE},
q AS (SELECT DISTINCT query_id FROM qrels), a AS (SELECT query_id, min(rank) AS x FROM r JOIN qrels USING (query_id, chunk_id) WHERE rank <= 3 GROUP BY 1),
b AS (SELECT query_id, min(rank) AS y FROM r JOIN ev USING (query_id, document_id) WHERE rank <= 3 GROUP BY 1)
SELECT query_id, CASE WHEN x IS NOT NULL THEN 'relevant_found' WHEN y IS NOT NULL THEN 'document_found_chunk_miss' ELSE 'document_miss' END AS status, x AS first_relevant_rank, y AS first_document_rank FROM q LEFT JOIN a USING (query_id) LEFT JOIN b USING (query_id)""")


def parent_max_child_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as parents of their chunks."""
    children = d.run(spark, sf_dir).withColumn("parent_id", F.col("document_id"))
    out = retrieval.parent_ranking(children, d.documents(spark, sf_dir).select(F.col("document_id").alias("parent_id")))
    return _rounded(out.withColumn("rank", F.col("rank").cast("bigint")).withColumn("best_child_rank", F.col("best_child_rank").cast("bigint")), "score")


register("parent_max_child_ranking", parent_max_child_ranking, f"""WITH {d.SQL_BM25}{d.sql_run("r")},
b AS (SELECT query_id, document_id AS parent_id, max(score) AS score, arg_min(chunk_id, rank) AS best_child_id, min(rank) AS best_child_rank FROM r GROUP BY 1, 2)
SELECT query_id, parent_id, round(score, 6) AS score, best_child_id, best_child_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, best_child_rank, parent_id) AS rank FROM b""")


def _ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run with the texts and places of its chunks, stored: it is read several times."""
    run = d.run(spark, sf_dir)
    own = d.found_chunks(spark, sf_dir, run).select("chunk_id", "text", "start_position", "end_position", tx.word_count(F.col("text")).cast("bigint").alias("words"), "document_id")
    return stored(run.select("query_id", "chunk_id", "rank").join(own, "chunk_id"), "ranking")


def context_budget_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = retrieval.context_by_truncation(_ranking(spark, sf_dir), 400)
    return out.select("query_id", "chunk_id", *[F.col(c).cast("bigint").alias(c) for c in ("rank", "source_number", "included_words")], "truncated")


_SQL_CONTEXT = f"WITH {d.SQL_BM25}{d.sql_run('r')}, x AS (SELECT r.query_id, r.chunk_id, r.rank, len(regexp_extract_all(c.text, '\\S+')) AS words FROM r JOIN chunks c USING (chunk_id))"
register("context_budget_truncate", context_budget_truncate, _SQL_CONTEXT + ", y AS (SELECT *, least(words, greatest(0, 400 - coalesce(sum(words) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS t FROM x WHERE words > 0) SELECT query_id, chunk_id, rank, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS source_number, CAST(t AS BIGINT) AS included_words, t < words AS truncated FROM y WHERE t > 0")


def context_budget_skip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _ranking(spark, sf_dir).select("query_id", F.col("chunk_id").alias("unit_id"), "rank", "words")
    out = retrieval.context_by_skipping(rows, 400)
    return out.select("query_id", "unit_id", *[F.col(c).cast("bigint").alias(c) for c in ("rank", "words", "used")])


register("context_budget_skip", context_budget_skip, _SQL_CONTEXT.replace("WITH ", "WITH RECURSIVE ", 1) + """, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS p FROM x),
f AS (SELECT query_id, p, chunk_id, rank, words, true AS taken, words AS used FROM o WHERE p = 1 UNION ALL SELECT o.query_id, o.p, o.chunk_id, o.rank, o.words, f.used + o.words <= 400 AND f.used < 400, CASE WHEN f.used + o.words <= 400 AND f.used < 400 THEN f.used + o.words ELSE f.used END FROM f JOIN o ON o.query_id = f.query_id AND o.p = f.p + 1)
SELECT query_id, chunk_id AS unit_id, rank, CAST(words AS BIGINT) AS words, CAST(max(used) OVER (PARTITION BY query_id) AS BIGINT) AS used FROM f QUALIFY taken""")


def context_delivery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the context of each question holds its evidence, by question with the first document that has it."""
    first = d.evidence(spark, sf_dir).groupBy("query_id").agg(F.min(F.struct("document_id", "evidence_start", "evidence_end")).alias("e")).select("query_id", "e.*")
    ranking = _ranking(spark, sf_dir)
    included = retrieval.context_by_truncation(ranking, 400).join(ranking.select("chunk_id", "document_id").distinct(), "chunk_id")
    return metrics.context_delivery(included, first).select("query_id", "evidence_hit", F.col("words").cast("bigint").alias("words"), "units")




def latency_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The summary's shape, over the values of events."""
    events = table(spark, sf_dir, "events").select("event_type", F.col("value").alias("latency_ms"))
    return _rounded(metrics.latency_summary(events, keys=["event_type"]), "mean", "median", "p95")


register("latency_summary", latency_summary, "SELECT event_type, count(value) AS count, round(avg(value), 6) AS mean, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.95), 6) AS p95, min(value) AS minimum, max(value) AS maximum FROM events GROUP BY 1")


def _two_runs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    held: list[str] = []
    own, qrels = d.postings(spark, sf_dir, held), _graded(spark, sf_dir)
    runs = d.run(spark, sf_dir, own=own), d.run(spark, sf_dir, own=own, k1=0.2, b=0.0)
    # both are stored
    dropped_tables(spark, held)
    return _metrics(spark, sf_dir, runs[0], qrels), _metrics(spark, sf_dir, runs[1], qrels)


def _sql_two(tail: str) -> str:
    return f"""WITH {d.SQL_BM25}{d.sql_run("r1")}{d.sql_run("r2", 10, 0.2, 0.0)},{d.SQL_EVIDENCE},
r AS (SELECT 1 AS arm, query_id, chunk_id, rank FROM r1 UNION ALL SELECT 2, query_id, chunk_id, rank FROM r2){SQL_METRICS.format("arm, ", "r")},
wide AS (SELECT arm, idl.query_id, idl.k, coalesce(c / u, 0) AS recall, coalesce(1 / f, 0) AS mrr, coalesce(dcg / ideal, 0) AS ndcg FROM idl JOIN un USING (query_id) CROSS JOIN (SELECT unnest([1, 2]) AS arm) LEFT JOIN hit USING (arm, query_id, k) LEFT JOIN cov USING (arm, query_id, k)),
m AS (SELECT arm, query_id, k, 'recall' AS metric, CAST(recall AS DOUBLE) AS value FROM wide UNION ALL SELECT arm, query_id, k, 'mrr', mrr FROM wide UNION ALL SELECT arm, query_id, k, 'ndcg', ndcg FROM wide),
p AS (SELECT query_id, metric, k, max(value) FILTER (arm = 1) AS baseline, max(value) FILTER (arm = 2) AS candidate, max(value) FILTER (arm = 2) - max(value) FILTER (arm = 1) AS difference FROM m GROUP BY 1, 2, 3){tail}"""


def win_tie_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(inference.outcomes(inference.paired(*_two_runs(spark, sf_dir))), "baseline_mean", "candidate_mean", "difference", "relative_difference")


register("win_tie_loss", win_tie_loss, _sql_two(" SELECT metric, k, count(*) AS queries, round(avg(baseline), 6) AS baseline_mean, round(avg(candidate), 6) AS candidate_mean, round(avg(difference), 6) AS difference, count(*) FILTER (difference > 1e-12) AS wins, count(*) FILTER (abs(difference) <= 1e-12) AS ties, count(*) FILTER (difference < -1e-12) AS losses, CASE WHEN avg(baseline) <> 0 THEN round(avg(difference) / abs(avg(baseline)), 6) END AS relative_difference FROM p GROUP BY 1, 2"))


def paired_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(inference.paired(*_two_runs(spark, sf_dir)), "baseline", "candidate", "difference")


register("paired_differences", paired_differences, _sql_two(" SELECT query_id, metric, k, round(baseline, 6) AS baseline, round(candidate, 6) AS candidate, round(difference, 6) AS difference FROM p"))


def _clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions by the document that holds them first, four documents to a cluster."""
    return d.evidence(spark, sf_dir).groupBy("query_id").agg(F.min("document_id").alias("cluster"))


_SQL_CLUSTERS = """,
cl AS (SELECT query_id, min(document_id) AS cluster FROM ev GROUP BY 1),
cs AS (SELECT metric, k, cluster, sum(difference) AS s, count(*) AS n FROM p JOIN cl USING (query_id) GROUP BY 1, 2, 3),
c2 AS (SELECT *, row_number() OVER (PARTITION BY metric, k ORDER BY cluster) - 1 AS place, count(*) OVER (PARTITION BY metric, k) AS cn FROM cs)"""


def cluster_bootstrap_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = inference.clustered(inference.paired(*_two_runs(spark, sf_dir)), _clusters(spark, sf_dir), ["metric", "k"])
    return _rounded(inference.cluster_bootstrap(sums, ["metric", "k"], samples=2000), "ci_low", "ci_high")


register("cluster_bootstrap_ci", cluster_bootstrap_ci, _sql_two(_SQL_CLUSTERS + """,
dr AS (SELECT metric, k, rep, CAST(('0x' || substr(md5('42|' || rep || '|' || i), 1, 8)) AS BIGINT) % cn AS place FROM (SELECT DISTINCT metric, k, cn FROM c2) CROSS JOIN (SELECT unnest(range(1, 2001)) AS rep) CROSS JOIN LATERAL (SELECT unnest(range(0, cn)) AS i)),
me AS (SELECT metric, k, rep, sum(s) / sum(n) AS v FROM dr JOIN c2 USING (metric, k, place) GROUP BY 1, 2, 3)
SELECT metric, k, round(quantile_cont(v, 0.025), 6) AS ci_low, round(quantile_cont(v, 0.975), 6) AS ci_high FROM me GROUP BY 1, 2"""))


def sign_flip_p(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = inference.clustered(inference.paired(*_two_runs(spark, sf_dir)), _clusters(spark, sf_dir), ["metric", "k"])
    return _rounded(inference.sign_flip(sums, ["metric", "k"], samples=10_000), "observed", "p_value")


register("sign_flip_p", sign_flip_p, _sql_two(_SQL_CLUSTERS + """,
fl AS (SELECT metric, k, rep, sum(CASE WHEN CAST(('0x' || substr(md5('42|' || rep || '|' || place), 1, 8)) AS BIGINT) % 2 = 0 THEN s ELSE -s END) AS v FROM c2 CROSS JOIN (SELECT unnest(range(1, 10001)) AS rep) GROUP BY 1, 2, 3),
ob AS (SELECT metric, k, sum(s) AS s, sum(n) AS n FROM c2 GROUP BY 1, 2)
SELECT metric, k, round(max(ob.s) / max(ob.n), 6) AS observed, round((count(*) FILTER (round(abs(v / ob.n), 12) >= round(abs(ob.s / ob.n), 12)) + 1) / 10001, 6) AS p_value FROM fl JOIN ob USING (metric, k) GROUP BY 1, 2"""))


def factorial_contrasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four arms from two BM25 settings at two depths."""
    qrels = d.qrels(spark, sf_dir).select("query_id", "chunk_id", "evidence_id", F.col("auto_grade").alias("grade"))
    settings = {"fixed_independent": (1.2, 0.75), "fixed_contextual": (0.2, 0.0), "sac_independent": (1.2, 0.0), "sac_contextual": (0.2, 0.75)}
    arms, own = None, d.postings(spark, sf_dir)
    for arm, (k1, b) in settings.items():
        found = metrics.ranking_metrics(qrels, d.run(spark, sf_dir, 5, own, k1=k1, b=b), qrels.select("query_id", "evidence_id", "chunk_id"), (5,)).withColumn("arm", F.lit(arm))
        arms = found if arms is None else arms.unionByName(found)
    return _rounded(inference.contrast_outcomes(inference.contrasts(arms)), "mean_difference")




def icc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all line items, the correlation of quantities within orders, for each size of order."""
    items = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_quantity").cast("double").alias("q"))
    return _rounded(inference.intraclass_correlations(items, "l_orderkey", "q"), "icc")


register("icc", icc, """WITH g AS (SELECT l_orderkey, count(l_quantity) AS n, avg(CAST(l_quantity AS DOUBLE)) AS m, var_pop(CAST(l_quantity AS DOUBLE)) AS v FROM lineitem GROUP BY 1),
t AS (SELECT n, count(*) AS clusters, n * var_samp(m) AS b, CASE WHEN n > 1 THEN n * sum(v) / (count(*) * (n - 1)) END AS w FROM g GROUP BY 1)
SELECT n, clusters, CASE WHEN clusters >= 2 AND n >= 2 THEN round(CASE WHEN b + (n - 1) * w = 0 THEN 0.0 ELSE least(1.0, greatest(0.0, (b - w) / (b + (n - 1) * w))) END, 6) END AS icc FROM t""")


def plan_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inference.plan_grid(spark, [0.05, 0.1], [0.0, 0.2], 0.5, 4)


register("plan_grid", plan_grid, "SELECT * FROM (VALUES (0.05::DOUBLE, 0.0::DOUBLE, 785, 1.0::DOUBLE, 197, 788), (0.05, 0.2, 785, 1.6, 314, 1256), (0.1, 0.0, 197, 1.0, 50, 200), (0.1, 0.2, 197, 1.6, 79, 316)) t(effect, icc, pairs, design_effect, documents, queries)")


def hashed_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Feature-hashed vectors of chunks and questions, searched exactly."""
    own = embedding.hashed_vectors(d.chunks(spark, sf_dir), ["chunk_id", "chunk_ord"], F.col("text"), dimension=64, out="vector")
    asked = embedding.hashed_vectors(d.questions(spark, sf_dir), ["query_id"], F.col("question"), dimension=64, out="vector")
    found = retrieval.dense_topk(asked, own, 10)
    return _rounded(found.withColumn("rank", F.col("rank").cast("bigint")), "score")


register("hashed_dense_topk", hashed_dense_topk, f"""WITH {d.SQL_CHUNKS},
tk AS (SELECT 'c' AS side, chunk_id AS id, unnest({d.SQL_TOKENS.format('text')}) AS t FROM chunks UNION ALL SELECT 'q', CAST(item_id AS VARCHAR), unnest({d.SQL_TOKENS.format('text')}) FROM benchmark),
pl AS (SELECT side, id, CAST(('0x' || substr(md5(t), 1, 8)) AS BIGINT) % 64 AS place, sum(CASE WHEN CAST(('0x' || substr(md5(t), 9, 8)) AS BIGINT) % 2 = 0 THEN 1.0 ELSE -1.0 END) AS w FROM tk GROUP BY ALL),
no AS (SELECT side, id, sqrt(sum(w * w)) AS n FROM pl GROUP BY 1, 2 HAVING sum(w * w) > 0),
ids AS (SELECT q.id AS query_id, c.id AS chunk_id, q.n AS qn, c.n AS cn FROM no q JOIN no c ON q.side = 'q' AND c.side = 'c'),
sc AS (SELECT ids.query_id, ids.chunk_id, round(coalesce(d, 0) / (qn * cn), 9) AS score FROM ids LEFT JOIN (SELECT q.id AS query_id, c.id AS chunk_id, sum(q.w * c.w) AS d FROM pl q JOIN pl c USING (place) WHERE q.side = 'q' AND c.side = 'c' GROUP BY 1, 2) USING (query_id, chunk_id)),
r AS (SELECT CAST(query_id AS BIGINT) AS query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) AS rank FROM sc JOIN chunks USING (chunk_id))
SELECT query_id, chunk_id, rank, round(score, 6) AS score FROM r WHERE rank <= 10""")


def run_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that the BM25 run breaks: none."""
    return retrieval.ranking_violations(d.run(spark, sf_dir))


register("run_violations", run_violations, "SELECT item_id AS query_id, '' AS problem FROM benchmark WHERE false")


def failure_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why evidence is missed in the top 3, with a chunk's place in its document as its section."""
    own = d.chunks(spark, sf_dir).withColumn("section_label", F.when(F.col("chunk_index") == 0, "first").otherwise("later"))
    qrels = d.qrels(spark, sf_dir)
    first = qrels.join(own.select("chunk_id", "section_label"), "chunk_id").groupBy("query_id").agg(F.min_by(F.struct("document_id", "section_label"), F.struct("document_id", "chunk_start")).alias("q")).select("query_id", "q.document_id", F.col("q.section_label").alias("target_section_label"))
    out = metrics.failure_classes(qrels.select("query_id", "chunk_id", F.col("auto_grade").alias("grade")), d.run(spark, sf_dir), first, own, 3)
    return out.groupBy("category").agg(F.count(F.lit(1)).alias("queries"))


