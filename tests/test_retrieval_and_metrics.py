import math

import pytest

from verdigrain.operators import augment, embedding, groundtruth, inference, metrics, relational, retrieval


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


RUN = "query_id string, chunk_id string, rank int"


def values(df):
    return {(r.query_id, r.metric, r.k): r.value for r in df.collect()}


def test_dense_search(spark):
    index = table(spark, "chunk_id string, chunk_ord int, vector array<float>", ("law", 0, [1.0, 0.0]), ("other", 1, [0.0, 1.0]), ("zero", 2, [0.0, 0.0]))
    rows = retrieval.dense_topk(table(spark, "query_id string, vector array<float>", ("q", [2.0, 0.0])), index.where("chunk_id <> 'zero'"), 2).orderBy("rank").collect()
    assert [(r.chunk_id, r.score) for r in rows] == [("law", 1.0), ("other", 0.0)]
    assert [r.chunk_id for r in retrieval.bad_vectors(index, "vector").collect()] == ["zero"]


def test_bm25_and_fusion(spark):
    own = table(spark, "chunk_id string, chunk_ord int, text string", ("a", 0, "pasal narkotika"), ("b", 1, "hukum acara pidana"), ("c", 2, "narkotika narkotika"))
    asked = table(spark, "query_id string, question string", ("q", "Narkotika!"))
    rows = retrieval.bm25_topk(asked, own, 5).orderBy("rank").collect()
    idf = math.log(1 + (3 - 2 + 0.5) / 2.5)
    score = idf * 2 * 2.2 / (2 + 1.2 * (0.25 + 0.75 * 2 / (7 / 3)))
    assert rows[0].chunk_id == "c" and rows[0].score == pytest.approx(score) and len(rows) == 2
    dense = table(spark, RUN, ("q", "b", 1), ("q", "a", 2), ("q", "c", 3))
    ranks = retrieval.lexical_ranks(dense, retrieval.bm25_scores(asked, own))
    order = lambda w: [r.chunk_id for r in retrieval.fused(ranks, [w]).orderBy("rank").collect()]
    assert order(1.0) == ["b", "a", "c"] and order(0.0) == ["c", "a", "b"]
    with pytest.raises(ValueError):
        retrieval.fused(ranks, [1.5])


def test_contexts(spark):
    units = table(spark, "query_id string, unit_id string, rank int, words int", ("q", "a", 1, 4), ("q", "b", 2, 9), ("q", "c", 3, 3), ("r", "z", 1, 99), ("r", "y", 2, 1))
    rows = retrieval.context_by_skipping(units, 8).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r.unit_id, r.used) for r in rows] == [("q", "a", 7), ("q", "c", 7), ("r", "z", 99)]
    chunks = table(spark, "query_id string, chunk_id string, rank int, words int, start_position int, end_position int, text string", ("q", "a", 1, 4, 0, 7, "a b c d"), ("q", "b", 2, 4, 100, 115, "one  two six ten"))
    rows = retrieval.context_by_truncation(chunks, 6).orderBy("rank").collect()
    assert [(r.included_words, r.truncated, r.included_end_position) for r in rows] == [(4, False, 7), (2, True, 108)]
    assert retrieval.assembled_contexts(retrieval.context_by_truncation(chunks, 6), 6).first().context == "[Chunk 1]\na b c d\n\n[Chunk 2]\none two"


def test_parents(spark):
    kids = table(spark, "query_id string, chunk_id string, parent_id string, rank int, score double", ("q", "a", "p", 1, 0.5), ("q", "b", "p", 2, 0.5), ("q", "c", "r", 3, 0.9))
    own = table(spark, "parent_id string", ("p",), ("r",))
    rows = retrieval.parent_ranking(kids, own).orderBy("rank").collect()
    assert [(r.parent_id, r.best_child_id) for r in rows] == [("r", "c"), ("p", "a")]


def test_ranking_metrics(spark):
    qrels = table(spark, "query_id string, chunk_id string, grade int", ("q1", "high", 2), ("q1", "low", 1), ("q2", "x", 1))
    run = table(spark, RUN, ("q1", "low", 1), ("q1", "low", 2), ("q1", "high", 3))
    found = values(metrics.ranking_metrics(qrels, run, ks=(1, 2, 3)))
    assert found["q1", "ndcg", 2] == pytest.approx((1 + 3 / math.log2(3)) / (3 + 1 / math.log2(3)))
    assert found["q1", "recall", 1] == 0.5 and found["q1", "mrr", 1] == 1 and found["q2", "mrr", 3] == found["q2", "recall", 3] == 0
    evidence = table(spark, "query_id string, evidence_id string, chunk_id string", ("q", "e1", "a"), ("q", "e1", "b"), ("q", "e2", "c"))
    grades = table(spark, "query_id string, chunk_id string, grade int", ("q", "a", 2), ("q", "b", 2), ("q", "c", 2))
    recall = lambda *ids: values(metrics.ranking_metrics(grades, table(spark, RUN, *[("q", c, i + 1) for i, c in enumerate(ids)]), evidence, (2,)))["q", "recall", 2]
    assert recall("a", "b") == 0.5 and recall("a", "c") == 1.0


def test_document_metrics(spark):
    gold = table(spark, "query_id string, document_id string", ("q", "d1"), ("n", "d9"))
    run = table(spark, "query_id string, document_id string, rank int", ("q", "x", 1), ("q", "d1", 2), ("q", "y", 3))
    found = values(metrics.document_metrics(gold, run, (1, 3)))
    assert found["q", "drm", 1] == 1 and found["q", "drm", 3] == pytest.approx(2 / 3) and found["q", "hit", 3] == 1 and found["q", "document_mrr", 3] == 0.5
    assert found["n", "drm", 3] == 1 and found["n", "hit", 3] == 0
    many = metrics.gold_documents(table(spark, "query_id string, document_id string, relevant_document_ids string", ("q", "d1", "d1| d2"), ("r", "d3", None)))
    assert sorted(map(tuple, many.collect())) == [("q", "d1"), ("q", "d2"), ("r", "d3")]
    assert values(metrics.returned_drm(gold, run.where("rank < 3"), (5,)))["q", "drm_returned", 5] == 0.5


def test_latency(spark):
    row = metrics.latency_summary(table(spark, "latency_ms double", (10.0,), (20.0,), (30.0,))).first()
    assert (row.mean, row.median, row.p95) == (20, 20, 29)


def test_qrels(spark):
    asked = table(spark, "query_id string, document_id string, evidence_start int, evidence_end int", ("q", "d", 10, 20))
    own = table(spark, "chunk_id string, document_id string, start_position int, end_position int", ("a", "d", 0, 30), ("b", "d", 5, 15), ("c", "d", 20, 30))
    rows = {r.chunk_id: r for r in groundtruth.qrel_candidates(asked, own).collect()}
    assert set(rows) == {"a", "b"} and (rows["a"].auto_grade, rows["b"].auto_grade, rows["b"].evidence_coverage, rows["b"].relevance_grade) == (2, 1, 0.5, None)


def test_bootstrap_and_signs(spark):
    diffs = table(spark, "query_id string, metric string, k int, difference double", ("a", "m", 1, 1.0), ("b", "m", 1, 1.0), ("c", "m", 1, -1.0), ("d", "m", 1, -1.0))
    clusters = table(spark, "query_id string, cluster string", ("a", "1"), ("b", "1"), ("c", "2"), ("d", "2"))
    sums = inference.clustered(diffs, clusters, ["metric", "k"])
    row = inference.cluster_bootstrap(sums, ["metric", "k"], samples=200).first()
    assert (row.ci_low, row.ci_high) == (-1, 1)
    assert inference.sign_flip(sums, ["metric", "k"], samples=50).first().p_value == 1


def test_contrasts_and_plans(spark):
    arms = [(a, q, "recall", 1, v) for a, vs in {"fixed_independent": (0, 0), "fixed_contextual": (1, 0), "sac_independent": (0, 1), "sac_contextual": (1, 1)}.items() for q, v in zip("xy", map(float, vs), strict=True)]
    found = {r.contrast: r for r in inference.contrast_outcomes(inference.contrasts(table(spark, "arm string, query_id string, metric string, k int, value double", *arms))).collect()}
    one = found["contextual_effect_within_fixed"]
    assert (one.mean_difference, one.wins, one.ties, one.losses) == (0.5, 1, 1, 0)
    assert found["combined_vs_conventional_baseline"].mean_difference == 1
    assert inference.paired_sample_size(0.1, 0.5) == 197 and inference.paired_sample_size(0.05, 0.5) == 785
    assert inference.cluster_plan(197, 4, 0.2) == {"design_effect": 1.6, "documents": 79, "queries": 316}
    groups = table(spark, "c string, v double", ("a", 1.0), ("a", 1.0), ("b", 2.0), ("b", 2.0), ("c", 3.0), ("c", 3.0))
    assert inference.intraclass_correlation(groups, "c", "v").first().icc == 1


def test_representations_and_budget(spark):
    own = table(spark, "chunk_id string, document_id string, section_label string, original_text string, start_position int, end_position int", ("c", "d", "s", "evidence here stays", 0, 19))
    rows = augment.representations(own, table(spark, "document_id string, summary string", ("d", "one two three")), table(spark, "document_id string, section_label string, summary string", ("d", "s", "four five six")))
    assert augment.misaligned(rows).count() == 0
    cut = augment.budgeted(rows, 14).where("method = 'M1'").first()
    assert cut.summary_budget_applied and cut.embedding_tokens <= 14 and "evidence here stays" in cut.embedding_text and "one two three" in cut.embedding_text
    encode, decode = (lambda t: list(t.encode())), (lambda ids: bytes(ids).decode(errors="ignore"))
    fine = augment.budgeted(rows, 90, encode=encode, decode=decode).where("method = 'M1'").first()
    assert fine.embedding_tokens <= 90 and "evidence here stays" in fine.embedding_text
    bad = augment.diagnostics(table(spark, "summary string, source string", ("x 99 unknown words only", "other text 12"))).first()
    assert bad.unsupported_number_tokens == ["99"] and "unsupported_number" in bad.quality_flags and bad.unexpected_language


def test_embedding_windows(spark):
    docs = table(spark, "document_id string, tokens int", ("d", 14))
    spans = table(spark, "document_id string, span_id int, start int, end int", ("d", 0, 6, 8), ("d", 1, 9, 11))
    windows = embedding.context_windows(docs, spans, capacity=10, overlap=6)
    assert sorted((r.start, r.end) for r in windows.collect()) == [(0, 10), (4, 14)]
    chosen = {r.span_id: r.window_index for r in embedding.window_of_span(spans, windows).collect()}
    assert chosen == {0: 0, 1: 1}
    tokens = table(spark, "document_id string, token int, vector array<double>", ("d", 6, [1.0, 0.0]), ("d", 7, [0.0, 1.0]), ("d", 9, [0.0, 2.0]))
    pooled = {r.span_id: r.embedding for r in embedding.pooled(tokens, spans).collect()}
    assert pooled[0] == pytest.approx([2**-0.5] * 2) and pooled[1] == [0.0, 1.0]


def test_relational(spark):
    rows = table(spark, "id int, g string", *[(i, f"g{i % 3}") for i in range(30)])
    kept = relational.capped(rows, "g", "id", 2, 5).collect()
    assert len(kept) == 5 and max([r.g for r in kept].count(g) for g in "g0 g1 g2".split()) <= 2
    assert sum(r["size"] for r in relational.disjoint_split(rows, "g", 20).collect()) == 20
    assert relational.same_rows(rows, rows).count() == 0


def test_best_of_blocks_as_all_pairs(spark):
    """Small blocks give what the scores of all pairs give, and no plan has a row for each pair."""
    words = "satu dua tiga empat lima".split()
    own = spark.createDataFrame([(f"c{n}", n % 97, " ".join(words[(n * m) % 5] for m in range(1, 2 + n % 6)) if n % 11 else "") for n in range(97)] + [("none", 97, None)], "chunk_id string, chunk_ord int, text string")
    asked = spark.createDataFrame([(n, " ".join(words[: 1 + n % 5]) + " satu enam") for n in range(23)] + [(23, "enam"), (24, "")], "query_id int, question string")
    postings = retrieval.bm25_postings(asked, own)
    assert postings.count() == 97
    scores = {}
    for r in retrieval.bm25_scores(asked, postings).collect():
        scores.setdefault(r.query_id, []).append((-r.score, r.chunk_ord, r.chunk_id))
    best = retrieval.bm25_best(asked, postings, 4, block=(5, 13))
    found = {}
    for r in best.orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((-r.score, r.chunk_ord, r.chunk_id))
    assert found == {q: sorted(rows)[:4] for q, rows in scores.items()} and set(found) == set(range(23))
    assert "functions=[partial_sum" not in best._jdf.queryExecution().executedPlan().toString()
    assert retrieval.bm25_best(asked, own.where("false"), 4).count() == 0
    assert retrieval.bm25_best(asked.where("false"), own, 4).count() == 0
