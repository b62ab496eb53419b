"""Queries do their whole job: every row counts."""

import numpy as np
import pytest

from verdigrain.operators import retrieval
from verdigrain.plans import catalogue, retrieval_queries, text_queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("filtered", [False, True])
def test_every_twentieth_embedding_is_a_query(spark, filtered):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    v = np.array([r.embedding for r in rows], np.float64)
    v /= np.sqrt((v * v).sum(1))[:, None]
    score = np.round(v @ v.T, 9)
    found = {}
    query = retrieval_queries.dense_topk_filtered if filtered else retrieval_queries.dense_topk_cosine
    for r in query(spark, SF).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.chunk_id, r.score)
    assert set(found) == {r.vec_id for r in rows if r.vec_id % 20 == 0}
    for i, r in enumerate(rows):
        if r.vec_id % 20:
            continue
        fit = [j for j, c in enumerate(rows) if not filtered or c.label == r.label]
        best = sorted(fit, key=lambda j: (-score[i, j], rows[j].vec_id))[:10]
        assert [found[r.vec_id][n + 1][0] for n in range(len(best))] == [rows[j].vec_id for j in best]
        assert [found[r.vec_id][n + 1][1] for n in range(len(best))] == pytest.approx([score[i, j] for j in best], abs=2e-6)


def test_blocks_as_rows(spark):
    """Small blocks give what row by row gives, with ties, a zero vector and another dimension."""
    rng = np.random.default_rng(1)
    own = [(k, k, rng.integers(-2, 3, 4).astype(float).tolist(), k % 3) for k in range(60)] + [(60, 60, [0.0] * 4, 0), (61, 61, [1.0, 2.0], 1)]
    index = spark.createDataFrame(own, "chunk_id bigint, chunk_ord bigint, vector array<double>, label int")
    asked = index.select(index.chunk_id.alias("query_id"), "vector", "label")
    norms = {k: np.array(v) / np.sqrt(np.dot(v, v)) for k, _, v, _ in own if np.any(v)}
    for on in (None, "label"):
        told = sorted((r.query_id, r.rank, r.chunk_id, r.score) for r in retrieval.dense_topk(asked, index, 5, on=on, block=7).collect() if r.score is not None)
        expected = []
        for q, _, _, label in own:
            near = [(-round(float(norms[q] @ norms[c]), 9), c) for c, _, _, other in own if q in norms and c in norms and len(norms[q]) == len(norms[c]) and (on is None or other == label)]
            expected += [(q, n + 1, c, -s) for n, (s, c) in enumerate(sorted(near)[:5])]
        assert [t[:3] for t in told] == [e[:3] for e in sorted(expected)] and [t[3] for t in told] == pytest.approx([e[3] for e in sorted(expected)], abs=1e-8)


def test_a_document_of_more_than_100000_chunks(spark):
    """Ties keep the order of documents and chunks, whatever their numbers."""
    from pyspark.sql import functions as F

    from verdigrain.operators import chunking
    from verdigrain.plans import derived

    docs = spark.createDataFrame([(1, 100_001), (2, 3)], "document_id bigint, n int").select("document_id", F.trim(F.expr("repeat('kata ', n)")).alias("text"))
    own = derived.ordered(chunking.fixed_chunks(docs, 1, 0))
    assert own.where("document_id = 1").count() == 100_001
    asked = spark.createDataFrame([("q", "kata")], "query_id string, question string")
    rows = retrieval.bm25_topk(asked, own.where("chunk_index > 99998 OR document_id = 2"), 5).join(own, "chunk_id").orderBy("rank").collect()
    assert [(r.document_id, r.chunk_index) for r in rows] == [(1, 99_999), (1, 100_000), (2, 0), (2, 1), (2, 2)]


def test_no_job_while_plans_are_built(spark):
    """Only the stored postings and qrels run before a result is read."""
    asked = spark.createDataFrame([("q", "a b")], "query_id string, question string")
    own = spark.createDataFrame([("c", 0, "a a"), ("d", 1, "b")], "chunk_id string, chunk_ord int, text string")
    postings = retrieval.bm25_postings(asked, own)
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "planning")
    retrieval.bm25_topk(asked, postings, 5)
    assert not tracker.getJobIdsForGroup("planning")


def test_numbers(spark):
    from verdigrain.operators import relational

    rows = spark.range(1000).selectExpr("id", "id % 7 AS g")
    found = {(r.g, r.id): r.place for r in relational.numbered(rows, "g", "id").collect()}
    assert [found[k] for k in sorted(found)] == list(range(1, 1001))
    assert relational.numbered(rows.where("false"), "id").count() == 0


def test_questions_and_fingerprints_read_documents(spark, tmp_path):
    plain = "PUTUSAN\nNomor 1\nIDENTITAS TERDAKWA\nNama lengkap Budi Santoso Tempat lahir Jakarta Umur 30 tahun\nMENGADILI\nmenjatuhkan pidana penjara selama lima tahun"
    path = f"{tmp_path}/documents.parquet"
    spark.createDataFrame([(1, plain), (2, "no decision at all"), (3, ""), (4, None)], "doc_id bigint, text string").write.parquet(path)
    slots = catalogue.queries()["question_slots"](spark, str(tmp_path)).collect()
    assert {r.document_id for r in slots} == {1, 2, 3, 4} and len(slots) == 16
    assert {r.document_id for r in catalogue.queries()["fingerprints"](spark, str(tmp_path)).collect()} == {1, 2, 3, 4}
    failed = {r.document_id for r in text_queries.question_failures(spark, str(tmp_path)).where("question_type = 'all'").collect()}
    assert {2, 3, 4} <= failed
    assert 1 not in failed
    asked = {r.query_id: r for r in text_queries.question_drafts(spark, str(tmp_path)).collect()}
    assert set(asked) == {"dev-001-birthplace", "dev-001-disposition"} and asked["dev-001-birthplace"].reference_answer == "Jakarta"
    assert plain[asked["dev-001-birthplace"].evidence_start : asked["dev-001-birthplace"].evidence_end] == "Jakarta"


def test_summaries_are_checked_against_whole_texts(spark, tmp_path):
    text = "kata " * 24 + "nomor 77 narkotika " + "lagi " * 40
    spark.createDataFrame([(1, text)], "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    row = text_queries.summary_diagnostics(spark, str(tmp_path)).first()
    assert row.unsupported == "" and row.lexical_support_ratio == 1.0 and row.automated_quality_status == "pass"


def test_icc_of_every_order(spark):
    rows = spark.read.parquet(f"{SF}/lineitem.parquet").select("l_orderkey", "l_quantity").collect()
    orders, sets = {}, {}
    for r in rows:
        orders.setdefault(r.l_orderkey, []).append(float(r.l_quantity))
    for own in orders.values():
        sets.setdefault(len(own), []).append(own)
    found = {r.n: r for r in retrieval_queries.icc(spark, SF).collect()}
    assert set(found) == set(sets) and sum(n * r.clusters for n, r in found.items()) == len(rows)
    for n, own in sets.items():
        assert found[n].clusters == len(own)
        if n == 1 or len(own) == 1:
            assert found[n].icc is None
            continue
        x = np.array(own)
        b, w = n * x.mean(1).var(ddof=1), ((x - x.mean(1, keepdims=True)) ** 2).sum() / (len(x) * (n - 1))
        assert found[n].icc == pytest.approx(min(1, max(0, (b - w) / (b + (n - 1) * w))), abs=1e-6)


def test_mentions_as_brute_force(spark):
    """Each question's first place in each text, of questions of any length, over texts that are null, empty or hold part of it."""
    from verdigrain.operators import groundtruth

    asked = [(1, "satu dua tiga empat"), (2, "dua"), (3, "lain sama  sekali ya"), (4, None), (5, "satu dua"), (6, "é dua tiga x")]
    texts = [(1, "nol satu dua tiga empat satu dua tiga empat"), (2, None), (3, ""), (4, "xdua"), (5, "a lain sama  sekali yang"), (6, "satu  dua tiga empat"), (7, "😀 é dua tiga x"), (8, "tidak ada")]
    found = groundtruth.mentions(spark.createDataFrame(asked, "query_id bigint, question string"), spark.createDataFrame(texts, "document_id bigint, text string"))
    told = {(r.document_id, e.query_id, e.evidence_start, e.evidence_end) for r in found.collect() for e in r.found}
    assert told == {(d, q, t.find(a), t.find(a) + len(a)) for d, t in texts for q, a in asked if t is not None and a is not None and a in t} and len(told) == 8
    assert {(r.document_id, r.text) for r in found.collect()} == {(d, t) for d, t in texts if d in {x[0] for x in told}}
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()


def test_scanned_as_blocks(spark):
    """The best of each task are the best of all, with ties over batches, any number of queries, and where the weights are too many to hold."""
    rng = np.random.default_rng(3)
    words = [f"w{i}" for i in range(12)]
    own = spark.createDataFrame([(f"c{n:03}", (n % 7, n), " ".join(rng.choice(words, rng.integers(1, 5)))) for n in range(300)], "chunk_id string, chunk_ord struct<d:int,i:int>, text string").repartition(3)
    asked = spark.createDataFrame([(n, " ".join(rng.choice([*words, "none"], 3))) for n in range(17)], "query_id bigint, question string")
    postings = retrieval.bm25_postings(asked, own)
    told = lambda df: sorted((r.query_id, r.rank, r.chunk_id, tuple(r.chunk_ord), r.score) for r in df.collect())
    expected = told(retrieval.bm25_best(asked, postings, 4))
    size = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "16")
    try:
        scanned = retrieval.bm25_scanned(asked, postings, 4, block=5)
        assert len(expected) > 60 and told(scanned) == expected
        plan = scanned._jdf.queryExecution().optimizedPlan().toString()
        assert "CoGroup" not in plan and "Join" not in plan
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
    assert told(retrieval.bm25_scanned(asked, postings, 4, most=3)) == expected
    assert retrieval.bm25_scanned(asked, own.where("false"), 4).count() == 0 and retrieval.bm25_scanned(asked.where("false"), own, 4).count() == 0


def test_contexts_and_comparisons_leave_little(spark):
    """Postings are deleted once runs are stored, and no text is shuffled for evidence or contexts."""
    from pathlib import Path

    from verdigrain.plans import comparison_queries, derived
    from verdigrain.session import shared_dir

    there = set(Path(shared_dir(spark)).iterdir())
    run = derived.run(spark, SF)
    plan = derived.found_chunks(spark, SF, run)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    for query in (retrieval_queries.context_delivery, comparison_queries.comparison_by_stratum):
        assert query(spark, SF).collect()
    made = [p.name for p in set(Path(shared_dir(spark)).iterdir()) - there]
    assert made and not [name for name in made if name.startswith(("bm25-postings", "mentions"))]
