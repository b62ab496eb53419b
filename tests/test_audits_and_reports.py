import numpy as np
from pyspark.sql import functions as F

from verdigrain.functions import extract
from verdigrain.operators import augment, chunking, embedding, groundtruth, inference, metrics, questions, retrieval, sections
from verdigrain.plans.text_queries import decision_sections
from tests.test_text_and_chunks import DECISION, docs


def table(spark, schema, *rows):
    return spark.createDataFrame(list(rows), schema)


def test_compliance(spark):
    text = "fakta satu dua tiga empat\nPERTIMBANGAN HUKUM\nalasan panjang lagi\nMENGADILI\nmenghukum dia"
    cuts = [0, text.index("PERTIMBANGAN"), text.index("MENGADILI"), len(text)]
    rows = [("d0", label, heading, a, b, text[a:b]) for label, heading, a, b in zip(("fakta", "pertimbangan_hukum", "amar_putusan"), (None, "PERTIMBANGAN HUKUM", "MENGADILI"), cuts, cuts[1:])]
    own = table(spark, "document_id string, section_label string, section_heading string, start_position bigint, end_position bigint, section_text string", *rows)
    chunks = chunking.structure_chunks(own, words=300, overlap=50)
    found = sections.compliance(docs(spark, text), own, chunks, tail=0.4).first().asDict()
    assert all(v for k, v in found.items() if k != "document_id"), found
    broken = sections.compliance(docs(spark, text), own.where("section_label <> 'fakta'"), chunks).first()
    assert not broken.full_section_coverage and not broken.three_rhetorical_strata and not broken.chunks_within_sections


def test_section_reviews(spark):
    table_ = docs(spark, DECISION)
    own = sections.detect(table_)
    review = sections.annotation_template(table_, own)
    assert review.count() == len(sections.REVIEW_LABELS) and review.where("detected = 'yes'").count() == 7
    done = review.withColumn("gold_present", F.lit("yes")).withColumn("review_status", F.when(F.col("section_label") == "fakta", "near").otherwise("exact"))
    assert sections.review_violations(done).count() == 0
    row = sections.review_scores(done).where("section_label = 'fakta'").first()
    assert (row.exact_recall, row.tolerant_recall) == (0.0, 1.0)
    assert sections.review_violations(done.withColumn("detected", F.lit("no"))).count() == 7
    assert sections.structure_audit(table_, own).count() == 8


def test_question_checks(spark):
    text = docs(spark, "Pasal 5 lalu pasal 5 lagi")
    own = table(spark, "document_id string, section_label string, start_position bigint, end_position bigint, section_text string", ("d0", "pertimbangan_hukum", 0, 25, "Pasal 5 lalu pasal 5 lagi"))
    asked = table(spark, "query_id string, document_id string, question string, reference_answer string, evidence_start bigint, evidence_end bigint, evidence_text string, target_section_label string, review_status string, difficulty string", ("q", "d0", "apa?", "Pasal 5", 0, 7, "Pasal 5", "pertimbangan_hukum", "approved", "easy"), ("bad", "zz", "", "umur", 5, 2, "", "x", "?", "?"))
    chunks = table(spark, "chunk_id string, document_id string, start_position bigint, end_position bigint", ("a", "d0", 0, 10), ("b", "d0", 10, 25), ("c", "d0", 2, 5))
    assert sorted(r.chunk_id for r in groundtruth.positive_qrels(asked.where("query_id = 'q'"), chunks, own).collect()) == ["a", "b"]
    problems = {r.problem for r in groundtruth.question_violations(asked, text).where("query_id = 'bad'").collect()}
    assert {"unknown_document", "invalid_status", "invalid_difficulty", "blank_question"} <= problems
    audited = groundtruth.question_audit(asked, text, own)
    status = {r.query_id: r for r in audited.collect()}
    assert status["q"].automatic_status == "include_exploratory_only" and "field_label_as_answer" in status["bad"].automatic_flags
    assert groundtruth.audit_histogram(audited).where("flag = 'none'").first()["count"] == 1
    assert [r.query_id for r in groundtruth.uncovered(asked, groundtruth.qrel_candidates(asked, chunks)).collect()] == ["bad"]


def test_ranks_and_classes(spark):
    qrels = table(spark, "query_id string, chunk_id string, grade int", ("q", "a", 2), ("r", "z", 1))
    run = table(spark, "query_id string, chunk_id string, document_id string, rank int", ("q", "x", "d", 1), ("q", "a", "d", 7), ("r", "y", "e", 1))
    asked = table(spark, "query_id string, document_id string, target_section_label string", ("q", "d", "s"), ("r", "f", "s"))
    chunks = table(spark, "chunk_id string, document_id string, section_label string, start_position int, end_position int", ("x", "d", "s", 0, 5), ("a", "d", "s", 5, 9), ("y", "e", "s", 0, 2))
    parts = table(spark, "document_id string, section_label string, start_position int, end_position int", ("d", "s", 0, 9))
    deep = {r.query_id: r["class"] for r in metrics.depth_classes(qrels, run, asked, chunks, parts).collect()}
    assert deep == {"q": "rank_6_to_50", "r": "wrong_document"}
    why = {r.query_id: r.category for r in metrics.failure_classes(qrels, run, asked, chunks).collect()}
    assert why == {"q": "correct_document_and_section_wrong_passage+evidence_beyond_top_k", "r": "wrong_source_document"}
    assert metrics.rank_summary(metrics.first_relevant(qrels, run)).first().p90_rank == 7
    long = metrics.ranking_metrics(qrels, run, ks=(5, 10), dedupe=False)
    wide = metrics.wide_metrics(long, ["query_id"]).where("query_id = 'q'").first()
    assert wide["recall@10"] == 1 and wide["recall@5"] == 0
    assert metrics.missing_runs(qrels, run.where("query_id = 'q'")).count() == 1
    assert inference.unpaired(long, long.where("query_id = 'q'")).count() == 1


def test_prompts_and_orders(spark):
    asked = table(spark, "query_id string, question string, context string", ("q", " apa? ", "c {question}"))
    assert retrieval.prompts(asked.select("query_id", "question"), asked.select("query_id", "context")).first().prompt.startswith("Konteks:\nc ")
    both = table(spark, "query_id string, strategy string", *[(q, s) for q in "abcd" for s in ("fixed", "structure")])
    rows = retrieval.paired_order(both).orderBy("position", "turn").collect()
    assert [r.strategy for r in rows if r.turn == 1] == ["fixed", "structure", "fixed", "structure"]
    run = table(spark, "query_id string, rank int, chunk_id string", ("q", 2, "b"), ("q", 1, "a"))
    assert [x.chunk_id for x in retrieval.run_records(run).first().ranking] == ["a", "b"]
    assert retrieval.ranking_violations(run.where("rank = 2")).count() == 1


def test_contexts_and_summaries(spark):
    own = decision_sections(spark)
    row = extract.hierarchical_contexts(own).first()
    assert row.document_context.startswith("perkara 12") and row.section_contexts["pertimbangan_hukum"].startswith("bagian dokumen pertimbangan hukum; ketentuan pidana")
    assert extract.representative_documents(own, per_section=200).first().text.startswith("[kepala putusan] Putusan")
    chunks = chunking.structure_chunks(own, words=20, overlap=4, context="section_document")
    assert chunks.where("embedding_text LIKE 'perkara terdakwa: Budi Santoso 2. bagian dokumen: %'").count() == chunks.count()
    more = augment.with_hierarchical_contexts(chunks, extract.hierarchical_contexts(own))
    assert more.count() == chunks.count() and more.first().embedding_text.startswith("konteks dokumen: ")
    said = augment.with_summaries(chunks, table(spark, "document_id string, summary string", ("case-1", " a  b ")))
    assert said.where("embedding_text LIKE 'ringkasan dokumen: a b%'").count() == chunks.count()
    assert augment.summary_violations(chunks, table(spark, "document_id string, summary string", ("case-1", "x" * 171))).first().problem == "too long"
    made = augment.section_summaries(own, short=40).withColumn("source", F.col("section_text")).withColumn("summary_type", F.lit("section"))
    checked = augment.diagnostics(made)
    assert augment.quality_report(checked).count() == 8 and augment.review_sample(checked, "section_label", 1, stratum="section_label").count() == 6
    assert augment.cleaned_output(F.lit("x")) is not None and own.select(augment.cleaned_output(F.lit('"Ringkasan: isi "')).alias("r")).first().r == "isi"

    class Fixed:
        def summarize(self, sources):
            return ["" if "narkotika" in s else "dibuat" for s in sources]

    kinds = {r.section_label: r.generation_status for r in augment.section_summaries(own, short=20, summarizer=Fixed()).collect()}
    assert kinds["riwayat_dakwaan"] == "extractive_fallback" and kinds["amar_putusan"] == "generated"


def test_layout_drafts(spark):
    text = "1. Nama lengkap : Budi ; 2. Tempat lahir : Jakarta ; 3. Umur/Tgl. lahir : 30"
    ruling = "1. Menjatuhkan pidana penjara selama lima tahun kepada terdakwa; 2. Menetapkan"
    own = table(spark, "document_id string, section_label string, start_position bigint, section_text string", ("d", "identitas_terdakwa", 0, text), ("d", "amar_putusan", 100, ruling))
    slots = table(spark, "query_id string, document_id string, target_section_label string", ("a", "d", "identitas_terdakwa"), ("b", "d", "amar_putusan"), ("c", "d", "fakta"))
    rows = {r.query_id: r for r in questions.layout_drafts(slots, own).collect()}
    assert set(rows) == {"a", "b"} and rows["a"].reference_answer == "Jakarta" and rows["b"].reference_answer == "Menjatuhkan pidana penjara selama lima tahun kepada terdakwa"
    assert rows["b"].evidence_start == 100 and rows["a"].question == "Di mana Budi dilahirkan?"


def test_vectors(spark):
    class Lengths:
        model_name = "lengths"

        def embed_documents(self, texts):
            return np.array([[len(t), 1.0] for t in texts])

        embed_queries = embed_documents

    rows = table(spark, "text string", ("a",), ("bb",), ("a",))
    encode = lambda df: embedding.embedded(df, Lengths, F.col("text"))
    got, cache = embedding.reused(rows, table(spark, "text string, embedding array<float>", ("a", [9.0, 9.0])), encode)
    assert sorted((r.text, r.embedding[0]) for r in got.collect()) == [("a", 9.0), ("a", 9.0), ("bb", 2.0)] and cache.count() == 2
    assert embedding.cache_conflicts(cache.union(table(spark, "text string, embedding array<float>", ("bb", [2.5, 1.0])))).first().text == "bb"
    keyed = table(spark, "key string, embedding array<double>", ("x", [1.0, 2.0]))
    assert embedding.equivalence(keyed, keyed).first().accepted
    spans = embedding.token_spans(table(spark, "document_id string, span_id int, start int, end int", ("d", 0, 3, 8)), table(spark, "document_id string, token int, start int, end int", ("d", 0, 0, 4), ("d", 1, 5, 7), ("d", 2, 8, 9))).first()
    assert (spans.start, spans.end) == (0, 2)
    whole = table(spark, "chunk_id string, text string", ("a", "x"), ("b", "y"))
    assert [r.chunk_id for r in embedding.index_differences(whole, whole.where("chunk_id = 'a'")).collect()] == ["b"]


def test_layout_reach_and_narrowing():
    facts = "x " * 4500 + "Bahwa Terdakwa Budi tanpa hak menjual sesuatu yang dilarang di pasar, perbuatan mana;"
    assert questions.layout_span("fakta", facts) is None
    a, b = questions.layout_span("fakta", facts, None)
    assert facts[a:b] == "tanpa hak menjual sesuatu yang dilarang di pasar"
    law = "bahwa dakwaan yang berbentuk tunggal diatur dalam Pasal 112 halaman 3 tentang Narkotika; Memperhatikan, Pasal 114 Undang-Undang tentang Narkotika;"
    a, b = questions.layout_span("pertimbangan_hukum", law)
    assert law[a:b] == "Pasal 114 Undang-Undang tentang Narkotika"
    a, b = questions.layout_span("pertimbangan_hukum", "lain; Mengingat Pasal 5 saja;")
    assert "lain; Mengingat Pasal 5 saja;"[a:b] == "Mengingat Pasal 5 saja;"
    assert questions.layout_span("pertimbangan_hukum", "kosong") is None
    held = "1. Penyidik lain sejak tanggal 2 Mei 2018 sampai dengan tanggal 3 Mei 2018; Terdakwa ditahan; 2. Penyidik sejak tanggal 4 Mei 2018 sampai dengan tanggal 5 Mei 2018;"
    a, b = questions.layout_span("riwayat_penahanan", held)
    assert held[a:b].startswith("2. Penyidik sejak tanggal 4")


def test_contracts_raise(spark):
    import pytest

    runs = table(spark, "query_id string, chunk_id string, rank int", ("q", "a", 2))
    with pytest.raises(Exception, match="ranks aren't contiguous"):
        retrieval.insisted(runs, retrieval.ranking_violations(runs), "run").collect()
    assert retrieval.insisted(runs, retrieval.ranking_violations(runs).where("false"), "run").count() == 1
    asked = table(spark, "query_id string, prompt string", ("q", "p"))
    assert retrieval.generated(asked, lambda: lambda p: f" {p}! ").first().answer == "p!"
    with pytest.raises(Exception, match="no answer"):
        retrieval.generated(asked, lambda: lambda p: "  ").collect()
    from verdigrain.operators import relational

    rows = table(spark, "g string", *[("a",)] * 3, *[("b",)] * 2)
    assert sum(r["size"] for r in relational.disjoint_split(rows, "g", 5, exact=True).collect()) == 5
    with pytest.raises(Exception, match="don't fill"):
        relational.disjoint_split(rows, "g", 1, exact=True).collect()


def test_checkpoints_of_vectors(spark, tmp_path):
    import pytest

    items = table(spark, "chunk_id bigint, text string", *[(k, "x" * k) for k in range(10)])
    calls = []

    def encode(bad):
        def made(df):
            calls.append(df.count())
            return df.select("chunk_id", F.when(F.col("chunk_id") == bad, F.array(F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.length("text").cast("double"))).alias("embedding"))

        return made

    with pytest.raises(Exception, match="bad vector of"):
        embedding.checkpointed(items, str(tmp_path / "v"), encode(7), dimension=2, batches=3)
    done = spark.read.parquet(str(tmp_path / "v")).count()
    calls.clear()
    out = embedding.checkpointed(items, str(tmp_path / "v"), encode(None), dimension=2, batches=3)
    assert out.count() == 10 and sum(calls) == 10 - done


def test_bounded_sources(spark):
    seen = []

    class Heads:
        def summarize(self, sources):
            assert all(len(s) <= 40 + 8 and " [...] " in s for s in sources)
            return ["dibuat" for _ in sources]

    own = table(spark, "section_text string", ("kata " * 50,), ("pendek",))
    rows = {r.generation_status for r in augment.section_summaries(own, short=20, summarizer=Heads(), source_chars=40).collect()}
    assert rows == {"generated", "copied"} and not seen


def test_offsets_of_contextual_chunks(spark):
    text = docs(spark, "satu dua tiga")
    own = table(spark, "chunk_id string, document_id string, start_position int, end_position int, text string", ("a", "d0", 0, 4, "satu"), ("b", "d0", 5, 8, "dia"))
    assert [r.chunk_id for r in embedding.offset_violations(text, own).collect()] == ["b"]
