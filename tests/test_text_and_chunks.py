from pyspark.sql import functions as F

from verdigrain.functions import extract
from verdigrain.functions import text as tx
from verdigrain.operators import chunking, sections


def one(spark, expression, **columns):
    return spark.createDataFrame([tuple(columns.values())], list(columns)).select(expression.alias("r")).first().r


def docs(spark, *texts):
    return spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts)], "document_id string, text string")


def test_cleaning(spark):
    t = F.col("t")
    assert one(spark, tx.cleaned(t), t="  P U T U S A N  \r\nperka-\nra pidana\t  ") == "P U T U S A N\nperkara pidana"
    lines = "satu\nDisclaimer\nHalaman 3 dari 10\nHal. 4\nputusan.mahkamahagung.go.id\ndua\n\n\n\ntiga"
    assert one(spark, tx.cleaned(t), t=lines) == "satu\ndua\n\ntiga"
    assert one(spark, tx.repaired(t), t="â€œaâ€\u009d Â½") == "“a” ½"
    assert one(spark, tx.nfkc(t), t="ﬁ") == "fi"
    assert one(spark, tx.word_count(t), t="a b c") == 3


def test_cuts_and_names(spark):
    t = F.col("t")
    assert one(spark, tx.head_at_word(t, 10), t="one two, three") == "one two"
    assert one(spark, tx.head_at_word(t, 4), t="abcdefgh") == "abcd"
    assert one(spark, tx.tail_at_word(t, 9), t="one two, three") == "three"
    assert one(spark, tx.slug(t), t="Putusan No. 12/Pid") == "putusan-no-12-pid"
    assert one(spark, tx.plausible_name(t), t="Budi Santoso") and not one(spark, tx.plausible_name(t), t="umur 30")
    assert one(spark, tx.valid_birthplace(t), t="Jakarta Selatan") and not one(spark, tx.valid_birthplace(t), t="tanggal 3")


def test_word_windows(spark):
    rows = chunking.fixed_chunks(docs(spark, " ".join(f"w{i}" for i in range(1, 11)), "", " a "), 4, 1).orderBy("document_id", "chunk_index").collect()
    assert [r.text for r in rows] == ["w1 w2 w3 w4", "w4 w5 w6 w7", "w7 w8 w9 w10", "a"]
    assert rows[-1].start_position == 1 and rows[-1].end_position == 2
    spans = one(spark, tx.word_spans(F.col("t")), t=" aa  b\n")
    assert [(s.start, s.end) for s in spans] == [(1, 3), (5, 6)]


def test_sentences_and_packing(spark):
    spans = one(spark, chunking.sentence_spans(F.col("t")), t=" One. Two!? Three")
    assert [(s.start, s.end) for s in spans] == [(1, 5), (6, 11), (12, 17)]
    text = "a b c d e. f g h i j."
    runs = chunking.packed_sentences(text, 4, 1, 2, False)
    words = [text[a:b].split() for a, b in runs]
    assert all(len(w) <= 4 for w in words) and all(runs[i + 1][0] < runs[i][1] for i in range(len(runs) - 1))
    whole = " ".join(f"w{i}" for i in range(13))
    sizes = [len(whole[a:b].split()) for a, b in chunking.packed_sentences(whole, 6, 1, 2, True)]
    assert sizes == [6, 6, 6] and whole[slice(*chunking.packed_sentences(whole, 6, 1, 2, True)[-1])] == " ".join(f"w{i}" for i in range(7, 13))
    three = "a a a. b b b. c c c. d d d."
    assert [three[a:b] for a, b in chunking.packed_sentences(three, 6, 0, 1, False)] == ["a a a. b b b.", "b b b. c c c.", "c c c. d d d."]


def test_rhetorical_and_recursive(spark):
    text = "x x x x menimbang bahwa y y y y y y"
    runs = [text[a:b] for a, b in chunking.rhetorical_windows(text, 5, 1, 0.7, False)]
    assert runs[0] == "x x x x" and runs[1].startswith("x menimbang")
    rows = chunking.recursive_chunks(docs(spark, "Kalimat yang berulang. " * 40), size=120).collect()
    whole = "Kalimat yang berulang. " * 40
    assert all(whole[r.start_position : r.end_position] == r.original_text and len(r.original_text) <= 120 for r in rows)
    assert len({r.chunk_id for r in rows}) == len(rows)


def test_parents_and_audit(spark):
    table = docs(spark, " ".join(f"w{i}" for i in range(900)))
    parents, children = chunking.parent_child_chunks(table)
    assert parents.count() == 2
    assert children.where("start_position < parent_start_position OR end_position > parent_end_position").count() == 0
    own = chunking.fixed_chunks(table, 100, 20)
    assert chunking.chunk_violations(own, table).count() == 0
    broken = own.withColumn("end_position", F.col("end_position") + 1).where("chunk_index > 0")
    assert {r["check"] for r in chunking.chunk_violations(broken, table).collect()} == {"text", "coverage", "offsets"}


DECISION = "kop surat\nPUTUSAN\n1. Nama lengkap : Budi\nTerdakwa ditahan sejak\nMenimbang, bahwa Terdakwa diajukan ke persidangan dengan dakwaan\nisi fakta\nPERTIMBANGAN HUKUM\nalasan\nMENGADILI\nmenghukum\nDemikian diputuskan\n"


def test_section_cascade(spark):
    rows = sections.detect(docs(spark, DECISION, "tidak ada")).orderBy("document_id", "start_position").collect()
    first = [r for r in rows if r.document_id == "d0"]
    assert [r.section_label for r in first] == ["unknown", "kepala_putusan", "identitas_terdakwa", "riwayat_penahanan", "fakta", "pertimbangan_hukum", "amar_putusan", "penutup"]
    assert "".join(r.section_text for r in first) == DECISION and first[1].section_heading == "PUTUSAN"
    assert [r.section_label for r in rows if r.document_id == "d1"] == ["unknown"]
    long = "MENGADILI\n" + "isi panjang sekali\n" * 100 + "MENGADILI\nputus\n"
    assert [s for g, s in sections.boundaries(long, 0.2) if g == "amar_putusan"] == [long.rindex("MENGADILI")]


def test_section_assignment(spark):
    own = spark.createDataFrame([("c", "d", 50, 150, "x")], "chunk_id string, document_id string, start_position int, end_position int, text string")
    parts = spark.createDataFrame([("d", "a", None, 0, 80), ("d", "b", "H", 80, 200)], "document_id string, section_label string, section_heading string, start_position int, end_position int")
    pages = spark.createDataFrame([("d", 1, 0, 200), ("d", 2, 202, 300)], "document_id string, page_number int, start_position int, end_position int")
    row = sections.assign_sections(own, parts, pages).first()
    assert (row.section_label, row.section_overlap_chars, row.section_assignment_status, row.mixed_section_labels, row.page_numbers) == ("b", 70, "mixed_maximum_overlap", ["b", "a"], [1])


def test_merged_intervals(spark):
    spans = spark.createDataFrame([("d", 0, 5), ("d", 3, 8), ("d", 8, 9), ("d", 12, 13)], "document_id string, start_position int, end_position int")
    assert sorted((r.start_position, r.end_position) for r in chunking.merged_intervals(spans, ["document_id"]).collect()) == [(0, 9), (12, 13)]


def test_fingerprint_and_questions(spark):
    from verdigrain.operators import questions
    from verdigrain.plans.text_queries import DECISION as CASE
    from verdigrain.plans.text_queries import decision_sections

    own = decision_sections(spark)
    row = extract.components(own).first()
    assert (row["case"], row.defendant, row.topic) == ("12 Pid Sus 2018 PN Cth", "Budi Santoso", "narkotika")
    assert row.statute == "pasal 114 ayat 1"
    summary = extract.fingerprints(own).first().summary
    assert summary.startswith("perkara 12 Pid Sus 2018 PN Cth; terdakwa Budi Santoso") and len(summary) <= 170
    asked, failed = questions.questions_v2(own, "dev")
    rows = {r.question_type: r for r in asked.collect()}
    assert set(rows) == {"birthplace", "detention", "charge", "statute", "disposition"} and failed.count() == 0
    starts = {r.section_label: r.start_position for r in own.collect()}
    texts = dict(CASE)
    for r in rows.values():
        base = starts[r.evidence_section_label]
        part = texts[r.evidence_section_label][r.evidence_start - base : r.evidence_end - base]
        assert " ".join(part.split()) == r.reference_answer
    assert rows["birthplace"].reference_answer == "Jakarta" and rows["statute"].question.endswith("Budi Santoso?")
    assert questions.questions_v1(own, "x")[0].count() == 4
