import json

import pytest
from pyspark.sql import functions as F

from verdigrain.sources import files
from verdigrain.streaming import chunks

XML = '<putusan id="case-1" klasifikasi="pidana-khusus" sub_klasifikasi="narkotika-dan-psikotropika" lembaga_peradilan="PN" provinsi="X" url="http://a"><kepala_putusan>Putusan nomor 12 pid sus 2018 pn cth <b>demi</b> keadilan</kepala_putusan><identitas>Nama  Budi</identitas><penutup>akhir</penutup></putusan>'


def test_jsonl(spark, tmp_path):
    (tmp_path / "in.jsonl").write_text('{"b": 1, "a": "é"}\n\n{"a": null, "b": 2}\n')
    rows = files.read_jsonl(spark, str(tmp_path / "in.jsonl"), "a string, b int")
    assert [tuple(r) for r in rows.collect()] == [("é", 1), (None, 2)]
    files.write_jsonl(rows.coalesce(1), str(tmp_path / "out"))
    text = next((tmp_path / "out").glob("part-*")).read_text()
    assert text.splitlines()[0] == '{"a":"é","b":1}'
    with pytest.raises(Exception, match="exist"):
        files.write_jsonl(rows, str(tmp_path / "out"))
    (tmp_path / "bad.jsonl").write_text("[1]\n")
    with pytest.raises(Exception, match="not an object"):
        files.read_jsonl(spark, str(tmp_path / "bad.jsonl"), "a string").collect()


def test_csv_and_config(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes('﻿x,y\n"1\n2",z\n'.encode())
    assert tuple(files.read_csv(spark, str(tmp_path / "a.csv")).first()) == ("1\n2", "z")
    (tmp_path / "base.json").write_text(json.dumps({"a": {"x": 1, "y": 2}}))
    (tmp_path / "child.json").write_text(json.dumps({"extends": "base.json", "a": {"y": 3}}))
    assert files.load_config(tmp_path / "child.json") == {"a": {"x": 1, "y": 3}}
    (tmp_path / "self.json").write_text(json.dumps({"extends": "self.json"}))
    with pytest.raises(ValueError):
        files.load_config(tmp_path / "self.json")


def test_decisions(spark, tmp_path):
    (tmp_path / "x.xml").write_text(XML)
    found = files.read_decisions(spark, str(tmp_path))
    row = files.decision_metadata(found).first()
    assert (row.source_id, row.case_year, row.case_number_normalized, row.section_lengths["penutup"]) == ("case-1", 2018, "12 pid sus 2018 pn cth", 5)
    rows = files.decision_sections(found).orderBy("start_position").collect()
    assert [(r.section_label, r.section_text) for r in rows][1:] == [("identitas_terdakwa", "Nama Budi\n\n"), ("penutup", "akhir")]
    assert rows[0].end_position == rows[1].start_position


def test_index_and_hashes(spark, tmp_path):
    index = spark.createDataFrame([("a", "x", [1.0, 0.0])], "chunk_id string, text string, embedding array<double>")
    files.save_index(index, str(tmp_path / "i"), model_name="m")
    assert files.load_index(spark, str(tmp_path / "i"), model_name="m").count() == 1
    with pytest.raises(ValueError):
        files.load_index(spark, str(tmp_path / "i"), model_name="n")
    a = spark.range(5).withColumn("t", F.lit("x"))
    assert files.fingerprint(a) == files.fingerprint(a.orderBy(F.desc("id"))) != files.fingerprint(a.where("id < 4"))
    assert files.cached(spark, str(tmp_path / "c"), "k", lambda: a).count() == 5
    with pytest.raises(ValueError):
        files.cached(spark, str(tmp_path / "c"), "other", lambda: a)


def test_page_text_and_reports(spark):
    assert files.page_text([[((1.0, 0.0), "a"), ((0.0, 1.0), "turned")], [((1.0, 0.0), "b"), ((1.0, 0.0), "c")]]) == "a\n\nb\nc"
    assert files.markdown(spark.createDataFrame([(1, "a|b")], "x int, y string")) == "| x | y |\n|---|---|\n| 1 | a\\|b |\n"
    assert files.run_stages({"a": lambda: None, "b": lambda: None}, "b") == ["b"] and "<svg" in files.bar_chart(["x"], {"s": [1.0]})


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps({"document_id": "d", "text": " ".join(f"w{i}" for i in range(300))}) + "\n")
    query = chunks.chunk_files(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"))
    query.awaitTermination(60)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_printed_text_is_page_text(spark):
    lines = [("d", 1, 0, 0, 1.0, 0.0, "a"), ("d", 1, 0, 1, 0.0, 1.0, "turned"), ("d", 1, 1, 2, 1.0, 0.0, "b"), ("d", 1, 1, 3, 1.0, 0.0, "c"), ("d", 2, 0, 0, 0.0, 1.0, "all turned")]
    rows = files.printed_text(spark.createDataFrame(lines, "document_id string, page_number int, block int, line int, x double, y double, text string"))
    assert {r.page_number: r.raw_text for r in rows.collect()} == {1: "a\n\nb\nc", 2: ""}


def test_pdfs_by_a_stand_in(spark, tmp_path, monkeypatch):
    """The reader's own part, with a module that has the calls of the optional library."""
    (tmp_path / "lib").mkdir()
    (tmp_path / "lib" / "fitz.py").write_text("""
class Page:
    def __init__(self, text): self.text = text
    def get_text(self, kind):
        span = lambda d, t: {"dir": d, "spans": [{"text": t}]}
        return {"blocks": [{"lines": [span((1, 0), self.text), span((0, 1), "turned")]}, {}]}
class Document(list):
    def __enter__(self): return self
    def __exit__(self, *error): return False
def open(stream, filetype): return Document(Page(t) for t in bytes(stream).decode().split("|"))
""")
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "Putusan 1.PDF").write_bytes(b"one|two")
    (tmp_path / "in" / "skip.txt").write_bytes(b"x")
    files.on_workers(spark)
    environment = spark.sparkContext.environment
    before = environment.get("PYTHONPATH", "")
    environment["PYTHONPATH"] = f"{tmp_path / 'lib'}:{before}"
    try:
        rows = files.read_pdfs(spark, str(tmp_path / "in")).orderBy("page_number").collect()
    finally:
        environment["PYTHONPATH"] = before
    assert [(r.filename, r.page_number, r.raw_text) for r in rows] == [("Putusan%201.PDF", 1, "one"), ("Putusan%201.PDF", 2, "two")] or [r.raw_text for r in rows] == ["one", "two"]
    assert rows[0].document_id.startswith("putusan")


def test_acquired_and_restored(spark, tmp_path):
    tries, waits = {}, []

    def fetch(address):
        tries[address] = tries.get(address, 0) + 1
        if tries[address] < 3:
            raise OSError("busy")
        return address.encode()

    assert files.acquired(["a", "b"], fetch, sleep=waits.append) == {"a": b"a", "b": b"b"} and sorted(waits) == [1.0, 1.0, 2.0, 2.0]
    with pytest.raises(OSError):
        files.acquired(["c"], fetch, attempts=2, sleep=waits.append)
    own = spark.createDataFrame([("x/a.xml", bytearray(b"one")), ("x/b.xml", bytearray(b"two"))], "path string, content binary")
    manifest = own.select(F.element_at(F.split("path", "/"), -1).alias("local_file"), F.sha2("content", 256).alias("sha256"), F.length("content").alias("bytes"))
    assert files.restored(own, manifest, str(tmp_path / "r")).count() == 2
    with pytest.raises(ValueError, match="b.xml: hash"):
        files.restored(own, manifest.withColumn("sha256", F.when(F.col("local_file") == "b.xml", "0").otherwise(F.col("sha256"))), str(tmp_path / "s"))
    assert not (tmp_path / "s").exists()


def test_charts_and_reports(spark):
    assert files.line_chart([1, 2], {"a": [0.1, 0.2]}, "t").count("<polyline") == 1
    assert files.interval_chart([("a", -0.1, 0.0, 0.1), ("b", 0.0, 0.1, 0.2)]).count("<circle") == 2
    text = files.report("Title", "pilot", {"Means": spark.createDataFrame([(1,)], "x int")})
    assert text.startswith("# Title") and files.CAVEATS["pilot"] in text and "| 1 |" in text
    with pytest.raises(ValueError):
        files.report("Title", "other", {})


def test_each_decision_is_parsed_once(spark):
    """One XPath tells all of a file, no filter repeats it, and no section is shuffled."""
    from verdigrain.plans import decisions

    xml = '<putusan id="7"><kepala_putusan> putusan\n nomor 7 pid 2019 demi keadilan </kepala_putusan><identitas>a<b>c</b> d</identitas><fakta> </fakta><amar_putusan>z</amar_putusan></putusan>'
    found = spark.createDataFrame([("a", xml), ("b", '<putusan id="8"/>'), ("c", None)], "source_path string, xml string")
    rows = files.decision_sections(found)
    head = "putusan nomor 7 pid 2019 demi keadilan\n\n"
    told = [(r.document_id, r.section_label, r.start_position, r.end_position, r.section_text) for r in rows.orderBy("start_position").collect()]
    assert told == [("7", "kepala_putusan", 0, len(head), head), ("7", "identitas_terdakwa", len(head), len(head) + 6, "ac d\n\n"), ("7", "amar_putusan", len(head) + 6, len(head) + 7, "z")]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("/putusan/@id") == 1 and "Window" not in plan
    assert decisions.decision_facts(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() == 4


def test_decisions_of_any_xml(spark):
    """What expat doesn't take goes to XPath: a document type's entities, and errors; a comment, CDATA and another root are told alike."""
    deep = '<putusan id="a&amp;b"><fakta>x<!-- no -->\u00a0 <![CDATA[<y>]]></fakta><fakta>second</fakta><b><penutup>inner</penutup></b></putusan>'
    typed = '<!DOCTYPE putusan [<!ENTITY e "  from  entity ">]><putusan id="2"><fakta>&e;</fakta></putusan>'
    found = spark.createDataFrame([("a", deep), ("b", typed), ("c", "<other><fakta>no</fakta></other>"), ("d", None)], "source_path string, xml string")
    told = [(r.document_id, r.section_label, r.start_position, r.end_position, r.section_text) for r in files.decision_sections(found).collect()]
    assert told == [("a&b", "fakta", 0, 5, "x <y>"), ("2", "fakta", 0, 11, "from entity")]
    plan = files.decision_sections(found)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("parsed(") == 1
    assert files.decision_metadata(found.where("source_path = 'b'")).first().section_lengths["fakta"] == 11
    with pytest.raises(Exception, match="not a decision"):
        files.decision_metadata(found.where("source_path = 'c'")).collect()
    with pytest.raises(Exception, match="(?i)xml"):
        files.decision_sections(spark.createDataFrame([("e", "<putusan><fakta></putusan>")], "source_path string, xml string")).collect()


def test_documents_of_one_row(spark):
    """One row for each document with its sections as an array says the same as a row for each section, repeated labels too."""
    from verdigrain.functions import extract
    from verdigrain.operators import questions
    from verdigrain.plans import decisions

    sf = "/root/testdata/sf0.001"
    rows, own = decisions.decision_sections(spark, sf), decisions.decision_parts(spark, sf)
    for made in (extract.fingerprints, questions.question_slots, lambda df: extract.components(df).drop("labels"), lambda df: questions.questions_v2(df, "q")[0]):
        a, b = sorted(map(tuple, made(rows).collect()), key=str), sorted(map(tuple, made(own).collect()), key=str)
        assert a and a == b
    plan = extract.components(own)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan and plan.count("parsed(") == 1
    twice = spark.createDataFrame([(1, "fakta", "a", 0), (1, "fakta", "b", 1), (2, "amar_putusan", "c", 0)], "document_id bigint, section_label string, section_text string, start_position bigint")
    assert {(r.document_id, r.labels.get("fakta")) for r in extract.by_label(twice).collect()} == {(1, "b"), (2, None)}
    assert {(r.document_id, tuple(r.texts.items())) for r in questions._evidence(twice, questions.RULES).collect()} == {(1, (("fakta", "b"),)), (2, (("amar_putusan", "c"),))}
