"""Queries on court decisions that are written from the rows of customer, so that every rule has something to find.

Each customer is one decision with a number, a name, a place, an article and a term that follow from its
key; some lack a section or have another wording. The SQL knows these facts and says what must be found,
without any of the patterns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrain.functions import extract
from verdigrain.functions import text as tx
from verdigrain.operators import augment, chunking, groundtruth, questions, relational, sections
from verdigrain.plans.catalogue import register
from verdigrain.session import spread, stored, table
from verdigrain.sources import files

FIRST, LAST, PLACES = ("Budi", "Siti", "Agus", "Dewi", "Joko"), ("Santoso", "Wijaya", "Lestari"), ("Jakarta", "Bandung", "Surabaya", "Medan")

#: label and text of the sections in order; {} names a fact, and a condition on the key says which decisions have it.
WORDING = (
    ("kepala_putusan", "kepala_putusan", "putusan nomor {n} pid sus {year} pn cth demi keadilan berdasarkan ketuhanan", "n >= 0"),
    ("identitas", "identitas_terdakwa", "1 nama lengkap {name} 2 tempat lahir {place} 3 umur atau tanggal lahir 30 tahun", "n % 7 <> 3"),
    ("identitas", "identitas_terdakwa", "1 tanggal lahir tidak diketahui", "n % 7 = 3"),
    ("riwayat_penahanan", "riwayat_penahanan", "penyidik sejak tanggal 1 mei {year} sampai dengan tanggal 20 juni {year} 2 penuntut umum", "n >= 0"),
    ("riwayat_tuntutan", "riwayat_tuntutan", "menyatakan terdakwa {name} telah bersalah melakukan tindak pidana", "n % 3 <> 0 AND n % 6 <> 1"),
    ("riwayat_tuntutan", "riwayat_tuntutan", "menyatakan terdakwa umur 30 tahun telah bersalah", "n % 6 = 1"),
    ("riwayat_dakwaan", "riwayat_dakwaan", "bahwa ia terdakwa {name} pada hari itu tanpa hak atau melawan hukum menjual narkotika golongan satu bukan tanaman sebagaimana diatur", "n >= 0"),
    ("fakta", "fakta", "bahwa pada hari itu terdakwa {name} ditangkap di {place}", "n % 2 = 0"),
    ("pertimbangan_hukum", "pertimbangan_hukum", "menimbang bahwa pasal {article} undang undang nomor 35 tahun 2009 tentang narkotika unsur setiap orang memperhatikan pasal {article}", "n % 4 <> 1"),
    ("pertimbangan_hukum", "pertimbangan_hukum", "menimbang bahwa pasal {article} undang undang nomor 35 tahun 2009 tentang narkotika lalu pasal 112 ayat 2 dan pasal 112 ayat 2 memperhatikan pasal 197 ayat 1", "n % 4 = 1"),
    ("amar_putusan", "amar_putusan", "menyatakan terdakwa {name} telah terbukti bersalah 2 menjatuhkan pidana penjara selama {term} tahun 3 menetapkan barang bukti", "n % 8 <> 0"),
    ("amar_putusan", "amar_putusan", "membebaskan terdakwa {name} dari seluruh dakwaan", "n % 8 = 0"),
)


def _pick(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, values)), (index + 1).cast("int"))


def _filled(wording: str) -> Column:
    """A wording with its facts put in."""
    out = F.lit(wording)
    for fact in ("n", "year", "name", "place", "article", "term"):
        if "{" + fact + "}" in wording:
            out = F.replace(out, F.lit("{" + fact + "}"), F.col(fact).cast("string"))
    return out


def decision_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("n")
    # each key becomes a whole decision
    rows = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("n")), "n")
    name = F.concat_ws(" ", _pick(FIRST, n % 5), _pick(LAST, n % 3))
    return rows.select("n", name.alias("name"), _pick(PLACES, n % 4).alias("place"), F.concat(F.lit(""), (111 + n % 5).cast("string"), F.lit(" ayat "), (1 + n % 2).cast("string")).alias("article"), (2010 + n % 10).alias("year"), (1 + n % 12).alias("term"))


def decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """source_path and xml of every decision."""
    parts = [F.when(F.expr(condition), F.concat(F.lit(f"<{tag}>\n  "), _filled(wording), F.lit(f" </{tag}>"))).otherwise("") for tag, _, wording, condition in WORDING]
    head = F.concat(F.lit('<putusan id="'), F.col("n").cast("string"), F.lit('" klasifikasi="pidana" sub_klasifikasi="'), F.when(F.col("n") % 5 == 0, "umum").otherwise("narkotika"), F.lit('" lembaga_peradilan="PN '), F.col("place"), F.lit('" provinsi="'), F.col("place"), F.lit('" url="'), F.when(F.col("n") % 9 == 0, "").otherwise("https://x.example"), F.lit('">'))
    return decision_facts(spark, sf_dir).select(F.concat(F.lit("a/"), F.col("n").cast("string"), F.lit(".xml")).alias("source_path"), F.concat(head, *parts, F.lit("</putusan>")).alias("xml"))


def decision_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of all decisions, stored: each file is parsed once."""
    return stored(files.decision_sections(decisions(spark, sf_dir)), "sections")


def decision_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sections of each decision in one row, for queries that read them once."""
    return files.decision_parts(decisions(spark, sf_dir))


def _texts(own: DataFrame) -> DataFrame:
    """The whole texts that sections make up."""
    return own.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_position", "section_text"))), lambda s: s["section_text"]), "").alias("text"))


def _sql_pick(values: tuple[str, ...], index: str) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + f"][{index} + 1]"


def _sql_filled(wording: str) -> str:
    out = f"'{wording}'"
    for fact in ("n", "year", "name", "place", "article", "term"):
        if "{" + fact + "}" in wording:
            out = f"replace({out}, '{{{fact}}}', CAST({fact} AS VARCHAR))"
    return out


def sql_head(text: str, most: int) -> str:
    """The SQL of head_at_word on squeezed text."""
    cut = f"regexp_extract(substring({text}, 1, {most + 1}), '(?s)^(.*) ', 1)"
    return f"CASE WHEN length({text}) <= {most} THEN {text} WHEN {cut} = '' THEN rtrim(substring({text}, 1, {most})) ELSE rtrim({cut}, ' ,;:-') END"


SQL_FACTS = f"""
fa AS (SELECT c_custkey AS n, CAST(c_custkey AS VARCHAR) AS doc, {_sql_pick(FIRST, "c_custkey % 5")} || ' ' || {_sql_pick(LAST, "c_custkey % 3")} AS name, {_sql_pick(PLACES, "c_custkey % 4")} AS place,
  (111 + c_custkey % 5) || ' ayat ' || (1 + c_custkey % 2) AS article, 2010 + c_custkey % 10 AS year, 1 + c_custkey % 12 AS term FROM customer),
sr AS ({" UNION ALL ".join(f"SELECT n, doc, {i} AS i, '{tag}' AS tag, '{label}' AS label, {_sql_filled(wording)} AS t FROM fa WHERE {condition}" for i, (tag, label, wording, condition) in enumerate(WORDING))}),
sk AS (SELECT *, t || CASE WHEN i = max(i) OVER (PARTITION BY n) THEN '' ELSE e'\\n\\n' END AS x FROM sr),
sec AS (SELECT n, doc AS document_id, i, tag, label AS section_label, t, x AS section_text, CAST(coalesce(sum(length(x)) OVER w, 0) AS BIGINT) AS start_position, CAST(coalesce(sum(length(x)) OVER w, 0) + length(x) AS BIGINT) AS end_position FROM sk WINDOW w AS (PARTITION BY n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
dd AS (SELECT n, document_id, string_agg(section_text, '' ORDER BY i) AS text FROM sec GROUP BY 1, 2),
co AS (SELECT *, n || ' pid sus ' || year || ' pn cth' AS case_, 'pasal ' || CASE WHEN n % 4 = 1 THEN '112 ayat 2' ELSE article END AS statute,
  CASE WHEN n % 8 = 0 THEN 'membebaskan terdakwa ' || name || ' dari seluruh dakwaan' ELSE 'menjatuhkan pidana penjara selama ' || term || ' tahun 3 menetapkan barang bukti' END AS disposition,
  'tanpa hak atau melawan hukum menjual narkotika golongan satu bukan tanaman' AS charge FROM fa)"""


def decision_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of all decisions, and whether each is a candidate for a held-out set."""
    rows = files.decision_metadata(decisions(spark, sf_dir))
    wanted = lambda lengths=None: F.coalesce(relational.holdout_candidate(["PN Medan"], classification="Pidana", subclassification="narkotika", lengths=lengths), F.lit(False))
    # candidates need text in every section that the layout has; these decisions never have all
    some = F.map_filter("section_lengths", lambda k, v: k.isin("identitas", "riwayat_dakwaan", "riwayat_tuntutan"))
    total = F.aggregate(F.map_values("section_lengths"), F.lit(0).cast("bigint"), lambda s, x: s + x)
    return rows.select("source_path", "source_id", "classification", "subclassification", "court", "province", "case_number_normalized", F.col("case_year").cast("bigint").alias("case_year"), total.alias("chars"), wanted(some).alias("candidate"), wanted().alias("strict"))


register("decision_metadata", decision_metadata, f"""WITH {SQL_FACTS}, le AS (SELECT n, sum(length(t)) AS chars FROM sr GROUP BY 1)
SELECT 'a/' || n || '.xml' AS source_path, doc AS source_id, 'pidana' AS classification, CASE WHEN n % 5 = 0 THEN 'umum' ELSE 'narkotika' END AS subclassification, 'PN ' || place AS court, place AS province, n || ' pid sus ' || year || ' pn cth' AS case_number_normalized,
CAST(CASE WHEN n BETWEEN 1900 AND 2099 THEN n ELSE year END AS BIGINT) AS case_year, CAST(chars AS BIGINT) AS chars, n % 5 <> 0 AND place <> 'Medan' AND n % 9 <> 0 AND (n % 3 <> 0 OR n % 6 = 1) AS candidate, false AS strict FROM fa JOIN le USING (n)""")


def decision_section_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.decision_sections(decisions(spark, sf_dir)).select("document_id", "section_label", "start_position", "end_position", F.md5(F.col("section_text").cast("binary")).alias("text_md5"))


register("decision_sections", decision_section_offsets, f"WITH {SQL_FACTS} SELECT document_id, section_label, start_position, end_position, md5(section_text) AS text_md5 FROM sec")


def decision_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.components(decision_parts(spark, sf_dir)).drop("labels")


register("decision_components", decision_components, f"WITH {SQL_FACTS} SELECT doc AS document_id, case_ AS \"case\", name AS defendant, statute, 'narkotika' AS topic, disposition, {sql_head('(charge || ' + chr(39) + ' sebagaimana diatur' + chr(39) + ')', 80)} AS charge FROM co")


def decision_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.fingerprints(decision_parts(spark, sf_dir))


_FINGERPRINT = f"('perkara ' || case_ || '; terdakwa ' || name || '; ' || statute || '; perkara narkotika; ' || {sql_head('disposition', 70)})"
register("decision_fingerprints", decision_fingerprints, f"WITH {SQL_FACTS} SELECT doc AS document_id, {sql_head(_FINGERPRINT, 170)} AS summary FROM co")


def decision_contexts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The context of each document, and of each of its sections."""
    rows = extract.hierarchical_contexts(decision_sections(spark, sf_dir))
    # an inner explode is given a filter on its map's size, which would find all facts again
    return rows.select("document_id", "document_context", F.explode_outer("section_contexts").alias("section_label", "section_context")).where("section_label IS NOT NULL")


_OWN = "CASE section_label WHEN 'identitas_terdakwa' THEN '; identitas terdakwa ' || name WHEN 'riwayat_dakwaan' THEN '; dakwaan ' || (" + sql_head("(charge || ' sebagaimana diatur')", 80) + ") WHEN 'pertimbangan_hukum' THEN '; ketentuan pidana ' || statute WHEN 'amar_putusan' THEN '; ' || disposition WHEN 'riwayat_penahanan' THEN '; penahanan terdakwa ' || name ELSE '' END"
register("decision_contexts", decision_contexts, f"""WITH {SQL_FACTS}, j AS (SELECT co.doc AS document_id, section_label, 'perkara ' || case_ || '; terdakwa ' || name || '; perkara narkotika' AS d, 'bagian dokumen ' || replace(section_label, '_', ' ') || {_OWN} AS s FROM sec JOIN co USING (n))
SELECT document_id, {sql_head('d', 120)} AS document_context, section_label, {sql_head('s', 120)} AS section_context FROM j""")


def decision_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts that stand for a document: in brackets, and as a summariser's source."""
    own = decision_sections(spark, sf_dir)
    one = extract.representative_documents(own).select("document_id", F.lit("representative").alias("kind"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
    two = augment.document_sources(own).select("document_id", F.lit("summary_source").alias("kind"), F.md5(F.col("text").cast("binary")).alias("text_md5"))
    return one.unionByName(two)


register("decision_sources", decision_sources, f"""WITH {SQL_FACTS}, o AS (SELECT * FROM (VALUES ('kepala_putusan', 1), ('identitas_terdakwa', 2), ('riwayat_dakwaan', 3), ('fakta_hukum', 4), ('pertimbangan_hukum', 5), ('amar_putusan', 6)) v(section_label, p))
SELECT document_id, 'representative' AS kind, md5(string_agg('[' || replace(section_label, '_', ' ') || '] ' || t, e'\\n' ORDER BY p)) AS text_md5 FROM sec JOIN o USING (section_label) GROUP BY 1
UNION ALL SELECT document_id, 'summary_source', md5(string_agg('[bagian ' || replace(section_label, '_', ' ') || '] ' || t, ' ' ORDER BY p)) FROM sec JOIN o USING (section_label) GROUP BY 1""")

_SQL_EVIDENCE = """,
ev AS (SELECT n, 'birthplace' AS family, 'identitas_terdakwa' AS label, place AS e FROM co WHERE n % 7 <> 3
  UNION ALL SELECT n, 'detention', 'riwayat_penahanan', 'penyidik sejak tanggal 1 mei ' || year || ' sampai dengan tanggal 20 juni' FROM co
  UNION ALL SELECT n, 'charge', 'riwayat_dakwaan', charge FROM co
  UNION ALL SELECT n, 'statute', 'pertimbangan_hukum', 'pasal ' || article || ' undang undang nomor 35 tahun 2009 tentang narkotika' FROM co
  UNION ALL SELECT n, 'disposition', 'amar_putusan', replace(disposition, ' 3 menetapkan barang bukti', '') FROM co),
pl AS (SELECT n, row_number() OVER (ORDER BY doc) AS place_ FROM fa),
fm AS (SELECT * FROM (VALUES ('birthplace', 'Di mana {name} dilahirkan?', 'easy', 1), ('detention', 'Bagaimana riwayat awal penahanan {name}?', 'easy', 1), ('charge', 'Perbuatan apa yang didakwakan kepada {name}?', 'medium', 2), ('statute', 'Ketentuan pidana apa yang dipertimbangkan dalam perkara {name}?', 'hard', 3), ('disposition', 'Apa isi amar putusan dalam perkara {name}?', 'easy', 4)) v(family, question, difficulty, slot)),
qu AS (SELECT ev.n, ev.family, sec.document_id, replace(question, '{name}', name) AS question, difficulty, slot, place_, e, label, sec.start_position + position(e IN section_text) - 1 AS a, sec.start_position + position(e IN section_text) - 1 + length(e) AS z, contains(lower(section_text), lower(name)) AS named
  FROM ev JOIN sec ON sec.n = ev.n AND sec.section_label = ev.label JOIN co ON co.n = ev.n JOIN pl ON pl.n = ev.n JOIN fm USING (family))"""


def decision_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = questions.questions_v2(stored(decision_parts(spark, sf_dir), "sections"), "dev")[0]
    return out.select("query_id", "document_id", "question", "reference_answer", "evidence_start", "evidence_end", "difficulty", "target_section_label", "query_anchor_scope", "quality_flags")


register("decision_questions", decision_questions, f"""WITH {SQL_FACTS}{_SQL_EVIDENCE}
SELECT 'dev-' || CASE WHEN place_ < 1000 THEN lpad(CAST(place_ AS VARCHAR), 3, '0') ELSE CAST(place_ AS VARCHAR) END || '-' || family AS query_id, document_id, question, e AS reference_answer, a AS evidence_start, z AS evidence_end, difficulty, label AS target_section_label, CASE WHEN named THEN 'target_section' ELSE 'external_identity' END AS query_anchor_scope, CASE WHEN named THEN '' ELSE 'query_name_not_in_evidence_section' END AS quality_flags FROM qu""")


def decision_question_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.questions_v2(stored(decision_parts(spark, sf_dir), "sections"), "dev")[1]


register("decision_question_failures", decision_question_failures, f"WITH {SQL_FACTS} SELECT doc AS document_id, 'birthplace' AS question_type FROM fa WHERE n % 7 = 3")


def decision_questions_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = questions.questions_v1(stored(decision_parts(spark, sf_dir), "sections"), "q")[0]
    return out.select("query_id", "document_id", "question", "reference_answer", "evidence_start", "evidence_end", "review_status")


register("decision_questions_v1", decision_questions_v1, f"""WITH {SQL_FACTS}{_SQL_EVIDENCE}
SELECT 'q-' || CASE WHEN place_ < 1000 THEN lpad(CAST(place_ AS VARCHAR), 3, '0') ELSE CAST(place_ AS VARCHAR) END || '-' || slot AS query_id, document_id, question, e AS reference_answer, a AS evidence_start, z AS evidence_end, 'approved' AS review_status FROM qu WHERE family <> 'detention' OR n % 7 = 3""")


def decision_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.question_slots(decision_parts(spark, sf_dir))


register("decision_slots", decision_slots, f"""WITH {SQL_FACTS}, pl AS (SELECT n, doc, row_number() OVER (ORDER BY doc) AS p FROM fa),
sl AS (SELECT n, doc, p, unnest([CASE WHEN p % 2 = 1 THEN 'identitas_terdakwa' ELSE 'riwayat_penahanan' END, 'fakta', 'pertimbangan_hukum', 'amar_putusan']) AS label, unnest([1, 2, 3, 4]) AS k FROM pl)
SELECT 'q-' || CASE WHEN p < 1000 THEN lpad(CAST(p AS VARCHAR), 3, '0') ELSE CAST(p AS VARCHAR) END || '-' || k AS query_id, doc AS document_id, label AS target_section_label, label <> 'fakta' OR n % 2 = 0 AS found FROM sl""")


def _layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections in the punctuated layout, one after the other."""
    texts = (
        ("identitas_terdakwa", "1. Nama lengkap : {name}; 2. Tempat lahir : {place}; 3. Umur/Tanggal lahir : 30 tahun;"), ("riwayat_penahanan", "Terdakwa ditahan oleh: 1. Penyidik sejak tanggal 1 Mei {year} sampai dengan tanggal 20 Juni {year};"),
        ("fakta", "Bahwa Terdakwa {name} tanpa hak menjual Narkotika Golongan I bukan tanaman di {place}, perbuatan mana diatur;"),
        ("pertimbangan_hukum", "bahwa Majelis akan memilih langsung dakwaan sebagaimana diatur dalam Pasal {article} Undang-Undang Nomor 35 Tahun 2009 tentang Narkotika yang unsurnya; Memperhatikan, Pasal 9 tentang Narkotika;"),
        ("amar_putusan", "1. Menyatakan Terdakwa bersalah; 2. Menjatuhkan pidana penjara selama {term} tahun; 3. Menetapkan;"),
    )
    parts = F.array(*[F.struct(F.lit(g).alias("g"), _filled(t).alias("t")) for g, t in texts])
    rows = decision_facts(spark, sf_dir).select("n", F.posexplode(parts).alias("i", "s"))
    return rows.select(F.col("n").alias("document_id"), F.col("s.g").alias("section_label"), (F.col("i") * 1000).cast("bigint").alias("start_position"), F.col("s.t").alias("section_text"))


def decision_layout_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = _layout(spark, sf_dir)
    slots = own.select(F.concat_ws("-", F.col("document_id").cast("string"), "section_label").alias("query_id"), "document_id", F.col("section_label").alias("target_section_label"))
    return questions.layout_drafts(slots, own).select("query_id", "question", "reference_answer", "evidence_start", "evidence_end", "difficulty")


register("decision_layout_drafts", decision_layout_drafts, f"""WITH {SQL_FACTS}, x AS (
SELECT n, 'identitas_terdakwa' AS g, 0 AS b, '1. Nama lengkap : ' || name || '; 2. ' AS pre, 'Tempat lahir : ' || place AS e, place AS a, 'Di mana ' || name || ' dilahirkan?' AS q, 'easy' AS d FROM fa
UNION ALL SELECT n, 'riwayat_penahanan', 1000, 'Terdakwa ditahan oleh: ', '1. Penyidik sejak tanggal 1 Mei ' || year || ' sampai dengan tanggal 20 Juni ' || year || ';', 'Penyidik sejak tanggal 1 Mei ' || year || ' sampai dengan tanggal 20 Juni ' || year, 'Kapan masa penahanan pada tingkat penyidikan untuk perkara ' || name || ' dimulai dan berakhir?', 'easy' FROM fa
UNION ALL SELECT n, 'fakta', 2000, 'Bahwa Terdakwa ' || name || ' ', 'tanpa hak menjual Narkotika Golongan I bukan tanaman di ' || place, 'tanpa hak menjual Narkotika Golongan I bukan tanaman di ' || place, 'Perbuatan apa yang disebut dalam uraian dakwaan awal terhadap ' || name || '?', 'medium' FROM fa
UNION ALL SELECT n, 'pertimbangan_hukum', 3000, 'bahwa Majelis akan memilih langsung dakwaan sebagaimana diatur dalam ', 'Pasal ' || article || ' Undang-Undang Nomor 35 Tahun 2009 tentang Narkotika', 'Pasal ' || article || ' Undang-Undang Nomor 35 Tahun 2009 tentang Narkotika', 'Ketentuan pidana apa yang menjadi dasar pertimbangan Majelis Hakim dalam perkara ' || name || '?', 'hard' FROM fa
UNION ALL SELECT n, 'amar_putusan', 4000, '1. Menyatakan Terdakwa bersalah; ', '2. Menjatuhkan pidana penjara selama ' || term || ' tahun', 'Menjatuhkan pidana penjara selama ' || term || ' tahun', 'Pidana apa yang dijatuhkan kepada ' || name || '?', 'easy' FROM fa)
SELECT n || '-' || g AS query_id, q AS question, a AS reference_answer, CAST(b + length(pre) AS BIGINT) AS evidence_start, CAST(b + length(pre) + length(e) AS BIGINT) AS evidence_end, d AS difficulty FROM x""")

#: Lines of a decision with headings; a condition on the key says which decisions have them.
LINES = (
    (None, "kop surat {n}", "n % 2 = 0"), ("kepala_putusan", "PUTUSAN", "n >= 0"), (None, "Nomor {n}", "n >= 0"), ("identitas_terdakwa", "1. Nama lengkap : {name}", "n % 5 <> 1"), ("riwayat_penahanan", "Terdakwa ditahan sejak {year}", "n % 7 <> 2"),
    ("fakta", "Menimbang, bahwa Terdakwa diajukan ke persidangan dengan dakwaan", "n >= 0"), (None, "isi fakta {place}", "n >= 0"), ("pertimbangan_hukum", "PERTIMBANGAN HUKUM", "n % 3 <> 0"), (None, "alasan {article}", "n >= 0"),
    ("amar_putusan", "M E N G A D I L I", "n % 11 <> 4"), (None, "menghukum {name}", "n >= 0"), ("penutup", "Demikian diputuskan", "n % 11 <> 4 AND n % 4 <> 1"), (None, "panitera", "n >= 0"),
)


def decision_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """document_id and text of decisions whose sections are told by their headings."""
    return decision_facts(spark, sf_dir).select(F.col("n").alias("document_id"), F.concat(*[F.when(F.expr(c), F.concat(_filled(t), F.lit("\n"))).otherwise("") for _, t, c in LINES]).alias("text"))


def section_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.detect(decision_texts(spark, sf_dir)).select("document_id", "section_label", "section_heading", "start_position", "end_position", F.md5(F.col("section_text").cast("binary")).alias("text_md5"))


SQL_LINES = f"""
ln AS ({" UNION ALL ".join(f"SELECT n, {i} AS i, {chr(39) + label + chr(39) if label else 'NULL'} AS label, {_sql_filled(t)} || e'\\n' AS t FROM fa WHERE {c}" for i, (label, t, c) in enumerate(LINES))}),
st AS (SELECT *, CAST(coalesce(sum(length(t)) OVER (PARTITION BY n ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS s, count(label) OVER (PARTITION BY n ORDER BY i) AS g FROM ln),
det AS (SELECT n AS document_id, coalesce(max(label), 'unknown') AS section_label, trim(max(t) FILTER (label IS NOT NULL), e' \\n') AS section_heading, min(s) AS start_position, CAST(max(s + length(t)) AS BIGINT) AS end_position, string_agg(t, '' ORDER BY i) AS section_text FROM st GROUP BY n, g),
doc AS (SELECT n AS document_id, string_agg(t, '' ORDER BY i) AS text FROM ln GROUP BY 1)"""
register("section_cascade", section_cascade, f"WITH {SQL_FACTS},{SQL_LINES} SELECT document_id, section_label, section_heading, start_position, end_position, md5(section_text) AS text_md5 FROM det")


def section_compliance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nine checks on three strata of each decision; some lack a stratum, an order, a trigger or a chunk."""
    facts_ = decision_facts(spark, sf_dir)
    n = F.col("n")
    text = F.concat(_filled("fakta {name} di {place}\n"), F.lit("MENIMBANG alasan\n"), _filled("MENGADILI\n"))
    rows = facts_.withColumn("text", text).withColumn("a", F.length(_filled("fakta {name} di {place}\n"))).withColumn("b", F.col("a") + 17)
    cuts = F.array(F.struct(F.lit("fakta").alias("g"), F.lit(None).cast("string").alias("h"), F.lit(0).alias("s"), F.col("a").alias("e")), F.struct(F.when(n % 5 == 1, "fakta").otherwise("pertimbangan_hukum").alias("g"), F.when(n % 7 == 2, "alasan").otherwise("MENIMBANG").alias("h"), F.col("a").alias("s"), F.col("b").alias("e")), F.struct(F.lit("amar_putusan").alias("g"), F.lit("MENGADILI").alias("h"), F.when(n % 6 == 3, F.col("b") + 1).otherwise(F.col("b")).alias("s"), F.length("text").alias("e")))
    own = rows.select(n.alias("document_id"), "text", F.explode(cuts).alias("c")).select("document_id", F.col("c.g").alias("section_label"), F.col("c.h").alias("section_heading"), F.col("c.s").cast("bigint").alias("start_position"), F.col("c.e").cast("bigint").alias("end_position"), F.substring("text", F.col("c.s") + 1, F.col("c.e") - F.col("c.s")).alias("section_text"))
    # chunks are the sections without their last line end; some end in the next section, or are left out
    late = (F.col("document_id") % 8 == 5) & (F.col("section_label") == "fakta")
    cut = own.where("NOT (document_id % 9 = 4 AND section_label = 'amar_putusan')").withColumn("_e", F.when(late, F.col("end_position") + 3).otherwise(F.col("end_position") - 1))
    docs = rows.select(n.alias("document_id"), "text")
    chunks = cut.join(docs, "document_id").select(F.concat_ws("-", F.col("document_id").cast("string"), F.col("start_position").cast("string")).alias("chunk_id"), "document_id", "start_position", F.col("_e").alias("end_position"), F.expr("substring(text, cast(start_position + 1 as int), cast(_e - start_position as int))").alias("text"))
    return sections.compliance(docs, own, chunks, tail=0.5)


register("section_compliance", section_compliance, f"""WITH {SQL_FACTS}, x AS (SELECT n, length('fakta ' || name || ' di ' || place) + 1 AS a, n % 5 <> 1 AS three FROM fa), y AS (SELECT *, a + 17 AS b, a + 27 AS size FROM x)
SELECT n AS document_id, n % 6 <> 3 AS full_section_coverage, three AS three_rhetorical_strata, three AS ordered_rhetorical_strata, three AND (b + CASE WHEN n % 6 = 3 THEN 1 ELSE 0 END) >= floor(size * 0.5) AS conclusion_in_final_window, three AND n % 7 <> 2 AS high_precision_analysis_trigger, three AS high_precision_conclusion_trigger,
n % 8 <> 5 AS chunks_within_sections, n % 9 <> 4 AND n % 8 <> 5 AND n % 6 <> 3 AS chunk_text_covered, true AS intra_section_overlap FROM y""")


def _review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The annotation template, filled in by the keys of decisions; some entries contradict themselves."""
    docs = decision_texts(spark, sf_dir)
    rows = sections.annotation_template(docs, sections.detect(docs))
    odd = F.col("document_id") % 13
    gold = F.when((F.col("detected") == "yes") & (odd == 1), "no").when((F.col("detected") == "no") & (odd == 2), "yes").otherwise(F.col("detected"))
    rows = rows.withColumn("gold_present", gold)
    seen, there = F.col("detected") == "yes", F.col("gold_present") == "yes"
    status = F.when(odd == 5, "pending").when(odd == 6, "exact").when(seen & there, F.when(odd % 2 == 0, "exact").otherwise("near")).when(seen, "false_positive").when(there, "missed").otherwise("not_applicable")
    return rows.withColumn("review_status", status)


_SQL_REVIEW = """,
lb AS (SELECT unnest(['kepala_putusan', 'identitas_terdakwa', 'riwayat_penahanan', 'fakta', 'pertimbangan_hukum', 'amar_putusan', 'penutup']) AS section_label),
tp AS (SELECT fa.n AS document_id, lb.section_label, CASE WHEN det.document_id IS NULL THEN 'no' ELSE 'yes' END AS detected, det.section_heading AS detected_heading, det.start_position AS detected_start_position, len(regexp_extract_all(det.section_text, '\\S+')) AS detected_word_count FROM fa CROSS JOIN lb LEFT JOIN det ON det.document_id = fa.n AND det.section_label = lb.section_label),
rv AS (SELECT *, CASE WHEN detected = 'yes' AND document_id % 13 = 1 THEN 'no' WHEN detected = 'no' AND document_id % 13 = 2 THEN 'yes' ELSE detected END AS gold FROM tp),
re AS (SELECT *, CASE WHEN document_id % 13 = 5 THEN 'pending' WHEN document_id % 13 = 6 THEN 'exact' WHEN detected = 'yes' AND gold = 'yes' THEN CASE WHEN document_id % 13 % 2 = 0 THEN 'exact' ELSE 'near' END WHEN detected = 'yes' THEN 'false_positive' WHEN gold = 'yes' THEN 'missed' ELSE 'not_applicable' END AS status FROM rv)"""


def annotation_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = decision_texts(spark, sf_dir)
    out = sections.annotation_template(docs, sections.detect(docs))
    return out.select("document_id", "section_label", "detected", "detected_heading", "detected_start_position", F.col("detected_word_count").cast("bigint").alias("detected_word_count"))


register("annotation_template", annotation_template, f"WITH {SQL_FACTS},{SQL_LINES}{_SQL_REVIEW} SELECT document_id, section_label, detected, detected_heading, detected_start_position, CAST(detected_word_count AS BIGINT) AS detected_word_count FROM tp")


def review_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.review_scores(_review(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("exact_precision", "exact_recall", "tolerant_precision", "tolerant_recall")})


_share = lambda a, b: f"CASE WHEN {b} > 0 THEN round({a} / {b}, 6) END"
register("review_scores", review_scores, f"""WITH {SQL_FACTS},{SQL_LINES}{_SQL_REVIEW}, c AS (SELECT section_label, count(*) AS reviewed, count(*) FILTER (gold = 'yes') AS gold_positive, count(*) FILTER (detected = 'yes') AS predicted_positive, {", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in sections.REVIEW_STATUSES)} FROM re WHERE status <> 'pending' GROUP BY 1)
SELECT *, {_share("exact", "predicted_positive")} AS exact_precision, {_share("exact", "gold_positive")} AS exact_recall, {_share("(exact + near)", "predicted_positive")} AS tolerant_precision, {_share("(exact + near)", "gold_positive")} AS tolerant_recall FROM c""")


def review_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.review_violations(_review(spark, sf_dir))


register("review_violations", review_violations, f"""WITH {SQL_FACTS},{SQL_LINES}{_SQL_REVIEW}
SELECT document_id, section_label, 'status needs gold_present yes' AS problem FROM re WHERE status = 'exact' AND gold <> 'yes' UNION ALL SELECT document_id, section_label, 'status needs detected yes' FROM re WHERE status = 'exact' AND detected <> 'yes'""")


def _asked(spark: SparkSession, sf_dir: str, own: DataFrame) -> DataFrame:
    """Questions on the cited article of each decision, some with faults that follow from the key."""
    first = F.concat(F.lit("menimbang bahwa "), F.lit("pasal "), F.col("article"))
    base = own.where("section_label = 'pertimbangan_hukum'").select(F.col("document_id").cast("bigint").alias("n"), "start_position")
    rows = decision_facts(spark, sf_dir).join(base, "n")
    n = F.col("n")
    start = F.col("start_position") + 16
    return rows.select(
        F.when(n % 17 == 3, F.concat(F.lit("twice-"), F.floor(n / 17).cast("string"))).otherwise(F.concat(F.lit("q-"), n.cast("string"))).alias("query_id"), F.when(n % 19 == 2, F.lit("none")).otherwise(n.cast("string")).alias("document_id"), F.when(n % 23 == 1, "  ").otherwise(F.concat(F.lit("Pasal apa bagi "), F.col("name"), F.lit("?"))).alias("question"),
        F.when(n % 29 == 4, "Umur").when(n % 29 == 5, "x").otherwise(F.concat(F.lit("pasal "), F.col("article"))).alias("reference_answer"), start.alias("evidence_start"), F.when(n % 31 == 6, start).otherwise(start + F.length(first) - 16).cast("bigint").alias("evidence_end"), F.concat(F.lit("PASAL "), F.col("article")).alias("evidence_text"),
        F.when(n % 7 == 5, "amar_putusan").otherwise("pertimbangan_hukum").alias("target_section_label"), F.when(n % 37 == 8, "maybe").when(n % 2 == 0, "approved").otherwise("draft").alias("review_status"), F.when(n % 41 == 9, "odd").otherwise("easy").alias("difficulty"), n.alias("n"),
    )


_SQL_ASKED = """,
qq AS (SELECT fa.n, CASE WHEN fa.n % 17 = 3 THEN 'twice-' || CAST(floor(fa.n / 17) AS BIGINT) ELSE 'q-' || fa.n END AS query_id, CASE WHEN fa.n % 19 = 2 THEN 'none' ELSE doc END AS document_id, fa.n % 19 = 2 AS lost, fa.n % 31 = 6 AS bare, 'pasal ' || article AS needle, start_position + 16 AS a, start_position + 16 + CASE WHEN fa.n % 31 = 6 THEN 0 ELSE length('pasal ' || article) END AS z,
  CASE WHEN fa.n % 29 = 4 THEN 'Umur' WHEN fa.n % 29 = 5 THEN 'x' ELSE 'pasal ' || article END AS answer, fa.n % 7 = 5 AS elsewhere FROM fa JOIN sec ON sec.n = fa.n AND section_label = 'pertimbangan_hukum'),
qn AS (SELECT query_id, count(*) AS k FROM qq GROUP BY 1),
qx AS (SELECT qq.*, k FROM qq JOIN qn USING (query_id))"""


def question_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = decision_sections(spark, sf_dir)
    asked = _asked(spark, sf_dir, own)
    # a number that two decisions share makes a repeated id
    asked = asked.withColumn("query_id", F.when(F.col("n") % 17 == 3, F.concat(F.lit("twice-"), F.floor(F.col("n") / 34).cast("string"))).otherwise(F.col("query_id")))
    return groundtruth.question_violations(asked, _texts(own))


register("question_violations", question_violations, f"""WITH {SQL_FACTS}{_SQL_ASKED.replace("floor(fa.n / 17)", "floor(fa.n / 34)")}
{" UNION ALL ".join(f"SELECT query_id, '{p}' AS problem FROM qx WHERE {c}" for p, c in (("duplicate_query_id", "k > 1"), ("unknown_document", "lost"), ("invalid_status", "n % 37 = 8"), ("invalid_difficulty", "n % 41 = 9"), ("blank_question", "n % 23 = 1"), ("invalid_span", "bare AND NOT lost")))}""")


def question_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = decision_sections(spark, sf_dir)
    out = groundtruth.question_audit(_asked(spark, sf_dir, own), _texts(own), own)
    return out.select("query_id", F.array_join("automatic_flags", "|").alias("flags"), "automatic_status")


_SQL_FLAGS = """,
fl AS (SELECT query_id, array_to_string(list_filter([CASE WHEN k > 1 THEN 'duplicate_query_id' END, CASE WHEN lost THEN 'unknown_document' END, CASE WHEN NOT lost AND bare THEN 'invalid_evidence_offsets' END, CASE WHEN NOT lost AND NOT bare AND answer <> needle THEN 'answer_span_mismatch' END,
  CASE WHEN NOT lost AND NOT bare AND elsewhere THEN 'target_section_mismatch' END, CASE WHEN answer = 'x' THEN 'implausibly_short_answer' END, CASE WHEN answer = 'Umur' THEN 'field_label_as_answer' END], lambda x: x IS NOT NULL), '|') AS flags FROM qx)"""
register("question_audit", question_audit, f"WITH {SQL_FACTS}{_SQL_ASKED}{_SQL_FLAGS} SELECT query_id, flags, CASE WHEN flags = '' THEN 'include_exploratory_only' ELSE 'exclude_pending_human_review' END AS automatic_status FROM fl")


def question_audit_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = decision_sections(spark, sf_dir)
    return groundtruth.audit_histogram(groundtruth.question_audit(_asked(spark, sf_dir, own), _texts(own), own))


register("question_audit_histogram", question_audit_histogram, f"WITH {SQL_FACTS}{_SQL_ASKED}{_SQL_FLAGS} SELECT flag, count(*) AS count FROM (SELECT unnest(CASE WHEN flags = '' THEN ['none'] ELSE string_split(flags, '|') END) AS flag FROM fl) GROUP BY 1")


def unapproved_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.unapproved(_asked(spark, sf_dir, decision_sections(spark, sf_dir))).select("query_id", "review_status")


register("unapproved_questions", unapproved_questions, f"WITH {SQL_FACTS}{_SQL_ASKED} SELECT query_id, CASE WHEN n % 37 = 8 THEN 'maybe' ELSE 'draft' END AS review_status FROM qx WHERE n % 37 = 8 OR n % 2 <> 0")


def positive_qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of 12 words that hold the cited article, or another mention of it in the reasoning."""
    own = decision_sections(spark, sf_dir)
    chunks = stored(chunking.fixed_chunks(_texts(own), 12, 4), "chunks")
    asked = _asked(spark, sf_dir, own).where("n % 31 <> 6").drop("review_status")
    return groundtruth.positive_qrels(asked, chunks, own).select("query_id", "document_id", "chunk_id")


def uncovered_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions whose document is unknown meet no chunk; nor do those not approved."""
    own = decision_sections(spark, sf_dir)
    chunks = chunking.fixed_chunks(_texts(own), 12, 4)
    asked = _asked(spark, sf_dir, own)
    return groundtruth.uncovered(asked, groundtruth.qrel_candidates(asked, chunks)).select("query_id")


SQL_WINDOWS = r"""
wp AS (SELECT document_id, i, piece, sum(length(piece)) OVER (PARTITION BY document_id ORDER BY i) AS en FROM (SELECT document_id, unnest(regexp_extract_all(text, '\s*\S+')) AS piece, unnest(range(1, len(regexp_extract_all(text, '\s*\S+')) + 1)) AS i FROM {docs})),
wb AS (SELECT document_id, i, CAST(en - length(regexp_extract(piece, '\S+')) AS BIGINT) AS st, CAST(en AS BIGINT) AS en FROM wp),
wn AS (SELECT document_id, max(i) AS c FROM wp GROUP BY 1),
wi AS (SELECT document_id, c, unnest(range(0, CASE WHEN c <= {w} THEN 1 ELSE CAST(ceil((c - {w}) / ({w} - {o} + 0.0)) AS BIGINT) + 1 END)) AS j FROM wn),
ch AS (SELECT wi.document_id, wi.j AS chunk_index, a.st AS start_position, b.en AS end_position, wi.document_id || '-fixed-' || substr(sha1('fixed|' || wi.document_id || '|' || wi.j || '|' || a.st || '|' || b.en), 1, 12) AS chunk_id FROM wi
  JOIN wb a ON a.document_id = wi.document_id AND a.i = wi.j * ({w} - {o}) + 1 JOIN wb b ON b.document_id = wi.document_id AND b.i = least(wi.j * ({w} - {o}) + {w}, wi.c))"""
_SQL_12 = SQL_WINDOWS.replace("{docs}", "dd").replace("{w}", "12").replace("{o}", "4")
register("positive_qrels", positive_qrels, f"""WITH {SQL_FACTS}{_SQL_ASKED},{_SQL_12},
mt AS (SELECT query_id, document_id, a AS s, z AS e FROM qx WHERE NOT bare AND NOT lost
  UNION ALL SELECT query_id, qx.document_id, start_position + o, start_position + o + length(needle) FROM qx JOIN sec ON sec.n = qx.n AND section_label = 'pertimbangan_hukum' CROSS JOIN LATERAL (SELECT unnest(range(0, length(section_text))) AS o) WHERE NOT bare AND NOT lost AND NOT elsewhere AND substring(section_text, o + 1, length(needle)) = needle)
SELECT DISTINCT query_id, mt.document_id, chunk_id FROM mt JOIN ch ON ch.document_id = mt.document_id AND ch.start_position <= s AND e <= ch.end_position""")
register("uncovered_questions", uncovered_questions, f"WITH {SQL_FACTS}{_SQL_ASKED} SELECT query_id FROM qx WHERE lost OR n % 37 = 8 OR n % 2 <> 0")


def contextual_structure_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The text to embed of each section's chunk, in every mode of context."""
    own = decision_sections(spark, sf_dir)
    base = own.select("document_id", "section_label", "section_heading", F.col("section_text").alias("text"), "start_position")
    out = None
    for mode in ("none", "section", "section_document", "section_reasoning_document"):
        made = chunking.with_context(base, own, mode).select("document_id", "section_label", F.lit(mode).alias("mode"), F.md5(F.col("embedding_text").cast("binary")).alias("text_md5"))
        out = made if out is None else out.unionByName(made)
    return out


register("contextual_structure_chunks", contextual_structure_chunks, f"""WITH {SQL_FACTS}, md AS (SELECT unnest(['none', 'section', 'section_document', 'section_reasoning_document']) AS mode),
x AS (SELECT document_id, section_label, mode, 'bagian dokumen: ' || replace(section_label, '_', ' ') || e'.\\n' || section_text AS s, CASE WHEN n % 7 <> 3 AND (mode = 'section_document' OR mode = 'section_reasoning_document' AND section_label = 'pertimbangan_hukum') THEN 'perkara terdakwa: ' || name || ' 2. ' ELSE '' END AS who FROM sec JOIN fa USING (n) CROSS JOIN md)
SELECT document_id, section_label, mode, CASE WHEN mode <> 'none' THEN md5(who || s) END AS text_md5 FROM x""")


def summary_augmented_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with their document's fingerprint, or with contexts of document and section, before the text."""
    own = decision_sections(spark, sf_dir)
    chunks = own.select("document_id", "section_label", F.col("section_text").alias("text"), "start_position", "end_position", F.row_number().over(_by_document()).alias("chunk_index"), F.lit("s").alias("strategy"), F.lit("x").alias("chunk_id"))
    one = augment.with_summaries(chunks, extract.fingerprints(own))
    two = augment.with_hierarchical_contexts(chunks, extract.hierarchical_contexts(own))
    return one.unionByName(two).select("document_id", "chunk_index", "strategy", F.md5(F.col("embedding_text").cast("binary")).alias("text_md5"))


def _by_document():
    from pyspark.sql import Window

    return Window.partitionBy("document_id").orderBy("start_position")


register("summary_augmented_chunks", summary_augmented_chunks, f"""WITH {SQL_FACTS}, x AS (SELECT document_id, row_number() OVER (PARTITION BY n ORDER BY sec.i) AS chunk_index, section_text, ({sql_head(_FINGERPRINT, 170)}) AS f, ('perkara ' || case_ || '; terdakwa ' || name || '; perkara narkotika') AS d, ('bagian dokumen ' || replace(section_label, '_', ' ') || {_OWN}) AS s FROM sec JOIN co USING (n)),
y AS (SELECT *, {sql_head('d', 120)} AS dc, {sql_head('s', 120)} AS sc FROM x)
SELECT document_id, chunk_index, 'summary_augmented' AS strategy, md5('ringkasan dokumen: ' || f || e'\\n\\n' || section_text) AS text_md5 FROM y UNION ALL SELECT document_id, chunk_index, 'hierarchical_summary_augmented', md5('konteks dokumen: ' || dc || e'\\nkonteks bagian: ' || sc || e'\\n\\n' || section_text) FROM y WHERE length(dc) + length(sc) <= 240""")


def section_summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all sections, their diagnostics, and a report by label with totals."""
    own = augment.section_summaries(decision_sections(spark, sf_dir), short=100)
    rows = augment.diagnostics(own.withColumn("source", F.col("section_text")), target=90, tolerance=10).withColumn("summary_type", F.lit("section"))
    out = augment.quality_report(rows)
    return out.select("summary_type", "section_label", "summaries", "flagged", F.round("mean_chars", 6).alias("mean_chars"), F.col("level").cast("bigint").alias("level"))


_SUMMARY = f"""sm AS (SELECT *, {sql_head('t', 100)} AS summary, CASE WHEN length(t) <= 100 THEN 'copied' ELSE 'extractive' END AS generation_status FROM sec)"""
register("section_summary_report", section_summary_report, f"""WITH {SQL_FACTS},{_SUMMARY}, z AS (SELECT section_label, length(summary) AS c, length(summary) < 30 OR length(summary) > 100 AS f FROM sm)
SELECT 'section' AS summary_type, section_label, count(*) AS summaries, count(*) FILTER (f) AS flagged, round(avg(c), 6) AS mean_chars, 0 AS level FROM z GROUP BY 2 UNION ALL SELECT 'section', NULL, count(*), count(*) FILTER (f), round(avg(c), 6), 1 FROM z UNION ALL SELECT NULL, NULL, count(*), count(*) FILTER (f), round(avg(c), 6), 3 FROM z""")


def section_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.section_summaries(decision_sections(spark, sf_dir), short=100).select("document_id", "section_label", "summary", "generation_status")


register("section_summaries", section_summaries, f"WITH {SQL_FACTS},{_SUMMARY} SELECT document_id, section_label, summary, generation_status FROM sm")


def review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return augment.review_sample(decision_sections(spark, sf_dir), "document_id", 3, stratum="section_label").select("document_id", "section_label")


register("review_sample", review_sample, f"WITH {SQL_FACTS} SELECT document_id, section_label FROM sec QUALIFY row_number() OVER (PARTITION BY section_label ORDER BY md5('42|' || document_id), document_id) <= 3")


def misplaced_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections that were moved or changed: by one character, or by a word."""
    own = decision_sections(spark, sf_dir)
    n = F.col("document_id").cast("bigint")
    moved = own.withColumn("start_position", F.when(n % 10 == 3, F.col("start_position") + 1).otherwise(F.col("start_position"))).withColumn("section_text", F.when((n % 10 == 6) & (F.col("section_label") == "amar_putusan"), F.concat("section_text", F.lit(" kata"))).otherwise(F.col("section_text")))
    return chunking.misplaced_sections(_texts(own), moved).select("document_id", "section_label")


register("misplaced_sections", misplaced_sections, f"WITH {SQL_FACTS} SELECT document_id, section_label FROM sec WHERE n % 10 = 3 OR n % 10 = 6 AND section_label = 'amar_putusan'")


def heading_triggers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether headings of detected sections open the reasoning or the ruling, and names and places that are plausible."""
    own = sections.detect(decision_texts(spark, sf_dir)).where("section_heading IS NOT NULL")
    h = F.col("section_heading")
    return own.select("document_id", "section_label", tx.analysis_trigger(h).alias("analysis"), tx.conclusion_trigger(h).alias("conclusion"), tx.plausible_name(h).alias("name_like"), tx.valid_birthplace(h).alias("place_like"))


register("heading_triggers", heading_triggers, f"""WITH {SQL_FACTS},{SQL_LINES} SELECT document_id, section_label, section_label IN ('fakta', 'pertimbangan_hukum') AS analysis, section_label = 'amar_putusan' AS conclusion, section_label NOT IN ('identitas_terdakwa', 'riwayat_penahanan') AS name_like, section_label IN ('kepala_putusan', 'pertimbangan_hukum', 'amar_putusan', 'penutup') AND section_label <> 'amar_putusan' OR section_label = 'amar_putusan' AND false AS place_like FROM det WHERE section_heading IS NOT NULL""")
