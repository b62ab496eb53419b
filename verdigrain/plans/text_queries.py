"""Queries on cleaning, sections, augmentation, questions and relational shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from verdigrain.functions import extract
from verdigrain.functions import text as tx
from verdigrain.operators import augment, chunking, groundtruth, questions, relational, sections
from verdigrain.plans import derived as d
from verdigrain.plans.catalogue import register
from verdigrain.session import table
from verdigrain.sources import files


def text_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.documents(spark, sf_dir).select("document_id", F.md5(tx.cleaned(F.col("text")).cast("binary")).alias("clean_md5"), F.length(tx.cleaned(F.col("text"), normalize_unicode=False)).cast("bigint").alias("clean_chars"))


register("text_cleaning", text_cleaning, r"SELECT doc_id AS document_id, md5(c) AS clean_md5, length(c) AS clean_chars FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(text, '[\t \f\x0B]+', ' ', 'g'), '(?m)^ | $', '', 'g'), '\n{3,}', e'\n\n', 'g'), e' \n\t') AS c FROM documents)")


def line_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of documents as sections: labels go by the line's number modulo 3."""
    lines = d.documents(spark, sf_dir).select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    order = Window.partitionBy("document_id").orderBy("i")
    size = F.length("line").cast("bigint")
    before = F.coalesce(F.sum(size + 1).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return lines.select("document_id", F.concat(F.lit("s"), (F.col("i") % 3).cast("string")).alias("section_label"), F.lit(None).cast("string").alias("section_heading"), before.alias("start_position"), (before + size).alias("end_position"), F.col("line").alias("section_text")).where("start_position < end_position")


_SQL_LINES = r"""
ln AS (SELECT document_id, i, line, coalesce(sum(length(line) + 1) OVER (PARTITION BY document_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS st FROM (SELECT doc_id AS document_id, unnest(string_split(text, e'\n')) AS line, unnest(range(0, len(string_split(text, e'\n')))) AS i FROM documents)),
sec AS (SELECT document_id, 's' || (i % 3) AS section_label, CAST(st AS BIGINT) AS start_position, CAST(st + length(line) AS BIGINT) AS end_position FROM ln WHERE length(line) > 0)"""


def section_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.assign_sections(d.chunks(spark, sf_dir), line_sections(spark, sf_dir))
    return out.select("chunk_id", "section_label", F.col("section_overlap_chars").cast("bigint").alias("section_overlap_chars"), "section_assignment_status", F.array_join("mixed_section_labels", ",").alias("mixed"))


register("section_assignment_max_overlap", section_assignment, f"""WITH {d.SQL_CHUNKS},{_SQL_LINES},
o AS (SELECT c.chunk_id, s.section_label, s.start_position AS s, least(c.end_position, s.end_position) - greatest(c.start_position, s.start_position) AS n FROM chunks c JOIN sec s ON s.document_id = c.document_id AND s.start_position < c.end_position AND c.start_position < s.end_position),
g AS (SELECT chunk_id, list(section_label ORDER BY n DESC, s) AS l, max(n) AS m, count(*) AS c FROM o GROUP BY 1), t AS (SELECT chunk_id, count(*) AS ties FROM o JOIN g USING (chunk_id) WHERE n = m GROUP BY 1)
SELECT c.chunk_id, coalesce(l[1], 'unknown') AS section_label, coalesce(m, 0) AS section_overlap_chars, CASE WHEN l IS NULL THEN 'unassigned' WHEN ties > 1 THEN 'mixed_tie_first_section' WHEN g.c > 1 THEN 'mixed_maximum_overlap' ELSE 'single_section' END AS section_assignment_status, coalesce(array_to_string(l, ','), '') AS mixed FROM chunks c LEFT JOIN g USING (chunk_id) LEFT JOIN t USING (chunk_id)""")


def boundary_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.boundary_crossings(d.chunks(spark, sf_dir), line_sections(spark, sf_dir)).groupBy("document_id").agg(F.count(F.lit(1)).alias("crossings"))


register("boundary_crossings", boundary_crossings, f"WITH {d.SQL_CHUNKS},{_SQL_LINES} SELECT document_id, count(*) AS crossings FROM chunks c WHERE EXISTS (SELECT 1 FROM sec s WHERE s.document_id = c.document_id AND c.start_position < s.start_position AND s.start_position < c.end_position) GROUP BY 1")


def interval_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = d.documents(spark, sf_dir).select("document_id", F.length("text").cast("bigint").alias("size"))
    out = sections.interval_coverage(line_sections(spark, sf_dir), sizes)
    return out.withColumn("share", F.round("share", 6)).withColumn("covered", F.col("covered").cast("bigint"))


register("interval_coverage_audit", interval_coverage, f"WITH {_SQL_LINES}, g AS (SELECT document_id, CAST(sum(end_position - start_position) AS BIGINT) AS covered, count(*) AS islands FROM sec GROUP BY 1) SELECT doc_id AS document_id, length(text) AS size, coalesce(covered, 0) AS covered, coalesce(islands, 0) AS islands, CASE WHEN length(text) > 0 THEN round(coalesce(covered, 0) / length(text), 6) END AS share FROM documents LEFT JOIN g ON document_id = doc_id")


def chunk_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that chunks break: none."""
    return chunking.chunk_violations(d.chunks(spark, sf_dir), d.documents(spark, sf_dir))


register("chunk_audit", chunk_audit, "SELECT '' AS \"check\", doc_id AS document_id, '' AS chunk_id FROM documents WHERE false")


def html_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.html_sections(table(spark, sf_dir, "pages")).select("page_id", "section_label", F.col("section_number").cast("bigint").alias("section_number"), F.md5(F.col("section_text").cast("binary")).alias("text_md5"))


register("html_sections", html_sections, r"WITH m AS (SELECT page_id, unnest(regexp_extract_all(html, '(?is)<(title|h1|p)\b[^>]*>[^<]*')) AS m, unnest(range(1, len(regexp_extract_all(html, '(?is)<(title|h1|p)\b[^>]*>[^<]*')) + 1)) AS i FROM pages), t AS (SELECT page_id, i, lower(regexp_extract(m, '(?is)<(title|h1|p)\b[^>]*>([^<]*)', 1)) AS section_label, trim(regexp_replace(regexp_extract(m, '(?is)<(title|h1|p)\b[^>]*>([^<]*)', 2), '\s+', ' ', 'g')) AS x FROM m) SELECT page_id, section_label, row_number() OVER (PARTITION BY page_id ORDER BY i) AS section_number, md5(x) AS text_md5 FROM t WHERE x <> ''")


def structure_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.detect(d.documents(spark, sf_dir)).select("document_id", "section_label", "start_position", "end_position")


register("structure_detection", structure_detection, "SELECT doc_id AS document_id, 'unknown' AS section_label, 0::BIGINT AS start_position, length(text) AS end_position FROM documents WHERE length(text) > 0")


def _whole(spark: SparkSession, sf_dir: str, label: str) -> DataFrame:
    return d.documents(spark, sf_dir).select("document_id", F.lit(label).alias("section_label"), F.lit(None).cast("string").alias("section_heading"), F.lit(0).cast("bigint").alias("start_position"), F.length("text").cast("bigint").alias("end_position"), F.col("text").alias("section_text"))


def sentence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return d.documents(spark, sf_dir).select("document_id", F.size(chunking.sentence_spans(F.col("text"))).cast("bigint").alias("sentences"))


register("sentence_counts", sentence_counts, r"SELECT doc_id AS document_id, len(regexp_extract_all(text, '[.!?;]+(\s|$)')) + CASE WHEN regexp_matches(text, '[.!?;]\s*$') OR trim(text, e' \n\t') = '' THEN 0 ELSE 1 END AS sentences FROM documents")


def summary_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = d.documents(spark, sf_dir).select("document_id", tx.head_at_word(F.col("text"), 150).alias("summary"), F.col("text").alias("source"))
    out = augment.diagnostics(rows)
    return out.select("document_id", F.array_join("unsupported_number_tokens", "|").alias("unsupported"), F.round("lexical_support_ratio", 6).alias("lexical_support_ratio"), "unexpected_language", F.array_join("quality_flags", "|").alias("flags"), "automated_quality_status")




def _representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = d.chunks(spark, sf_dir).withColumn("original_text", F.col("text")).withColumn("section_label", F.when(F.col("chunk_index") == 0, "first").otherwise("later")).drop("text")
    docs = d.documents(spark, sf_dir).select("document_id", tx.head_at_word(F.col("text"), 60).alias("summary"))
    parts = docs.select("document_id", F.lit("first").alias("section_label"), F.concat(F.lit("first: "), F.substring("summary", 1, 20)).alias("summary"))
    return augment.representations(own, docs, parts)


def representations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _representations(spark, sf_dir).select("chunk_id", "method", F.length("embedding_text").cast("bigint").alias("chars"), "section_summary_status")


register("representations_b1_b2_m1", representations, f"""WITH {d.SQL_CHUNKS},
sq AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents), sm AS (SELECT doc_id, CASE WHEN length(t) <= 60 THEN t WHEN regexp_extract(substring(t, 1, 61), '(?s)^(.*) ', 1) = '' THEN rtrim(substring(t, 1, 60)) ELSE rtrim(regexp_extract(substring(t, 1, 61), '(?s)^(.*) ', 1), ' ,;:-') END AS s FROM sq),
x AS (SELECT chunk_id, chunk_index, length(text) AS n, length(s) AS a, CASE WHEN chunk_index = 0 THEN length(trim('first: ' || substring(s, 1, 20))) ELSE length('Bagian dokumen tidak teridentifikasi (later).') END AS b FROM chunks JOIN sm ON doc_id = document_id WHERE s <> '')
SELECT chunk_id, 'B1' AS method, n AS chars, NULL AS section_summary_status FROM x UNION ALL SELECT chunk_id, 'B2', n + a + 32, NULL FROM x UNION ALL SELECT chunk_id, 'M1', n + a + b + 52, CASE WHEN chunk_index = 0 THEN 'summary' ELSE 'documented_unknown_section_fallback' END FROM x""")


def misaligned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose representations don't agree: none."""
    return augment.misaligned(_representations(spark, sf_dir)).select("chunk_id")


register("representation_alignment", misaligned, "SELECT '' AS chunk_id FROM documents WHERE false")


def group_cap_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.capped(table(spark, sf_dir, "documents").select("doc_id", "source"), "source", "doc_id", 4, 50)


register("group_cap_selection", group_cap_selection, "SELECT doc_id, source FROM (SELECT doc_id, source, md5('42|' || doc_id) AS o FROM documents QUALIFY row_number() OVER (PARTITION BY source ORDER BY o, doc_id) <= 4) ORDER BY o, doc_id LIMIT 50")


def group_disjoint_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relational.disjoint_split(table(spark, sf_dir, "documents").where("source IS NOT NULL"), "source", 200)


register("group_disjoint_split", group_disjoint_split, "WITH RECURSIVE g AS (SELECT source, count(*) AS size, row_number() OVER (ORDER BY md5('42|' || source), source) AS p FROM documents WHERE source IS NOT NULL GROUP BY 1), f AS (SELECT p, source, size, size <= 200 AS t, CASE WHEN size <= 200 THEN size ELSE 0 END AS n FROM g WHERE p = 1 UNION ALL SELECT g.p, g.source, g.size, f.n + g.size <= 200, CASE WHEN f.n + g.size <= 200 THEN f.n + g.size ELSE f.n END FROM f JOIN g ON g.p = f.p + 1) SELECT source, size FROM f WHERE t")


def label_quality_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    met = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "source"), "doc_id")
    return met.rollup("lang", "source").agg(F.count(F.lit(1)).alias("labelled"), F.sum("quality").alias("good"), F.sum("toxic").alias("toxic"), F.grouping_id().cast("bigint").alias("level"))


register("label_quality_rollup", label_quality_rollup, "SELECT lang, source, count(*) AS labelled, CAST(sum(quality) AS BIGINT) AS good, CAST(sum(toxic) AS BIGINT) AS toxic, grouping(lang, source) AS level FROM labels JOIN documents USING (doc_id) GROUP BY ROLLUP (lang, source)")


def structure_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sections.structure_audit(d.documents(spark, sf_dir), line_sections(spark, sf_dir))
    return out.withColumns({c: F.round(c, 6) for c in ("document_share", "word_share", "median_words")})


register("structure_audit", structure_audit, rf"WITH {_SQL_LINES}, t AS (SELECT section_label, document_id, len(regexp_extract_all(substring(text, start_position + 1, end_position - start_position), '\S+')) AS w FROM sec JOIN documents ON doc_id = document_id), n AS (SELECT count(*) AS n FROM documents) SELECT section_label, count(DISTINCT document_id) AS documents, round(count(DISTINCT document_id) / max(n), 6) AS document_share, count(*) AS sections, CAST(sum(w) AS BIGINT) AS words, round(sum(w) / sum(sum(w)) OVER (), 6) AS word_share, round(quantile_cont(CAST(w AS DOUBLE), 0.5), 6) AS median_words, max(n) - count(DISTINCT document_id) AS missing FROM t CROSS JOIN n GROUP BY 1")


def dataset_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return groundtruth.dataset_audit(d.documents(spark, sf_dir), _whole(spark, sf_dir, "body"), ("body",))


register("dataset_audit", dataset_audit, "SELECT 'duplicate_texts' AS \"check\", count(text) - count(DISTINCT text) AS count FROM documents UNION ALL SELECT 'empty_texts', count(*) FILTER (coalesce(length(text), 0) = 0) FROM documents UNION ALL SELECT 'missing_labels', 0 FROM (SELECT 1) UNION ALL SELECT 'not_rebuilt', 0 FROM (SELECT 1)")


def paged_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns as pages of a conversation: their spans in the joined text."""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), F.col("text").alias("clean_text"))
    return sections.page_spans(pages)


register("page_spans", paged_conversations, "SELECT conv_id AS document_id, turn AS page_number, CAST(coalesce(sum(length(coalesce(text, '')) + 2) OVER w, 0) AS BIGINT) AS start_position, CAST(coalesce(sum(length(coalesce(text, '')) + 2) OVER w, 0) + length(coalesce(text, '')) AS BIGINT) AS end_position FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)")

#: A decision in the layout of the corpus, for tests of rules that no table has text for.
DECISION = (
    ("kepala_putusan", "Putusan Nomor 12 Pid Sus 2018 PN Cth demi keadilan berdasarkan ketuhanan"), ("identitas_terdakwa", "1 nama lengkap Budi Santoso 2 tempat lahir Jakarta 3 umur atau tanggal lahir 30 tahun"),
    ("riwayat_penahanan", "Penyidik sejak tanggal 1 Mei 2018 sampai dengan tanggal 20 Mei 2018 2 Penuntut"), ("riwayat_dakwaan", "bahwa ia terdakwa Budi Santoso pada hari itu tanpa hak atau melawan hukum menjual narkotika golongan satu bukan tanaman sebagaimana diatur"),
    ("pertimbangan_hukum", "menimbang bahwa pasal 114 ayat 1 undang undang nomor 35 tahun 2009 tentang narkotika unsur setiap orang memperhatikan pasal 114 ayat 1"), ("amar_putusan", "menyatakan terdakwa Budi Santoso telah terbukti bersalah 2 menjatuhkan pidana penjara selama lima tahun 3 menetapkan barang bukti"),
)


def decision_sections(spark: SparkSession) -> DataFrame:
    rows, at = [], 0
    for label, text in DECISION:
        rows.append(("case-1", label, None, at, at + len(text), text))
        at += len(text) + 2
    return spark.createDataFrame(rows, "document_id string, section_label string, section_heading string, start_position bigint, end_position bigint, section_text string")


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sections of all documents; an empty or null text is one empty section, so that no document is lost."""
    docs = d.documents(spark, sf_dir)
    empty = _whole(spark, sf_dir, "unknown").where("coalesce(length(section_text), 0) = 0").withColumn("end_position", F.lit(0).cast("bigint")).withColumn("section_text", F.lit(""))
    return sections.detect(docs).unionByName(empty)


def question_drafts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return questions.questions_v2(_detected(spark, sf_dir), "dev")[0].select("query_id", "question", "reference_answer", "evidence_start", "evidence_end", "extraction_method", "quality_flags")


def question_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the questions that nothing was found for."""
    return questions.questions_v2(_detected(spark, sf_dir), "dev")[1]


register("question_drafts", question_drafts)
register("question_failures", question_failures, "SELECT doc_id AS document_id, 'all' AS question_type FROM documents")
register("fingerprints", lambda spark, sf_dir: extract.fingerprints(_detected(spark, sf_dir)), "SELECT doc_id AS document_id, CAST(NULL AS VARCHAR) AS summary FROM documents")
register("question_slots", lambda spark, sf_dir: questions.question_slots(_detected(spark, sf_dir)), """WITH pl AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS p FROM documents)
SELECT 'q-' || CASE WHEN p < 1000 THEN lpad(CAST(p AS VARCHAR), 3, '0') ELSE CAST(p AS VARCHAR) END || '-' || k AS query_id, doc_id AS document_id, CASE k WHEN 1 THEN CASE WHEN p % 2 = 1 THEN 'identitas_terdakwa' ELSE 'riwayat_penahanan' END WHEN 2 THEN 'fakta' WHEN 3 THEN 'pertimbangan_hukum' ELSE 'amar_putusan' END AS target_section_label, false AS found FROM pl CROSS JOIN (SELECT unnest([1, 2, 3, 4]) AS k)""")
