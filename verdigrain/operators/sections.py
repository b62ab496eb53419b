"""Sections of court decisions: detection by cascade, audits and review scores.

The cascade works from the back: the ruling near the end, the reasoning before it, the facts before
that, then the parts of the preamble; a closing follows the ruling. It needs searches bounded inside
the text, so it is one Arrow function; all that follows is relational.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigrain.functions import text as tx
from verdigrain.operators.chunking import merged_intervals
from verdigrain.session import on_workers

# How headings and turns of the text look, by label.
PREAMBLE = (
    ("kepala_putusan", r"^[ \t]*(?:P[ \t]+U[ \t]+T[ \t]+U[ \t]+S[ \t]+A[ \t]+N|PUTUSAN|DEMI KEADILAN BERDASARKAN KETUHANAN YANG MAHA ESA)[ \t:]*$"),
    ("identitas_terdakwa", r"^[ \t]*(?:IDENTITAS (?:TERDAKWA|PARA PIHAK)|(?:\d+[.)][ \t]*)?Nama[ \t]+lengkap(?:[ \t]*/)?)(?:[ \t]*:.*)?$"),
    ("riwayat_penahanan", r"^[ \t]*(?:RIWAYAT PENAHANAN|(?:Para[ \t]+)?Terdakwa\b[\s\S]{0,350}?\b(?:ditangkap|ditahan)\b)"),
)
FACTS = (
    r"^[ \t]*Menimbang\s*,?\s*bahwa\s+(?:(?:Para\s+)?Terdakwa\b|ia\s+Terdakwa\b)[\s\S]{0,500}?\b(?:diajukan|dihadapkan|didakwa|dakwaan)\b",
    r"^[ \t]*(?:FAKTA(?:-FAKTA)?|DAKWAAN|TUNTUTAN)[ \t:;]*$",
    r"^[ \t]*Menimbang\s*,?\s*bahwa\b.*$",
)
ANALYSIS = (
    r"^[ \t]*(?:PERTIMBANGAN HUKUM|MENIMBANG)[ \t:;]*$",
    r"^[ \t]*Menimbang\s*,?\s*bahwa\s+selanjutnya\s+Majelis\s+Hakim\s+akan\s+mempertimbangkan\s+apakah\b.*$",
    r"^[ \t]*Menimbang\s*,?\s*bahwa\s+selanjutnya\b[\s\S]{0,500}?Majelis\s+Hakim\s+akan\s+(?:mempertimbangkan|membuktikan)\s+apakah\b",
    r"^[ \t]*Menimbang\s*,?\s*bahwa\s+untuk\s+menyatakan\s+seseorang\s+(?:telah\s+)?terbukti\s+melakukan\s+(?:suatu\s+)?tindak\s+pidana\b.*$",
    r"^[ \t]*Menimbang\s*,?\s*bahwa\s+terhadap\s+unsur(?:-unsur)?\s+tersebut\b.*$",
)
RULING = r"^[ \t]*(?:AMAR PUTUSAN|M(?:[ \t]+)?E(?:[ \t]+)?N(?:[ \t]+)?G(?:[ \t]+)?A(?:[ \t]+)?D(?:[ \t]+)?I(?:[ \t]+)?L(?:[ \t]+)?I)[ \t:]*$"
CLOSING = r"^[ \t]*(?:PENUTUP[ \t:]*|Demikian(?:lah)?(?:[ \t]+|[ \t]*\n[ \t]*)diputuskan\b.*)$"
MACRO = {"facts": "fakta", "analysis": "pertimbangan_hukum", "conclusion": "amar_putusan"}
REVIEW_LABELS = ("kepala_putusan", "identitas_terdakwa", "riwayat_penahanan", "fakta", "pertimbangan_hukum", "amar_putusan", "penutup")
REVIEW_STATUSES = ("exact", "near", "missed", "false_positive", "not_applicable")

_FOUND = "array<struct<label:string,start:bigint>>"


def _compiled(pattern: str) -> re.Pattern[str]:
    return re.compile(pattern, re.I | re.M)


def boundaries(text: str, tail: float) -> list[tuple[str, int]]:
    """(label, start) of the sections found, in order; equal starts keep the label found first."""
    begins: dict[str, int] = {}
    tail_from = 0 if len(text) < 500 else int(len(text) * (1 - tail))
    limit, after = len(text), None
    if (ruling := _compiled(RULING).search(text, tail_from)) is not None:
        limit, after = ruling.start(), ruling.end()
    reasons = (m for p in ANALYSIS if (m := _compiled(p).search(text, 0, limit)) is not None)
    if (reason := next(reasons, None)) is not None:
        limit = begins["pertimbangan_hukum"] = reason.start()
    facts = [m.start() for p in FACTS if (m := _compiled(p).search(text, 0, limit)) is not None]
    if facts:
        limit = begins["fakta"] = min(facts)
    before = {label: m.start() for label, p in PREAMBLE if (m := _compiled(p).search(text, 0, limit)) is not None}
    if ruling is not None:
        begins["amar_putusan"] = ruling.start()
        if (closing := _compiled(CLOSING).search(text, after)) is not None:
            begins["penutup"] = closing.start()
    order = [*before, "fakta", "pertimbangan_hukum", "amar_putusan", "penutup"]
    begins |= before
    unique: dict[int, str] = {}
    for label in order:
        if label in begins:
            unique.setdefault(begins[label], label)
    return [(unique[start], start) for start in sorted(unique)]


def detect(documents: DataFrame, *, fallback: str = "unknown", tail: float = 0.2) -> DataFrame:
    """document_id, section_label, section_heading, start_position, end_position, section_text: nothing of a text is lost."""
    if not 0 < tail <= 1:
        raise ValueError("tail must be above 0 and at most 1")
    on_workers(documents.sparkSession)

    @F.pandas_udf(_FOUND)
    def found(text: pd.Series) -> pd.Series:
        return pd.Series([[{"label": g, "start": s} for g, s in boundaries(t or "", tail)] for t in text], dtype=object)

    rows = documents.where(F.length("text") > 0).select("document_id", "text", found("text").alias("_found"))
    # get() gives null past the end, also under ANSI mode
    rows = rows.withColumn("_all", F.when(F.size("_found") == 0, F.array(F.struct(F.lit(fallback).alias("label"), F.lit(0).cast("bigint").alias("start")))).when(F.get("_found", F.lit(0))["start"] > 0, F.concat(F.array(F.struct(F.lit(fallback).alias("label"), F.lit(0).cast("bigint").alias("start"))), F.col("_found"))).otherwise(F.col("_found")))
    each = rows.select("document_id", "text", F.size("_found").alias("_n"), "_all", F.posexplode("_all").alias("_i", "_s"))
    start = F.col("_s.start")
    end = F.coalesce(F.get("_all", F.col("_i") + 1)["start"], F.length("text").cast("bigint"))
    named = F.when(F.col("_s.label") != fallback, tx.heading_at(F.col("text"), start))
    return each.select("document_id", F.col("_s.label").alias("section_label"), named.alias("section_heading"), start.alias("start_position"), end.alias("end_position"), F.substring("text", (start + 1).cast("int"), (end - start).cast("int")).alias("section_text"))


def boundary_crossings(chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks inside which a section starts: a semi-join on document and position."""
    c, s = chunks.alias("c"), sections.select("document_id", F.col("start_position").alias("_cut")).alias("s")
    return c.join(s, (F.col("c.document_id") == F.col("s.document_id")) & (F.col("c.start_position") < F.col("s._cut")) & (F.col("s._cut") < F.col("c.end_position")), "left_semi")


def assign_sections(chunks: DataFrame, sections: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """Each chunk with the section that it overlaps most (the first of equals), how clear that is, all it overlaps, and its pages.

    Arrays are small: a chunk overlaps few sections and pages.
    """
    c = chunks.alias("c")
    s = sections.select("document_id", "section_label", "section_heading", F.col("start_position").alias("s"), F.col("end_position").alias("e")).alias("s")
    shared = F.least(F.col("c.end_position"), F.col("s.e")) - F.greatest(F.col("c.start_position"), F.col("s.s"))
    met = c.join(s, (F.col("c.document_id") == F.col("s.document_id")) & (F.col("s.s") < F.col("c.end_position")) & (F.col("c.start_position") < F.col("s.e")), "inner")
    by = met.groupBy(F.col("c.chunk_id").alias("chunk_id")).agg(F.array_sort(F.collect_list(F.struct((-shared).alias("n"), F.col("s.s").alias("s"), F.coalesce("s.section_label", F.lit("unknown")).alias("label"), F.col("s.section_heading").alias("heading")))).alias("_o"))
    first = F.get("_o", F.lit(0))
    ties = F.size(F.filter("_o", lambda o: o["n"] == first["n"]))
    status = F.when(F.col("_o").isNull(), "unassigned").when(ties > 1, "mixed_tie_first_section").when(F.size("_o") > 1, "mixed_maximum_overlap").otherwise("single_section")
    out = chunks.drop("section_label", "section_heading").join(by, "chunk_id", "left").withColumns({"section_label": F.coalesce(first["label"], F.lit("unknown")), "section_heading": first["heading"], "section_overlap_chars": F.coalesce(-first["n"], F.lit(0)), "section_assignment_status": status, "mixed_section_labels": F.coalesce(F.transform("_o", lambda o: o["label"]), F.array().cast("array<string>"))}).drop("_o")
    if pages is None:
        return out
    p = pages.select("document_id", "page_number", F.col("start_position").alias("s"), F.col("end_position").alias("e")).alias("p")
    on = (F.col("c.document_id") == F.col("p.document_id")) & (F.col("p.s") < F.col("c.end_position")) & (F.col("c.start_position") < F.col("p.e"))
    numbers = c.join(p, on).groupBy(F.col("c.chunk_id").alias("chunk_id")).agg(F.array_sort(F.collect_list("page_number")).alias("page_numbers"))
    return out.join(numbers, "chunk_id", "left").withColumn("page_numbers", F.coalesce("page_numbers", F.array().cast("array<int>")))


def page_spans(pages: DataFrame) -> DataFrame:
    """document_id, page_number, start_position, end_position of pages joined by empty lines."""
    order = Window.partitionBy("document_id").orderBy("page_number")
    size = F.length(F.coalesce("clean_text", F.lit(""))).cast("bigint")
    before = F.coalesce(F.sum(size + 2).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return pages.select("document_id", "page_number", before.alias("start_position"), (before + size).alias("end_position"))


def join_pages(pages: DataFrame) -> DataFrame:
    """document_id and text of pages joined by empty lines in the order of their numbers."""
    return pages.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page_number", F.coalesce("clean_text", F.lit("")).alias("t")))).alias("p")).select("document_id", F.array_join(F.transform("p", lambda p: p["t"]), "\n\n").alias("text"))


def structure_audit(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """By label: documents that have it, their share, sections, words, share of words, median words, and documents without."""
    n = documents.select(F.count(F.lit(1)).alias("_documents"))
    words = sections.withColumn("_w", tx.word_count(F.col("section_text")))
    by = words.groupBy("section_label").agg(F.count_distinct("document_id").alias("documents"), F.count(F.lit(1)).alias("sections"), F.sum("_w").alias("words"), F.percentile("_w", F.lit(0.5)).alias("median_words"))
    return by.crossJoin(F.broadcast(n)).withColumn("_total", F.sum("words").over(Window.partitionBy())).select("section_label", "documents", (F.col("documents") / F.col("_documents")).alias("document_share"), "sections", "words", (F.col("words") / F.col("_total")).alias("word_share"), "median_words", (F.col("_documents") - F.col("documents")).alias("missing"))


def compliance(documents: DataFrame, sections: DataFrame, chunks: DataFrame, *, tail: float = 0.2, max_words: int = 300) -> DataFrame:
    """For each document, whether each of nine checks holds."""
    doc = documents.select("document_id", F.col("text").alias("_doc"), F.length("text").cast("bigint").alias("_size"))
    own = sections.join(doc, "document_id")
    order = Window.partitionBy("document_id").orderBy("start_position")
    exact = F.substring("_doc", (F.col("start_position") + 1).cast("int"), (F.col("end_position") - F.col("start_position")).cast("int")) == F.col("section_text")
    walk = own.withColumn("_before", F.coalesce(F.lag("end_position").over(order), F.lit(0)))
    good = (F.col("start_position") == F.col("_before")) & (F.col("start_position") < F.col("end_position")) & exact
    label = lambda k: F.col("section_label") == MACRO[k]
    place = lambda k: F.min(F.when(label(k), F.col("start_position")))
    by = walk.groupBy("document_id").agg(
        (F.min(F.coalesce(good, F.lit(False)).cast("int")) == 1).alias("_steps"), (F.max("end_position") == F.max("_size")).alias("_end"),
        *[F.count(F.when(label(k), 1)).alias(f"_n_{k}") for k in MACRO], *[place(k).alias(f"_at_{k}") for k in MACRO], F.max("_size").alias("_size"),
        F.max(F.when(label("analysis"), tx.analysis_trigger(F.coalesce("section_heading", F.lit(""))))).alias("_analysis"), F.max(F.when(label("conclusion"), tx.conclusion_trigger(F.coalesce("section_heading", F.lit(""))))).alias("_conclusion"),
    )
    three = (F.col("_n_facts") == 1) & (F.col("_n_analysis") == 1) & (F.col("_n_conclusion") == 1)
    c = chunks.alias("c").join(doc.alias("d"), "document_id")
    s = sections.select("document_id", F.col("start_position").alias("s"), F.col("end_position").alias("e")).alias("s")
    inside = c.join(s, (F.col("c.document_id") == F.col("s.document_id")) & (F.col("s.s") <= F.col("c.start_position")) & (F.col("c.end_position") <= F.col("s.e")), "left")
    each = inside.groupBy(F.col("c.document_id").alias("document_id"), "c.chunk_id", "c.start_position", "c.end_position").agg(F.count("s.s").alias("n"), F.min("s.s").alias("s"), F.first("c.text").alias("text"), F.first("_doc").alias("_doc"))
    valid = (F.col("n") == 1) & (F.col("start_position") < F.col("end_position")) & (F.substring("_doc", (F.col("start_position") + 1).cast("int"), (F.col("end_position") - F.col("start_position")).cast("int")) == F.col("text")) & (tx.word_count(F.col("text")) <= max_words)
    each = each.withColumn("_valid", F.coalesce(valid, F.lit(False)))
    follow = Window.partitionBy("document_id", "s").orderBy("start_position", "end_position")
    gaps = each.where("_valid").withColumn("_gap", (F.col("start_position") >= F.lag("end_position").over(follow)).cast("int")).groupBy("document_id").agg(F.coalesce(F.sum("_gap"), F.lit(0)).alias("_gaps"))
    from verdigrain.operators.chunking import chunk_violations

    bare = chunk_violations(each.where("_valid").select("document_id", "chunk_id", "start_position", "end_position", "text"), documents).where("check = 'coverage'").select("document_id", F.lit(False).alias("_covered"))
    sound = each.groupBy("document_id").agg((F.min(F.col("_valid").cast("int")) == 1).alias("_sound"))
    out = documents.select("document_id").join(by, "document_id", "left").join(sound, "document_id", "left").join(gaps, "document_id", "left").join(bare, "document_id", "left")
    yes = lambda c: F.coalesce(c, F.lit(False))
    return out.select(
        "document_id", yes(F.col("_steps") & F.col("_end")).alias("full_section_coverage"), yes(three).alias("three_rhetorical_strata"), yes(three & (F.col("_at_facts") < F.col("_at_analysis")) & (F.col("_at_analysis") < F.col("_at_conclusion"))).alias("ordered_rhetorical_strata"),
        yes(three & (F.col("_at_conclusion") >= F.floor(F.col("_size") * F.lit(1 - tail)))).alias("conclusion_in_final_window"), yes(three & F.col("_analysis")).alias("high_precision_analysis_trigger"), yes(three & F.col("_conclusion")).alias("high_precision_conclusion_trigger"),
        yes(F.col("_sound")).alias("chunks_within_sections"), F.coalesce("_covered", F.lit(True)).alias("chunk_text_covered"), (F.coalesce("_gaps", F.lit(0)) == 0).alias("intra_section_overlap"),
    )


def annotation_template(documents: DataFrame, sections: DataFrame, labels: tuple[str, ...] = REVIEW_LABELS) -> DataFrame:
    """One row for each document and label, with what was detected and blanks for a reviewer."""
    table = documents.sparkSession.createDataFrame([(x,) for x in labels], "section_label string")
    first = sections.groupBy("document_id", "section_label").agg(F.min_by(F.struct("section_heading", "start_position", "section_text"), "start_position").alias("_s"))
    met = documents.select("document_id").crossJoin(F.broadcast(table)).join(first, ["document_id", "section_label"], "left")
    return met.select("document_id", "section_label", F.when(F.col("_s").isNotNull(), "yes").otherwise("no").alias("detected"), F.col("_s.section_heading").alias("detected_heading"), F.col("_s.start_position").alias("detected_start_position"), tx.word_count(F.col("_s.section_text")).alias("detected_word_count"), F.lit("").alias("gold_present"), F.lit("pending").alias("review_status"), F.lit("").alias("gold_heading"), F.lit("").alias("reviewer_notes"))


def review_scores(review: DataFrame) -> DataFrame:
    """By label, of reviewed rows: counts by status, precision and recall, exact and tolerant; null where nothing is to divide by."""
    rows = review.where(F.trim("review_status").isin(*REVIEW_STATUSES))
    yes = lambda c: F.lower(F.trim(F.col(c))) == "yes"
    is_ = lambda s: F.trim("review_status") == s
    by = rows.groupBy("section_label").agg(F.count(F.lit(1)).alias("reviewed"), F.count_if(yes("gold_present")).alias("gold_positive"), F.count_if(yes("detected")).alias("predicted_positive"), *[F.count_if(is_(s)).alias(s) for s in REVIEW_STATUSES])
    share = lambda a, b: F.when(F.col(b) > 0, a / F.col(b))
    exact, near = F.col("exact"), F.col("exact") + F.col("near")
    return by.select("*", share(exact, "predicted_positive").alias("exact_precision"), share(exact, "gold_positive").alias("exact_recall"), share(near, "predicted_positive").alias("tolerant_precision"), share(near, "gold_positive").alias("tolerant_recall"))


def review_violations(review: DataFrame) -> DataFrame:
    """(document_id, section_label, problem) where a reviewed row contradicts itself."""
    status, gold, seen = F.trim("review_status"), F.lower(F.trim("gold_present")), F.lower(F.trim("detected"))
    checks = F.array_compact(F.array(
        F.when(~status.isin(*REVIEW_STATUSES), "unknown status"), F.when(~gold.isin("yes", "no"), "gold_present must be yes or no"), F.when(~seen.isin("yes", "no"), "detected must be yes or no"),
        F.when(status.isin("exact", "near", "missed") & (gold != "yes"), "status needs gold_present yes"), F.when((status == "not_applicable") & (gold != "no"), "status needs gold_present no"),
        F.when(status.isin("exact", "near", "false_positive") & (seen != "yes"), "status needs detected yes"), F.when(status.isin("missed", "not_applicable") & (seen != "no"), "status needs detected no"),
    ))
    return review.where(~status.isin("", "pending")).select("document_id", "section_label", F.explode(checks).alias("problem"))


def interval_coverage(spans: DataFrame, sizes: DataFrame) -> DataFrame:
    """By document: characters covered by spans, and their share of its size."""
    merged = merged_intervals(spans.select("document_id", "start_position", "end_position"), ["document_id"]).groupBy("document_id").agg(F.sum(F.col("end_position") - F.col("start_position")).alias("covered"), F.count(F.lit(1)).alias("islands"))
    return sizes.join(merged, "document_id", "left").select("document_id", "size", F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce("islands", F.lit(0)).alias("islands"), F.when(F.col("size") > 0, F.coalesce("covered", F.lit(0)) / F.col("size")).alias("share"))
