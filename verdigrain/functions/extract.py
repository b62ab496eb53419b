"""Facts of a court decision taken from its sections by pattern, as column expressions.

Sections come as a map from label to squeezed text. Alternatives are tried in order; nothing found is
an empty string.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigrain.functions import text as tx
from verdigrain.functions.arrays import let

# Where a defendant's name stands, in the order of trust.
NAME_SOURCES = (
    ("riwayat_tuntutan", r"\bmenyatakan\s+terdakwa\s+(.+?)(?=\s+(?:(?:secara\s+sah\s+dan\s+(?:meyakinkan|menyakinkan)|tidak|telah)\s+)*(?:bersalah|terbukti)\b)"),
    ("amar_putusan", r"\bmenyatakan\s+terdakwa\s+(.+?)(?=\s+(?:tersebut\s+diatas\s+)?(?:(?:secara\s+sah\s+dan\s+(?:meyakinkan|menyakinkan)|tidak|telah)\s+)*(?:bersalah|terbukti)\b)"),
    ("riwayat_dakwaan", r"\b(?:bahwa\s+)?(?:ia\s+)?terdakwa\s+(.+?)(?=\s+(?:pada|bersama\s+sama|telah|yang)\b)"),
    ("identitas_terdakwa", r"\b(?:\d+\s+)?nama(?:\s+lengkap)?\s+(.+?)(?=\s+(?:\d+\s+)?tempat\s+lahir\b)"),
    ("kepala_putusan", r"\bdalam\s+perkara\s+terdakwa(?:\s+sebagai\s+berikut)?\s+(.+)$"),
)

# Articles of law, those of procedure, and those that say little.
ARTICLE = r"pasal\s+\d+(?:\s+ayat\s+(?:\(\s*)?\d+(?:\s*\))?)?(?:\s+(?:huruf|butir)\s+[a-z])?"
PROCEDURAL = ("pasal 22", "pasal 183", "pasal 193", "pasal 197", "pasal 222")
COMMON_ARTICLES = ("pasal 1", "pasal 222", "pasal 197")

# Patterns of rulings and charges in order, the case number, and the identity's name.
DISPOSITIONS = (r"\b((?:menjatuhkan\s+pidana).{10,120})", r"\b((?:membebaskan\s+terdakwa).{10,120})", r"\b((?:menyatakan\s+terdakwa).{10,120})")
CHARGES = (r"\b((?:tanpa\s+hak\s+atau\s+melawan\s+hukum).{10,120})", r"\b((?:menyalahgunakan\s+narkotika).{10,120})")
CASE = r"\bputusan\s+nomor\s+(.{1,100}?)(?=\s+demi\s+keadilan\b)"
IDENTITY_NAME = r"\bnama lengkap\s+(.{1,160}?)(?=\s+(?:tempat lahir|umur|tanggal lahir|jenis kelamin|kebangsaan)\b)"
LABELS_IN_ORDER = ("kepala_putusan", "identitas_terdakwa", "riwayat_dakwaan", "fakta_hukum", "pertimbangan_hukum", "amar_putusan")


def group(text: Column, pattern: str) -> Column:
    """The first group of a pattern's first match, squeezed; empty if there is none."""
    return F.coalesce(tx.squeezed(F.regexp_extract(text, f"(?iuU){pattern}", 1)), F.lit(""))


def identity_context(text: Column) -> Column:
    found = group(text, IDENTITY_NAME)
    return F.when(found != "", found)


def by_document(sections: DataFrame) -> DataFrame:
    """One row for each document: `s`, an array of its sections (p, section_label, t) by their start.

    A table that has one row for each document and its `sections` as an array is taken as it is; documents without any are left out.
    """
    told = lambda x: F.struct(x["start_position"].alias("p"), x["section_label"].alias("section_label"), x["section_text"].alias("t"))
    if "sections" in sections.columns:
        return sections.select("document_id", F.transform("sections", told).alias("s")).where("size(s) > 0")
    return sections.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct(F.col("start_position").alias("p"), "section_label", F.col("section_text").alias("t")))).alias("s"))


def by_label(sections: DataFrame) -> DataFrame:
    """One row for each document: labels, a map from label to squeezed text (the last section of a label counts)."""
    # texts are grouped once; a label stands where its first section is, with the text of its last
    labels = F.array_distinct(F.transform("s", lambda x: x["section_label"]))
    last = lambda label: F.element_at(F.filter("s", lambda x: x["section_label"] == label), -1)["t"]
    return by_document(sections).select("document_id", F.map_from_arrays(labels, F.transform(labels, lambda label: tx.squeezed(last(label)))).alias("labels"))


def _label(name: str) -> Column:
    return F.coalesce(F.col("labels")[name], F.lit(""))


def defendant() -> Column:
    """The first plausible name among the sources."""
    found = [F.regexp_replace(group(_label(label), pattern), r"^[0-9 ,;:\-]+|[0-9 ,;:\-]+$", "") for label, pattern in NAME_SOURCES]
    return F.coalesce(*[let(x, lambda name: F.when(tx.plausible_name(name), name)) for x in found], F.lit(""))


def salient_statute(reasoning: Column) -> Column:
    """The last article that the court leans on and that isn't procedural; else the most frequent, the earliest of equals."""
    anchored = F.regexp_extract_all(reasoning, F.lit(rf"(?iuU)\b(?:memperhatikan|mengingat)\s+({ARTICLE}(?:\s+jo\s+{ARTICLE})?)"), F.lit(1))
    lean = F.filter(anchored, lambda a: ~F.exists(F.array(*map(F.lit, PROCEDURAL)), lambda p: tx.squeezed(F.lower(a)).startswith(p)))
    found = F.regexp_extract_all(reasoning, F.lit(rf"(?iuU)\b{ARTICLE}"), F.lit(0))
    keyed = F.transform(found, lambda a, i: F.struct(i.alias("i"), tx.squeezed(F.regexp_replace(F.lower(a), "[()]", "")).alias("key"), a.alias("text")))
    telling = F.filter(keyed, lambda k: ~k["key"].isin(*COMMON_ARTICLES))
    used = F.when(F.size(telling) > 0, telling).otherwise(keyed)
    ranked = F.transform(used, lambda k: F.struct((-F.size(F.filter(used, lambda o: o["key"] == k["key"]))).alias("n"), k["i"].alias("i"), k["text"].alias("text")))
    return F.when(F.size(lean) > 0, F.element_at(lean, -1)).when(F.size(found) > 0, F.array_min(ranked)["text"]).otherwise("")


def components(sections: DataFrame) -> DataFrame:
    """document_id, labels, case, defendant, statute, topic, disposition, charge."""
    rows = by_label(sections)
    whole = F.array_join(F.map_values("labels"), " ")
    first = lambda text, patterns: F.coalesce(*[F.nullif(group(text, p), F.lit("")) for p in patterns], F.lit(""))
    charge = first(_label("riwayat_dakwaan"), CHARGES)
    return rows.select(
        "document_id", "labels", group(_label("kepala_putusan"), CASE).alias("case"), defendant().alias("defendant"), salient_statute(_label("pertimbangan_hukum")).alias("statute"),
        F.when(whole.rlike(r"(?iU)\bnarkotika\b"), "narkotika").otherwise("").alias("topic"), first(_label("amar_putusan"), DISPOSITIONS).alias("disposition"),
        F.when(charge == "", "").otherwise(tx.head_at_word(charge, 80)).alias("charge"),
    )


def _said(prefix: str, name: str) -> Column:
    return F.when(F.col(name) != "", F.concat(F.lit(prefix), F.col(name)))


def fingerprints(sections: DataFrame, *, target: int = 150, tolerance: int = 20) -> DataFrame:
    """document_id and summary: what identifies a decision, each part once, cut at a word; null if nothing is found."""
    if target <= 0 or tolerance < 0:
        raise ValueError("limits are invalid")
    parts = F.array_distinct(F.array_compact(F.array(_said("perkara ", "case"), _said("terdakwa ", "defendant"), _said("", "statute"), F.when(F.col("topic") != "", F.lit("perkara narkotika")), F.when(F.col("disposition") != "", tx.head_at_word(F.col("disposition"), 70)))))
    return components(sections).select("document_id", F.when(F.size(parts) > 0, tx.head_at_word(F.array_join(parts, "; "), target + tolerance)).alias("summary"))


def hierarchical_contexts(sections: DataFrame, *, document_chars: int = 120, section_chars: int = 120) -> DataFrame:
    """document_id, document_context (null if nothing is found), section_contexts (map by label)."""
    whole = F.array_compact(F.array(_said("perkara ", "case"), _said("terdakwa ", "defendant"), F.when(F.col("topic") != "", F.lit("perkara narkotika"))))
    own = lambda label: (
        F.when(label == "identitas_terdakwa", _said("identitas terdakwa ", "defendant")).when(label == "riwayat_dakwaan", _said("dakwaan ", "charge")).when(label == "pertimbangan_hukum", _said("ketentuan pidana ", "statute"))
        .when(label == "amar_putusan", _said("", "disposition")).when(label == "riwayat_penahanan", _said("penahanan terdakwa ", "defendant"))
    )
    said = lambda label: F.array_join(F.array_compact(F.array(F.concat(F.lit("bagian dokumen "), F.replace(label, F.lit("_"), F.lit(" "))), own(label))), "; ")
    by = F.map_from_entries(F.transform(F.map_keys("labels"), lambda label: F.struct(label, tx.head_at_word(said(label), section_chars))))
    return components(sections).select("document_id", F.when(F.size(whole) > 0, tx.head_at_word(F.array_join(whole, "; "), document_chars)).alias("document_context"), by.alias("section_contexts"))


def representative_documents(sections: DataFrame, *, per_section: int = 1600, trim_tail: bool = True, style: str = "[{}] ", joint: str = "\n") -> DataFrame:
    """document_id and text: heads and tails of the telling sections in order; null if a document has none of them."""
    if per_section < 200:
        raise ValueError("per_section must be at least 200")
    head, tail = style.split("{}")
    blocks = F.array_compact(F.array(*[F.when(_label(label) != "", F.concat(F.lit(head + label.replace("_", " ") + tail), tx.excerpt(_label(label), per_section, trim_tail=trim_tail))) for label in LABELS_IN_ORDER]))
    return by_label(sections).select("document_id", F.when(F.size(blocks) > 0, F.array_join(blocks, joint)).alias("text"))


def case_year(heading: Column) -> Column:
    found = F.regexp_extract(heading, r"\b(?:19|20)\d{2}\b", 0)
    return F.when(found != "", found.cast("int"))


def case_number(heading: Column) -> Column:
    return group(heading, r"\b(?:nomor|no)\b\s*(.+?)\s+demi\s+keadilan\b")
