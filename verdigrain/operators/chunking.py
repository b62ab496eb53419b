"""Chunks over positions: word windows, sentence packing, rhetorical windows, character windows, parents and children.

Word windows have a closed form and stay in the JVM: a text is cut once into runs of as many words as
divide both window and step, and windows are ranges of runs. Chunkers whose next start depends on the
last end are one Arrow function over a column of texts. Every chunk keeps exact code-point offsets.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigrain.functions import text as tx
from verdigrain.functions.arrays import at, let, prefix_sums
from verdigrain.session import on_workers

SPANS = "array<struct<start:bigint,end:bigint>>"

# Phrases at which legal argument turns, and the labels to which that applies.
RHETORICAL_MARKERS = (
    r"menimbang\s+bahwa", r"berdasarkan\s+(?:fakta|alat\s+bukti)", r"selanjutnya\s+majelis\s+hakim", r"terhadap\s+unsur",
    r"unsur(?:\s+ke\s*\d+|\s+kesatu|\s+kedua|\s+ketiga|\s+keempat|\s+setiap\s+orang|\s+tanpa\s+hak|\s+perbuatan|\s+unsurnya)",
    r"oleh\s+karena\s+(?:itu|semua\s+unsur)", r"(?:hal|keadaan)(?:\s+hal)?\s+yang\s+(?:memberatkan|meringankan)",
    r"memperhatikan(?:\s+pasal)?", r"mengadili(?:\s|$)", r"menyatakan\s+terdakwa", r"menjatuhkan\s+pidana",
)
RHETORICAL_LABELS = ("riwayat_dakwaan", "fakta", "fakta_hukum", "pertimbangan_hukum", "amar_putusan")

# Separators by preference; the empty one is the hard cut.
SEPARATORS = ("\n\n", "\n", "!", "?", ".", ":", ";", ",", " ", "")

# Sections whose chunks carry the document's identity.
REASONING_LABELS = ("pertimbangan_hukum", "fakta_hukum")


def check_window(words: int, overlap: int) -> None:
    if words <= 0:
        raise ValueError("a window needs at least one word")
    if not 0 <= overlap < words:
        raise ValueError("overlap must be at least 0 and below the window")


def word_windows(text: Column, words: int, overlap: int) -> Column:
    """start, end and text of windows of so many words, each of which repeats `overlap` words of the last.

    A window's text is joined from its runs: a cut from the whole text would count characters from its start.
    """
    check_window(words, overlap)
    step = words - overlap
    unit = math.gcd(words, step)
    runs = F.regexp_extract_all(text, F.lit(rf"(?U)(?:\s*+\S++){{1,{unit}}}+"), F.lit(0))
    lead = lambda run: F.length(run) - F.length(F.regexp_replace(run, r"(?U)\A\s+", ""))

    def of(run: Column) -> Column:
        total = (F.size(run) - 1) * unit + tx.word_count(F.element_at(run, -1))
        count = F.when(total <= words, F.lit(1)).otherwise(F.ceil((total - words) / step) + 1)
        first = lambda i: i * (step // unit)
        body = lambda i: F.regexp_replace(F.array_join(F.slice(run, first(i) + 1, F.lit(words // unit)), ""), r"(?U)\A\s+", "")
        window = lambda ends, i: F.struct((at(ends, first(i)) + lead(at(run, first(i)))).cast("bigint").alias("start"), at(ends, F.least(first(i) + words // unit, F.size(run))).alias("end"), body(i).alias("text"))
        made = let(prefix_sums(F.transform(run, F.length)), lambda ends: F.transform(F.sequence(F.lit(0), (count - 1).cast("int")), lambda i: window(ends, i)))
        return F.when(F.size(run) > 0, made).otherwise(F.array().cast("array<struct<start:bigint,end:bigint,text:string>>"))

    return let(runs, of)


def part(text: Column, span: Column) -> Column:
    return F.substring(text, (span["start"] + 1).cast("int"), (span["end"] - span["start"]).cast("int"))


def chunk_id(document: Column, strategy: Column, index: Column, start: Column, end: Column) -> Column:
    return F.concat_ws("-", document.cast("string"), strategy, tx.short_hash([strategy, document, index, start, end]))


def fixed_chunks(documents: DataFrame, words: int = 300, overlap: int = 50, *, strategy: str = "fixed") -> DataFrame:
    """Of document_id and text: chunk_id, document_id, chunk_index, strategy, text, start_position, end_position."""
    exploded = documents.select("document_id", F.posexplode(word_windows(F.col("text"), words, overlap)).alias("chunk_index", "span"))
    start, end = F.col("span.start"), F.col("span.end")
    return exploded.select(chunk_id(F.col("document_id"), F.lit(strategy), F.col("chunk_index"), start, end).alias("chunk_id"), "document_id", "chunk_index", F.lit(strategy).alias("strategy"), F.col("span.text").alias("text"), start.alias("start_position"), end.alias("end_position"))


def sentence_spans(text: Column) -> Column:
    """start and end of sentences: up to terminators before white space; what is left is one too."""
    pieces = F.regexp_extract_all(text, F.lit(r"(?sU).*?[.!?;]+(?=\s|\z)|.+\z"), F.lit(0))
    spans = let(prefix_sums(F.transform(pieces, F.length)), lambda ends: F.transform(F.sequence(F.lit(0), F.size(ends) - 2), lambda i: tx.trimmed_span(text, at(ends, i), at(ends, i + 1))))
    return F.when(F.length(text) > 0, F.filter(spans, lambda s: s["start"] < s["end"])).otherwise(F.array().cast(SPANS))


# --- chunkers that fold over a text -------------------------------------------------------------


class _Words:
    """The words of a text with searches over their positions."""

    def __init__(self, text: str) -> None:
        found = [m.span() for m in re.finditer(r"\S+", text)]
        self.starts, self.ends = [a for a, _ in found], [b for _, b in found]

    def __len__(self) -> int:
        return len(self.starts)

    def first_at(self, position: int) -> int:
        """The number of the first word that begins at a position or later."""
        return bisect_left(self.starts, position)

    def span(self, first: int, stop: int) -> tuple[int, int]:
        return self.starts[first], self.ends[stop - 1]

    def windows(self, first: int, stop: int, words: int, overlap: int) -> list[tuple[int, int]]:
        """Word windows over the words from first to stop."""
        n = stop - first
        count = 1 if n <= words else -(-(n - words) // (words - overlap)) + 1
        return [(first + i * (words - overlap), min(first + i * (words - overlap) + words, stop)) for i in range(count)]


def _backfilled(runs: list[tuple[int, int]], words: int) -> list[tuple[int, int]]:
    """A last window of at most half the words is replaced by the last full window of the text so far."""
    if len(runs) < 2:
        return runs
    first, stop = runs[-1]
    short = stop - first <= max(1, words // 2) and stop > words
    return [*runs[:-1], (stop - words, stop)] if short else runs


def packed_sentences(text: str, words: int, overlap: int, sentences: int, backfill: bool) -> list[tuple[int, int]]:
    """Sentences packed up to a number of words, sharing some with the window before.

    Sentence ends are a running total of words, so each window ends at the last total within reach. A
    sentence over the budget becomes word windows. Windows that would share nothing are extended
    backwards, or a bridge is put between them.
    """
    units = _Words(text)
    cuts = [0]
    for m in re.finditer(r"[.!?;]+(?=\s|$)", text):
        stop = bisect_right(units.starts, m.end() - 1)
        # a mark inside a word's end closes the sentence with that word
        if stop > cuts[-1]:
            cuts.append(stop)
    if len(units) > cuts[-1]:
        cuts.append(len(units))
    last = len(cuts) - 1
    runs: list[tuple[int, int]] = []
    k = 0
    while k < last:
        if cuts[k + 1] - cuts[k] > words:
            runs += units.windows(cuts[k], cuts[k + 1], words, overlap)
            k += 1
            continue
        stop = bisect_right(cuts, cuts[k] + words, lo=k + 1) - 1
        runs.append((cuts[k], cuts[stop]))
        if stop == last:
            break
        # go back over whole sentences while the next, unseen one still fits
        k = min(stop, max(k + 1, stop - sentences, bisect_left(cuts, cuts[stop + 1] - words, lo=0)))
    if overlap:
        joined = runs[:1]
        for first, stop in runs[1:]:
            before, end = joined[-1]
            if first >= end:
                shared = min(overlap, end - before)
                if shared + stop - first <= words:
                    first = end - shared
                elif shared < words:
                    joined.append((end - shared, first + words - shared))
            joined.append((first, stop))
        runs = joined
    return [units.span(*run) for run in (_backfilled(runs, words) if backfill else runs)]


_MARKER = re.compile(r"(?<!\S)(?:" + "|".join(RHETORICAL_MARKERS) + ")", re.I)


def rhetorical_windows(text: str, words: int, overlap: int, fill: float, backfill: bool) -> list[tuple[int, int]]:
    """Word windows that end at the last marker within reach, once they are filled far enough."""
    units = _Words(text)
    turns = sorted({units.first_at(m.start()) for m in _MARKER.finditer(text) if m.start() > 0})
    least = max(overlap + 1, min(words, math.ceil(words * fill)))
    runs: list[tuple[int, int]] = []
    first = 0
    while first < len(units):
        stop = min(first + words, len(units))
        if stop < len(units):
            turn = bisect_right(turns, stop) - 1
            if turn >= 0 and turns[turn] >= first + least:
                stop = turns[turn]
        runs.append((first, stop))
        if stop == len(units):
            break
        first = stop - overlap
    return [units.span(*run) for run in (_backfilled(runs, words) if backfill else runs)]


def character_windows(text: str, size: int, overlap: int, separators: tuple[str, ...], fill: float) -> list[tuple[int, int]]:
    """Windows of characters that end after the most preferred separator that fills them far enough, trimmed."""
    found, at_, least = [], 0, int(size * fill)
    while at_ < len(text):
        stop = min(at_ + size, len(text))
        if stop < len(text):
            ends = (text.rfind(s, at_, stop) + len(s) for s in separators if s and text.rfind(s, at_, stop) >= 0)
            stop = next((e for e in ends if e >= at_ + least), stop)
        body = text[at_:stop]
        lead = len(body) - len(body.lstrip())
        if lead < len(body):
            found.append((at_ + lead, at_ + len(body.rstrip())))
        if stop == len(text):
            break
        at_ = max(stop - overlap, at_ + 1)
    return found


def _span_function(cut: Callable[..., list[tuple[int, int]]], with_label: bool = False):
    if with_label:

        @F.pandas_udf(SPANS)
        def spans(text: pd.Series, label: pd.Series) -> pd.Series:
            return pd.Series([[{"start": a, "end": b} for a, b in cut(t or "", g or "")] for t, g in zip(text, label, strict=True)], dtype=object)
    else:

        @F.pandas_udf(SPANS)
        def spans(text: pd.Series) -> pd.Series:
            return pd.Series([[{"start": a, "end": b} for a, b in cut(t or "")] for t in text], dtype=object)

    return spans


def structure_chunks(sections: DataFrame, *, words: int = 300, overlap: int = 50, sentences: int = 2, backfill: bool = False, mode: str = "sentence", fill: float = 0.7, context: str = "none", strategy: str = "structure_aware") -> DataFrame:
    """Chunks that never cross sections, numbered through each document.

    sections: document_id, section_label, section_heading, start_position, end_position, section_text.
    mode: sentence or legal_rhetorical (for the labels to which markers apply).
    """
    check_window(words, overlap)
    if sentences < 0:
        raise ValueError("sentences must be at least 0")
    if mode not in ("sentence", "legal_rhetorical"):
        raise ValueError("mode must be sentence or legal_rhetorical")
    if not 0 < fill <= 1:
        raise ValueError("fill must be above 0 and at most 1")
    on_workers(sections.sparkSession)

    def cut(text: str, label: str) -> list[tuple[int, int]]:
        if mode == "legal_rhetorical" and label in RHETORICAL_LABELS:
            return rhetorical_windows(text, words, overlap, fill, backfill)
        return packed_sentences(text, words, overlap, sentences, backfill)

    spans = _span_function(cut, True)
    rows = sections.withColumn("_spans", spans("section_text", "section_label")).select("*", F.posexplode("_spans").alias("_number", "_span"))
    order = Window.partitionBy("document_id").orderBy("start_position", "_number")
    base = F.col("start_position")
    rows = rows.select("document_id", (F.row_number().over(order) - 1).alias("chunk_index"), F.lit(strategy).alias("strategy"), part(F.col("section_text"), F.col("_span")).alias("text"), (base + F.col("_span.start")).alias("_start"), (base + F.col("_span.end")).alias("_end"), F.coalesce("section_label", F.lit("unknown")).alias("section_label"), "section_heading")
    made = rows.select(chunk_id(F.col("document_id"), F.col("strategy"), F.col("chunk_index"), F.col("_start"), F.col("_end")).alias("chunk_id"), "document_id", "chunk_index", "strategy", "text", F.col("_start").alias("start_position"), F.col("_end").alias("end_position"), "section_label", "section_heading")
    return with_context(made, sections, context)


def with_context(chunks: DataFrame, sections: DataFrame, context: str) -> DataFrame:
    """embedding_text: null, or a prefix of the section's label and, where asked for, the defendant's identity."""
    if context not in ("none", "section", "section_document", "section_reasoning_document"):
        raise ValueError("context must be none, section, section_document or section_reasoning_document")
    if context == "none":
        return chunks.withColumn("embedding_text", F.lit(None).cast("string"))
    head = F.concat(F.lit("bagian dokumen: "), F.replace(F.col("section_label"), F.lit("_"), F.lit(" ")))
    tail = F.concat(F.lit(".\n"), F.col("text"))
    if context == "section":
        return chunks.withColumn("embedding_text", F.concat(head, tail))
    from verdigrain.functions.extract import identity_context

    who = sections.where("section_label = 'identitas_terdakwa'").groupBy("document_id").agg(F.min_by("section_text", "start_position").alias("_text")).select("document_id", identity_context(F.col("_text")).alias("_who"))
    wanted = F.col("_who").isNotNull() & (F.lit(context == "section_document") | F.col("section_label").isin(*REASONING_LABELS))
    full = F.when(wanted, F.concat(F.lit("perkara terdakwa: "), F.col("_who"), F.lit(". "), head, tail)).otherwise(F.concat(head, tail))
    return chunks.join(who, "document_id", "left").withColumn("embedding_text", full).drop("_who")


def recursive_chunks(documents: DataFrame, *, size: int = 500, overlap: int = 0, separators: tuple[str, ...] = SEPARATORS, fill: float = 0.5) -> DataFrame:
    """Canonical chunks: chunk_id, document_id, chunk_index, original_text, start_position, end_position."""
    if size <= 0 or not 0 <= overlap < size:
        raise ValueError("size must be positive and overlap at least 0 and below it")
    if not separators or separators[-1]:
        raise ValueError("separators must end with the empty one")
    if not 0 < fill <= 1:
        raise ValueError("fill must be above 0 and at most 1")
    on_workers(documents.sparkSession)
    spans = _span_function(lambda text: character_windows(text, size, overlap, separators, fill))
    rows = documents.select("document_id", "text", F.posexplode(spans("text")).alias("chunk_index", "_span"))
    original = part(F.col("text"), F.col("_span"))
    rows = rows.select("document_id", "chunk_index", original.alias("original_text"), F.col("_span.start").alias("start_position"), F.col("_span.end").alias("end_position"))
    digest = F.substring(F.sha2(F.concat_ws("|", F.col("document_id").cast("string"), "chunk_index", "start_position", "end_position", "original_text").cast("binary"), 256), 1, 16)
    number = F.format_string("%05d", "chunk_index")
    return rows.select(F.concat_ws("-", F.col("document_id").cast("string"), F.lit("rcts"), number, digest).alias("chunk_id"), *rows.columns)


def parent_child_chunks(sources: DataFrame, *, parent: tuple[int, int] = (500, 100), child: tuple[int, int] = (150, 30), structure_aware: bool = False) -> tuple[DataFrame, DataFrame]:
    """Parents over documents (document_id, text) or sections, and children inside each parent.

    Numbers come from counts of words: documents aren't shuffled, sections once, to add up those before.
    """
    if parent[0] < child[0] or parent[1] < child[1]:
        raise ValueError("parents must be at least as long and overlap at least as much as children")
    strategy = "hierarchical_structure_aware" if structure_aware else "hierarchical"
    if structure_aware:
        rows = sources.select("document_id", F.col("section_text").alias("text"), F.col("start_position").alias("_base"), "section_label", "section_heading")
    else:
        null = F.lit(None).cast("string")
        rows = sources.select("document_id", "text", F.lit(0).cast("bigint").alias("_base"), null.alias("section_label"), null.alias("section_heading"))

    def name(level: str, index: Column, start: Column, end: Column, owner: Column) -> Column:
        digest = tx.short_hash([F.lit(strategy), F.lit(level), F.col("document_id"), index, start, end, owner])
        return F.concat_ws("-", F.col("document_id").cast("string"), F.lit(strategy), F.lit(level), digest)

    count = lambda n, size, overlap: F.when(n == 0, 0).when(n <= size, 1).otherwise(F.ceil((n - size) / (size - overlap)) + 1).cast("bigint")
    # all parents of a source but the last are full, and have as many children each
    full = 1 + max(0, math.ceil((parent[0] - child[0]) / (child[0] - child[1])))
    if structure_aware:
        n = tx.word_count(F.col("text"))
        own = count(n, *parent)
        last = count(n - (own - 1) * (parent[0] - parent[1]), *child)
        before = Window.partitionBy("document_id").orderBy("_base").rowsBetween(Window.unboundedPreceding, -1)
        earlier = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)).cast("bigint")
        rows = rows.withColumns({"_parents": earlier(own), "_children": earlier(F.when(own > 0, (own - 1) * full + last).otherwise(0))})
    else:
        rows = rows.withColumns({"_parents": F.lit(0).cast("bigint"), "_children": F.lit(0).cast("bigint")})
    rows = rows.select("document_id", "_base", "_parents", "_children", "section_label", "section_heading", F.posexplode(word_windows(F.col("text"), *parent)).alias("_number", "_span"))
    rows = rows.select("document_id", (F.col("_parents") + F.col("_number")).alias("parent_index"), (F.col("_children") + F.col("_number") * full).alias("_first"), F.col("_span.text").alias("text"), (F.col("_base") + F.col("_span.start")).alias("start_position"), (F.col("_base") + F.col("_span.end")).alias("end_position"), "section_label", "section_heading")
    named = rows.select(name("parent", F.col("parent_index"), F.col("start_position"), F.col("end_position"), F.lit("")).alias("parent_id"), "document_id", "parent_index", "_first", F.lit(strategy).alias("strategy"), "text", "start_position", "end_position", "section_label", "section_heading")
    inner = named.select("*", F.posexplode(word_windows(F.col("text"), *child)).alias("_number", "_span"))
    start, end = F.col("start_position") + F.col("_span.start"), F.col("start_position") + F.col("_span.end")
    inner = inner.select("document_id", (F.col("_first") + F.col("_number")).alias("chunk_index"), "strategy", F.col("_span.text").alias("text"), start.alias("_start"), end.alias("_end"), "parent_id", F.col("start_position").alias("parent_start_position"), F.col("end_position").alias("parent_end_position"), "section_label", "section_heading")
    children = inner.select(name("child", F.col("chunk_index"), F.col("_start"), F.col("_end"), F.col("parent_id")).alias("chunk_id"), "document_id", "chunk_index", "strategy", "text", F.col("_start").alias("start_position"), F.col("_end").alias("end_position"), "parent_id", "parent_start_position", "parent_end_position", "section_label", "section_heading")
    return named.drop("_first"), children


def misplaced_sections(documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Sections whose text isn't what their document has at their offsets; none, if all is well."""
    met = sections.join(documents.select("document_id", F.col("text").alias("_text")), "document_id", "left")
    own = F.substring("_text", (F.col("start_position") + 1).cast("int"), (F.col("end_position") - F.col("start_position")).cast("int"))
    return met.where(~own.eqNullSafe(F.col("section_text"))).drop("_text")


def merged_intervals(spans: DataFrame, keys: list[str]) -> DataFrame:
    """Unions of overlapping or touching spans for each key (islands between gaps)."""
    order = Window.partitionBy(*keys).orderBy("start_position", "end_position")
    reach = F.max("end_position").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begun = spans.withColumn("_new", F.when(reach.isNull() | (F.col("start_position") > reach), 1).otherwise(0))
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return begun.withColumn("_island", island).groupBy(*keys, "_island").agg(F.min("start_position").alias("start_position"), F.max("end_position").alias("end_position")).drop("_island")


def chunk_violations(chunks: DataFrame, documents: DataFrame) -> DataFrame:
    """(check, document_id, chunk_id) of every broken rule: unique ids, valid offsets, exact text, covered words."""
    doc = documents.select("document_id", F.col("text").alias("_doc"))
    met = chunks.join(doc, "document_id", "left")
    own = F.substring("_doc", (F.col("start_position") + 1).cast("int"), (F.col("end_position") - F.col("start_position")).cast("int"))
    offsets = ~((F.col("start_position") >= 0) & (F.col("start_position") < F.col("end_position")) & (F.col("end_position") <= F.length("_doc")))
    checks = F.array_compact(F.array(F.when(F.coalesce(offsets, F.lit(True)), "offsets"), F.when(~own.eqNullSafe(F.col("text")), "text")))
    broken = met.select(F.explode(checks).alias("check"), "document_id", "chunk_id")
    repeated = chunks.groupBy("chunk_id").agg(F.count(F.lit(1)).alias("n"), F.min("document_id").alias("document_id")).where("n > 1").select(F.lit("duplicate_id").alias("check"), "document_id", "chunk_id")
    # gaps between merged chunks may hold only white space
    islands = merged_intervals(chunks.select("document_id", "start_position", "end_position"), ["document_id"])
    order = Window.partitionBy("document_id").orderBy("start_position")
    edges = islands.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("start_position", "end_position"))).alias("spans"))
    outside = doc.join(edges, "document_id", "left").select("document_id", "_doc", F.coalesce("spans", F.array().cast("array<struct<start_position:bigint,end_position:bigint>>")).alias("spans"))
    starts = F.concat(F.array(F.lit(0).cast("bigint")), F.transform("spans", lambda s: s["end_position"]))
    stops = F.concat(F.transform("spans", lambda s: s["start_position"]), F.array(F.length("_doc").cast("bigint")))
    gaps = F.zip_with(starts, stops, lambda a, b: F.substring("_doc", (a + 1).cast("int"), (b - a).cast("int")))
    bare = outside.where(F.exists(gaps, lambda g: g.rlike(r"(?U)\S"))).select(F.lit("coverage").alias("check"), "document_id", F.lit(None).cast("string").alias("chunk_id"))
    return broken.unionByName(repeated).unionByName(bare)


def length_distribution(lengths: DataFrame, column: str, keys: list[str] | None = None) -> DataFrame:
    """count, min, mean, median, p95 (interpolated) and max."""
    x = F.col(column)
    return lengths.groupBy(*(keys or [])).agg(F.count(x).alias("count"), F.min(x).alias("minimum"), F.avg(x).alias("mean"), F.percentile(x, F.lit(0.5)).alias("median"), F.percentile(x, F.lit(0.95)).alias("p95"), F.max(x).alias("maximum"))


def design_grid(sizes: tuple[int, ...] = (150, 300, 500), overlap_share: float = 0.2, sentence_overlaps: tuple[int, ...] = (0, 2)) -> list[dict]:
    """Named designs: fixed windows and structure-aware packing of several sizes."""
    grid = [{"name": f"fixed_{w}_{round(w * overlap_share)}", "kind": "fixed", "words": w, "overlap": round(w * overlap_share)} for w in sizes]
    return grid + [{"name": f"structure_{w}_s{s}", "kind": "structure", "words": w, "overlap": round(w * overlap_share), "sentences": s} for w in sizes for s in sentence_overlaps]


def design_chunks(documents: DataFrame, sections: DataFrame, grid: list[dict]) -> DataFrame:
    """The chunks of all designs, with the design's name as strategy."""
    out = None
    for design in grid:
        if design["kind"] == "fixed":
            made = fixed_chunks(documents, design["words"], design["overlap"], strategy=design["name"])
        else:
            made = structure_chunks(sections, words=design["words"], overlap=design["overlap"], sentences=design["sentences"], strategy=design["name"]).drop("section_label", "section_heading", "embedding_text")
        out = made if out is None else out.unionByName(made)
    return out
