"""Evidence spans mapped to chunks by interval joins, and checks of questions."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verdigrain.functions import text as tx
from verdigrain.session import on_workers

# States of a question, and answers that are only a field's name.
STATUSES = ("draft", "reviewed", "approved", "rejected")
DIFFICULTIES = ("easy", "medium", "hard")
FIELD_LABELS = ("umur", "tanggal", "tempat", "nama")


def _overlaps(a: str, b: str) -> Column:
    return (F.col(f"{a}.document_id") == F.col(f"{b}.document_id")) & (F.col(f"{a}.start_position") < F.col(f"{b}.evidence_end")) & (F.col(f"{b}.evidence_start") < F.col(f"{a}.end_position"))


def mentions(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """document_id, text, found of the documents that hold a question verbatim: found has query_id, evidence_start, evidence_end of each question's first place.

    One pass over the texts, which stay in their tasks: nothing is shuffled. A text that holds a question
    holds its inner words between blanks; the longest of them tells which questions to look for. A question
    of one or two words is looked for in all texts. The driver holds the questions.
    """
    on_workers(documents.sparkSession)
    kinds = dict(questions.dtypes) | dict(documents.dtypes)
    known = documents.sparkSession.sparkContext.broadcast(questions.where("question IS NOT NULL").select("query_id", "question").toArrow().combine_chunks())

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = known.value["question"].to_pylist()
        always, by_word = [], {}
        for q, question in enumerate(asked):
            inner = question.split()[1:-1]
            (by_word.setdefault(max(inner, key=len), []) if inner else always).append(q)
        ids = known.value["query_id"].combine_chunks() if asked else None
        for batch in batches:
            rows, ends, which, starts, stops = [], [0], [], [], []
            for row, text in enumerate(batch.column(1).to_pylist()):
                if text is None:
                    continue
                for q in [*always, *(q for word in by_word.keys() & set(text.split()) for q in by_word[word])]:
                    at = text.find(asked[q])
                    if at >= 0:
                        which.append(q)
                        starts.append(at)
                        stops.append(at + len(asked[q]))
                if len(which) > ends[-1]:
                    rows.append(row)
                    ends.append(len(which))
            if rows:
                spans = pa.StructArray.from_arrays([ids.take(pa.array(which, pa.int64())), pa.array(starts, pa.int64()), pa.array(stops, pa.int64())], ["query_id", "evidence_start", "evidence_end"])
                own = batch.take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([*own.columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), spans)], names=["document_id", "text", "found"])

    return documents.select("document_id", "text").mapInArrow(held, f"document_id {kinds['document_id']}, text string, found array<struct<query_id:{kinds['query_id']},evidence_start:bigint,evidence_end:bigint>>")


def qrel_candidates(questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """Every chunk that overlaps a question's evidence: coverage, and grade 2 if it holds all of it, else 1.

    questions: query_id, document_id, evidence_start, evidence_end [, review_status: only approved ones
    count]. The join is on document and position.
    """
    if "review_status" in questions.columns:
        questions = questions.where(F.lower(F.trim("review_status")) == "approved")
    c, q = chunks.alias("c"), questions.select("query_id", "document_id", "evidence_start", "evidence_end").alias("q")
    shared = F.least("c.end_position", "q.evidence_end") - F.greatest("c.start_position", "q.evidence_start")
    whole = (F.col("c.start_position") <= F.col("q.evidence_start")) & (F.col("q.evidence_end") <= F.col("c.end_position"))
    grade = F.when(whole, 2).otherwise(1)
    return c.join(q, _overlaps("c", "q")).select(
        F.col("q.query_id").alias("query_id"), F.col("c.document_id").alias("document_id"), F.concat_ws(":", F.col("q.query_id").cast("string"), "q.evidence_start", "q.evidence_end").alias("evidence_id"), F.col("c.chunk_id").alias("chunk_id"),
        F.col("c.start_position").alias("chunk_start"), F.col("c.end_position").alias("chunk_end"), F.col("q.evidence_start").alias("evidence_start"), F.col("q.evidence_end").alias("evidence_end"),
        (shared / (F.col("q.evidence_end") - F.col("q.evidence_start"))).alias("evidence_coverage"), grade.alias("auto_grade"), F.when(whole, 2).alias("relevance_grade"),
    )


def uncovered(questions: DataFrame, qrels: DataFrame) -> DataFrame:
    """Questions that no chunk overlaps."""
    return questions.join(qrels.select("query_id").distinct(), "query_id", "left_anti")


def positive_qrels(questions: DataFrame, chunks: DataFrame, sections: DataFrame) -> DataFrame:
    """Chunks that hold all of the evidence, or another literal mention of the cited article in the reasoning section.

    questions also have evidence_text and target_section_label. Mentions are found by splitting at the
    text itself, in any case.
    """
    whole = qrel_candidates(questions, chunks).where("auto_grade = 2").select("query_id", "document_id", "chunk_id")
    asked = questions.where("target_section_label = 'pertimbangan_hukum' AND length(evidence_text) > 0").select("query_id", "document_id", F.lower("evidence_text").alias("needle"))
    own = sections.where("section_label = 'pertimbangan_hukum'").select("document_id", "start_position", F.lower("section_text").alias("hay"))
    pieces = F.split("hay", F.concat(F.lit("\\Q"), F.col("needle"), F.lit("\\E")), -1)
    # a mention begins after each piece but the last
    sized = F.transform(pieces, lambda p: F.length(p).cast("bigint"))
    begins = F.transform(F.sequence(F.lit(1), F.size(pieces) - 1), lambda i: F.col("start_position") + F.aggregate(F.slice(sized, F.lit(1), i), F.lit(0).cast("bigint"), lambda s, x: s + x) + (i - 1) * F.length("needle"))
    places = own.join(asked, "document_id").where(F.size(pieces) > 1).select("query_id", "document_id", F.explode(begins).alias("s"), F.length("needle").alias("n"))
    c, m = chunks.alias("c"), places.alias("m")
    more = c.join(m, (F.col("c.document_id") == F.col("m.document_id")) & (F.col("c.start_position") <= F.col("m.s")) & (F.col("m.s") + F.col("m.n") <= F.col("c.end_position"))).select("m.query_id", "c.document_id", "c.chunk_id")
    return whole.unionByName(more).dropDuplicates(["query_id", "chunk_id"])


def question_violations(questions: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, problem) of every broken rule."""
    ids = questions.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    met = questions.join(ids, "query_id").join(documents.select("document_id", F.col("text").alias("_doc")), "document_id", "left")
    bounds = (F.col("evidence_start") >= 0) & (F.col("evidence_start") < F.col("evidence_end")) & (F.col("evidence_end") <= F.length("_doc"))
    part = F.substring("_doc", (F.col("evidence_start") + 1).cast("int"), (F.col("evidence_end") - F.col("evidence_start")).cast("int"))
    checks = F.array_compact(F.array(
        F.when(F.col("_n") > 1, "duplicate_query_id"), F.when(F.col("_doc").isNull(), "unknown_document"), F.when(~F.coalesce(F.col("review_status").isin(*STATUSES), F.lit(False)), "invalid_status"),
        F.when(~F.coalesce(F.col("difficulty").isin(*DIFFICULTIES), F.lit(False)), "invalid_difficulty"), F.when(F.coalesce(tx.stripped(F.col("question")), F.lit("")) == "", "blank_question"), F.when(F.coalesce(tx.stripped(F.col("reference_answer")), F.lit("")) == "", "blank_answer"),
        F.when(F.col("_doc").isNotNull() & ~F.coalesce(bounds, F.lit(False)), "invalid_span"), F.when(bounds & (tx.stripped(part) == ""), "blank_span"),
    ))
    return met.select("query_id", F.explode(checks).alias("problem"))


def question_audit(questions: DataFrame, documents: DataFrame, sections: DataFrame) -> DataFrame:
    """Each question with automatic_flags (an array) and automatic_status."""
    ids = questions.groupBy("query_id").agg(F.count(F.lit(1)).alias("_n"))
    own = sections.select("document_id", "section_label", F.col("start_position").alias("s"), F.col("end_position").alias("e")).alias("s")
    q = questions.alias("q")
    hit = q.join(own, (F.col("q.document_id") == F.col("s.document_id")) & (F.col("s.s") < F.col("q.evidence_end")) & (F.col("q.evidence_start") < F.col("s.e")) & (F.col("s.section_label") == F.col("q.target_section_label"))).select("q.query_id", "q.document_id").distinct().withColumn("_hit", F.lit(True))
    met = questions.join(ids, "query_id").join(documents.select("document_id", F.col("text").alias("_doc")), "document_id", "left").join(hit, ["query_id", "document_id"], "left")
    known = F.col("_doc").isNotNull()
    bounds = F.coalesce((F.col("evidence_start") >= 0) & (F.col("evidence_start") < F.col("evidence_end")) & (F.col("evidence_end") <= F.length("_doc")), F.lit(False))
    evidence = F.substring("_doc", (F.col("evidence_start") + 1).cast("int"), (F.col("evidence_end") - F.col("evidence_start")).cast("int"))
    answer, question = tx.squeezed(F.coalesce("reference_answer", F.lit(""))), tx.squeezed(F.coalesce("question", F.lit("")))
    flags = F.array_compact(F.array(
        F.when(F.col("_n") > 1, "duplicate_query_id"), F.when(~known, "unknown_document"), F.when(known & ~bounds, "invalid_evidence_offsets"),
        F.when(known & bounds & (tx.folded(tx.squeezed(evidence)) != tx.folded(answer)), "answer_span_mismatch"), F.when(known & bounds & F.col("_hit").isNull(), "target_section_mismatch"),
        F.when((F.length(answer) < 2) | answer.rlike("^[0-9]{1,2}$"), "implausibly_short_answer"), F.when(tx.folded(answer).isin(*FIELD_LABELS), "field_label_as_answer"),
        F.when(F.length(question) > 300, "excessive_question_length"), F.when(tx.folded(question).contains("tidak dilahirkan"), "malformed_identity_question"),
    ))
    return met.withColumn("automatic_flags", flags).withColumn("automatic_status", F.when(F.size("automatic_flags") > 0, "exclude_pending_human_review").otherwise("include_exploratory_only")).drop("_n", "_doc", "_hit")


def audit_histogram(audited: DataFrame) -> DataFrame:
    """flag and count; questions without a flag count as 'none'."""
    flags = F.when(F.size("automatic_flags") > 0, F.col("automatic_flags")).otherwise(F.array(F.lit("none")))
    return audited.select(F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("count"))


def dataset_audit(documents: DataFrame, sections: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """(check, count) of duplicates, empty texts, missing labels and texts that sections don't rebuild."""
    same = documents.groupBy(F.sha2("text", 256).alias("h")).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("count")).select(F.lit("duplicate_texts").alias("check"), "count")
    empty = documents.agg(F.count_if(F.coalesce(F.length("text"), F.lit(0)) == 0).alias("count")).select(F.lit("empty_texts").alias("check"), "count")
    labels = sections.groupBy("document_id").agg(F.collect_set("section_label").alias("l"))
    met = documents.select("document_id", "text").join(labels, "document_id", "left")
    missing = met.agg(F.count_if(F.size(F.array_except(F.array(*map(F.lit, required)), F.coalesce("l", F.array().cast("array<string>")))) > 0).alias("count")).select(F.lit("missing_labels").alias("check"), "count")
    rebuilt = sections.groupBy("document_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start_position", "section_text"))), lambda s: s["section_text"]), "").alias("t"))
    lost = documents.join(rebuilt, "document_id", "left").agg(F.count_if(~F.col("t").eqNullSafe(F.col("text"))).alias("count")).select(F.lit("not_rebuilt").alias("check"), "count")
    return same.unionByName(empty).unionByName(missing).unionByName(lost)
