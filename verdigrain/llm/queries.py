"""One query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrain.llm import exact_dedup, html_crf, jaccard_join, language_id, license_scan, media_jpeg, mixing, packing, secrets, warc
from verdigrain.llm.shared import stored
from verdigrain.session import table


#: Loss-bearing tokens of a sequence: below its 2,048 tokens, so that sequences without prompts are closed by it; they have 16 tokens of padding.
LOSS_TOKENS = 2032


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents"))
    own, labels = F.col("base_spans"), lambda c: F.transform(c, lambda s: s["label"])
    first = F.transform(own, lambda s: s["first"])
    joined = lambda c: F.array_join(F.array_sort(F.array_distinct(c)), ",")
    return found.select(
        "doc_id", "n_words", F.size(own).cast("long").alias("n_base"),
        F.array_min(first).alias("first_word"), F.array_max(first).alias("last_word"),
        joined(labels(own)).alias("base_labels"), joined(F.concat(labels(own), labels(F.col("spans")))).alias("labels"), "score",
    )


def op2_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A document's first line is its prompt; the rest bears loss."""
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_file=public_tokenizers.path("byte_bpe_50k.json"), prompt_end="\n", max_loss_tokens=LOSS_TOKENS)


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.fit(docs)
    return language_id.identify(docs, model, keep=["doc_id"]).select("doc_id", language_id.held_out().alias("held_out"), "lang_pred", "score")


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=(5, 2, 1))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op7_media_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored(media_jpeg.store(table(spark, sf_dir, "documents")), "media")
    found = media_jpeg.features(media)
    feature = F.concat_ws(":", F.concat("width", F.lit("x"), "height"), "thumb_hash")
    return found.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"), "width", "height", "thumb_hash")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages have no date: theirs are spread over some years by their ids."""
    second = F.lit(883_612_800) + F.pmod(F.coalesce("page_id", F.lit(0)) * 7919, F.lit(500_000_000))
    pages = table(spark, sf_dir, "pages").withColumn("_date", F.date_format(F.timestamp_seconds(second), "yyyyMMddHHmmss"))
    return warc.resolved(warc.read_archives(spark, warc.archived(pages, date_column="_date")))


def op9_html_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract(table(spark, sf_dir, "pages"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", *[count(k) for k in secrets.KINDS], F.sha2(secrets.joined(base), 256).alias("base_sha256"), secrets.joined(F.col("spans")).alias("spans"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and name[2].isdigit()}


_MIX_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1] AS weight FROM d GROUP BY 1),
o AS (SELECT *, sum(source_size) OVER () AS total, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER b, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER b, 0) AS weights, row_number() OVER (ORDER BY source_size / weight, source IS NULL, source) AS place
  FROM s WINDOW b AS (ORDER BY source_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT place, rest, weights FROM o WHERE NOT CAST(rest AS DOUBLE) * weight / weights > 3 * source_size ORDER BY place LIMIT 1),
t AS (SELECT source, source_size, CASE WHEN total = 0 THEN 0.0::DOUBLE WHEN o.place < l.place THEN CAST(3 * source_size AS DOUBLE) ELSE CAST(l.rest AS DOUBLE) * weight / l.weights END AS target FROM o CROSS JOIN l),
g AS (SELECT *, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS repeats, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) % source_size END AS budget FROM t),
c AS (SELECT source, h, words, sum(words) OVER (PARTITION BY source ORDER BY h) AS upto FROM (SELECT source, h, sum(size) AS words FROM d GROUP BY 1, 2))
SELECT doc_id, size, source_size, target, CAST(size * repeats + CASE WHEN upto <= budget THEN size WHEN upto - words <= budget AND words > 0 THEN size * (budget - (upto - words)) // words ELSE 0 END AS BIGINT) AS taken
FROM d JOIN g ON g.source IS NOT DISTINCT FROM d.source JOIN c ON c.source IS NOT DISTINCT FROM d.source AND c.h = d.h"""

_DEDUP_SQL = """
WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS h, row_number() OVER (PARTITION BY sha256(coalesce(text, '')), doc_id) AS r FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY h) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size, doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY h) AND r = 1 AS kept, h AS text_sha256 FROM d"""


def oracle_sql() -> dict[str, str]:
    """SQL of the two that SQL can express; the others rest on trained models, automata, tokenizers or file formats."""
    return {"op5_source_mixing": _MIX_SQL, "op6_exact_dedup": _DEDUP_SQL}
