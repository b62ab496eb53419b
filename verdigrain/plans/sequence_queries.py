"""Queries on chunkers whose next start depends on the last end, and their SQL as recursive steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrain.functions import text as tx
from verdigrain.operators import chunking
from verdigrain.plans import derived as d
from verdigrain.plans.catalogue import register
from verdigrain.plans.text_queries import _whole, summary_diagnostics

_COLUMNS = ("chunk_id", "document_id", "chunk_index", "start_position", "end_position")


def _spans(chunks: DataFrame) -> DataFrame:
    return chunks.select(*[F.col(c).cast("bigint").alias(c) if c == "chunk_index" else c for c in _COLUMNS])


def greedy_sentence_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences packed into 100 words with bridges of 20, and a short end filled up."""
    return _spans(chunking.structure_chunks(_whole(spark, sf_dir, "unknown"), words=100, overlap=20, backfill=True))


_SQL_WORDS = r"""
wp AS (SELECT document_id, i, piece, sum(length(piece)) OVER (PARTITION BY document_id ORDER BY i) AS en FROM (SELECT document_id, unnest(regexp_extract_all(text, '\s*\S+')) AS piece, unnest(range(1, len(regexp_extract_all(text, '\s*\S+')) + 1)) AS i FROM dx)),
wb AS (SELECT document_id, i, piece, CAST(en - length(regexp_extract(piece, '\S+')) AS BIGINT) AS st, CAST(en AS BIGINT) AS en FROM wp)"""

register("greedy_sentence_chunks", greedy_sentence_chunks, rf"""WITH RECURSIVE dx AS (SELECT doc_id AS document_id, text FROM documents),{_SQL_WORDS},
cu AS (SELECT document_id, list_sort(list_distinct(list_concat([0], list(i) FILTER (regexp_matches(piece, '[.!?;]$')), [max(i)]))) AS c FROM wb GROUP BY 1),
k AS (SELECT document_id, c, 0 AS step, 0 AS k FROM cu UNION ALL
  SELECT document_id, c, step + 1, CASE WHEN c[k + 2] - c[k + 1] > 100 THEN k + 1 ELSE least(stop, greatest(k + 1, stop - 2, len(list_filter(c, lambda x: x < c[stop + 2] - 100)))) END
  FROM (SELECT *, len(list_filter(c, lambda x: x <= c[k + 1] + 100)) - 1 AS stop FROM k WHERE k < len(c) - 1) WHERE c[k + 2] - c[k + 1] > 100 OR stop < len(c) - 1),
ru AS (SELECT document_id, step, 0 AS j, c[k + 1] AS a, c[len(list_filter(c, lambda x: x <= c[k + 1] + 100))] AS z FROM k WHERE k < len(c) - 1 AND c[k + 2] - c[k + 1] <= 100
  UNION ALL SELECT document_id, step, j, a + 80 * j, least(a + 80 * j + 100, z) FROM (SELECT document_id, step, c[k + 1] AS a, c[k + 2] AS z, unnest(range(0, CAST(ceil((c[k + 2] - c[k + 1] - 100) / 80.0) AS BIGINT) + 1)) AS j FROM k WHERE k < len(c) - 1 AND c[k + 2] - c[k + 1] > 100)),
rn AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY step, j) AS p FROM ru),
jo AS (SELECT document_id, p, a, z, CAST(NULL AS BIGINT) AS ba, CAST(NULL AS BIGINT) AS bz FROM rn WHERE p = 1 UNION ALL
  SELECT n.document_id, n.p, CASE WHEN n.a >= jo.z AND least(20, jo.z - jo.a) + n.z - n.a <= 100 THEN jo.z - least(20, jo.z - jo.a) ELSE n.a END, n.z,
    CASE WHEN n.a >= jo.z AND least(20, jo.z - jo.a) + n.z - n.a > 100 THEN jo.z - least(20, jo.z - jo.a) END, CASE WHEN n.a >= jo.z AND least(20, jo.z - jo.a) + n.z - n.a > 100 THEN n.a + 100 - least(20, jo.z - jo.a) END FROM jo JOIN rn n ON n.document_id = jo.document_id AND n.p = jo.p + 1),
al AS (SELECT document_id, p, 1 AS o, a, z FROM jo UNION ALL SELECT document_id, p, 0, ba, bz FROM jo WHERE ba IS NOT NULL),
od AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY p, o) - 1 AS x, count(*) OVER (PARTITION BY document_id) AS n FROM al),
bf AS (SELECT document_id, x, CASE WHEN n > 1 AND x = n - 1 AND z - a <= 50 AND z > 100 THEN z - 100 ELSE a END AS a, z FROM od)
SELECT bf.document_id || '-structure_aware-' || substr(sha1('structure_aware|' || bf.document_id || '|' || x || '|' || s.st || '|' || e.en), 1, 12) AS chunk_id, bf.document_id, x AS chunk_index, s.st AS start_position, e.en AS end_position FROM bf JOIN wb s ON s.document_id = bf.document_id AND s.i = a + 1 JOIN wb e ON e.document_id = bf.document_id AND e.i = z""")


def rhetorical_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with a turn of argument before every 37th, cut into windows of at most 100 that end at turns."""
    words = F.filter(F.split(tx.squeezed(F.col("text")), " "), lambda w: w != "")
    turned = F.flatten(F.transform(words, lambda w, i: F.when((i > 0) & (i % 37 == 0), F.array(F.lit("menimbang"), F.lit("bahwa"), w)).otherwise(F.array(w))))
    docs = d.documents(spark, sf_dir).select("document_id", F.array_join(turned, " ").alias("section_text")).where("section_text <> ''")
    rows = docs.select("document_id", F.lit("fakta").alias("section_label"), F.lit(None).cast("string").alias("section_heading"), F.lit(0).cast("bigint").alias("start_position"), F.length("section_text").cast("bigint").alias("end_position"), "section_text")
    return _spans(chunking.structure_chunks(rows, words=100, overlap=20, mode="legal_rhetorical", context="section"))


register("rhetorical_chunks", rhetorical_chunks, rf"""WITH RECURSIVE ow AS (SELECT doc_id AS document_id, regexp_extract_all(text, '\S+') AS w FROM documents),
dx AS (SELECT document_id, array_to_string(flatten(list_transform(w, lambda x, i: CASE WHEN i > 1 AND (i - 1) % 37 = 0 THEN ['menimbang', 'bahwa', x] ELSE [x] END)), ' ') AS text FROM ow WHERE len(w) > 0),{_SQL_WORDS},
tn AS (SELECT document_id, max(i) AS n, coalesce(list(i - 1) FILTER (trim(piece) = 'menimbang'), []) AS t FROM wb GROUP BY 1),
r AS (SELECT document_id, n, t, 0 AS p, 0 AS a, CASE WHEN n <= 100 THEN n ELSE coalesce(list_max(list_filter(t, lambda x: x <= 100 AND x >= 70)), 100) END AS z FROM tn UNION ALL
  SELECT document_id, n, t, p + 1, z - 20, CASE WHEN n <= z + 80 THEN n ELSE coalesce(list_max(list_filter(t, lambda x: x <= z + 80 AND x >= z + 50)), z + 80) END FROM r WHERE z < n)
SELECT r.document_id || '-structure_aware-' || substr(sha1('structure_aware|' || r.document_id || '|' || p || '|' || s.st || '|' || e.en), 1, 12) AS chunk_id, r.document_id, CAST(p AS BIGINT) AS chunk_index, s.st AS start_position, e.en AS end_position FROM r JOIN wb s ON s.document_id = r.document_id AND s.i = a + 1 JOIN wb e ON e.document_id = r.document_id AND e.i = z""")


def recursive_char_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical chunks of at most 500 characters that end after the most telling separator."""
    return _spans(chunking.recursive_chunks(d.documents(spark, sf_dir)))


def _end(separator: str) -> str:
    """Characters of the window up to and with a separator's last place, if they are enough."""
    s = separator.replace("\n", "' || chr(10) || '")
    return f"CASE WHEN position('{s}' IN v) > 0 AND length(v) - position('{s}' IN reverse(v)) + 1 >= 250 THEN length(v) - position('{s}' IN reverse(v)) + 1 END"


register("recursive_char_chunks", recursive_char_chunks, f"""WITH RECURSIVE c AS (SELECT doc_id, 0 AS p, CAST(0 AS BIGINT) AS a, CAST(0 AS BIGINT) AS z FROM documents WHERE length(text) > 0 UNION ALL
  SELECT doc_id, p + 1, z, CASE WHEN z + 500 >= n THEN n ELSE z + coalesce({", ".join(_end(s) for s in chunking.SEPARATORS if s)}, 500) END FROM (SELECT c.*, length(text) AS n, substring(text, z + 1, 500) AS v FROM c JOIN documents USING (doc_id) WHERE z < length(text))),
b AS (SELECT doc_id, p, a, substring(text, a + 1, z - a) AS v FROM c JOIN documents USING (doc_id) WHERE p > 0),
t AS (SELECT doc_id, p, a + length(v) - length(ltrim(v, e' \\n\\t\\r\\x0b\\x0c')) AS s, trim(v, e' \\n\\t\\r\\x0b\\x0c') AS v FROM b WHERE trim(v, e' \\n\\t\\r\\x0b\\x0c') <> ''),
x AS (SELECT doc_id AS document_id, row_number() OVER (PARTITION BY doc_id ORDER BY p) - 1 AS i, s, s + length(v) AS e, v FROM t)
SELECT document_id || '-rcts-' || lpad(CAST(i AS VARCHAR), 5, '0') || '-' || substr(sha256(document_id || '|' || i || '|' || s || '|' || e || '|' || v), 1, 16) AS chunk_id, document_id, i AS chunk_index, s AS start_position, e AS end_position FROM x""")


def summary_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries that are a document's head with a number and foreign words put in for some, checked against the whole text."""
    from verdigrain.operators import augment

    head = tx.head_at_word(F.col("text"), 150)
    odd = F.col("document_id") % 5
    said = F.when(odd == 1, F.concat(head, F.lit(" 987654321.5"))).when(odd == 2, F.lit("zzqx qqzy")).when(odd == 3, F.concat(F.lit("yang "), head)).otherwise(head)
    out = augment.diagnostics(d.documents(spark, sf_dir).where("length(text) > 0").select("document_id", said.alias("summary"), F.col("text").alias("source")))
    return out.select("document_id", F.array_join("unsupported_number_tokens", "|").alias("unsupported"), F.round("lexical_support_ratio", 6).alias("lexical_support_ratio"), "unexpected_language", F.array_join("quality_flags", "|").alias("flags"), "automated_quality_status")


from verdigrain.operators.augment import LANGUAGE_MARKERS  # noqa: E402
from verdigrain.plans.decisions import sql_head  # noqa: E402

_LOW = "replace(lower({0}), 'ß', 'ss')"
_SQL_DIAGNOSED = rf"""WITH x AS (SELECT doc_id AS document_id, text, trim(regexp_replace(text, '\s+', ' ', 'g')) AS q FROM documents WHERE length(text) > 0), h AS (SELECT *, {sql_head('q', 150)} AS head FROM x),
s AS (SELECT document_id, text, #SAID AS summary FROM h),
w AS (SELECT *, list_distinct(regexp_extract_all({_LOW.format('summary')}, '[a-z]+')) AS sw, list_distinct(regexp_extract_all({_LOW.format('text')}, '[a-z]+')) AS tw, #NUMBER AS u FROM s),
r AS (SELECT *, CASE WHEN len(sw) > 0 THEN len(list_intersect(sw, tw)) / len(sw) ELSE 1.0 END AS r FROM w), f AS (SELECT *, len(sw) > 0 AND len(list_intersect(sw, [{", ".join(f"'{m}'" for m in LANGUAGE_MARKERS)}])) = 0 AND r < 0.5 AS foreign_ FROM r)
SELECT document_id, u AS unsupported, round(r, 6) AS lexical_support_ratio, foreign_ AS unexpected_language, array_to_string(list_filter([CASE WHEN trim(summary, e' \n\t') = '' THEN 'empty' END, CASE WHEN length(summary) > 170 THEN 'over_length' END, CASE WHEN length(summary) < 50 THEN 'very_short' END, CASE WHEN u <> '' THEN 'unsupported_number' END, CASE WHEN r < 0.35 THEN 'low_lexical_support' END, CASE WHEN foreign_ THEN 'unexpected_language' END], lambda x: x IS NOT NULL), '|') AS flags,
CASE WHEN trim(summary, e' \n\t') = '' OR length(summary) > 170 OR length(summary) < 50 OR u <> '' OR r < 0.35 OR foreign_ THEN 'flagged' ELSE 'pass' END AS automated_quality_status FROM f"""

register("summary_faults", summary_faults, _SQL_DIAGNOSED.replace("#SAID", "CASE document_id % 5 WHEN 1 THEN head || ' 987654321.5' WHEN 2 THEN 'zzqx qqzy' WHEN 3 THEN 'yang ' || head ELSE head END").replace("#NUMBER", "CASE WHEN document_id % 5 = 1 AND NOT contains(text, '987654321.5') THEN '987654321.5' ELSE '' END"))
# a head's own numbers are all in its text, but one that is cut may not be
register("summary_diagnostics", summary_diagnostics, _SQL_DIAGNOSED.replace("WHERE length(text) > 0)", ")").replace("#SAID", "head").replace("#NUMBER", "array_to_string(list_sort(list_filter(list_distinct(regexp_extract_all(summary, '\\b[0-9]+([.,][0-9]+)*\\b')), lambda x: NOT list_contains(regexp_extract_all(text, '\\b[0-9]+([.,][0-9]+)*\\b'), x))), '|')"))
