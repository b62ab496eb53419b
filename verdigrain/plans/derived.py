"""Tables that several queries start from, over the standard data folder, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrain.operators import chunking, groundtruth, retrieval
from verdigrain.session import dropped_tables, stored, table

WORDS, OVERLAP = 150, 30


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), "text")


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def ordered(chunks: DataFrame) -> DataFrame:
    """Chunks with one column that keeps their order, by document and number."""
    return chunks.withColumn("chunk_ord", F.struct("document_id", "chunk_index"))


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordered(chunking.fixed_chunks(documents(spark, sf_dir), WORDS, OVERLAP))


def _told(mentions: DataFrame) -> DataFrame:
    return mentions.select("document_id", F.explode("found").alias("e")).select("e.query_id", "document_id", "e.evidence_start", "e.evidence_end")


def evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id, document_id, evidence_start, evidence_end of the first verbatim mention of each question in each document, stored."""
    return stored(_told(groundtruth.mentions(questions(spark, sf_dir), documents(spark, sf_dir))), "evidence")


def postings(spark: SparkSession, sf_dir: str, held: list[str] | None = None) -> DataFrame:
    """The chunks' postings for all questions, stored: runs of any settings share them."""
    return retrieval.bm25_postings(questions(spark, sf_dir), chunks(spark, sf_dir), held)


def run(spark: SparkSession, sf_dir: str, k: int = 10, own: DataFrame | None = None, **parameters) -> DataFrame:
    """A BM25 run with documents: query_id, chunk_id, rank, score, document_id. own: postings that exist already.

    Stored: k rows for each question, which metrics read several times; postings made for it alone are deleted.
    """
    held: list[str] = []
    best = retrieval.bm25_scanned(questions(spark, sf_dir), postings(spark, sf_dir, held) if own is None else own, k, **parameters)
    # the order column has the document in it: no second look at the chunks
    found = stored(best.select("query_id", "chunk_id", "rank", "score", "chunk_ord.document_id"), "run")
    dropped_tables(spark, held)
    return found


def found_chunks(spark: SparkSession, sf_dir: str, found: DataFrame) -> DataFrame:
    """The chunks of the documents in a run: only those texts are cut. Ids are stored, so that Spark knows how few they are."""
    ids = stored(found.select("document_id").distinct(), "found")
    return ordered(chunking.fixed_chunks(documents(spark, sf_dir).join(ids, "document_id", "left_semi"), WORDS, OVERLAP))


def qrels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence mapped to chunks, stored: metrics read it several times. Only documents with evidence are cut into chunks."""
    held: list[str] = []
    met = stored(groundtruth.mentions(questions(spark, sf_dir), documents(spark, sf_dir)), "mentions", held)
    found = stored(groundtruth.qrel_candidates(_told(met), ordered(chunking.fixed_chunks(met.select("document_id", "text"), WORDS, OVERLAP))), "qrels")
    dropped_tables(spark, held)
    return found


SQL_CHUNKS = r"""
w AS (SELECT document_id, i, piece, sum(length(piece)) OVER (PARTITION BY document_id ORDER BY i) AS en FROM (
  SELECT doc_id AS document_id, unnest(regexp_extract_all(text, '\s*\S+')) AS piece, unnest(range(1, len(regexp_extract_all(text, '\s*\S+')) + 1)) AS i FROM documents)),
ws AS (SELECT document_id, i, en - length(regexp_extract(piece, '\S+')) AS st, en FROM w),
nw AS (SELECT document_id, max(i) AS n FROM w GROUP BY 1),
win AS (SELECT document_id, n, unnest(range(0, CASE WHEN n <= 150 THEN 1 ELSE CAST(ceil((n - 150) / 120.0) AS BIGINT) + 1 END)) AS j FROM nw),
span AS (SELECT win.document_id, win.j AS chunk_index, CAST(a.st AS BIGINT) AS start_position, CAST(b.en AS BIGINT) AS end_position FROM win
  JOIN ws a ON a.document_id = win.document_id AND a.i = win.j * 120 + 1 JOIN ws b ON b.document_id = win.document_id AND b.i = least(win.j * 120 + 150, win.n)),
chunks AS (SELECT span.document_id || '-fixed-' || substr(sha1('fixed|' || span.document_id || '|' || chunk_index || '|' || start_position || '|' || end_position), 1, 12) AS chunk_id,
  span.document_id, chunk_index, start_position, end_position, substring(d.text, start_position + 1, end_position - start_position) AS text
  FROM span JOIN documents d ON d.doc_id = span.document_id)"""

SQL_TOKENS = r"list_filter(string_split(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '')"

SQL_BM25 = (
    SQL_CHUNKS
    + r""",
ct AS (SELECT chunk_id, chunk_index, document_id, """ + SQL_TOKENS.format("text") + r""" AS t FROM chunks),
st AS (SELECT count(*) AS n, avg(len(t)) AS average FROM ct),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest(""" + SQL_TOKENS.format("text") + r""") AS term FROM benchmark) GROUP BY 1, 2),
tf AS (SELECT chunk_id, chunk_index, document_id, size, term, count(*) AS tf FROM (SELECT chunk_id, chunk_index, document_id, len(t) AS size, unnest(t) AS term FROM ct) GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY 1)"""
)


def sql_scores(name: str, k1: float = 1.2, b: float = 0.75) -> str:
    return f""",
{name}_score AS (SELECT qt.query_id, tf.chunk_id, tf.chunk_index, tf.document_id, round(sum(qtf * ln(1 + (st.n - df.df + 0.5) / (df.df + 0.5)) * (tf.tf * ({k1} + 1) / (tf.tf + {k1} * (1 - {b} + {b} * tf.size / st.average)))), 9) AS score
  FROM tf JOIN qt USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY ALL)"""


def sql_run(name: str, k: int = 10, k1: float = 1.2, b: float = 0.75) -> str:
    return sql_scores(name, k1, b) + f""",
{name} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, document_id, chunk_index) AS rank FROM {name}_score) WHERE rank <= {k})"""


SQL_EVIDENCE = """
ev AS (SELECT b.item_id AS query_id, d.doc_id AS document_id, position(b.text IN d.text) - 1 AS evidence_start, position(b.text IN d.text) - 1 + length(b.text) AS evidence_end FROM documents d JOIN benchmark b ON position(b.text IN d.text) > 0),
qrels AS (SELECT ev.query_id, c.document_id, ev.query_id || ':' || evidence_start || ':' || evidence_end AS evidence_id, c.chunk_id, c.start_position AS chunk_start, c.end_position AS chunk_end, evidence_start, evidence_end,
  (least(c.end_position, evidence_end) - greatest(c.start_position, evidence_start)) / (evidence_end - evidence_start) AS evidence_coverage, CASE WHEN c.start_position <= evidence_start AND evidence_end <= c.end_position THEN 2 ELSE 1 END AS auto_grade
  FROM chunks c JOIN ev ON c.document_id = ev.document_id AND c.start_position < evidence_end AND evidence_start < c.end_position)"""
