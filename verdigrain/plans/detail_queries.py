"""Queries on single string functions, on tables with faults put in, on files, windows and vectors.

Faults follow from keys, so the SQL can say which rows must be told.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdigrain.functions import text as tx
from verdigrain.functions.arrays import at
from verdigrain.operators import augment, chunking, embedding, groundtruth, metrics, relational, retrieval, sections
from verdigrain.plans import derived as d
from verdigrain.plans.catalogue import register
from verdigrain.plans.decisions import sql_head
from verdigrain.plans.text_queries import line_sections
from verdigrain.session import fresh_path, stored, table
from verdigrain.sources import files

_SQ = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


def word_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of every document with its span."""
    return d.documents(spark, sf_dir).select("document_id", F.posexplode(tx.word_spans(F.col("text"))).alias("word", "s")).select("document_id", F.col("word").cast("bigint").alias("word"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))


register("word_offsets", word_offsets, r"""WITH w AS (SELECT doc_id AS document_id, i, piece, sum(length(piece)) OVER (PARTITION BY doc_id ORDER BY i) AS en FROM (SELECT doc_id, unnest(regexp_extract_all(text, '\s*\S+')) AS piece, unnest(range(0, len(regexp_extract_all(text, '\s*\S+')))) AS i FROM documents))
SELECT document_id, i AS word, CAST(en - length(regexp_extract(piece, '\S+')) AS BIGINT) AS start, CAST(en AS BIGINT) AS "end" FROM w""")


def string_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Heads, tails, excerpts, previews and slugs of all documents."""
    t = F.col("text")
    return d.documents(spark, sf_dir).select("document_id", tx.head_at_word(t, 80).alias("head"), tx.tail_at_word(t, 80).alias("tail"), tx.excerpt(t, 160).alias("excerpt"), tx.excerpt(t, 160, trim_tail=False).alias("plain_excerpt"), tx.preview(t, 100).alias("preview"), tx.slug(F.substring(t, 1, 40)).alias("slug"), tx.short_hash([t, F.col("document_id")]).alias("hash"))


_TAIL = "CASE WHEN length(q) <= 80 THEN q WHEN position(' ' IN right(q, 80)) = 0 THEN right(q, 80) ELSE ltrim(regexp_replace(right(q, 80), '^[^ ]* ', ''), ' ,;:-') END"
register("string_cuts", string_cuts, f"""WITH x AS (SELECT doc_id, text, {_SQ} AS q FROM documents), y AS (SELECT *, {sql_head('q', 80)} AS head, {_TAIL} AS tail FROM x)
SELECT doc_id AS document_id, head, tail, CASE WHEN length(q) <= 160 THEN q ELSE head || ' [...] ' || tail END AS excerpt, CASE WHEN length(q) <= 160 THEN q ELSE head || ' [...] ' || trim(regexp_replace(right(q, 80), '^[^ ]* ', '')) END AS plain_excerpt,
CASE WHEN length(q) <= 100 THEN q ELSE rtrim(substring(q, 1, 97)) || '...' END AS preview, regexp_replace(regexp_replace(lower(substring(text, 1, 40)), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, CASE WHEN text IS NULL THEN substr(sha1(CAST(doc_id AS VARCHAR)), 1, 12) ELSE substr(sha1(text || '|' || doc_id), 1, 12) END AS hash FROM y""")


def marked_excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Escaped text around the middle of each page's source, the line at it, and how often a marker occurs."""
    pages = table(spark, sf_dir, "pages").withColumn("m", F.floor(F.length("html") / 2))
    h = F.col("html")
    return pages.select("page_id", tx.marked_excerpt(h, F.col("m"), 60, 40).alias("excerpt"), F.md5(tx.html_escaped(h).cast("binary")).alias("escaped_md5"), tx.occurrences(h, "<p>").alias("paragraphs"), tx.occurrences(h, "aa").alias("pairs"), F.md5(tx.heading_at(h, F.col("m")).cast("binary")).alias("line_md5"))


_ESC = "replace(replace(replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#x27;')"
register("marked_excerpts", marked_excerpts, f"""WITH x AS (SELECT *, CAST(floor(length(html) / 2) AS BIGINT) AS m FROM pages)
SELECT page_id, {_ESC.format("substring(html, greatest(0, m - 60) + 1, m - greatest(0, m - 60))")} || '>>>' || {_ESC.format("substring(html, m + 1, 40)")} AS excerpt, md5({_ESC.format("html")}) AS escaped_md5, CAST((length(html) - length(replace(html, '<p>', ''))) / 3 AS BIGINT) AS paragraphs, CAST((length(html) - length(replace(html, 'aa', ''))) / 2 AS BIGINT) AS pairs, md5(trim(string_split(substring(html, m + 1), e'\\n')[1], e' \\n\\t\\r')) AS line_md5 FROM x""")


def repaired_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents with every kind of damage put in, cleaned again."""
    w = F.split(tx.squeezed(F.regexp_replace("text", r"[^A-Za-z ]", " ")), " ")
    rows = d.documents(spark, sf_dir).withColumn("w", F.slice(F.filter(w, lambda x: x != ""), 1, 6)).where(F.size("w") == 6)
    x = lambda i: at(F.col("w"), F.lit(i))
    line = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    damaged = line(" \t", x(0), "  \t", x(1), "\r\nDisclaimer\r\n", x(2), "-\n ", x(3), "\rHalaman 3 dari 10\nâ€œ", x(4), "â€\u009d  ﬁ Â½\0\n\n\n\n", x(5), "â€“ \n  Email : kepaniteraan@mahkamahagung.go.id x\n")
    keep = tx.cleaned(damaged, dehyphenate=False, repair=False, drop_boilerplate=False, normalize_unicode=False)
    return rows.select("document_id", tx.cleaned(damaged).alias("clean"), keep.alias("collapsed"))


register("repaired_text", repaired_text, r"""WITH x AS (SELECT doc_id AS document_id, list_filter(string_split(trim(regexp_replace(regexp_replace(text, '[^A-Za-z ]', ' ', 'g'), '\s+', ' ', 'g')), ' '), lambda x: x <> '')[1:6] AS w FROM documents)
SELECT document_id, w[1] || ' ' || w[2] || e'\n' || w[3] || w[4] || e'\n“' || w[5] || '” fi 1⁄2' || e'\n\n' || w[6] || '–' AS clean,
w[1] || ' ' || w[2] || e'\nDisclaimer\n' || w[3] || e'-\n' || w[4] || e'\nHalaman 3 dari 10\nâ€œ' || w[5] || 'â€' || chr(157) || ' ' || chr(160) || 'ﬁ Â½' || e'\n\n' || w[6] || 'â€“' || e'\nEmail : kepaniteraan@mahkamahagung.go.id x' AS collapsed FROM x WHERE len(w) = 6""")

# --- tables with faults -------------------------------------------------------------------------------


def chunk_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that chunks break after some were changed, left out or repeated, by their document's number."""
    n = F.col("document_id") % 10
    own = d.chunks(spark, sf_dir).drop("chunk_ord")
    own = own.where(~((n == 4) & (F.col("chunk_index") == 1)))
    own = own.withColumn("text", F.when((n == 3) & (F.col("chunk_index") == 0), F.concat("text", F.lit("x"))).otherwise(F.col("text"))).withColumn("end_position", F.when((n == 5) & (F.col("chunk_index") == 0), F.col("end_position") + 1_000_000).otherwise(F.col("end_position")))
    own = own.withColumn("_k", F.explode(F.when((n == 2) & (F.col("chunk_index") == 0), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_k")
    return chunking.chunk_violations(own, d.documents(spark, sf_dir))


register("chunk_faults", chunk_faults, f"""WITH {d.SQL_CHUNKS}, x AS (SELECT *, document_id % 10 AS n, count(*) OVER (PARTITION BY document_id) AS c FROM chunks)
SELECT 'text' AS "check", document_id, chunk_id FROM x WHERE n IN (3, 5) AND chunk_index = 0 AND (n = 3 OR length((SELECT text FROM documents WHERE doc_id = document_id)) > end_position)
UNION ALL SELECT 'offsets', document_id, chunk_id FROM x WHERE n = 5 AND chunk_index = 0 UNION ALL SELECT 'duplicate_id', document_id, chunk_id FROM x WHERE n = 2 AND chunk_index = 0
UNION ALL SELECT DISTINCT 'coverage', document_id, NULL FROM x WHERE n = 4 AND c > 1""")


def representation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks whose representations don't agree after some were left out, repeated or changed."""
    from verdigrain.plans.text_queries import _representations

    rows, n = _representations(spark, sf_dir), F.col("document_id") % 10
    rows = rows.where(~((n == 1) & (F.col("method") == "B2"))).withColumn("original_text", F.when((n == 2) & (F.col("method") == "M1"), F.concat("original_text", F.lit(" "))).otherwise(F.col("original_text")))
    rows = rows.withColumn("_k", F.explode(F.when((n == 3) & (F.col("method") == "B1"), F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_k")
    return augment.misaligned(rows).select("chunk_id", "methods", "n", "shapes")


register("representation_faults", representation_faults, f"""WITH {d.SQL_CHUNKS} SELECT chunk_id, CASE WHEN document_id % 10 = 1 THEN 2 ELSE 3 END AS methods, CASE document_id % 10 WHEN 1 THEN 2 WHEN 3 THEN 4 ELSE 3 END AS n, CASE WHEN document_id % 10 = 2 THEN 2 ELSE 1 END AS shapes FROM chunks WHERE document_id % 10 IN (1, 2, 3)""")


def representation_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three texts to embed of every chunk, by their hashes."""
    from verdigrain.plans.text_queries import _representations

    return _representations(spark, sf_dir).select("chunk_id", "method", F.md5(F.col("embedding_text").cast("binary")).alias("text_md5"))


SQL_REPRESENTATIONS = f"""
sq AS (SELECT doc_id, {_SQ} AS q FROM documents), sm AS (SELECT doc_id, {sql_head('q', 60)} AS s FROM sq),
rp AS (SELECT chunk_id, document_id, chunk_index, text, s AS ds, CASE WHEN chunk_index = 0 THEN trim(regexp_replace('first: ' || substring(s, 1, 20), '\\s+', ' ', 'g')) ELSE 'Bagian dokumen tidak teridentifikasi (later).' END AS ss FROM chunks JOIN sm ON doc_id = document_id WHERE s <> ''),
rt AS (SELECT chunk_id, 'B1' AS method, text AS own, NULL AS ds, NULL AS ss, text AS e FROM rp UNION ALL SELECT chunk_id, 'B2', text, ds, NULL, e'Ringkasan Dokumen:\\n' || ds || e'\\n\\nTeks Asli:\\n' || text FROM rp
  UNION ALL SELECT chunk_id, 'M1', text, ds, ss, e'Ringkasan Dokumen:\\n' || ds || e'\\n\\nRingkasan Bagian:\\n' || ss || e'\\n\\nTeks Asli:\\n' || text FROM rp)"""
register("representation_texts", representation_texts, f"WITH {d.SQL_CHUNKS},{SQL_REPRESENTATIONS} SELECT chunk_id, method, md5(e) AS text_md5 FROM rt")


def token_budget_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut to 160 words: section summaries give way first, then document summaries, evidence never."""
    from verdigrain.plans.text_queries import _representations

    out = augment.budgeted(_representations(spark, sf_dir), 160)
    return out.select("chunk_id", "method", F.md5(F.col("embedding_text").cast("binary")).alias("text_md5"), *[F.col(c).cast("bigint").alias(c) for c in ("embedding_tokens_before_budget", "embedding_tokens", "original_only_tokens")], "summary_budget_applied", "over_budget")


_COUNT = r"len(regexp_extract_all('passage: ' || {0}, '\S+'))"
_CUT = "array_to_string(list_slice(string_split({0}, ' '), 1, len(string_split({0}, ' ')) - ({1})), ' ')"
register("token_budget_texts", token_budget_texts, f"""WITH {d.SQL_CHUNKS},{SQL_REPRESENTATIONS}, a AS (SELECT *, {_COUNT.format('e')} AS n0, {_COUNT.format('own')} AS n1, CASE WHEN ss IS NULL THEN 0 ELSE len(string_split(ss, ' ')) END AS ns, CASE WHEN ds IS NULL THEN 0 ELSE len(string_split(ds, ' ')) END AS nd FROM rt),
b AS (SELECT *, greatest(0, n0 - 160) AS o FROM a), c AS (SELECT *, least(o, ns) AS cs, least(o - least(o, ns), nd) AS cd FROM b),
f AS (SELECT *, CASE WHEN o = 0 THEN e WHEN o > ns + nd THEN own WHEN method = 'B2' THEN e'Ringkasan Dokumen:\\n' || {_CUT.format('ds', 'cd')} || e'\\n\\nTeks Asli:\\n' || own ELSE e'Ringkasan Dokumen:\\n' || {_CUT.format('ds', 'cd')} || e'\\n\\nRingkasan Bagian:\\n' || {_CUT.format('ss', 'cs')} || e'\\n\\nTeks Asli:\\n' || own END AS t FROM c)
SELECT chunk_id, method, md5(t) AS text_md5, n0 AS embedding_tokens_before_budget, {_COUNT.format('t')} AS embedding_tokens, n1 AS original_only_tokens, o > 0 AS summary_budget_applied, n1 > 160 AS over_budget FROM f""")


def run_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules that a run breaks after ranks were moved and chunks repeated, by the question's number."""
    n = F.col("query_id") % 5
    run = d.run(spark, sf_dir).withColumn("rank", F.when(n == 1, F.col("rank") + 1).when((n == 2) & (F.col("rank") > 2), F.col("rank") + 3).otherwise(F.col("rank"))).withColumn("chunk_id", F.when(n == 3, F.lit("same")).otherwise(F.col("chunk_id")))
    return retrieval.ranking_violations(run)


register("run_faults", run_faults, f"""WITH {d.SQL_BM25}{d.sql_run('r')}, q AS (SELECT query_id, query_id % 5 AS n, count(*) AS c FROM r GROUP BY 1)
SELECT query_id, 'ranks aren''t contiguous from 1' AS problem FROM q WHERE n = 1 OR n = 2 AND c > 2 UNION ALL SELECT query_id, 'a chunk comes twice' FROM q WHERE n = 3 AND c > 1""")


def deduplicated_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A run of documents from a run of chunks: each at its first rank, renumbered, nested by question."""
    run = d.run(spark, sf_dir).select("query_id", F.col("document_id").cast("string").alias("chunk_id"), "rank")
    nested = retrieval.run_records(metrics.deduplicated(run))
    return nested.select("query_id", F.size("ranking").cast("bigint").alias("n"), F.array_join(F.transform("ranking", lambda r: r["chunk_id"]), ",").alias("documents"))


register("deduplicated_run", deduplicated_run, f"WITH {d.SQL_BM25}{d.sql_run('r')}, f AS (SELECT query_id, document_id, min(rank) AS k FROM r GROUP BY 1, 2) SELECT query_id, count(*) AS n, string_agg(CAST(document_id AS VARCHAR), ',' ORDER BY k) AS documents FROM f GROUP BY 1")


def dataset_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an audit tells of documents whose lines are sections: copies, empty texts, labels that lack, texts not rebuilt."""
    return groundtruth.dataset_audit(d.documents(spark, sf_dir), line_sections(spark, sf_dir), ("s0", "s1", "s2"))


register("dataset_faults", dataset_faults, r"""WITH l AS (SELECT doc_id, text, list_filter(string_split(text, e'\n'), lambda x, i: length(x) > 0) AS own, string_split(text, e'\n') AS a FROM documents),
m AS (SELECT *, len(list_filter([0, 1, 2], lambda k: len(list_filter(range(1, len(a) + 1), lambda i: (i - 1) % 3 = k AND length(a[i]) > 0)) = 0)) AS missing FROM l)
SELECT 'duplicate_texts' AS "check", count(*) - count(DISTINCT coalesce(text, '~null~')) AS count FROM documents UNION ALL SELECT 'empty_texts', count(*) FILTER (coalesce(length(text), 0) = 0) FROM documents
UNION ALL SELECT 'missing_labels', count(*) FILTER (coalesce(missing, 3) > 0) FROM m UNION ALL SELECT 'not_rebuilt', count(*) FILTER (CASE WHEN text IS NULL THEN false WHEN len(own) = 0 THEN true ELSE array_to_string(own, '') <> text END) FROM m""")


def page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of conversations with the turns that they touch."""
    pages = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("document_id"), F.col("turn").cast("int").alias("page_number"), F.col("text").alias("clean_text"))
    spans = sections.page_spans(pages)
    chunks = chunking.fixed_chunks(sections.join_pages(pages), 40, 10)
    whole = spans.groupBy("document_id").agg(F.lit("all").alias("section_label"), F.lit(None).cast("string").alias("section_heading"), F.lit(0).cast("bigint").alias("start_position"), F.max("end_position").alias("end_position"))
    return sections.assign_sections(chunks, whole, spans).select("document_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.array_join(F.transform("page_numbers", lambda p: p.cast("string")), ",").alias("pages"))


def _windows(docs: str, w: int, o: int) -> str:
    from verdigrain.plans.decisions import SQL_WINDOWS

    return SQL_WINDOWS.replace("{docs}", docs).replace("{w}", str(w)).replace("{o}", str(o))


register("page_numbers", page_numbers, f"""WITH pg AS (SELECT conv_id AS document_id, turn, coalesce(text, '') AS t, coalesce(sum(length(coalesce(text, '')) + 2) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM conversations),
dc AS (SELECT document_id, string_agg(t, e'\\n\\n' ORDER BY turn) AS text FROM pg GROUP BY 1),{_windows('dc', 40, 10)}
SELECT ch.document_id, chunk_index, coalesce(string_agg(CAST(turn AS VARCHAR), ',' ORDER BY turn) FILTER (s < end_position AND start_position < s + length(t)), '') AS pages FROM ch JOIN pg ON pg.document_id = ch.document_id GROUP BY ALL""")


def window_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which sizes and overlaps of windows are refused, of those that parts and lines give."""
    sizes = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") % 7).cast("int").alias("words"), (F.col("l_linenumber") - 2).alias("overlap")).distinct()
    rows = []
    for r in sizes.collect():  # at most 7 times 8 pairs
        try:
            chunking.check_window(r.words, r.overlap)
            rows.append((r.words, r.overlap, True))
        except ValueError:
            rows.append((r.words, r.overlap, False))
    return spark.createDataFrame(rows, "words int, overlap int, valid boolean")


register("window_checks", window_checks, "SELECT DISTINCT CAST(l_quantity % 7 AS INT) AS words, l_linenumber - 2 AS overlap, CAST(l_quantity % 7 AS INT) > 0 AND l_linenumber - 2 >= 0 AND l_linenumber - 2 < CAST(l_quantity % 7 AS INT) AS valid FROM lineitem")


def design_grid_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks of every fixed design of the grid, and of packing whole texts as one section without overlap of sentences."""
    grid = [g for g in chunking.design_grid((50, 100, 200)) if g["kind"] == "fixed"]
    docs = d.documents(spark, sf_dir)
    return chunking.design_chunks(docs, docs, grid).groupBy("strategy").agg(F.count(F.lit(1)).alias("chunks"), F.sum(F.length("text")).alias("chars"))


register("design_grid_counts", design_grid_counts, " UNION ALL ".join(f"SELECT 'fixed_{w}_{w // 5}' AS strategy, count(*) AS chunks, CAST(sum(end_position - start_position) AS BIGINT) AS chars FROM (WITH dx AS (SELECT doc_id AS document_id, text FROM documents),{_windows('dx', w, w // 5)} SELECT * FROM ch)" for w in (50, 100, 200)))

# --- files --------------------------------------------------------------------------------------------


def jsonl_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as JSON lines and read strictly; a second write to the same path is refused."""
    docs, path = table(spark, sf_dir, "documents"), fresh_path(spark, "jsonl")
    files.write_jsonl(docs, path)
    try:
        files.write_jsonl(docs.limit(0), path)
        refused = False
    except Exception as error:  # noqa: BLE001
        refused = "PATH_ALREADY_EXISTS" in str(error)
    return files.read_jsonl(spark, path, docs.schema).withColumn("refused", F.lit(refused))


register("jsonl_round_trip", jsonl_round_trip, "SELECT *, true AS refused FROM documents")


def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as CSV with some fields in order, and read as strings."""
    path = fresh_path(spark, "csv")
    files.write_csv(table(spark, sf_dir, "conversations").where("text <> ''"), path, ["turn", "conv_id", "text"])
    return files.read_csv(spark, path).select("turn", "conv_id", F.md5(F.col("text").cast("binary")).alias("text_md5"))


register("csv_round_trip", csv_round_trip, "SELECT CAST(turn AS VARCHAR) AS turn, CAST(conv_id AS VARCHAR) AS conv_id, md5(text) AS text_md5 FROM conversations WHERE text <> ''")


def index_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors saved as an index with its manifest, and loaded with its checks."""
    path = fresh_path(spark, "index")
    files.save_index(table(spark, sf_dir, "embeddings"), path, model_name="model", provenance={"a": "b"})
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return files.load_index(spark, path, model_name="model").select("vec_id", "label", F.size("embedding").cast("bigint").alias("dimension"), F.round(total, 4).alias("total"))


register("index_round_trip", index_round_trip, "SELECT vec_id, label, len(embedding) AS dimension, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total FROM embeddings")


def cached_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table made once for its key; another key at the same place is refused."""
    path = fresh_path(spark, "cache")
    files.cached(spark, path, "one", lambda: table(spark, sf_dir, "labels"))
    again = files.cached(spark, path, "one", lambda: table(spark, sf_dir, "labels").limit(0))
    try:
        files.cached(spark, path, "two", lambda: again)
        refused = False
    except ValueError:
        refused = True
    return again.withColumn("refused", F.lit(refused))


register("cached_table", cached_table, "SELECT *, true AS refused FROM labels")


def row_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash of each row, and of the whole table whatever its order."""
    rows = table(spark, sf_dir, "labels")
    whole = files.fingerprint(rows.orderBy(F.rand(3)))
    return files.row_hash(rows).select("doc_id", "row_sha256", F.lit(whole == files.fingerprint(rows)).alias("same_in_any_order"))


register("row_hashes", row_hashes, """SELECT doc_id, sha256('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') AS row_sha256, true AS same_in_any_order FROM labels""")


def manifest_mismatches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that lack, or differ from a manifest in size or hash, or whose names are used twice."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).cast("binary").alias("content"))
    n = F.col("doc_id")
    name = F.concat(n.cast("string"), F.lit(".txt"))
    held = docs.where(n % 10 != 1).select(F.concat(F.lit("x/"), name).alias("path"), "content")
    manifest = docs.select(F.when(n % 10 == 7, F.concat((n - 1).cast("string"), F.lit(".txt"))).otherwise(name).alias("local_file"), F.when(n % 10 == 2, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"), (F.length("content") + F.when(n % 10 == 3, 1).otherwise(0)).alias("bytes"), "doc_id")
    return files.file_mismatches(held, manifest.where(n % 10 != 7).drop("doc_id").unionByName(manifest.where(n % 10 == 7).select("local_file", F.sha2(F.lit("?").cast("binary"), 256).alias("sha256"), F.lit(-1).alias("bytes"))))


register("manifest_mismatches", manifest_mismatches, """SELECT doc_id || '.txt' AS local_file, 'missing' AS problem FROM documents WHERE doc_id % 10 = 1 UNION ALL SELECT doc_id || '.txt', 'size' FROM documents WHERE doc_id % 10 = 3
UNION ALL SELECT doc_id || '.txt', 'hash' FROM documents WHERE doc_id % 10 = 2 AND coalesce(text, '') <> '' UNION ALL SELECT (doc_id - 1) || '.txt', 'size' FROM documents WHERE doc_id % 10 = 7 UNION ALL SELECT (doc_id - 1) || '.txt', 'name used twice' FROM documents WHERE doc_id % 10 = 7""")


def page_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text of documents as printed lines, of which some are turned: only upright ones stay."""
    lines = d.documents(spark, sf_dir).select("document_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "text"))
    turned = F.col("line") % 4 == 3
    spans = lines.select("document_id", F.lit(1).alias("page_number"), F.floor(F.col("line") / 3).cast("int").alias("block"), "line", F.when(turned, 0.0).otherwise(1.0).alias("x"), F.when(turned, 1.0).otherwise(0.0).alias("y"), "text")
    return files.printed_text(spans).select("document_id", "page_number", F.md5(F.col("raw_text").cast("binary")).alias("text_md5"))


register("page_lines", page_lines, r"""WITH l AS (SELECT doc_id, unnest(string_split(text, e'\n')) AS t, unnest(range(0, len(string_split(text, e'\n')))) AS i FROM documents),
b AS (SELECT doc_id, i // 3 AS b, string_agg(t, e'\n' ORDER BY i) FILTER (i % 4 <> 3) AS t FROM l GROUP BY 1, 2)
SELECT doc_id AS document_id, 1 AS page_number, md5(coalesce(string_agg(t, e'\n\n' ORDER BY b) FILTER (regexp_matches(t, '\S')), '')) AS text_md5 FROM b GROUP BY 1""")


def report_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small table as Markdown, in one row."""
    rows = table(spark, sf_dir, "documents").groupBy(F.coalesce("lang", F.lit("-")).alias("lang")).agg(F.count(F.lit(1)).alias("documents"), F.avg(F.length("text")).alias("mean")).orderBy("lang")
    return spark.createDataFrame([(files.markdown(rows),)], "report string")


register("report_table", report_table, "SELECT e'| lang | documents | mean |\\n|---|---|---|\\n' || string_agg('| ' || l || ' | ' || n || ' | ' || printf('%.4f', m) || e' |\\n', '' ORDER BY l) AS report FROM (SELECT coalesce(lang, '-') AS l, count(*) AS n, avg(length(text)) AS m FROM documents GROUP BY 1)")

# --- vectors ------------------------------------------------------------------------------------------


def late_chunk_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of 60 words, 20 of them shared, over every document, and the window in which each chunk of 25 words is most central."""
    docs = d.documents(spark, sf_dir)
    sizes = docs.select("document_id", tx.word_count(F.col("text")).cast("bigint").alias("tokens"))
    spans = sizes.where("tokens > 0").select("document_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("tokens") - 1, F.lit(25).cast("bigint"))).alias("start"), "tokens").select("document_id", (F.col("start") / 25).cast("bigint").alias("span_id"), "start", F.least(F.col("start") + 25, F.col("tokens")).alias("end"))
    windows = stored(embedding.context_windows(sizes, spans, capacity=60, overlap=20), "windows")
    return embedding.window_of_span(spans, windows).select("document_id", "span_id", F.col("window_index").cast("bigint").alias("window_index"), "window_start", "window_end")


register("late_chunk_windows", late_chunk_windows, r"""WITH s AS (SELECT doc_id AS document_id, len(regexp_extract_all(text, '\S+')) AS n FROM documents), sp AS (SELECT document_id, n, unnest(range(0, n, 25)) AS a FROM s WHERE n > 0), spn AS (SELECT document_id, a // 25 AS span_id, a, least(a + 25, n) AS z, n FROM sp),
b AS (SELECT document_id, n, unnest(CASE WHEN n <= 60 THEN [0] ELSE list_distinct(list_concat(range(0, n - 60 + 1, 40), [n - 60])) END) AS a FROM s WHERE n > 0), bw AS (SELECT document_id, a, a + least(n, 60) AS z FROM b),
bare AS (SELECT * FROM spn WHERE NOT EXISTS (SELECT 1 FROM bw WHERE bw.document_id = spn.document_id AND bw.a <= spn.a AND spn.z <= bw.z)),
w AS (SELECT * FROM bw UNION SELECT document_id, greatest(greatest(0, z - 60), least(CAST(floor((a + z - 60) / 2) AS BIGINT), least(a, n - 60))) AS a, greatest(greatest(0, z - 60), least(CAST(floor((a + z - 60) / 2) AS BIGINT), least(a, n - 60))) + 60 FROM bare),
wi AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY a, z) - 1 AS i FROM w)
SELECT spn.document_id, span_id, i AS window_index, wi.a AS window_start, wi.z AS window_end FROM spn JOIN wi ON wi.document_id = spn.document_id AND wi.a <= spn.a AND spn.z <= wi.z QUALIFY row_number() OVER (PARTITION BY spn.document_id, span_id ORDER BY least(spn.a - wi.a, wi.z - spn.z) DESC, (spn.a - wi.a) + (wi.z - spn.z) DESC, i) = 1""")


def _grams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Conversations as documents, chunks of 30 words, and their words as tokens."""
    docs = table(spark, sf_dir, "conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("document_id"), "text")
    chunks = chunking.fixed_chunks(docs, 30, 10)
    tokens = docs.select("document_id", F.posexplode(tx.word_spans(F.col("text"))).alias("token", "s")).select("document_id", F.col("token").cast("bigint").alias("token"), F.col("s.start").alias("start"), F.col("s.end").alias("end"))
    return docs, chunks, tokens


def contextual_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late chunking with a plain model: a token's vector is its place in its window, and 1."""
    docs, chunks, tokens = _grams(spark, sf_dir)

    def encode(windows: DataFrame) -> DataFrame:
        each = windows.select("document_id", "window_start", F.explode(F.sequence("window_start", F.col("window_end") - 1)).alias("token"))
        return each.select("document_id", "window_start", "token", F.array((F.col("token") - F.col("window_start")).cast("double"), F.lit(1.0)).alias("vector"))

    out = embedding.contextual_embeddings(docs, chunks, tokens, encode, capacity=50, overlap=10)
    return out.select("chunk_id", F.round(at(F.col("embedding"), F.lit(0)), 6).alias("x"), F.round(at(F.col("embedding"), F.lit(1)), 6).alias("y"))


register("contextual_embeddings", contextual_embeddings, rf"""WITH dc AS (SELECT conv_id || '-' || turn AS document_id, text FROM conversations),{_windows('dc', 30, 10)},
sp AS (SELECT ch.chunk_id, ch.document_id, chunk_index * 20 AS a, least(chunk_index * 20 + 30, c) AS z, c AS n FROM ch JOIN wn USING (document_id)),
b AS (SELECT document_id, c AS n, unnest(CASE WHEN c <= 50 THEN [0] ELSE list_distinct(list_concat(range(0, c - 50 + 1, 40), [c - 50])) END) AS a FROM wn), bw AS (SELECT document_id, a, a + least(n, 50) AS z FROM b),
bare AS (SELECT * FROM sp WHERE NOT EXISTS (SELECT 1 FROM bw WHERE bw.document_id = sp.document_id AND bw.a <= sp.a AND sp.z <= bw.z)),
w AS (SELECT * FROM bw UNION SELECT document_id, greatest(greatest(0, z - 50), least(CAST(floor((a + z - 50) / 2) AS BIGINT), least(a, n - 50))) AS a, greatest(greatest(0, z - 50), least(CAST(floor((a + z - 50) / 2) AS BIGINT), least(a, n - 50))) + 50 FROM bare),
wv AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY a, z) - 1 AS i FROM w),
m AS (SELECT chunk_id, (sp.a + sp.z - 1) / 2.0 - wv.a AS x FROM sp JOIN wv ON wv.document_id = sp.document_id AND wv.a <= sp.a AND sp.z <= wv.z QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY least(sp.a - wv.a, wv.z - sp.z) DESC, (sp.a - wv.a) + (wv.z - sp.z) DESC, i) = 1)
SELECT chunk_id, round(x / sqrt(x * x + 1), 6) AS x, round(1 / sqrt(x * x + 1), 6) AS y FROM m""")


def vector_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of text chosen for embedding, compared with themselves scaled, and those that are unfit."""
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("key"), F.col("embedding").cast("array<double>").alias("embedding"))
    scaled = rows.withColumn("embedding", F.transform("embedding", lambda x: x * F.when(F.col("key") % 2 == 0, 1.0).otherwise(1.0 + 1e-7)))
    same = embedding.equivalence(rows, scaled)
    broken = rows.withColumn("embedding", F.when(F.col("key") % 50 == 3, F.transform("embedding", lambda x: x * 0)).when(F.col("key") % 50 == 4, F.slice("embedding", 1, 9)).otherwise(F.col("embedding")))
    bad = retrieval.bad_vectors(broken).agg(F.count(F.lit(1)).alias("bad"), F.sum("key").alias("bad_keys"))
    return same.select(F.round("min_cosine", 6).alias("min_cosine"), F.round("mean_cosine", 6).alias("mean_cosine"), "accepted").join(F.broadcast(bad), F.lit(True))


register("vector_checks", vector_checks, "SELECT 1.0::DOUBLE AS min_cosine, 1.0::DOUBLE AS mean_cosine, max(list_aggregate(list_transform(embedding, lambda x: abs(x)), 'max')) * 1e-7 <= 1e-5 AS accepted, count(*) FILTER (vec_id % 50 IN (3, 4)) AS bad, CAST(sum(vec_id) FILTER (vec_id % 50 IN (3, 4)) AS BIGINT) AS bad_keys FROM embeddings")


def reused_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which vectors are taken from a cache of half the texts, and which are made; texts with two vectors are told."""
    docs = table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", "text")
    cache = docs.where("doc_id % 2 = 0").select("text", F.array(F.lit(0.0), F.length("text").cast("double")).alias("embedding")).dropDuplicates(["text"])
    encode = lambda t: t.withColumn("embedding", F.array(F.lit(1.0), F.length("text").cast("double")))
    rows, _ = embedding.reused(docs, cache, encode)
    odd = cache.unionByName(docs.where("doc_id % 10 = 0").select("text", F.array(F.lit(5.0), F.length("text").cast("double")).alias("embedding")))
    clash = embedding.cache_conflicts(odd).select("text", F.lit(True).alias("conflict"))
    return rows.join(clash, "text", "left").select("doc_id", at(F.col("embedding"), F.lit(0)).alias("made"), at(F.col("embedding"), F.lit(1)).alias("size"), F.coalesce("conflict", F.lit(False)).alias("conflict"))


register("reused_vectors", reused_vectors, """WITH c AS (SELECT text, bool_or(doc_id % 2 = 0) AS cached, bool_or(doc_id % 10 = 0) AS clash FROM documents WHERE text IS NOT NULL GROUP BY 1) SELECT doc_id, CASE WHEN cached THEN 0.0 ELSE 1.0 END::DOUBLE AS made, length(text)::DOUBLE AS size, clash AS conflict FROM documents JOIN c USING (text)""")


def embedding_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors made in batches and kept; a second run makes only those of new items."""
    items, path = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("chunk_id"), "text"), fresh_path(spark, "vectors")
    encode = lambda mark: lambda t: t.select("chunk_id", F.array(F.lit(mark), F.length("text").cast("double")).alias("embedding"))
    embedding.checkpointed(items.where("chunk_id % 3 = 0"), path, encode(1.0), dimension=2, batches=4)
    out = embedding.checkpointed(items, path, encode(2.0), dimension=2, batches=4)
    return out.select("chunk_id", at(F.col("embedding"), F.lit(0)).alias("run"), at(F.col("embedding"), F.lit(1)).alias("size"))


register("embedding_checkpoint", embedding_checkpoint, "SELECT item_id AS chunk_id, CASE WHEN item_id % 3 = 0 THEN 1.0 ELSE 2.0 END::DOUBLE AS run, length(text)::DOUBLE AS size FROM benchmark")


def index_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks that only one of an index and its merged parts has, or whose text differs."""
    own = d.chunks(spark, sf_dir).select("chunk_id", "document_id", "text")
    n = F.col("document_id") % 10
    parts = own.where("document_id % 2 = 0 AND document_id % 10 <> 2").unionByName(own.where("document_id % 2 = 1").withColumn("text", F.when(n == 3, F.upper("text")).otherwise(F.col("text"))))
    return embedding.index_differences(own, parts)


register("index_differences", index_differences, f"WITH {d.SQL_CHUNKS} SELECT chunk_id FROM chunks WHERE document_id % 10 = 2 OR document_id % 10 = 3 AND upper(text) <> text")


def embedding_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is embedded of each document: its own text, or one given for it."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "text", F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("x "), "source")).when(F.col("doc_id") % 3 == 1, "").alias("embedding_text"))
    return rows.select("doc_id", F.md5(embedding.text_to_embed().cast("binary")).alias("text_md5"))


register("embedding_texts", embedding_texts, "SELECT doc_id, md5(coalesce(CASE WHEN doc_id % 3 = 0 THEN 'x ' || source END, text)) AS text_md5 FROM documents")


def cleaned_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a model with quotes and announcing words around them, cleaned."""
    own = tx.head_at_word(F.regexp_replace("text", '"', " "), 60)
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit('"'), own, F.lit('"'))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit(" Ringkasan:  "), own)).otherwise(F.concat(F.lit("SUMMARY: "), own, F.lit("\n")))
    return table(spark, sf_dir, "documents").select("doc_id", augment.cleaned_output(said).alias("answer"))


register("cleaned_outputs", cleaned_outputs, f"""WITH x AS (SELECT doc_id, trim(regexp_replace(replace(text, '"', ' '), '\\s+', ' ', 'g')) AS q FROM documents) SELECT doc_id, {sql_head('q', 60)} AS answer FROM x""")

# --- relational shapes --------------------------------------------------------------------------------


def table_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that only one of two versions of a table has, counting repeats."""
    rows = table(spark, sf_dir, "labels")
    other = rows.where("doc_id % 5 <> 1").withColumn("toxic", F.when(F.col("doc_id") % 5 == 2, 1 - F.col("toxic")).otherwise(F.col("toxic"))).withColumn("_k", F.explode(F.when(F.col("doc_id") % 5 == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1))))).drop("_k")
    return relational.same_rows(rows, other)


register("table_differences", table_differences, "SELECT doc_id, quality, toxic, 'left' AS side FROM labels WHERE doc_id % 5 IN (1, 2) UNION ALL SELECT doc_id, quality, CASE WHEN doc_id % 5 = 2 THEN 1 - toxic ELSE toxic END, 'right' FROM labels WHERE doc_id % 5 IN (2, 3)")


def numbered_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders numbered by price, without a task that has them all."""
    return relational.numbered(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), F.desc("o_totalprice"), "o_orderkey").select("o_orderkey", "place")


register("numbered_orders", numbered_orders, "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders")


def paired_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two strategies for each question, in a seeded order of questions."""
    both = d.questions(spark, sf_dir).select("query_id", F.explode(F.array(F.lit("fixed"), F.lit("structure"))).alias("strategy"))
    return retrieval.paired_order(both).select("position", F.col("turn").cast("bigint").alias("turn"), "query_id", "strategy")


register("paired_order", paired_order, "WITH p AS (SELECT item_id AS query_id, row_number() OVER (ORDER BY md5('42|' || item_id), item_id) AS position FROM benchmark) SELECT position, CASE WHEN (position % 2 = 1) = (strategy = 'fixed') THEN 1 ELSE 2 END AS turn, query_id, strategy FROM p CROSS JOIN (SELECT unnest(['fixed', 'structure']) AS strategy)")


def answer_inputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts of two strategies that differ in their budgets, by their hashes; blank questions have none."""
    from verdigrain.plans.retrieval_queries import _ranking

    ranking = _ranking(spark, sf_dir)
    contexts = None
    for strategy, budget in (("short", 120), ("long", 400)):
        made = retrieval.assembled_contexts(retrieval.context_by_truncation(ranking, budget), budget).withColumn("strategy", F.lit(strategy))
        contexts = made if contexts is None else contexts.unionByName(made)
    out = retrieval.answer_inputs(d.questions(spark, sf_dir), contexts)
    return out.select("query_id", "strategy", F.md5(F.col("prompt").cast("binary")).alias("prompt_md5"))


_PROMPT = "'" + retrieval.PROMPT.replace("\n", "' || chr(10) || '").replace("{context}", "' || c || '").replace("{question}", "' || trim(b.text) || '") + "'"
register("answer_inputs", answer_inputs, rf"""WITH {d.SQL_BM25}{d.sql_run('r')}, x AS (SELECT r.query_id, r.rank, regexp_extract_all(c.text, '\S+') AS w FROM r JOIN chunks c USING (chunk_id)),
y AS (SELECT x.*, s, g, least(len(w), greatest(0, g - coalesce(sum(len(w)) OVER (PARTITION BY query_id, s ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))) AS t FROM x CROSS JOIN (VALUES ('short', 120), ('long', 400)) v(s, g) WHERE len(w) > 0),
z AS (SELECT *, row_number() OVER (PARTITION BY query_id, s ORDER BY rank) AS k FROM y WHERE t > 0),
cx AS (SELECT query_id, s, string_agg('[Chunk ' || k || ']' || chr(10) || array_to_string(list_slice(w, 1, CAST(t AS BIGINT)), ' '), chr(10) || chr(10) ORDER BY k) AS c FROM z GROUP BY 1, 2)
SELECT query_id, s AS strategy, md5({_PROMPT}) AS prompt_md5 FROM cx JOIN benchmark b ON b.item_id = query_id WHERE trim(b.text) <> ''""")


def input_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Questions that a strategy lacks, contexts that can't be filled, blank questions, unknown documents and chunks with the same id."""
    asked, n = d.questions(spark, sf_dir), F.col("query_id")
    both = asked.select("query_id", F.explode(F.array(F.lit("fixed"), F.lit("structure"))).alias("strategy")).where(~((n % 4 == 1) & (F.col("strategy") == "fixed"))).withColumn("query_id", F.when((n % 4 == 2) & (F.col("strategy") == "structure"), n + 1_000_000).otherwise(n))
    one = retrieval.input_violations(asked, both).select(F.concat_ws("/", F.col("query_id").cast("string"), "strategy").alias("item"), "problem")
    ranking = asked.select("query_id", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))).alias("rank")).where(~((n % 4 == 3) & (F.col("rank") == 2))).select("query_id", "rank", F.concat_ws("-", n.cast("string"), F.when(n % 4 == 0, 1).otherwise(F.col("rank")).cast("string")).alias("chunk_id"), F.lit(10).alias("words"))
    two = retrieval.context_violations(ranking, 25).select(n.cast("string").alias("item"), "problem")
    blank = asked.withColumn("question", F.when(n % 4 == 0, " ").otherwise(F.col("question"))).withColumn("document_id", n + F.when(n % 4 == 1, 10_000_000).otherwise(0))
    three = retrieval.retrieval_violations(blank, d.documents(spark, sf_dir).select("document_id").unionByName(asked.select(n.alias("document_id"))), on="document_id").select(n.cast("string").alias("item"), "problem")
    four = retrieval.bm25_violations(asked.select(F.when(n % 4 == 1, " ").when(n % 4 == 2, "same").otherwise(n.cast("string")).alias("chunk_id"))).select(F.col("chunk_id").alias("item"), "problem")
    return one.unionByName(two).unionByName(three).unionByName(four)


register("input_faults", input_faults, """WITH b AS (SELECT item_id AS q, item_id % 4 AS n FROM benchmark)
SELECT q || '/fixed' AS item, 'missing_run' AS problem FROM b WHERE n = 1 UNION ALL SELECT q || '/structure', 'missing_run' FROM b WHERE n = 2 UNION ALL SELECT (q + 1000000) || '/structure', 'unknown_query' FROM b WHERE n = 2
UNION ALL SELECT CAST(q AS VARCHAR), 'insufficient_text' FROM b WHERE n = 3 UNION ALL SELECT CAST(q AS VARCHAR), 'ranks_not_contiguous' FROM b WHERE n = 3 UNION ALL SELECT CAST(q AS VARCHAR), 'duplicate_chunk' FROM b WHERE n = 0
UNION ALL SELECT CAST(q AS VARCHAR), 'blank_query' FROM b WHERE n = 0 UNION ALL SELECT CAST(q AS VARCHAR), 'unknown_document_id' FROM b WHERE n = 1
UNION ALL SELECT DISTINCT ' ', 'blank_chunk_id' FROM b WHERE n = 1 UNION ALL SELECT ' ', 'duplicate_chunk_id' WHERE (SELECT count(*) FROM b WHERE n = 1) > 1 UNION ALL SELECT 'same', 'duplicate_chunk_id' WHERE (SELECT count(*) FROM b WHERE n = 2) > 1""")


def generated_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a plain generator that gives a prompt's last words; each is timed."""
    prompts = d.questions(spark, sf_dir).select("query_id", F.concat(F.lit("Jawab: "), "question").alias("prompt"))
    out = retrieval.generated(prompts, lambda: lambda p: " " + " ".join(p.split()[-3:]) + " ")
    return out.select("query_id", "answer", (F.col("latency_ms") >= 0).alias("timed"))


register("generated_answers", generated_answers, r"SELECT item_id AS query_id, array_to_string(list_slice(regexp_extract_all('Jawab: ' || text, '\S+'), -3, -1), ' ') AS answer, true AS timed FROM benchmark")


def disjoint_split_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items split by their number, which fill the side exactly."""
    rows = table(spark, sf_dir, "orders").select((F.col("o_orderkey") % 40).alias("g"))
    n = rows.where("g < 12").count()
    return relational.disjoint_split(rows.withColumn("g", F.when(F.col("g") < 12, F.lit(-1)).otherwise(F.col("g"))), "g", n + rows.where("g = 39").count(), exact=False)


register("disjoint_split_exact", disjoint_split_exact, """WITH RECURSIVE r AS (SELECT CASE WHEN o_orderkey % 40 < 12 THEN -1 ELSE o_orderkey % 40 END AS g FROM orders), t AS (SELECT count(*) FILTER (o_orderkey % 40 < 12) + count(*) FILTER (o_orderkey % 40 = 39) AS t FROM orders),
s AS (SELECT g, count(*) AS size, row_number() OVER (ORDER BY md5('42|' || g), g) AS p FROM r GROUP BY 1), f AS (SELECT p, g, size, size <= t AS k, CASE WHEN size <= t THEN size ELSE 0 END AS n FROM s, t WHERE p = 1 UNION ALL SELECT s.p, s.g, s.size, f.n + s.size <= t, CASE WHEN f.n + s.size <= t THEN f.n + s.size ELSE f.n END FROM f JOIN s ON s.p = f.p + 1, t) SELECT g, size FROM f WHERE k""")
