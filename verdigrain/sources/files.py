"""Readers and writers: JSON lines, CSV, XML of decisions, binary files, PDF, index snapshots."""

from __future__ import annotations

import json
import time
from collections.abc import Callable, Iterator, Mapping
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path
from typing import Any
from xml.parsers import expat

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from verdigrain.functions import text as tx
from verdigrain.functions.extract import case_number, case_year
from verdigrain.session import on_workers

# Section tags of a decision in the order in which they form its text.
XML_TAGS = ("kepala_putusan", "identitas", "riwayat_penahanan", "riwayat_perkara", "riwayat_tuntutan", "riwayat_dakwaan", "fakta", "fakta_hukum", "pertimbangan_hukum", "amar_putusan", "penutup")
XML_LABELS = {"identitas": "identitas_terdakwa"}
INDEX_VERSION = 1


def read_jsonl(spark: SparkSession, path: str, schema: T.StructType | str, *, strict: bool = True) -> DataFrame:
    """One object a line, blank lines skipped; strict reading fails on lines that aren't an object."""
    if not strict:
        return spark.read.schema(schema).json(path)
    lines = spark.read.text(path).where(F.trim("value") != "")
    checked = F.when(F.ltrim("value").startswith("{"), F.col("value")).otherwise(F.raise_error(F.concat(F.lit("not an object: "), F.substring("value", 1, 60))))
    return lines.select(F.from_json(checked, schema, {"mode": "FAILFAST"}).alias("r")).select("r.*")


def write_jsonl(df: DataFrame, path: str, *, overwrite: bool = False) -> None:
    """One object a line with its keys in order; an existing path is refused unless told otherwise."""
    df.select(*sorted(df.columns)).write.mode("overwrite" if overwrite else "errorifexists").option("ignoreNullFields", "false").json(path)


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A header and all strings; a byte-order mark is skipped and fields may hold line breaks."""
    return spark.read.csv(path, header=True, multiLine=True, escape='"')


def write_csv(df: DataFrame, path: str, fields: list[str], *, overwrite: bool = False) -> None:
    """The named fields in their order; others are left out."""
    df.select(*fields).write.mode("overwrite" if overwrite else "errorifexists").csv(path, header=True, escape='"')


def load_config(path: str | Path, read: Any = json.loads) -> dict[str, Any]:
    """A configuration with those that it extends merged below it, dictionary by dictionary; a cycle is an error."""

    def load(at: Path, seen: tuple[Path, ...]) -> dict[str, Any]:
        at = at.resolve()
        if at in seen:
            raise ValueError(f"{at} extends itself")
        own = read(at.read_text(encoding="utf-8")) or {}
        if not isinstance(own, Mapping):
            raise ValueError(f"{at} isn't a mapping")
        base = own.pop("extends", None)
        return merged(load(at.parent / base, (*seen, at)), own) if base else dict(own)

    return load(Path(path), ())


def merged(base: Mapping[str, Any], over: Mapping[str, Any]) -> dict[str, Any]:
    out = dict(base)
    for key, value in over.items():
        out[key] = merged(out[key], value) if isinstance(value, Mapping) and isinstance(out.get(key), Mapping) else value
    return out


def document_id(path: Column) -> Column:
    """A readable id of a relative path: the slug of its stem and the head of its hash."""
    stem = F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")
    return F.concat(tx.slug(stem), F.lit("-"), F.substring(F.sha1(F.lower(path).cast("binary")), 1, 8))


def relative_path(root: str) -> Column:
    return F.regexp_replace(F.col("path"), "^.*?" + root.rstrip("/").rsplit("/", 1)[-1] + "/", "")


def read_pdfs(spark: SparkSession, root: str) -> DataFrame:
    """document_id, filename, page_number, raw_text of all PDF files under a folder.

    Needs the optional PyMuPDF; rotated lines are left out, lines and blocks are joined as they stand.
    """
    on_workers(spark)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[pP][dD][fF]").load(root)
    rows = files.select(document_id(relative_path(root)).alias("document_id"), F.element_at(F.split("path", "/"), -1).alias("filename"), "content")

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import fitz

        for batch in batches:
            for row in batch.itertuples():
                with fitz.open(stream=row.content, filetype="pdf") as document:
                    out = [(row.document_id, row.filename, n, page_text([[(tuple(line["dir"]), "".join(s["text"] for s in line["spans"])) for line in block.get("lines", ())] for block in page.get_text("dict")["blocks"]])) for n, page in enumerate(document, 1)]
                yield pd.DataFrame(out, columns=["document_id", "filename", "page_number", "raw_text"])

    return rows.mapInPandas(pages, "document_id string, filename string, page_number int, raw_text string")


def page_text(blocks: list[list[tuple[tuple[float, float], str]]]) -> str:
    """The text of blocks of (direction, line): horizontal lines only, one below the other, blocks apart."""
    kept = ("\n".join(text for (x, y), text in lines if x > 0.999 and abs(y) < 0.001) for lines in blocks)
    return "\n\n".join(b for b in kept if b.strip())


def printed_text(spans: DataFrame) -> DataFrame:
    """document_id, page_number, raw_text of printed lines (block, line, x, y, text): as page_text has it, but of a table.

    (x, y) is a line's direction; a page's lines are few.
    """
    upright = (F.col("x") > 0.999) & (F.abs("y") < 0.001)
    blocks = spans.groupBy("document_id", "page_number", "block").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.when(upright, F.struct("line", "text")))), lambda s: s["text"]), "\n").alias("t"))
    full = F.when(F.col("t").rlike(r"(?U)\S"), F.struct("block", "t"))
    return blocks.groupBy("document_id", "page_number").agg(F.array_join(F.transform(F.array_sort(F.collect_list(full)), lambda s: s["t"]), "\n\n").alias("raw_text"))


def acquired(listing: list[str], fetch: Callable[[str], bytes], *, attempts: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep, threads: int = 8) -> dict[str, bytes]:
    """What a fetcher gives for each address, on some threads; after a failed attempt it waits longer each time, and the last failure is raised.

    Driver-side: the list is what selection (relational.capped) has left.
    """

    def one(address: str) -> bytes:
        for n in range(1, attempts + 1):
            try:
                return fetch(address)
            except OSError:
                if n == attempts:
                    raise
                sleep(wait * n)
        raise ValueError("attempts must be positive")

    with ThreadPoolExecutor(threads) as pool:
        return dict(zip(listing, pool.map(one, listing), strict=True))


def restored(files: DataFrame, manifest: DataFrame, path: str) -> DataFrame:
    """Write the files that a manifest names to a table of local_file and content, if all are there and match it.

    Spark's commit makes the write whole or nothing; what doesn't match is an error before it.
    """
    problems = file_mismatches(files, manifest)
    first = problems.agg(F.min(F.concat_ws(": ", "local_file", "problem"))).first()[0]
    if first is not None:
        raise ValueError(f"files don't match their manifest, such as {first}")
    own = files.select(F.element_at(F.split("path", "/"), -1).alias("local_file"), "content")
    own.join(manifest.select("local_file"), "local_file", "left_semi").write.mode("errorifexists").parquet(path)
    return files.sparkSession.read.parquet(path)


#: Parts an XPath: no XML of any version has this character.
_PART = "\uffff"


def _parsed(xml: bytes, attributes: list[str]) -> list[str] | None:
    """The root's name, its attributes, and the squeezed text of the first element of each section tag in it.

    None for what is left to XPath: no XML to expat, or with a document type or byte-order mark, which it takes otherwise.
    """
    if xml[:3] == b"\xef\xbb\xbf" or b"<!DOCTYPE" in xml:
        return None
    path, root, texts, open_ = [], [], {}, []

    def begin(name: str, own: dict[str, str]) -> None:
        if not path:
            root.append((name, own))
        elif len(path) == 1 and name in XML_PLACES and name not in texts and path[0] == "putusan":
            open_.append(texts.setdefault(name, []))
        path.append(name)

    def end(name: str) -> None:
        path.pop()
        if len(path) == 1:
            open_.clear()

    def said(text: str) -> None:
        if open_:
            open_[0].append(text)

    parser = expat.ParserCreate("utf-8")
    parser.buffer_text = True
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = begin, end, said
    try:
        parser.Parse(xml, True)
    except expat.ExpatError:
        return None
    name, own = root[0]
    # white space of Unicode; the four controls that only Python counts as such are in no XML 1.0
    return [name, *[own.get(a, "") if name == "putusan" else "" for a in attributes], *[" ".join("".join(texts.get(t, ())).split()) for t in XML_TAGS]]


XML_PLACES = frozenset(XML_TAGS)


def _xml_parts(attributes: list[str]) -> Column:
    """The root's name (any but putusan may be empty), the attributes as they stand and the squeezed texts of all section tags, each file parsed once.

    expat takes a small part of the time of an XPath; files that it can't take go to one XPath for all parts, which says what is wrong with them.
    """

    @F.arrow_udf("array<string>")
    def parsed(xml: pa.Array) -> pa.Array:
        return pa.array([None if x is None else _parsed(x, attributes) for x in xml.to_pylist()], pa.list_(pa.string()))

    paths = ["name(/putusan)", *[f"/putusan/@{a}" for a in attributes], *[f"/putusan/{t}" for t in XML_TAGS]]
    whole = F.split(F.xpath_string("xml", F.lit(f"concat({f", '{_PART}', ".join(paths)}, '')")), _PART, -1)
    rest = F.transform(whole, lambda t, i: F.when(i > len(attributes), tx.squeezed(t)).otherwise(t))
    # a filter on a part would be moved below the function, and run it again
    return F.coalesce(parsed.asNondeterministic()(F.col("xml").cast("binary")), rest)


def read_decisions(spark: SparkSession, root: str) -> DataFrame:
    """source_path and xml of all XML files under a folder."""
    files = spark.read.option("wholetext", "true").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").text(root)
    return files.select(F.col("_metadata.file_path").alias("source_path"), F.col("value").alias("xml"))


def decision_metadata(decisions: DataFrame) -> DataFrame:
    """Attributes, case number and year of the heading, and each section's length; another root is an error."""
    attributes = {"source_id": "id", "source_url": "url", "classification": "klasifikasi", "subclassification": "sub_klasifikasi", "court": "lembaga_peradilan", "province": "provinsi"}
    on_workers(decisions.sparkSession)
    rows = decisions.select("source_path", _xml_parts([*attributes.values()]).alias("p"))
    values = {name: F.get("p", F.lit(i)).alias(name) for i, name in enumerate(attributes, 1)}
    texts = F.slice("p", len(attributes) + 2, len(XML_TAGS))
    rows = rows.select("source_path", F.get("p", F.lit(0)).alias("rooted"), *values.values(), texts.alias("t"))
    heading = F.get("t", F.lit(XML_TAGS.index("kepala_putusan")))
    rooted = F.when(F.col("rooted") == "putusan", F.col("source_path")).otherwise(F.raise_error(F.concat(F.lit("not a decision: "), F.col("source_path"))))
    lengths = F.map_from_arrays(F.array(*map(F.lit, XML_TAGS)), F.transform("t", F.length))
    return rows.select(rooted.alias("source_path"), *attributes, case_number(heading).alias("case_number_normalized"), case_year(heading).alias("case_year"), lengths.alias("section_lengths"))


def decision_parts(decisions: DataFrame, key: Column | None = None) -> DataFrame:
    """document_id and `sections`, an array of each file's sections as decision_sections has them: one row a file, which nothing has to group again."""
    on_workers(decisions.sparkSession)
    labels = [XML_LABELS.get(t, t) for t in XML_TAGS]
    rows = decisions.select((F.lit(None) if key is None else key).alias("key"), _xml_parts(["id"]).alias("p"))

    @F.arrow_udf("array<struct<section_label:string,start_position:bigint,end_position:bigint,section_text:string>>")
    def cut(parts: pa.Array) -> pa.Array:
        offsets, told, starts, ends, texts = [0], [], [], [], []
        for own in parts.to_pylist():
            at, first = 0, len(told)
            for label, text in zip(labels, own[2:] if own else (), strict=False):
                if text:
                    # all but the last section end in an empty line
                    if len(told) > first:
                        texts[-1] += "\n\n"
                        at += 2
                        ends[-1] = at
                    told.append(label)
                    starts.append(at)
                    at += len(text)
                    ends.append(at)
                    texts.append(text)
            offsets.append(len(told))
        columns = [pa.array(told, pa.string()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64()), pa.array(texts, pa.string())]
        return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, ["section_label", "start_position", "end_position", "section_text"]))

    # a filter on the sections would be moved below the function, and run it again
    return rows.select((F.get("p", F.lit(1)) if key is None else F.col("key")).alias("document_id"), cut.asNondeterministic()("p").alias("sections"))


def decision_sections(decisions: DataFrame, key: Column | None = None) -> DataFrame:
    """document_id and its sections in the order of the tags: squeezed, empty ones dropped, joined by empty lines, with offsets.

    A file's sections are found in its own row: nothing is shuffled.
    """
    # outer, so that no filter on the array's size is inferred, which could parse each file again
    each = decision_parts(decisions, key).select("document_id", F.explode_outer("sections").alias("s")).where("s IS NOT NULL")
    return each.select("document_id", "s.section_label", F.lit(None).cast("string").alias("section_heading"), "s.start_position", "s.end_position", "s.section_text")


def html_sections(pages: DataFrame) -> DataFrame:
    """page_id, section_label, section_number, section_text of plain HTML: title, h1 and p elements as they stand."""
    pattern = r"(?is)<(title|h1|p)\b[^>]*>([^<]*)"
    found = F.regexp_extract_all("html", F.lit(pattern), F.lit(0))
    each = pages.select("page_id", F.posexplode(found).alias("i", "m"))
    text = tx.squeezed(F.regexp_extract("m", pattern, 2))
    rows = each.select("page_id", "i", F.lower(F.regexp_extract("m", pattern, 1)).alias("section_label"), text.alias("section_text")).where("section_text <> ''")
    return rows.select("page_id", "section_label", F.row_number().over(Window.partitionBy("page_id").orderBy("i")).alias("section_number"), "section_text")


def file_mismatches(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """(local_file, problem): files have path and content, the manifest local_file, sha256, bytes."""
    own = files.select(F.element_at(F.split("path", "/"), -1).alias("local_file"), F.sha2("content", 256).alias("_h"), F.length("content").alias("_n"))
    met = manifest.join(own, "local_file", "left")
    problem = F.when(F.col("_h").isNull(), "missing").when(F.col("_n") != F.col("bytes"), "size").when(F.col("_h") != F.col("sha256"), "hash")
    twice = manifest.groupBy("local_file").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("local_file", F.lit("name used twice").alias("problem"))
    return met.select("local_file", problem.alias("problem")).where("problem IS NOT NULL").unionByName(twice)


def row_hash(df: DataFrame) -> DataFrame:
    """A table with row_sha256 over its columns in the order of their names."""
    return df.withColumn("row_sha256", F.sha2(F.to_json(F.struct(*sorted(df.columns)), {"ignoreNullFields": "false"}), 256))


def fingerprint(df: DataFrame) -> str:
    """A hash of a table's rows whatever their order: hashes are summed in four parts, so nothing is collected."""
    part = lambda k: F.sum(F.conv(F.substring("row_sha256", 1 + 12 * k, 12), 16, 10).cast("decimal(38,0)"))
    sums = row_hash(df).agg(F.count(F.lit(1)).alias("n"), *[part(k).alias(f"p{k}") for k in range(4)])
    return sums.select(F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in sums.columns]), 256)).first()[0]


def save_index(index: DataFrame, path: str, *, model_name: str, provenance: dict[str, str] | None = None, overwrite: bool = False) -> None:
    """Chunks with vectors as Parquet and a manifest of one row beside them."""
    mode = "overwrite" if overwrite else "errorifexists"
    index.write.mode(mode).parquet(f"{path}/chunks")
    stats = index.sparkSession.read.parquet(f"{path}/chunks").agg(F.count(F.lit(1)).alias("chunk_count"), F.max(F.size("embedding")).alias("dimension"))
    stats.select(F.lit(INDEX_VERSION).alias("schema_version"), F.lit(model_name).alias("model_name"), "chunk_count", "dimension", F.lit(json.dumps(provenance or {}, sort_keys=True)).alias("provenance")).coalesce(1).write.mode(mode).json(f"{path}/manifest")


def load_index(spark: SparkSession, path: str, *, model_name: str | None = None) -> DataFrame:
    """An index whose manifest matches its version, rows, dimension and, if asked for, model."""
    manifest = spark.read.json(f"{path}/manifest").first()
    if manifest.schema_version != INDEX_VERSION:
        raise ValueError(f"index version {manifest.schema_version} isn't known")
    if model_name is not None and manifest.model_name != model_name:
        raise ValueError(f"the index is of {manifest.model_name}, not {model_name}")
    index = spark.read.parquet(f"{path}/chunks")
    found = index.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if tuple(found) != (manifest.chunk_count, manifest.dimension, manifest.dimension):
        raise ValueError("the index doesn't match its manifest")
    return index


def cached(spark: SparkSession, path: str, key: str, make: Any) -> DataFrame:
    """A table that is made once for each key; what is there under another key is an error, not a guess."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    mark = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/key")
    if mark.getFileSystem(conf).exists(mark):
        found = spark.read.text(f"{path}/key").first()[0]
        if found != key:
            raise ValueError(f"{path} was made from other inputs")
        return spark.read.parquet(f"{path}/rows")
    make().write.mode("overwrite").parquet(f"{path}/rows")
    spark.createDataFrame([(key,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/key")
    return spark.read.parquet(f"{path}/rows")


def markdown(df: DataFrame, *, most: int = 1000) -> str:
    """A small table as Markdown; larger ones are refused."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report has at most {most} rows")
    cell = lambda v: "" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(map(cell, r)) + " |" for r in rows]) + "\n"


def bar_chart(labels: list[str], series: Mapping[str, list[float]], title: str = "") -> str:
    """Grouped bars as SVG."""
    top = max([v for s in series.values() for v in s] + [1e-9])
    width, height, tones = 80 * len(labels) + 60, 240, ("#4477aa", "#ee6677", "#228833", "#ccbb44")
    bars = []
    for j, (name, values) in enumerate(series.items()):
        wide = 60 / len(series)
        bars += [f'<rect x="{50 + 80 * i + wide * j:.1f}" y="{200 - 160 * v / top:.1f}" width="{wide:.1f}" height="{160 * v / top:.1f}" fill="{tones[j % 4]}"><title>{name}: {v:.4f}</title></rect>' for i, v in enumerate(values)]
    names = [f'<text x="{80 + 80 * i}" y="220" text-anchor="middle" font-size="11">{x}</text>' for i, x in enumerate(labels)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}"><text x="10" y="20">{title}</text>{"".join(bars + names)}</svg>'


def line_chart(x: list[float], series: Mapping[str, list[float]], title: str = "") -> str:
    """Lines over common positions as SVG."""
    top, left, right = max([v for s in series.values() for v in s] + [1e-9]), min(x), max(x)
    place = lambda a, v: f"{50 + 300 * (a - left) / ((right - left) or 1):.1f},{200 - 160 * v / top:.1f}"
    tones = ("#4477aa", "#ee6677", "#228833", "#ccbb44")
    lines = [f'<polyline fill="none" stroke="{tones[j % 4]}" points="{" ".join(place(a, v) for a, v in zip(x, values, strict=True))}"><title>{name}</title></polyline>' for j, (name, values) in enumerate(series.items())]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="400" height="240"><text x="10" y="20">{title}</text>{"".join(lines)}</svg>'


def interval_chart(rows: list[tuple[str, float, float, float]], title: str = "") -> str:
    """Means with their intervals (name, low, mean, high) as SVG, with a line at zero."""
    low, high = min([r[1] for r in rows] + [0.0]), max([r[3] for r in rows] + [1e-9])
    place = lambda v: f"{120 + 260 * (v - low) / ((high - low) or 1):.1f}"
    marks = [f'<text x="10" y="{45 + 20 * i}" font-size="11">{name}</text><line x1="{place(a)}" x2="{place(z)}" y1="{40 + 20 * i}" y2="{40 + 20 * i}" stroke="#4477aa"/><circle cx="{place(m)}" cy="{40 + 20 * i}" r="3"><title>{m:.4f}</title></circle>' for i, (name, a, m, z) in enumerate(rows)]
    return f'<svg xmlns="http://www.w3.org/2000/svg" width="400" height="{60 + 20 * len(rows)}"><text x="10" y="20">{title}</text><line x1="{place(0.0)}" x2="{place(0.0)}" y1="30" y2="{40 + 20 * len(rows)}" stroke="#bbbbbb"/>{"".join(marks)}</svg>'


# What a report says of its results at each stage.
CAVEATS = {"pilot": "Pilot: results are exploratory and choose settings only.", "development": "Development: settings were chosen on these questions.", "holdout": "Held-out set: settings were fixed before."}


def report(title: str, stage: str, tables: Mapping[str, DataFrame]) -> str:
    """A Markdown report: a title, the caveat of its stage, and small tables under headings."""
    if stage not in CAVEATS:
        raise ValueError(f"unknown stage {stage}; there are {', '.join(CAVEATS)}")
    return "\n".join([f"# {title}\n", f"> {CAVEATS[stage]}\n", *[f"## {name}\n\n{markdown(df)}" for name, df in tables.items()]])


def run_stages(stages: Mapping[str, Any], wanted: str = "all", **context: Any) -> list[str]:
    """Run named steps in their order, or one of them; gives the names run."""
    if wanted != "all" and wanted not in stages:
        raise ValueError(f"unknown stage {wanted}; there are {', '.join(stages)}")
    names = list(stages) if wanted == "all" else [wanted]
    for name in names:
        stages[name](**context)
    return names
