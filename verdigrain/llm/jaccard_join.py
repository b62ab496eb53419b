"""Near-duplicate self-join on n-gram Jaccard similarity with Bayesian candidate pruning.

1. Every text is normalised to its words (lower-case, split at whatever isn't a letter or digit).
   Texts with equal words are one node, so that copies never meet as pairs.
2. Each node gets MinHash values of its word shingles; values in bands give candidate buckets.
   Buckets in several bands with the same members are kept once, in the first band.
3. A bucket is cut into blocks of bounded size and each pair of blocks is a task's group, so no task
   holds an unbounded bucket. In a group, a pair counts only in the first band that both share.
   Values are compared step by step; a pair is dropped when the posterior probability that its
   similarity reaches the threshold, under a uniform prior, is below `tolerance`. All others are
   verified exactly on their sets of shingles, which are numbered by the words themselves and not by
   hashes (by blocked matrix products where pairs are many).
4. A group tells, for each node, how many rows it is linked with there and one edge of a spanning
   forest; pairs themselves are never rows. Connected classes come from alternating large-star and
   small-star steps on those edges, stored after each step.

A pair at similarity s shares a band with probability 1-(1-s^4)^32, over 0.9999999 at 0.8; pruning
loses at most `tolerance` more. Texts of fewer words than the shingle width link only with their
equals. Texts without words are equal when identical; null counts as empty. class_id is the smallest
id of a class, null if it has none; repeated rows are copies of each other. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from verdigrain.llm import textvec
from verdigrain.llm.shared import buffers, dropped_tables, fresh_path, released, slices, stored
from verdigrain.session import on_workers

BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
STEP = 32
#: Nodes, and words, that one block of a bucket has about.
BLOCK_NODES, BLOCK_WORDS = 512, 500_000
_BAND_SHIFT = 58


@lru_cache(1)
def _multipliers() -> np.ndarray:
    return textvec.mixed(np.arange(1, HASHES + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def shingle_values(hashes: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """The hash of the shingle at every word, and where each text's begin (texts of fewer words have none)."""
    counts = np.maximum(np.diff(first) - width + 1, 0)
    value = np.zeros(max(0, len(hashes) - width + 1), np.uint64)
    for k in range(width):
        value = value * np.uint64(0x2545F4914F6CDD1D) + hashes[k : k + len(value)]
    stops = np.cumsum(counts)
    at = np.repeat(first[:-1] - (stops - counts), counts) + np.arange(int(stops[-1]) if len(stops) else 0)
    return textvec.mixed(value[at]), np.concatenate([[0], stops])


def signatures(values: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """MinHash values, 32 bits each, of texts that have shingles."""
    out = np.empty((len(edges) - 1, HASHES), np.uint32)
    for k, m in enumerate(_multipliers()):
        out[:, k] = np.minimum.reduceat(values * m >> np.uint64(32), edges[:-1])
    return out


def band_values(signature: np.ndarray) -> np.ndarray:
    """One value for each band: its number in the upper bits, then a hash of its rows."""
    rows = signature.reshape(len(signature), BANDS, ROWS).astype(np.uint64)
    value = np.zeros((len(signature), BANDS), np.uint64)
    for k in range(ROWS):
        value = textvec.mixed(value * np.uint64(0x2545F4914F6CDD1D) + rows[:, :, k] + np.uint64(1))
    return (value >> np.uint64(64 - _BAND_SHIFT)) | (np.arange(BANDS, dtype=np.uint64) << np.uint64(_BAND_SHIFT))


def keys(data: np.ndarray, offsets: np.ndarray, low: np.ndarray, first: np.ndarray) -> list[bytes]:
    """A 16-byte digest of each text's words, or of the text itself where it has none."""
    inside = textvec._WORD[low]
    keep = inside.copy()
    keep[1:] |= inside[:-1]
    clean = np.where(inside, low, 32)
    found = []
    for k, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
        body = clean[a:b][keep[a:b]].tobytes().strip(b" ") if first[k + 1] > first[k] else b"\0" + data[a:b].tobytes()
        found.append(hashlib.blake2b(body, digest_size=16).digest())
    return found


@lru_cache(8)
def least_matches(threshold: float, tolerance: float) -> dict[int, int]:
    """By number of values compared, the fewest matches that a pair must have to go on.

    Given m matches of n, the similarity has a Beta(m+1, n-m+1) posterior; its upper tail at the
    threshold is the chance of at most m successes in n+1 draws.
    """
    found = {}
    for n in range(STEP, HASHES + 1, STEP):
        tail, least = 0.0, n
        for m in range(n + 1):
            tail += math.comb(n + 1, m) * threshold**m * (1 - threshold) ** (n + 1 - m)
            if tail >= tolerance:
                least = m
                break
        found[n] = least
    return found


def linked(sets: list[np.ndarray], signature: np.ndarray, block: np.ndarray, pair: tuple[int, int], band: int, threshold: float, tolerance: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of a group that are similar, across two blocks or within one, in this band first."""
    left, right = np.flatnonzero(block == pair[0]), np.flatnonzero(block == pair[1])
    bands = band_values(signature)
    sizes = np.array([len(s) for s in sets])
    # the hashes of the shingles that at least two rows have, as columns
    xs, ys = [], []
    step = max(1, (1 << 18) // max(1, len(right)))
    for k in range(0, len(left), step):
        x = left[k : k + step]
        a, b = sizes[x][:, None], sizes[right][None, :]
        ok = (np.minimum(a, b) >= threshold * np.maximum(a, b) - 1e-9) & (bands[x, band][:, None] == bands[right, band][None, :])
        if pair[0] == pair[1]:
            ok &= x[:, None] < right[None, :]
        for earlier in range(band):
            ok &= bands[x, earlier][:, None] != bands[right, earlier][None, :]
        i, j = np.nonzero(ok)
        i, j = x[i], right[j]
        matches = np.zeros(len(i), np.int64)
        for n, least in least_matches(threshold, tolerance).items():
            matches += (signature[i, n - STEP : n] == signature[j, n - STEP : n]).sum(1)
            alive = matches >= least
            i, j, matches = i[alive], j[alive], matches[alive]
        xs.append(i)
        ys.append(j)
    x, y = (np.concatenate(v) if v else np.zeros(0, np.int64) for v in (xs, ys))
    if not len(x):
        return x, y
    if len(x) <= 4 * len(sets):
        common = np.array([len(np.intersect1d(sets[i], sets[j], assume_unique=True)) for i, j in zip(x.tolist(), y.tolist(), strict=True)])
    else:
        common = _products(sets, x, y)
    union = sizes[x] + sizes[y] - common
    good = common >= threshold * union - 1e-9
    return x[good], y[good]


def _products(sets: list[np.ndarray], x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of many pairs of few sets: presence vectors multiplied in blocks of columns."""
    values, which, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    place = np.where(counts > 1, np.cumsum(counts > 1) - 1, -1)[which]
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    row, place = row[place >= 0], place[place >= 0]
    order = np.argsort(place, kind="stable")
    row, place = row[order], place[order]
    total, width = np.zeros((len(sets), len(sets)), np.float32), 4096
    for begin in range(0, int(place[-1]) + 1 if len(place) else 0, width):
        a, b = np.searchsorted(place, [begin, begin + width])
        part = np.zeros((len(sets), width), np.float32)
        part[row[a:b], place[a:b] - begin] = 1
        total += part @ part.T
    return total[x, y].astype(np.int64)


def _roots(n: int, x: np.ndarray, y: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The smallest value that each of n rows is connected with by the given pairs."""
    label = value.copy()
    while True:
        new = label.copy()
        np.minimum.at(new, x, label[y])
        np.minimum.at(new, y, label[x])
        if (new == label).all():
            return label
        label = new


def _groups(width: int, threshold: float, tolerance: float):
    """A function over sorted rows of (bucket, i, j, block, node, key, copies, text): node, root and links of each linked node."""
    names = ["node", "root", "links"]

    def told(key: tuple[int, int, int], rows: list[tuple]) -> pa.RecordBatch | None:
        seen: dict[int, tuple] = {}
        texts = pa.array([r[4] for r in rows], pa.string())
        data, offsets = buffers(texts)
        words = textvec.Words()
        for begin, end in slices(offsets):
            own, at = data[offsets[begin] : offsets[end]], offsets[begin : end + 1] - offsets[begin]
            low = textvec.lowered(own)
            starts, ends, first = textvec.words(low, at)
            hashes = textvec.span_hashes(low, starts, ends)
            numbers = words.numbers(low, starts, ends, hashes)
            values, edges = shingle_values(hashes, first, width)
            for k, digest in enumerate(keys(own, at, low, first)):
                block, node, wanted, copies = rows[begin + k][:4]
                # ids needn't be unique: only the text that the node stands for counts
                if digest == wanted and node not in seen and edges[k] < edges[k + 1]:
                    seen[node] = (block, copies, values[edges[k] : edges[k + 1]], numbers[first[k] : first[k + 1]])
        if len(seen) < 2:
            return None
        nodes = np.array(sorted(seen), np.int64)
        parts = [seen[n][2] for n in nodes.tolist()]
        # sets of shingles by the words themselves
        spelled = [seen[n][3] for n in nodes.tolist()]
        runs, cuts = textvec.numbered_shingles(np.concatenate(spelled), np.concatenate([[0], np.cumsum([len(w) for w in spelled])]), width)
        sets = [np.unique(runs[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]
        edges = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        signature = signatures(np.concatenate(parts), edges)
        block = np.array([seen[n][0] for n in nodes.tolist()])
        copies = np.array([seen[n][1] for n in nodes.tolist()], np.int64)
        x, y = linked(sets, signature, block, key[1:], key[0] >> _BAND_SHIFT, threshold, tolerance)
        if not len(x):
            return None
        links = np.zeros(len(nodes), np.int64)
        np.add.at(links, x, copies[y])
        np.add.at(links, y, copies[x])
        root = _roots(len(nodes), x, y, nodes)
        some = np.flatnonzero(links)
        return pa.RecordBatch.from_arrays([pa.array(nodes[some]), pa.array(root[some]), pa.array(links[some])], names=names)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, []
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(batch.num_columns)]
            for h, i, j, *row in zip(*columns, strict=True):
                if (h, i, j) != key:
                    if len(rows) > 1 and (out := told(key, rows)) is not None:
                        yield out
                    key, rows = (h, i, j), []
                rows.append(row)
        if len(rows) > 1 and (out := told(key, rows)) is not None:
            yield out
        rows.clear()
        released()

    return work


def keyed(df: DataFrame, *, id_column: str, text_column: str, width: int) -> DataFrame:
    """id, key, words and band values (null where there are no shingles) of every row."""
    on_workers(df.sparkSession)
    id_type = dict(df.dtypes)[id_column]

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(1))
            found: list[bytes] = []
            counts: list[np.ndarray] = []
            bands: list = []
            for i, j in slices(offsets):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                low = textvec.lowered(own)
                starts, ends, first = textvec.words(low, at)
                found += keys(own, at, low, first)
                counts.append(np.diff(first))
                values, edges = shingle_values(textvec.span_hashes(low, starts, ends), first, width)
                some = np.flatnonzero(np.diff(edges))
                rows: list = [None] * (j - i)
                if len(some):
                    each = band_values(signatures(values, np.append(edges[some], len(values)))).astype(np.int64)
                    for k, value in zip(some.tolist(), each, strict=True):
                        rows[k] = value
                bands += rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.binary()), pa.array(np.concatenate(counts) if counts else [], pa.int64()), pa.array(bands, pa.list_(pa.int64()))], names=["id", "key", "words", "bands"])
        released()

    return df.select(id_column, text_column).mapInArrow(made, f"id {id_type}, key binary, words bigint, bands array<bigint>")


def classes(edges: DataFrame) -> DataFrame:
    """node and label (the smallest node of its connected class) of every node with an edge.

    Alternates large-star and small-star steps until the edges stay the same.
    """
    spark, held = edges.sparkSession, []

    def kept(df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(spark, name)
        held.append(path)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    def star(e: DataFrame, large: bool) -> DataFrame:
        if large:
            e = e.union(e.select("v", "u"))
        least = kept(e.groupBy("u").agg(F.min("v").alias("v")).select("u", F.least("u", "v").alias("m")), "star-least")
        met = e.join(least, "u")
        if large:
            out = met.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        else:
            out = met.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))).alias("e")).select("e.u", "e.v")
        return kept(out.where("u <> v").distinct(), "star-edges")

    now = kept(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "star-edges")
    mark = None
    while True:
        now = star(star(now, True), False)
        seen = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if seen == mark:
            break
        mark = seen
    last = held.pop()
    dropped_tables(spark, held)
    return spark.read.schema("u bigint, v bigint").parquet(last).select(F.col("u").alias("node"), F.col("v").alias("label"))


def with_key(df: DataFrame, *, text_column: str = "text", name: str = "__join_key") -> DataFrame:
    """All columns of a table and the key of its text."""
    on_workers(df.sparkSession)
    columns = df.columns
    rows = df.select("*", F.col(text_column).alias(name))

    def made(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column(len(columns)))
            found: list[bytes] = []
            for i, j in slices(offsets):
                own, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                low = textvec.lowered(own)
                found += keys(own, at, low, textvec.words(low, at)[2])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(columns)], pa.array(found, pa.binary())], names=[*columns, name])
        released()

    return rows.mapInArrow(made, rows.drop(name).schema.add(name, "binary"))


def _solved(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", width: int = 5, threshold: float = 0.8, tolerance: float = 1e-6) -> tuple[DataFrame, DataFrame]:
    """(id, key) of every row; key, node, rep, copies, links, class_id, stays of every node."""
    held: list[str] = []
    rows = stored(keyed(df, id_column=id_column, text_column=text_column, width=width), "join-keys")
    # stored: a node's number is made once, and no two nodes have the same
    each = rows.groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("copies"), F.first("words").alias("words"), F.first("bands").alias("bands"))
    nodes = stored(each.withColumn("node", F.monotonically_increasing_id()), "join-nodes", held)
    band_rows = nodes.where("bands IS NOT NULL").select("node", "words", F.explode("bands").alias("bucket"))
    buckets = band_rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"), F.sum("words").alias("w"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("y")).where("n > 1")
    # the band's number leads a bucket's value, so that the first of equal buckets is the smallest
    once = stored(buckets.groupBy("n", "w", "x", "y").agg(F.min("bucket").alias("bucket")).select("bucket", F.greatest(F.ceil(F.col("n") / BLOCK_NODES), F.ceil(F.col("w") / BLOCK_WORDS)).cast("int").alias("blocks")), "join-buckets", held)
    met = band_rows.select("bucket", "node").join(once, "bucket")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    places = met.select("node", "bucket", own.alias("block"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")).select("node", F.struct("bucket", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block").alias("place"))
    # a node is in at most one bucket for each band, in as many places as that bucket has blocks
    wanted = places.groupBy("node").agg(F.collect_list("place").alias("places")).join(nodes.select("node", "key", "rep", "copies"), "node")
    texts = df.select(F.col(id_column).alias("rep"), F.col(text_column).alias("text"))
    sent = wanted.join(texts, wanted["rep"].eqNullSafe(texts["rep"])).select(F.explode("places").alias("p"), "node", "key", "copies", "text").select("p.bucket", "p.i", "p.j", "p.block", "node", "key", "copies", "text")
    grouped = sent.repartition("bucket", "i", "j").sortWithinPartitions("bucket", "i", "j")
    found = stored(grouped.mapInArrow(_groups(width, threshold, tolerance), "node bigint, root bigint, links bigint"), "join-links", held)
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    label = classes(found.select(F.col("node").alias("u"), F.col("root").alias("v")))
    named = stored(nodes.join(links, "node", "left").join(label, "node", "left").select("key", "node", "rep", "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("label", "node").alias("label")), "join-named", held)
    # the node with the smallest id leads its class
    first = stored(named.groupBy("label").agg(F.min(F.struct(F.col("rep").isNull().alias("null"), "rep", "node")).alias("lead")).select("label", F.col("lead.rep").alias("class_id"), F.col("lead.node").alias("lead")), "join-classes", held)
    result = named.join(first, "label").select("key", "node", "rep", "copies", "links", "class_id", (F.col("node") == F.col("lead")).alias("stays"))
    found = stored(result, "join-results")
    # the rows and the results are what is left to read
    dropped_tables(df.sparkSession, held)
    return rows.select("id", "key"), found


def join(df: DataFrame, *, id_column: str = "doc_id", **parameters) -> DataFrame:
    """Each row's id, class_id, copy_id (the smallest id with its words), n_copies, n_links (other rows that are similar).

    Only one row for each node is compared; every row gets its node's results.
    """
    rows, result = _solved(df, id_column=id_column, **parameters)
    return rows.join(result, "key").select(F.col("id").alias(id_column), "class_id", F.col("rep").alias("copy_id"), F.col("copies").alias("n_copies"), (F.col("links") + F.col("copies") - 1).alias("n_links"))


def kept_rows(df: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", **parameters) -> DataFrame:
    """The rows that stay when one of each class does, with all their columns: the one with the smallest id."""
    _, result = _solved(df, id_column=id_column, text_column=text_column, **parameters)
    keep = result.where("stays").select(F.col("key").alias("__keep_key"), F.col("rep").alias("__keep_id"))
    rows = with_key(df, text_column=text_column)
    met = rows.join(keep, (rows["__join_key"] == keep["__keep_key"]) & rows[id_column].eqNullSafe(keep["__keep_id"]), "left_semi")
    order = Window.partitionBy("__join_key", id_column).orderBy(id_column)
    return met.withColumn("__join_copy", F.row_number().over(order)).where("__join_copy = 1").select(*df.columns)
