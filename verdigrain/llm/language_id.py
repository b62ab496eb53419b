"""Language ID by string kernels.

The kernel of two texts counts the character n-grams of every length up to `longest` that both
contain (blended spectrum, presence not counts), divided by the geometric mean of the numbers that
each contains. Landmarks chosen among the labelled texts span a Nyström approximation of that
kernel, and a kernel ridge regression for each language against the rest is fitted in it. As the kernel is
linear in presence vectors, landmarks and regression fold into one matrix; texts are scored by
products of batches of presence vectors with it.

Fitting takes at most `per_language` labelled texts of each language, chosen by hashes of their ids, of
at most `most_languages` languages, and takes each of them whole. Their presence vectors are made and
stored by the executors; the driver gets those of the landmarks, and from each task the sums that the
regression needs. Scoring takes every text whole. n-grams are hashed to 2^16 places. Letters are
lower-cased and every run of other characters counts as one blank.

A text that is null or has no letter gets `und` and score 0; so does everything if nothing is
labelled. Rows with a null id are never learned from. Repeated rows and ties have equal results (of
equally good languages, the first by name). Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from verdigrain.llm.shared import buffers, dropped_tables, released, slices, stored
from verdigrain.session import on_workers

BITS = 16
UNDETERMINED = "und"


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)


#: Characters of a text that are worked on at once.
PART = 1 << 20


def presence(text: str, longest: int) -> np.ndarray:
    """The places of a text's distinct n-grams; none if it has no letter."""
    flags = np.zeros(1 << BITS, bool)

    def mark(clean: np.ndarray) -> None:
        value = np.zeros(len(clean), np.uint64)
        for n in range(1, min(longest, len(clean)) + 1):
            value = value[: len(clean) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + clean[n - 1 :] + np.uint64(n)
            flags[((value ^ (value >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(64 - BITS)).astype(np.int64)] = True

    blank = np.array([32], np.uint64)
    lower, tail, after, found = text.lower(), blank, False, False
    for k in range(0, len(lower), PART):
        points = np.frombuffer(lower[k : k + PART].encode("utf-32-le", "surrogatepass"), "<u4")
        letter = _letters()[points]
        # the first of a run of other characters stays, as a blank; blanks also stand at both ends
        keep = letter.copy()
        keep[1:] |= letter[:-1]
        keep[0] |= after
        after = bool(letter[-1])
        found |= bool(letter.any())
        clean = np.concatenate([tail, np.where(letter, points, 32)[keep].astype(np.uint64)])
        mark(clean)
        tail = clean[max(0, len(clean) - longest + 1) :]
    if not found:
        return np.zeros(0, np.int64)
    mark(np.concatenate([tail, blank]))
    return np.flatnonzero(flags)


class Landmarks:
    """Presence vectors, as columns of norm 1, whose kernels with a text are its features."""

    def __init__(self, places: list[np.ndarray]) -> None:
        self.matrix = np.zeros((1 << BITS, len(places)), np.float32)
        for j, at in enumerate(places):
            self.matrix[at, j] = 1 / np.sqrt(len(at))

    def kernel(self, at: np.ndarray) -> np.ndarray:
        return self.matrix[at].sum(0).astype(np.float64) / np.sqrt(len(at))

    def sums(self, rows: Iterator[tuple[np.ndarray, str]], weight: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
        """Of labelled presence vectors: the weighted sum of the features' outer products, and by label that of the features."""
        names, size = sorted(weight), self.matrix.shape[1]
        gram, total = np.zeros((size, size)), np.zeros((len(names), size))
        for at, label in rows:
            k = self.kernel(at)
            gram += weight[label] * np.outer(k, k)
            total[names.index(label)] += weight[label] * k
        return gram, total


def weights_of(counts: dict[str, int]) -> dict[str, float]:
    """Every language weighs as much as any other; the mean weight of a text is 1."""
    rows = sum(counts.values())
    return {g: rows / (len(counts) * n) for g, n in counts.items()}


class LanguageModel:
    """labels, and the matrix of place by language whose product with presence vectors scores them."""

    def __init__(self, labels: list[str], matrix: np.ndarray, longest: int) -> None:
        self.labels, self.matrix, self.longest = labels, matrix, longest

    @staticmethod
    def empty(longest: int = 4) -> "LanguageModel":
        return LanguageModel([], np.zeros((1 << BITS, 0), np.float32), longest)

    @staticmethod
    def solved(names: list[str], marks: Landmarks, kernel: np.ndarray, gram: np.ndarray, total: np.ndarray, longest: int, ridge: float) -> "LanguageModel":
        """From the landmarks' own kernel and the sums over all rows: the Nyström map, and one ridge regression for each language."""
        values, vectors = np.linalg.eigh(kernel)
        good = values > 1e-6 * values[-1]
        root = vectors[:, good] / np.sqrt(values[good])
        # targets are 1 for a language's own texts and -1 for all others
        goals = 2 * total - total.sum(0)
        found = np.linalg.solve(root.T @ gram @ root + ridge * np.eye(root.shape[1]), root.T @ goals.T)
        return LanguageModel(names, (marks.matrix @ (root @ found).astype(np.float32)).astype(np.float32), longest)

    @staticmethod
    def fitted(texts: list[str], labels: list[str], *, longest: int = 4, landmarks: int = 256, ridge: float = 0.1) -> "LanguageModel":
        """Of texts in the order in which they may be landmarks."""
        rows = [(t, g) for t, g in zip((presence(x, longest) for x in texts), labels, strict=True) if len(t)]
        weight = weights_of(Counter(g for _, g in rows))
        if not weight:
            return LanguageModel.empty(longest)
        own = [t for t, _ in rows[:landmarks]]
        marks = Landmarks(own)
        return LanguageModel.solved(sorted(weight), marks, np.stack([marks.kernel(t) for t in own]), *marks.sums(iter(rows), weight), longest, ridge)

    def scored(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """The best language of each text and its score, by one matrix product."""
        places = [presence(t, self.longest) for t in texts]
        if not self.labels:
            return [UNDETERMINED] * len(texts), np.zeros(len(texts))
        vectors = np.zeros((len(texts), 1 << BITS), np.float32)
        for k, at in enumerate(places):
            vectors[k, at] = 1 / np.sqrt(max(1, len(at)))
        values = vectors @ self.matrix
        best = values.argmax(1)
        empty = np.array([not len(at) for at in places], bool)
        score = np.where(empty, 0.0, np.clip((values[np.arange(len(texts)), best].astype(np.float64) + 1) / 2, 0, 1))
        return [UNDETERMINED if e else self.labels[b] for e, b in zip(empty, best, strict=True)], score


def held_out(id_column: str = "doc_id") -> Column:
    """The rows to test on: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_column).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(df: DataFrame, *, where: Column | None = None, id_column: str = "doc_id", text_column: str = "text", label_column: str = "lang", per_language: int = 300, most_languages: int = 200, longest: int = 4, landmarks: int = 256, ridge: float = 0.1) -> LanguageModel:
    """Fit on at most per_language * most_languages labelled texts, each whole; the first `landmarks` of them, languages in turn, are the landmarks.

    Only ids go through the choice; texts are read for the chosen ones and stay with the executors. Of
    rows with the same id and label, the smallest text counts.
    """
    on_workers(df.sparkSession)
    rows = df.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull() & (~held_out(id_column) if where is None else where))
    order = (F.xxhash64(id_column), F.col(id_column))
    salt = F.pmod(F.xxhash64(id_column, F.lit(1)), F.lit(256))
    keys = [id_column, label_column]
    # the first of each salt, then of those: no language's rows meet in one task
    some = rows.select(*keys, salt.alias("_salt")).withColumn("_rank", F.row_number().over(Window.partitionBy(label_column, "_salt").orderBy(*order))).where(F.col("_rank") <= -(-per_language // 16))
    chosen = some.withColumn("_rank", F.row_number().over(Window.partitionBy(label_column).orderBy(*order))).where(F.col("_rank") <= per_language)
    # at most per_language * most_languages rows of ids
    chosen = chosen.orderBy("_rank", label_column).limit(per_language * most_languages).groupBy(*keys).agg(F.min("_rank").alias("_rank"))
    texts = rows.select(*keys, F.col(text_column).alias("_text")).where("_text IS NOT NULL").join(F.broadcast(chosen), keys).groupBy(*keys, "_rank").agg(F.min("_text").alias("_text"))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = [presence(t, longest).astype("<u2").tobytes() for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(places, pa.binary())], names=["label", "rank", "places"])

    held: list[str] = []
    sample = stored(texts.select(F.col(label_column).cast("string").alias("label"), "_rank", "_text").mapInArrow(vectors, "label string, rank int, places binary").where("length(places) > 0"), "language-sample", held)
    weight = weights_of({r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()})
    if not weight:
        return LanguageModel.empty(longest)
    # at most `landmarks` vectors of at most 2^16 places
    own = [np.frombuffer(r.places, "<u2").astype(np.int64) for r in sample.orderBy("rank", "label", "places").limit(landmarks).collect()]

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = ((np.frombuffer(p, "<u2").astype(np.int64), g) for batch in batches for g, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True))
        gram, total = Landmarks(own).sums(rows, weight)
        yield pa.RecordBatch.from_arrays([pa.array([gram.tobytes()], pa.binary()), pa.array([total.tobytes()], pa.binary())], names=["gram", "total"])
        released()

    parts = sample.select("label", "places").coalesce(16).mapInArrow(summed, "gram binary, total binary").collect()
    dropped_tables(df.sparkSession, held)
    marks, names = Landmarks(own), sorted(weight)
    shaped = lambda column, rows: sum(np.frombuffer(p[column]).reshape(rows, len(own)) for p in parts)
    return LanguageModel.solved(names, marks, np.stack([marks.kernel(t) for t in own]), shaped("gram", len(own)), shaped("total", len(names)), longest, ridge)


def identified_rows(df: DataFrame, model: LanguageModel, *, least: float = 0.0, text_column: str = "text") -> DataFrame:
    """The rows whose language can be told, with a score of at least `least`, with all their columns."""
    inner = {c: f"__own_{k}" for k, c in enumerate(df.columns)}
    found = identify(df.toDF(*inner.values()), model, text_column=inner[text_column])
    kept = found.where((F.col("lang_pred") != UNDETERMINED) & (F.col("score") >= least))
    return kept.select(*[F.col(own).alias(c) for c, own in inner.items()])


def identify(df: DataFrame, model: LanguageModel, *, text_column: str = "text", keep: list[str] | None = None, batch: int = 64) -> DataFrame:
    """Add lang_pred and score to the columns of `keep` (all, if none are named); columns of those names are replaced."""
    on_workers(df.sparkSession)
    keep = [c for c in (df.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    rows = df.select(*keep, F.col(text_column).alias("_scored_text"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for got in batches:
            data, offsets = buffers(got.column(len(keep)))
            names, scores = [], []
            for i, j in slices(offsets):
                texts = [data[offsets[k] : offsets[k + 1]].tobytes().decode() for k in range(i, j)]
                for k in range(0, len(texts), batch):
                    one, two = model.scored(texts[k : k + batch])
                    names += one
                    scores.append(two)
            yield pa.RecordBatch.from_arrays([*got.columns[: len(keep)], pa.array(names, pa.string()), pa.array(np.concatenate(scores) if scores else [], pa.float64())], names=[*keep, "lang_pred", "score"])
        released()

    schema = rows.drop("_scored_text").schema.add("lang_pred", "string").add("score", "double")
    return rows.mapInArrow(scored, schema)
