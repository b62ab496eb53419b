import re
import zlib

import numpy as np
from pyspark.sql import functions as F

from tests.llm.cases import documents, saved
from verdigrain.llm import language_id, queries


def test_held_out_accuracy(spark):
    sf_dir = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op3_language_id(spark, sf_dir).collect()
    assert len(rows) == len(truth)
    good = total = 0
    for r in rows:
        lang, text = truth[r.doc_id]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or ""))
        if r.held_out and lang is not None and r.lang_pred != "und":
            good, total = good + (r.lang_pred == lang), total + 1
    assert total > 200 and good / total > 0.97


def test_awkward(spark, tmp_path):
    rows = queries.op3_language_id(spark, saved(documents(spark), tmp_path)).collect()
    assert len(rows) == documents(spark).count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[0].lang_pred == by_id[1].lang_pred == by_id[3].lang_pred == "und" and by_id[0].score == 0
    assert by_id[8].lang_pred in ("en", "de") and by_id[8].score == by_id[9].score
    assert all(r.held_out is False for r in rows if r.doc_id is None)


def test_nothing_labelled(spark):
    model = language_id.fit(documents(spark).where("false"))
    assert {r.lang_pred for r in language_id.identify(documents(spark), model).collect()} == {"und"}
    assert language_id.identify(documents(spark).where("false"), model).count() == 0


def test_presence_kernel():
    sets = lambda t: set(language_id.presence(t, 3).tolist())
    assert sets("Ab, ab") == sets("ab AB") and sets("ab") < sets("ab cd") and not sets("12 !")
    model = language_id.LanguageModel.fitted(["aaa bbb ab", "ccc ddd cd"], ["x", "y"])
    assert model.scored(["abba", "dccd", ""])[0] == ["x", "y", "und"]


def plain_grams(text, longest=4):
    """n-grams as strings, over letters with blanks for all else; none without a letter."""
    low = text.lower()
    if not any(c.isalpha() for c in low):
        return set()
    clean = re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in low)).lstrip(" ")
    clean = f" {clean} "
    return {clean[i : i + n] for n in range(1, longest + 1) for i in range(len(clean) - n + 1)}


def test_against_plain_kernel_ridge(spark):
    """All texts as landmarks, against a kernel ridge regression without Nyström map and without hashing."""
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("lang IS NOT NULL AND length(text) < 900").orderBy("doc_id").limit(70).collect()
    rows = [(r.text, r.lang) for r in rows if plain_grams(r.text or "")]
    train, other = rows[: len(rows) * 2 // 3], rows[len(rows) * 2 // 3 :]
    kernel = lambda a, b: len(a & b) / np.sqrt(len(a) * len(b))
    sets = [plain_grams(t) for t, _ in train]
    names = sorted({g for _, g in train})
    weight = np.array([len(train) / (len(names) * sum(h == g for _, h in train)) for _, g in train])
    goals = np.where(np.array([g for _, g in train])[:, None] == np.array(names)[None], 1.0, -1.0)
    full = np.array([[kernel(a, b) for b in sets] for a in sets])
    solved = np.linalg.solve(weight[:, None] * full + 0.1 * np.eye(len(train)), weight[:, None] * goals)
    expected = np.array([[kernel(plain_grams(t), b) for b in sets] for t, _ in other]) @ solved
    model = language_id.LanguageModel.fitted([t for t, _ in train], [g for _, g in train], landmarks=len(train))
    labels, score = model.scored([t for t, _ in other])
    assert labels == [names[k] for k in expected.argmax(1)]
    assert np.abs(score - np.clip((expected.max(1) + 1) / 2, 0, 1)).max() < 0.02


def test_fit_on_executors_is_fit_on_the_driver(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = language_id.fit(docs, landmarks=40, per_language=30)
    # every language has fewer than 30 or its first 30 by hash
    rows = docs.where(F.col("lang").isNotNull() & ~language_id.held_out()).select("lang", "text", F.xxhash64("doc_id").alias("h")).collect()
    by = {}
    for r in sorted(rows, key=lambda r: r.h):
        by.setdefault(r.lang, []).append(r.text)
    turns = sorted((k, g, t) for g, own in by.items() for k, t in enumerate(own[:30]) if t is not None)
    plain = language_id.LanguageModel.fitted([t for _, _, t in turns], [g for _, g, _ in turns], landmarks=40)
    assert found.labels == plain.labels and np.allclose(found.matrix, plain.matrix, atol=1e-4)


def test_long_texts_in_parts(monkeypatch):
    text = "Ärger über 12 dies, das!  und jenes -- ΟΔΟΣ" * 7
    whole = language_id.presence(text, 4).tolist()
    for part in (1, 2, 3, 7):
        monkeypatch.setattr(language_id, "PART", part)
        assert language_id.presence(text, 4).tolist() == whole
