import random
import re

import pytest

from tests.llm.cases import documents, saved
from verdigrain.llm import license_scan, queries

PHRASES = {("mit", "license"): "mit", ("apache", "license"): "apache", ("general", "public", "license"): "gpl"}


def brute(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    hits = [(i, i + len(p) - 1, label) for p, label in PHRASES.items() for i in range(len(words)) if tuple(words[i : i + len(p)]) == p]
    return len(words), len(hits), min((h[0] for h in hits), default=None), max((h[0] for h in hits), default=None), ",".join(sorted({h[2] for h in hits}))


@pytest.fixture
def awkward(spark, tmp_path):
    return saved(documents(spark), tmp_path)


def check(spark, sf_dir):
    rows = queries.op1_license_scan(spark, sf_dir).collect()
    texts = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        texts.setdefault(r.doc_id, []).append(r.text)
    assert len(rows) == sum(map(len, texts.values()))
    for r in rows:
        if r.doc_id is None:
            continue
        n_words, n_base, first, last, labels = brute(texts[r.doc_id][0])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n_words, n_base, first, last, labels)
        assert 0 <= r.score <= 1 and set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(","))
        assert list(filter(None, r.labels.split(","))) == sorted(set(filter(None, r.labels.split(","))))


def test_awkward(spark, awkward):
    check(spark, awkward)


def test_whole_table(spark):
    check(spark, "/root/testdata/sf0.001")


def test_regions():
    auto = license_scan.compiled([("x", "one <<optional>>two <<any:2>> three<</optional>> <<one:four|five six>> seven")])
    spans = lambda text: [s[:2] for s in license_scan.spans(auto, license_scan.words_of(text))]
    assert spans("one four seven") == [(0, 3)]
    assert spans("One, two a b three; five six seven!") == [(0, 8)]
    assert spans("one two a b c three four seven") == []
    assert spans("one four eight") == [] and spans("") == []
    with pytest.raises(ValueError):
        license_scan.compiled([("x", "<<optional>>all<</optional>>")])


def test_empty_table(spark):
    assert license_scan.scan_licenses(documents(spark).where("false")).count() == 0


def parsed(markup):
    """A template as nested lists: words, ("optional", parts), ("any", n), ("one", wordings)."""
    root = []
    stack = [root]
    for text, close, name, value in re.findall(r"([^<]+)|<<(/?)([a-z]+)(?::([^>]*))?>>", markup):
        if text:
            stack[-1] += license_scan.words_of(text)
        elif close:
            stack.pop()
        elif name == "optional":
            part = []
            stack[-1].append(("optional", part))
            stack.append(part)
        else:
            stack[-1].append((name, int(value) if name == "any" else [license_scan.words_of(v) for v in value.split("|")]))
    return root


def ends(parts, words, at):
    """All places at which a run from `at` may end, by trying everything."""
    if not parts:
        return {at}
    head, rest = parts[0], parts[1:]
    if isinstance(head, bytes):
        return ends(rest, words, at + 1) if at < len(words) and words[at] == head else set()
    kind, value = head
    if kind == "optional":
        return ends(value + rest, words, at) | ends(rest, words, at)
    if kind == "any":
        return set().union(*(ends(rest, words, at + n) for n in range(min(value, len(words) - at) + 1)))
    return set().union(*(ends([*v, *rest], words, at) for v in value))


def backtracked(templates, words):
    found = []
    for i in range(len(words)):
        for label, markup in templates.items():
            stops = {e for e in ends(parsed(markup), words, i) if e > i}
            if stops:
                found.append((i, max(stops), label))
    return found


def wording(parts, draw):
    """A random text that a template accepts."""
    out = []
    for part in parts:
        if isinstance(part, bytes):
            out.append(part.decode())
        elif part[0] == "optional":
            out += wording(part[1], draw) if draw.random() < 0.5 else []
        elif part[0] == "any":
            out += [draw.choice("2024 jane doe of the project".split()) for _ in range(draw.randint(0, min(part[1], 5)))]
        else:
            out += [w.decode() for w in draw.choice(part[1])]
    return out


def test_all_templates_against_backtracking(spark):
    draw = random.Random(11)
    texts = []
    for label, markup in license_scan.TEMPLATES.items():
        for _ in range(3):
            own = wording(parsed(markup), draw)
            texts.append((label, own))
            # one word changed, left out or put in
            broken, k = list(own), draw.randrange(len(own))
            broken[k : k + 1] = draw.choice([[], ["zebra"], [broken[k], "zebra"]])
            texts.append((None, broken))
    for _ in range(100):
        texts.append((None, [draw.choice("licensed under the terms of mit license cc by nc 4 0 spdx identifier gnu general public version 3 or any later".split()) for _ in range(40)]))
    df = spark.createDataFrame([(k, draw.choice([" ", ", ", "-"]).join(["Intro", *t, "end"])) for k, (_, t) in enumerate(texts)], "doc_id long, text string")
    for r in license_scan.scan_licenses(df).collect():
        label, own = texts[r.doc_id]
        words = [b"intro", *(w.lower().encode() for w in own), b"end"]
        assert [(s["first"], s["end"], s["label"]) for s in r.spans] == backtracked(license_scan.TEMPLATES, words)
        assert label is None or any(s["label"] == label and s["first"] == 1 and s["end"] >= len(words) - 1 for s in r.spans)


def test_wordings():
    auto = license_scan.compiled(license_scan.TEMPLATES.items())
    labels = lambda text: {s[2] for s in license_scan.spans(auto, license_scan.words_of(text))}
    assert labels("Licensed under CC BY-NC 4.0") == {"cc-by-nc"} and labels("SPDX-License-Identifier: BSD-3-Clause") == {"spdx-BSD-3-Clause"}
    assert labels("This work is licensed under the Creative Commons Attribution-ShareAlike 3.0 Unported License.") == {"cc-by-sa"}
    assert labels("Released under the terms of the MIT License") == {"mit-notice"} and labels("licensed under nothing") == set()
    assert labels("# Licensed under the Apache License, Version 2.0 (the \"License\");") == {"apache-2.0"}
