import re
from collections import defaultdict

import pytest

from tests.llm.cases import documents, saved
from verdigrain.llm import mixing, queries


def expected_targets(sizes, weights=(5, 2, 1)):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    capped, total = set(), sum(sizes.values())
    while True:
        free = [s for s in names if s not in capped]
        rest = total - 3 * sum(sizes[s] for s in capped)
        goal = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / sum(weight[f] for f in free) for s in names}
        over = {s for s in free if goal[s] > 3 * sizes[s]}
        if not over:
            return goal
        capped |= over


def check(spark, sf_dir):
    docs = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op5_source_mixing(spark, sf_dir).collect()
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes, of = defaultdict(int), {}
    for key, text, source in docs:
        sizes[source] += count(text)
        of[key] = (source, count(text))
    goal = expected_targets(sizes)
    taken = defaultdict(int)
    assert len(rows) == len(docs)
    for r in rows:
        if r.doc_id is not None:
            source, size = of[r.doc_id]
            assert (r.size, r.source_size) == (size, sizes[source]) and r.target == pytest.approx(goal[source])
            taken[source] += r.taken
        assert 0 <= r.taken <= 3 * r.size
    for source, words in taken.items():
        if all(s != source for k, _, s in docs if k is None):
            assert abs(words - goal[source]) <= 4
    again = queries.op5_source_mixing(spark, sf_dir).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_awkward(spark, tmp_path):
    check(spark, saved(documents(spark), tmp_path))


def test_whole_table(spark):
    check(spark, "/root/testdata/sf0.001")


def test_no_words(spark):
    docs = documents(spark)
    assert mixing.mix(docs.where("false"), weights=(5, 2, 1)).count() == 0
    assert [r.taken for r in mixing.mix(docs.where("doc_id < 3"), weights=(5, 2, 1)).collect()] == [0, 0, 0]
