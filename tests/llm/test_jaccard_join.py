import random
import re
from collections import Counter

import numpy as np

from tests.llm.cases import documents, saved
from verdigrain.llm import jaccard_join, queries


def words(text):
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs):
    """By id: class, links, by comparing all pairs."""
    sets, parent = {}, {}
    for key, text in docs:
        own = words(text)
        n = min(5, len(own))
        sets[key] = frozenset(tuple(own[i : i + n]) for i in range(len(own) - n + 1)) if own else frozenset([("", text or "")])
        parent[key] = key

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    links, by_shingle = Counter(), {}
    for key, own in sets.items():
        for s in own:
            by_shingle.setdefault(s, []).append(key)
    common = Counter((a, b) for keys in by_shingle.values() for i, a in enumerate(keys) for b in keys[i + 1 :])
    for (a, b), n in common.items():
        if n >= 0.8 * (len(sets[a]) + len(sets[b]) - n):
            links[a] += 1
            links[b] += 1
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    least = {}
    for key in sets:
        least[root(key)] = min(key, least.get(root(key), key))
    return {key: (least[root(key)], links[key]) for key in sets}


def check(rows, docs):
    expected = brute(docs)
    found = {r.doc_id: (r.class_id, r.n_links) for r in rows}
    assert found == expected


def test_whole_table(spark):
    for sf in ("sf0.001", "sf0.01"):
        docs = spark.read.parquet(f"/root/testdata/{sf}/documents.parquet").select("doc_id", "text").collect()
        check(queries.op4_jaccard_join(spark, f"/root/testdata/{sf}").collect(), [(d.doc_id, d.text) for d in docs])


def test_blocks(spark, monkeypatch):
    """A large group of near copies, cut into many blocks, against all pairs."""
    monkeypatch.setattr(jaccard_join, "BLOCK_NODES", 7)
    draw = random.Random(5)
    base = [f"w{draw.randrange(10**6)}" for _ in range(120)]
    docs = []
    for i in range(60):
        own = list(base)
        for _ in range(draw.randrange(0, 4)):
            own[draw.randrange(len(own))] = f"x{draw.randrange(10**6)}"
        docs.append((i, " ".join(own)))
    docs += [(100 + i, docs[i][1].upper()) for i in range(10)]
    check(jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_awkward(spark, tmp_path):
    table = documents(spark)
    rows = queries.op4_jaccard_join(spark, saved(table, tmp_path)).collect()
    assert len(rows) == table.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    assert by_id[0].class_id == by_id[1].class_id and by_id[3].class_id == 3
    assert by_id[5].class_id == by_id[6].class_id == 5 and by_id[5].n_links == 3
    assert by_id[8].class_id == by_id[9].class_id == 8
    kept = jaccard_join.kept_rows(table)
    assert kept.columns == table.columns
    got = kept.collect()
    assert Counter(r.doc_id for r in got) == Counter(x for x in {r.class_id for r in rows} | {None})
    assert jaccard_join.join(table.where("false")).count() == 0


def test_pruning_keeps_similar_pairs():
    least = jaccard_join.least_matches(0.8, 1e-6)
    draw = np.random.default_rng(3)
    kept = [all(matches[:n].sum() >= m for n, m in least.items()) for matches in draw.random((20000, jaccard_join.HASHES)) < 0.8]
    assert np.mean(kept) > 0.9995
    low = [all(matches[:n].sum() >= m for n, m in least.items()) for matches in draw.random((20000, jaccard_join.HASHES)) < 0.3]
    assert np.mean(low) < 0.01


def test_words_that_share_a_hash(spark, monkeypatch):
    """Texts whose words all differ but have equal hashes aren't similar."""
    def twin(n, odd):
        return "".join("ab"[(bin(k).count("1") + odd) % 2] for k in range(n))

    rest = [f"word{k}" for k in range(30)]
    docs = [(k, " ".join([*rest[:15], *[twin(1024, k % 2) + "c" * j for j in range(15)]])) for k in range(4)]
    check(jaccard_join.join(spark.createDataFrame(docs, "doc_id long, text string")).collect(), docs)


def test_numbers_of_words_and_shingles():
    from verdigrain.llm import textvec

    draw = random.Random(2)
    texts = [" ".join(draw.choice("abc") * draw.randint(1, 3) for _ in range(draw.randrange(30))) for _ in range(20)]
    data = np.frombuffer(" ".join(texts).encode() + b" ", np.uint8)
    offsets = np.cumsum([0, *[len(t) + 1 for t in texts]])
    starts, ends, first = textvec.words(data, offsets)
    # hashes that many words share
    numbers = textvec.Words().numbers(data, starts, ends, (ends - starts).astype(np.uint64))
    spelled = [data[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
    assert len({*zip(numbers.tolist(), spelled, strict=True)}) == len(set(spelled)) == len(set(numbers.tolist()))
    for width in (1, 2, 3, 5, 8):
        runs, edges = textvec.numbered_shingles(numbers, first, width)
        plain = [tuple(spelled[i : i + width]) for k in range(len(texts)) for i in range(first[k], first[k + 1] - width + 1)]
        assert len(runs) == len(plain) == edges[-1]
        assert len({*zip(runs.tolist(), plain, strict=True)}) == len(set(plain)) == len(set(runs.tolist()))
