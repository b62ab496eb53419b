import re
from collections import Counter, defaultdict

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.cases import documents, saved
from tests.llm.test_jaccard_join import brute
from tests.llm.test_mixing import expected_targets


def stages(spark, sf_dir, folder):
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    out.append(docs)
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return out


def test_stages_against_plain_versions(spark, tmp_path):
    found = stages(spark, "/root/testdata/sf0.001", tmp_path)
    assert all(t.columns == found[0].columns for t in found[:-1])
    texts = [{r.doc_id: (r.text, r.source) for r in t.collect()} for t in found[:4]]
    assert texts[1] == {k: v for k, v in texts[0].items() if any(c.isalpha() for c in v[0] or "")}
    largest = {}
    for k, (text, _) in texts[1].items():
        largest[text] = max(k, largest.get(text, k))
    assert set(texts[2]) == set(largest.values())
    classes = brute([(k, v[0]) for k, v in texts[2].items()])
    assert set(texts[3]) == {c for c, _ in classes.values()}
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    sizes, taken = defaultdict(int), defaultdict(int)
    for text, source in texts[3].values():
        sizes[source] += count(text)
    mixed = found[4].collect()
    for r in mixed:
        taken[r.source] += count(r.text)
        whole = texts[3][r.doc_id][0]
        assert whole.startswith(r.text) and r.text
    assert all(abs(taken[s] - t) <= 2 for s, t in expected_targets(sizes).items())
    assert max(Counter(r.doc_id for r in mixed).values()) <= 3
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    wanted, got = Counter(), Counter()
    for r in mixed:
        wanted[r.doc_id] += len(exact.encode(r.text, add_special_tokens=False).ids) + 1
    for r in found[5].collect():
        got[r.doc_id] += r.length
    assert got == wanted


def test_run_and_awkward(spark, tmp_path):
    sf_dir = saved(documents(spark), tmp_path / "in")
    found = stages(spark, sf_dir, tmp_path)
    assert all(t.columns == found[0].columns for t in found[:-1])
    assert {r.text for r in found[3].collect()} <= {r.text for r in found[0].collect()}
    rows = corpus_pipeline.run(spark, sf_dir)
    assert rows.columns == found[5].columns and rows.count() > 0


def test_empty(spark, tmp_path):
    sf_dir = saved(documents(spark).where("false"), tmp_path)
    assert corpus_pipeline.run(spark, sf_dir).count() == 0
