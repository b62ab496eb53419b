import hashlib
from collections import Counter

from tests.llm.cases import documents, saved
from verdigrain.llm import exact_dedup, queries


def check(spark, sf_dir):
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows = queries.op6_exact_dedup(spark, sf_dir).collect()
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    groups = {}
    for key, text in docs:
        groups.setdefault(sha(text), []).append(key)
    assert Counter((r.doc_id, r.text_sha256) for r in rows) == Counter((key, sha(text)) for key, text in docs)
    kept = Counter()
    for r in rows:
        own = groups[r.text_sha256]
        assert r.keep_id == max((x for x in own if x is not None), default=None) and r.group_size == len(own)
        kept[r.text_sha256] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_awkward(spark, tmp_path):
    check(spark, saved(documents(spark), tmp_path))


def test_whole_table(spark):
    check(spark, "/root/testdata/sf0.001")


def test_kept_rows_and_batches(spark):
    docs = documents(spark)
    index = exact_dedup.DigestIndex(spark, name="digests_of_two_batches")
    kept = exact_dedup.kept_rows(docs, index)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({r.text or "" for r in docs.collect()})
    # a second batch: what the index has stays with its first id
    later = spark.createDataFrame([(100, "Word"), (101, "new"), (102, "new")], "doc_id long, text string")
    found = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(later, index).collect()}
    assert found == {100: (6, False), 101: (102, False), 102: (102, True)}
    assert index.table().where("keep_id = 102").count() == 1
    before = sorted(map(str, index.rows().collect()))
    index.compact()
    assert sorted(map(str, index.rows().collect())) == sorted(map(str, index.table().collect())) == before
    files = [f for f in index.rows().inputFiles() if "part-" in f]
    assert len(files) <= index.buckets
    again = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(later, index).collect()}
    assert again == {100: (6, False), 101: (102, False), 102: (102, True)}
    index.forget()


def test_string_ids_and_no_tables_left(spark):
    rows = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", None)], "doc_id string, text string")
    found = {r.doc_id: (r.keep_id, r.kept) for r in exact_dedup.dedup(rows).collect()}
    assert found == {"a": ("b", False), "b": ("b", True), "c": ("c", True)}
    assert sorted(r.doc_id for r in exact_dedup.kept_rows(rows).collect()) == ["b", "c"]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("digest_index_")]


def test_empty_table(spark):
    assert exact_dedup.dedup(documents(spark).where("false")).count() == 0


def test_index_is_not_moved(spark):
    index = exact_dedup.DigestIndex(spark, name="digests_not_moved")
    new = exact_dedup.counted(documents(spark)).groupBy("digest").count()
    plan = new.join(index.table().hint("merge"), "digest", "left_anti")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") <= 1 and "SortMergeJoin" in plan
