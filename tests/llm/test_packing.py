import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.cases import documents, saved
from verdigrain.llm import packing, queries
from verdigrain.llm.tokens import WordCachedTokenizer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check(spark, sf_dir):
    rows = queries.op2_vector_packing(spark, sf_dir).collect()
    exact = Tokenizer.from_file(PATH)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    ids = {}
    for key, text in docs:
        ids.setdefault(key, []).append([*exact.encode(text or "", add_special_tokens=False).ids, 1])
    pieces, bins = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert set(pieces) == set(ids)
    for key, own in pieces.items():
        if len(ids[key]) == 1:
            (whole,), at = ids[key], 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(whole)
                assert r.ids_crc32 == zlib.crc32(np.array(whole[at : at + r.length], "<u4").tobytes())
                at += r.length
            assert at == len(whole)
        else:
            assert sum(r.length for r in own) == sum(map(len, ids[key]))
    padded = 0
    for spans in bins.values():
        at = 0
        for offset, length in sorted(spans):
            assert offset == at
            at += length
        assert at <= 2048
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    assert padded <= 0.01 * sum(len(x) for y in ids.values() for x in y)


def test_awkward(spark, tmp_path):
    check(spark, saved(documents(spark), tmp_path))


def test_whole_table(spark):
    check(spark, "/root/testdata/sf0.001")


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.characters(codec="utf-8"), st.sampled_from(" '\n\tstredvlmé1½")), max_size=30), max_size=5))
def test_same_ids(texts):
    import pyarrow as pa

    exact = Tokenizer.from_file(PATH)
    found = [x.tolist() for x in WordCachedTokenizer.of(PATH).encoded(pa.array(texts, pa.string()))]
    assert found == [exact.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 70), max_size=60), st.integers(1, 6))
def test_limits(sizes, segments):
    bins = packing.VectorBins((16, segments, 15), 8)
    for k, size in enumerate(sizes):
        bins.add(k, size)
    bins.finish()
    out = bins.pieces()
    used, by_key = {}, {}
    for key, start, length, number, offset in out:
        used.setdefault(number, []).append((offset, length))
        by_key.setdefault(key, []).append((start, length))
    for spans in used.values():
        assert len(spans) <= segments and sum(n for _, n in spans) <= 16
    for k, size in enumerate(sizes):
        at = 0
        for start, length in sorted(by_key[k]):
            assert start == at
            at += length
        assert at == size


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=1, max_size=70), max_size=60), st.integers(1, 6), st.integers(1, 20), st.booleans())
def test_masks_and_any_loss_limit(masks, segments, loss, whole):
    bins = packing.VectorBins((16, segments, loss), 8)
    for k, mask in enumerate(masks):
        bins.add(k, len(mask), None if whole else np.array(mask))
    bins.finish()
    used, by_key = {}, {}
    for key, start, length, number, offset in bins.pieces():
        used.setdefault(number, []).append((length, length if whole else sum(masks[key][start : start + length])))
        by_key.setdefault(key, []).append((start, length))
    for spans in used.values():
        assert len(spans) <= segments and sum(n for n, _ in spans) <= 16 and sum(n for _, n in spans) <= loss
    for k, mask in enumerate(masks):
        at = 0
        for start, length in sorted(by_key[k]):
            assert start == at and length >= 1
            at += length
        assert at == len(mask)
    assert not bins.before


def test_each_limit_binds():
    def sums(limits, items, pool=512):
        bins, out = packing.VectorBins(limits, pool), {}
        for k, (size, loss) in enumerate(items):
            bins.add(k, size, np.arange(size) < loss)
        bins.finish()
        for key, start, length, number, _ in bins.pieces():
            own = out.setdefault(number, [0, 0, 0])
            for n, more in enumerate((length, 1, max(0, min(start + length, items[key][1]) - start))):
                own[n] += more
        return np.array(list(out.values())).max(0).tolist()

    assert sums((2048, 256, 2048), [(100, 10)] * 600)[0] == 2048
    assert sums((2048, 256, 2048), [(1, 0)] * 600)[1] == 256
    most = sums((2048, 256, 300), [(100, 50)] * 600)
    assert most[2] == 300 and most[1] < 256


def test_mask_column(spark):
    rows = [(k, "one two three four five " * 8, [k % 2 == 0] * 10 if k % 3 else None) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, bears array<boolean>").coalesce(1)
    out = packing.pack(df, tokenizer_file=PATH, max_tokens=64, max_loss_tokens=20, loss_column="bears").collect()
    used, total = {}, {}
    for r in out:
        mask = rows[r.doc_id][2]
        flags = [True] * r.doc_tokens if mask is None else mask + [True] * (r.doc_tokens - 10)
        used[r.sequence_id] = used.get(r.sequence_id, 0) + sum(flags[r.start : r.start + r.length])
        total[r.doc_id] = total.get(r.doc_id, 0) + r.length
    assert max(used.values()) == 20 and all(total[r.doc_id] == r.doc_tokens for r in out) and len(total) == 40


def test_empty_table(spark):
    assert packing.pack(documents(spark).where("false"), tokenizer_file=PATH).count() == 0


def test_more_words_than_the_cache_holds():
    import pyarrow as pa

    exact = Tokenizer.from_file(PATH)
    texts = [" ".join(f"w{k} {k * 7919}" for k in range(400)), "", "again w1 w2", None, " ".join("ab" * (k % 13) for k in range(300))]
    found = [x.tolist() for x in WordCachedTokenizer(PATH, most=7).encoded(pa.array(texts, pa.string()))]
    assert found == [exact.encode(t or "", add_special_tokens=False).ids for t in texts]


def thue_morse(n, odd):
    return "".join("ab"[(bin(k).count("1") + odd) % 2] for k in range(n))


def test_words_that_share_a_hash(monkeypatch):
    import pyarrow as pa

    from verdigrain.llm import textvec, tokens

    exact = Tokenizer.from_file(PATH)
    texts = [thue_morse(2048, k) + " x" for k in (0, 1, 0)] + [thue_morse(1024, k) for k in (1, 0)]
    found = [x.tolist() for x in WordCachedTokenizer(PATH).encoded(pa.array(texts))]
    assert found == [exact.encode(t, add_special_tokens=False).ids for t in texts]
    # any two words of a length share a hash
    monkeypatch.setattr(tokens.textvec, "span_hashes", lambda units, starts, ends: (ends - starts).astype(np.uint64) % np.uint64(3))
    texts = ["one two six ten eleven", "ten six two one", "seven's a 12 of 34", "one two"]
    found = [x.tolist() for x in WordCachedTokenizer(PATH).encoded(pa.array(texts))]
    assert found == [exact.encode(t, add_special_tokens=False).ids for t in texts]
    assert textvec is tokens.textvec


def test_more_than_a_million_words():
    import pyarrow as pa

    text = " ".join(map(str, range(1_100_000)))
    (found,) = WordCachedTokenizer(PATH).encoded(pa.array([text]))
    assert found.tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_prompts_bear_no_loss(spark):
    texts = ["a prompt\nan answer that is longer " * 3, "no prompt at all", "\nonly an answer", "é👍 prompt\n", None]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").coalesce(1)
    exact = Tokenizer.from_file(PATH)
    out = packing.pack(df, tokenizer_file=PATH, max_tokens=16, max_loss_tokens=5, prompt_end="\n").collect()
    used = {}
    for r in out:
        text = texts[r.doc_id] or ""
        whole = exact.encode(text, add_special_tokens=False)
        end = text.find("\n") + 1
        bears = [a >= end for a, _ in whole.offsets] + [True] if end else [True] * (len(whole.ids) + 1)
        used[r.sequence_id] = used.get(r.sequence_id, 0) + sum(bears[r.start : r.start + r.length])
        assert r.doc_tokens == len(bears)
    assert max(used.values()) == 5


def placed(items, limits, pool):
    """The heuristic, item by item: (key, start, length, bin) in the order of placement."""
    waiting, out, bins = [], [], 0

    def cut(item, most, loss):
        n = 0
        while n < min(most, len(item[2])) and sum(item[2][: n + 1]) <= loss:
            n += 1
        return n

    def fill(size):
        nonlocal bins
        left = [size, *limits[1:]]
        while waiting and left[0] and left[1]:
            means = [sum(len(i[2]) for i in waiting) / len(waiting), 1, sum(sum(i[2]) for i in waiting) / len(waiting)]
            need = [(len(i[2]), 1, sum(i[2])) for i in waiting]
            score = [sum(m / c * (room / c) * (n / c) for m, c, room, n in zip(means, limits, left, x, strict=True)) for x in need]
            fits = [k for k, x in enumerate(need) if x[0] <= left[0] and x[2] <= left[2]]
            if fits:
                k = max(fits, key=lambda k: (round(score[k], 12), -k))
                n = len(waiting[k][2])
            else:
                order = sorted(range(len(waiting)), key=lambda k: len(waiting[k][2]))
                k = next((k for k in order if cut(waiting[k], left[0], left[2])), None)
                if k is None:
                    break
                n = cut(waiting[k], left[0], left[2])
            key, start, mask = waiting[k]
            out.append((key, start, n, bins))
            left = [left[0] - n, left[1] - 1, left[2] - sum(mask[:n])]
            if n == len(mask):
                waiting[k] = waiting[-1]
                waiting.pop()
            else:
                waiting[k] = (key, start + n, mask[n:])
        bins += 1

    for key, mask in enumerate(items):
        start = 0
        while len(mask) - start >= limits[0] or sum(mask[start:]) > limits[2]:
            n = cut((key, 0, mask[start:]), limits[0], limits[2])
            out.append((key, start, n, bins))
            bins, start = bins + 1, start + n
        if start < len(mask):
            waiting.append((key, start, mask[start:]))
        if len(waiting) == pool:
            while len(waiting) > pool // 2:
                fill(limits[0])
    while waiting:
        rest = sum(len(i[2]) for i in waiting)
        fill(limits[0] if rest >= limits[0] else 1 << (rest.bit_length() - 1))
    return out


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.booleans(), min_size=1, max_size=40), max_size=30), st.integers(2, 6), st.integers(3, 16))
def test_placement_against_plain_version(masks, segments, loss):
    bins = packing.VectorBins((16, segments, loss), 8)
    for k, mask in enumerate(masks):
        bins.add(k, len(mask), np.array(mask))
    bins.finish()
    assert [x[:4] for x in bins.pieces()] == placed(masks, (16, segments, loss), 8)
