"""Huffman files and BPE round trip against the tokenizers library."""

import hashlib
import heapq
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from croupier.llm import bpe, common, huffman

WORD = public_tokenizers.path("word_bpe_49k.json")
BYTE = public_tokenizers.path("byte_bpe_50k.json")
PARTS = ["a", "B", "É", "ß", "'s", "'t", "'", "l'eau", "!", "...", "12", " ", "\n", "\t", "\xa0", "\x85", "\x1c", "<|endoftext|>", "中",
         "\U0001F600", "Ab.", "\r\n", "  ", chr(0x3000), chr(0x200B), chr(0x301), "-"]


def strange_texts(n):
    r = random.Random(11)
    return ["".join(r.choice(PARTS) for _ in range(r.randint(0, 12))) for _ in range(n)] + [None, "", "x" * 5000, "ab " * 4000]


def test_word_table_equals_the_library():
    table, texts = huffman.WordIds(WORD, limit=200), strange_texts(3000)
    for lo in range(0, len(texts), 50):
        for text, ids in zip(texts[lo:lo + 50], table.of(texts[lo:lo + 50])):
            assert ids.tolist() == table.tokenizer.encode(text or "", add_special_tokens=False).ids + [huffman.END_ID]


def test_split_words_encode_to_the_text():
    tokenizer, split = bpe.load(BYTE), bpe.splitter(bpe.special_tokens(BYTE))
    for text in strange_texts(3000):
        ids = [i for w in split(text or "") for i in tokenizer.encode(w, add_special_tokens=False).ids]
        assert ids == tokenizer.encode(text or "", add_special_tokens=False).ids


def huffman_cost(counts):
    heap, cost = list(counts), 0
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap) + heapq.heappop(heap)
        cost += a
        heapq.heappush(heap, a)
    return cost


@pytest.mark.parametrize("n", [2, 3, 17, 300])
def test_code_lengths_are_optimal_and_limited(n):
    r = np.random.default_rng(n)
    counts = np.maximum(1, (r.pareto(0.7, n) * 5).astype(np.int64))
    free = huffman.code_lengths(counts, 40)
    assert int((free * counts).sum()) == huffman_cost(counts.tolist())
    limit = max(2, int(np.ceil(np.log2(n))) + 1)
    short = huffman.code_lengths(counts, limit)
    assert short.max() <= limit and (0.5 ** short).sum() <= 1 + 1e-12
    fib = np.array([1, 1, 2, 3, 5, 8, 13, 21])
    assert (0.5 ** huffman.code_lengths(fib, 4)).sum() == 1


@pytest.mark.parametrize("size", [1, 255, 256, 257, 5000])
def test_block_round_trip(size):
    r = np.random.default_rng(size)
    ids = np.minimum(r.zipf(1.3, size), 49_000)
    known, counts = np.unique(ids, return_counts=True)
    code = huffman.Code(known, huffman.code_lengths(counts))
    payload, checkpoints = code.encode(ids)
    assert len(checkpoints) == -(-size // huffman.LANE)
    assert (code.decode(payload, checkpoints, size) == ids).all()


def expected_files(rows):
    t = bpe.load(WORD)
    start, out = 0, {}
    for doc_id, text in sorted(rows):
        ids = t.encode(text or "", add_special_tokens=False).ids + [1]
        out[doc_id] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    return out


def test_files_equal_the_library(spark, documents):
    rows = [(d.doc_id, d.text) for d in documents.collect()] + [(10_000 + i, t) for i, t in enumerate(strange_texts(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    folder = common.scratch_dir(spark, "test-huffman")
    huffman.write(docs, WORD, folder, block_ids=3000)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in huffman.read(spark, folder).collect()}
    assert got == expected_files(rows)
    assert spark.read.parquet(f"{folder}/blocks").filter("n_ids > 3000 AND size(doc_ids) > 1").count() == 0


def test_files_odd_rows(spark, odd, nothing):
    got = huffman.round_trip(odd, WORD).collect()
    assert len(got) == odd.count()
    nulls = [r for r in got if r.doc_id is None]
    assert len(nulls) == 2 and min(r.start for r in got) == min(r.start for r in nulls) == 0
    assert {r.n_tokens for r in got if r.doc_id in (3, 4, 5)} == {1}
    ends = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(ends, ends[1:]))
    assert huffman.round_trip(nothing, WORD).count() == 0


def digest(t, text):
    ids = t.encode(text or "", add_special_tokens=False).ids
    return (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
            hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest())


def test_bpe_digests_equal_the_library(spark, documents, odd, nothing, monkeypatch):
    t = bpe.load(BYTE)
    rows = [(d.doc_id, d.text) for d in documents.collect()] + [(10_000 + i, x) for i, x in enumerate(strange_texts(200))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: tuple(r)[1:] for r in bpe.digests(docs, BYTE).collect()}
    assert got == {i: digest(t, x) for i, x in rows}
    again = bpe.digests(odd, BYTE).collect()
    assert sorted(tuple(r)[1:] for r in again) == sorted(digest(t, r.text) for r in odd.collect())
    assert bpe.digests(nothing, BYTE).count() == 0


def test_encode_then_decode_returns_the_text(documents, spark):
    ids = bpe.encode(documents, BYTE)
    back = {r.doc_id: r.text for r in bpe.decode(ids, BYTE).collect()}
    assert back == {r.doc_id: r.text for r in documents.collect()}


def test_packing_round_trip():
    r = np.random.default_rng(0)
    for values in (np.zeros(0, np.int64), np.array([0, 254, 255, 256, 2**32 - 1]), r.integers(0, 2**20, 5000), r.integers(0, 255, 100)):
        assert (common.unpack(common.pack(values)) == values).all()
