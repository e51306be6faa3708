"""Packing against the tokenizers library, the rules of a packing, and one global best fit."""

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from croupier.llm import packing, registry
from tests.llm.conftest import SMALL
from tests.llm.test_tokens import strange_texts

BYTE = public_tokenizers.path("byte_bpe_50k.json")


def library():
    tokenizer = Tokenizer.from_file(BYTE)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [0]


def expected_pieces(docs, size):
    ids_of, out = library(), []
    for doc_id, text in docs:
        ids = ids_of(text)
        start, k = 0, 0
        while start < len(ids):
            length = size if (len(ids) - start) % size == 0 else (len(ids) - start) % size
            out.append((doc_id, k, start, length, zlib.crc32(np.array(ids[start:start + length], "<u4").tobytes())))
            start, k = start + length, k + 1
    return out


def key(rows):
    return sorted(rows, key=repr)


def check_packing(rows, size):
    """Sequences without gaps and at most ``size`` long; how many there are."""
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


def check(rows, docs, size):
    assert key((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == key(expected_pieces(docs, size))
    return check_packing(rows, size)


def test_query_on_whole_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    rows = registry.QUERIES["op11_best_fit_packing"](spark, SMALL).collect()
    n = check(rows, docs, 2048)
    assert n <= 1.01 * -(-sum(r.length for r in rows) // 2048) + 1


def test_parts_equal_the_library():
    table, ids_of, texts = packing.PartIds(BYTE, limit=200), library(), strange_texts(3000)
    for lo in range(0, len(texts), 50):
        for text, ids in zip(texts[lo:lo + 50], table.of(texts[lo:lo + 50])):
            assert ids.tolist() == ids_of(text)


@pytest.mark.parametrize("items,fan", [(packing.ITEMS, 8), (60, 2)])
def test_odd_rows_and_rounds(spark, odd, items, fan):
    docs = [(r.doc_id, r.text) for r in odd.collect()] * 2 + [(100 + i, t) for i, t in enumerate(strange_texts(300))]
    table = spark.createDataFrame([(i, t, 5, 6) for i, t in docs], "doc_id long, text string, piece int, fill int").repartition(7)
    cut = packing.pieces(table, BYTE, 32)
    placed = packing.pack(cut, 32, items, fan)
    rows = placed.collect()
    n = check(rows, docs, 32)
    best = len(packing.best_fit(np.array([r.length for r in rows]), 32)[2])
    assert n <= 1.05 * best + 1
    # the training rows hold the ids of their pieces, in order
    where = {(r.sequence_id, r.offset): r for r in rows}
    for s in packing.sequences(cut, placed).collect():
        at = 0
        for doc_id, length in zip(s.doc_ids, s.lengths):
            r = where[s.sequence_id, at]
            assert (r.doc_id, r.length) == (doc_id, length)
            assert zlib.crc32(np.array(s.ids[at:at + length], "<u4").tobytes()) == r.ids_crc32
            at += length
        assert at == len(s.ids)


def _made(spark, lengths, parts):
    rows = [(i, i, 0, 0, n, 0) for i, n in enumerate(lengths)]
    return spark.createDataFrame(rows, "piece_id long, doc_id long, piece int, start long, length long, ids_crc32 long").repartition(parts)


@pytest.mark.parametrize("lengths", [[60] * 400, [1] * 1000, [100] * 50, [51] * 300 + [49] * 300, [99] * 200 + [1] * 7])
def test_residuals_meet_in_later_rounds(spark, lengths):
    rows = packing.pack(_made(spark, lengths, 16), 100, fan=4).collect()
    n = check_packing(rows, 100)
    best = len(packing.best_fit(np.array(lengths), 100)[2])
    assert sorted(r.length for r in rows) == sorted(lengths) and len({r.piece_id for r in rows}) == len(lengths)
    assert n <= best + 1 + len(lengths) // 100


def test_best_fit_is_best_fit():
    r = random.Random(2)
    for _ in range(50):
        lengths = [r.randint(1, 50) for _ in range(r.randint(1, 120))]
        place, offset, fill = packing.best_fit(np.array(lengths), 50)
        bins: list[int] = []
        for n in sorted(lengths, reverse=True):
            room = min((50 - b for b in bins if 50 - b >= n), default=None)
            if room is None:
                bins.append(n)
            else:
                bins[bins.index(50 - room)] += n
        assert sorted(bins) == sorted(fill)


def test_empty_table(spark, nothing):
    out = packing.digests(nothing, BYTE)
    assert out.collect() == [] and dict(out.dtypes)["piece"] == "int"
