"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming search, exact check.

Texts are read as lower-cased words (runs of letters, digits or ``_``) and their five-word
shingles; an item of fewer words is one shingle of all its words. For every item size a window of
that many shingles slides over the text, one shingle at a time. The window's 128-bit SimHash is
the bitwise majority over its shingles, so a shingle weighs as often as it occurs.

Windows are taken wherever the text holds at least one shingle of the benchmark (any item's): a
window without one has similarity 0 to every item, so this loses nothing, and it leaves most
texts without a window. A window with fewer shingles of the benchmark than a match must share with
an item of the size is passed over, which loses nothing either. Which item a window resembles is
found by the fingerprints alone.

Search: a fingerprint is cut into ``BLOCKS`` blocks. If two fingerprints differ in at most
``RADIUS`` bits, then in at least one block they differ in at most ``RADIUS // BLOCKS`` bits. Each
block has a table from block value to the items within that block radius, so the union over the
blocks holds every item within ``RADIUS``. Those are compared in full, and the survivors are
verified by exact weighted Jaccard similarity (sum of the smaller shingle counts over the sum of
the larger). A match is a similarity of at least ``THRESHOLD``.

A pair at the threshold is expected to differ in about 19 of the 128 bits, with a deviation of 4;
``RADIUS`` leaves more than six deviations. Equal passages differ in none.

Items are the small side: at most ``MAX_ITEMS`` of them reach the driver and the tasks at a time;
a larger benchmark is dealt over several passes. Documents are read row by row without a shuffle;
a stretch of windows is cut into overlapping pieces of bounded size.

Cases: NULL or wordless texts and items match nothing. A text shorter than an item is compared as
a whole. Repeated documents or items each give rows. An empty table gives no rows. NULL ids are
carried. Ties of similarity go to the earliest window. Further columns are ignored by ``matches``
and kept by ``clean``.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.llm.common import HashedWords, mix64, shingles

WIDTH = 5
THRESHOLD = 0.8
BITS = 128
BLOCKS = 16
RADIUS = 47
PIECE = 4096  # shingles whose windows are in memory at a time
MAX_ITEMS = 100_000
_WORD = re.compile(r"\w+")


def words_of(text: str | None, words: HashedWords) -> np.ndarray:
    return words.of(_WORD.findall((text or "").lower()))


def votes(hashes: np.ndarray) -> np.ndarray:
    """(n, BITS) matrix of 0/1: the bits that each shingle votes for."""
    both = np.stack((hashes, mix64(hashes + np.uint64(0x9E3779B97F4A7C15))), axis=1)
    return np.unpackbits(both.view(np.uint8), axis=1)


def running(bits: np.ndarray) -> np.ndarray:
    sums = np.zeros((len(bits) + 1, *bits.shape[1:]), np.int32)
    np.cumsum(bits, axis=0, out=sums[1:])
    return sums


def window_prints(bits: np.ndarray, size: int) -> np.ndarray:
    """Fingerprints of all windows of ``size`` rows, as BLOCKS bytes each: the bitwise majority."""
    return _prints(running(bits), size, np.arange(len(bits) - size + 1))


def _prints(sums: np.ndarray, size: int, rows: np.ndarray) -> np.ndarray:
    """Fingerprints of the windows that begin at ``rows``, from the running sums of the votes."""
    return np.packbits(2 * (sums[rows + size] - sums[rows]) > size, axis=1)


class Item:
    def __init__(self, number: int, hashes: np.ndarray) -> None:
        self.number, self.size = number, len(hashes)
        self.counts = Counter(hashes.tolist())
        self.print = window_prints(votes(hashes), len(hashes))[0]

    def similarity(self, window: np.ndarray) -> float:
        common = sum((Counter(window.tolist()) & self.counts).values())
        return common / (self.size + len(window) - common)


class HammingIndex:
    """Items of one size by the blocks of their fingerprints; a table entry is a set of 64 items."""

    GROUP = 64

    def __init__(self, items: list[Item]) -> None:
        self.items = items
        self.prints = np.stack([x.print for x in items])
        width = BITS // BLOCKS
        near = np.array([sum(1 << b for b in c) for r in range(RADIUS // BLOCKS + 1) for c in combinations(range(width), r)])
        self.tables = np.zeros((-(-len(items) // self.GROUP), BLOCKS, 1 << width), np.uint64)
        for j, x in enumerate(items):
            for b in range(BLOCKS):
                self.tables[j // self.GROUP, b, x.print[b] ^ near] |= np.uint64(1 << j % self.GROUP)

    def within(self, prints: np.ndarray) -> Iterator[tuple[int, Item]]:
        """(row, item) of all fingerprints at most RADIUS bits apart."""
        for g, table in enumerate(self.tables):
            found = np.zeros(len(prints), np.uint64)
            for b in range(BLOCKS):
                found |= table[b][prints[:, b]]
            row = np.flatnonzero(found)
            left = found[row]
            while len(row):  # take the lowest item of each set until the sets are empty
                item = g * self.GROUP + np.bitwise_count((left & (~left + np.uint64(1))) - np.uint64(1)).astype(np.int64)
                far = np.bitwise_count(prints[row] ^ self.prints[item]).sum(axis=1, dtype=np.int32)
                for k in np.flatnonzero(far <= RADIUS):
                    yield int(row[k]), self.items[item[k]]
                left = left & (left - np.uint64(1))
                row, left = row[left != 0], left[left != 0]


class Matcher:
    """Finds benchmark items in texts. ``items``: (number, text) pairs."""

    def __init__(self, items: list[tuple[int, str]], threshold: float = THRESHOLD) -> None:
        self.words = HashedWords()
        self.threshold = threshold
        by_size: dict[int, dict[int, list[Item]]] = {}
        known: dict[int, list[np.ndarray]] = {}
        for number, text in items:
            w = words_of(text, self.words)
            if len(w):
                hashes = shingles(w, WIDTH)
                width = min(WIDTH, len(w))
                known.setdefault(width, []).append(hashes)
                by_size.setdefault(width, {}).setdefault(len(hashes), []).append(Item(number, hashes))
        self.index = {width: {n: HammingIndex(group) for n, group in sorted(sizes.items())} for width, sizes in by_size.items()}
        self.known = {width: np.unique(np.concatenate(hashes)) for width, hashes in known.items()}
        self.maybe = {}
        for width, hashes in self.known.items():  # a quick first test on 20 bits of the hash
            self.maybe[width] = np.zeros(1 << 20, bool)
            self.maybe[width][hashes >> np.uint64(44)] = True

    def search(self, text: str | None) -> dict[int, tuple[float, int]]:
        """item number -> (similarity, first word) of the best window of the text."""
        best: dict[int, tuple[float, int]] = {}
        words = words_of(text, self.words)
        for width, sizes in self.index.items():
            if len(words) < width:
                continue
            hashes = shingles(words, width)
            hits = np.flatnonzero(self.maybe[width][hashes >> np.uint64(44)])
            known = self.known[width]
            hits = hits[known[np.minimum(np.searchsorted(known, hashes[hits]), len(known) - 1)] == hashes[hits]]
            if not len(hits):
                continue
            held = np.zeros(len(hashes), bool)
            held[hits] = True
            largest = max(sizes)
            for group in np.split(hits, np.flatnonzero(np.diff(hits) > largest) + 1):
                lo, hi = max(0, int(group[0]) - largest + 1), min(len(hashes), int(group[-1]) + largest)
                for at in range(lo, max(lo + 1, hi - largest + 1), PIECE):
                    end = min(hi, at + PIECE + largest - 1)
                    self._scan(hashes[at:end], held[at:end], at, sizes, best)
        return best

    def _scan(self, piece: np.ndarray, held: np.ndarray, at: int, sizes: dict[int, HammingIndex], best: dict) -> None:
        """``held``: which shingles of the piece are in the benchmark."""
        known, sums = running(held), None
        for full, index in sizes.items():
            size = min(full, len(piece))
            # similarity is shared / (full + size - shared), and only benchmark shingles are shared
            least = self.threshold * (full + size) / (1 + self.threshold) - 1e-6
            rows = np.flatnonzero(known[size:] - known[:-size] >= least)
            if not len(rows):
                continue
            if sums is None:
                sums = running(votes(piece))
            for k, item in index.within(_prints(sums, size, rows)):
                row = int(rows[k])
                value = item.similarity(piece[row:row + size])
                old = best.get(item.number)
                if value >= self.threshold and (old is None or (-value, at + row) < (-old[0], old[1])):
                    best[item.number] = (value, at + row)


def _passes(items: DataFrame, max_items: int) -> Iterator[list[tuple]]:
    """Lists of at most about ``max_items`` (item_id, text) rows that cover the benchmark."""
    rows = items.select("item_id", "text").filter("text IS NOT NULL")
    parts = max(1, -(-rows.count() // max_items))
    for part in range(parts):
        chosen = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part) if parts > 1 else rows
        yield [(r.item_id, r.text) for r in chosen.collect()]


def matches(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, max_items: int = MAX_ITEMS) -> DataFrame:
    """doc_id, item_id, similarity, start_word, one row per document and benchmark item in it."""
    out: DataFrame | None = None
    for part in _passes(items, max_items):
        def task(batches: Iterator[pa.RecordBatch], part: list = part) -> Iterator[pa.RecordBatch]:
            matcher = Matcher([(i, text) for i, (_, text) in enumerate(part)], threshold)
            for batch in batches:
                found = [(row, item, *best) for row, text in enumerate(batch.column("text").to_pylist())
                         for item, best in sorted(matcher.search(text).items())]
                if found:
                    row, item, similarity, start = zip(*found)
                    yield pa.record_batch({
                        "doc_id": batch.column("doc_id").take(pa.array(row)),
                        "item_id": pa.array([part[i][0] for i in item], pa.int64()),
                        "similarity": pa.array(similarity, pa.float64()),
                        "start_word": pa.array(start, pa.int64())})

        got = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
               .mapInArrow(task, "doc_id long, item_id long, similarity double, start_word long"))
        out = got if out is None else out.union(got)
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, max_items: int = MAX_ITEMS) -> DataFrame:
    """The documents that hold no benchmark item, with all their columns."""
    for part in _passes(items, max_items):
        def task(batches: Iterator[pa.RecordBatch], part: list = part) -> Iterator[pa.RecordBatch]:
            matcher = Matcher([(i, text) for i, (_, text) in enumerate(part)], threshold)
            for batch in batches:
                yield batch.filter(pa.array([not matcher.search(t) for t in batch.column("text").to_pylist()], pa.bool_()))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
