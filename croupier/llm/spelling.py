"""Spelling variant grouping by Bloom-guided neighbourhoods.

1. Tasks count the words of whole texts and flush their counts at a fixed size; Spark sums them.
   Words with enough code points and occurrences are the vocabulary, a written table.
2. A blocked Bloom filter over the vocabulary is laid out as one line of 64-bit cells: a stretch per word
   length, as long as that length needs (words of ``LONG`` code points or more share one). A word
   sets ``4`` bits of one cell. Tasks build segments of the line; at most ``FILTER_CELLS`` cells
   (32 MB) are broadcast at once, and a longer line is probed in as many rounds, each with the
   words whose edits can fall into it.
3. Every word probes its edits: each deletion, and each replacement by a greater letter. An insertion
   is the deletion of the longer word and a smaller letter is the replacement of the other word, so each
   near pair is generated once, from one side. Hashes of edits come from per-place sums, not from strings.
4. Only positives become strings. They meet the vocabulary in an exact join, which drops the filter's false
   positives; the surviving pairs are turned both ways and reduced per word.
5. A form has at least ``RATIO`` times the count of its word, so a chain of forms has at most
   log10(largest count) links; roots are found by that many halvings of the chains.

The alphabet is A to Z in lower case and U+00C0 to U+00FF, so words are Latin-1 and an edit is a byte.

Cases: NULL and empty texts hold no words. A NULL doc_id reads as empty text in the hash. Repeated
rows count again. Ties in count go to the smaller word. Very long runs of letters are probed in
stretches of places. An empty table, or one without words, gives no rows. Further columns are ignored.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.llm.common import arrow_rows, mix64, written

SHORTEST = 7
TWICE = 2
RATIO = 10
DROP = 31
LONG = 64
PER_CELL = 2  # words per 64-bit cell: 32 bits a word
PROBED = 20_000  # words a task probes, about
FILTER_CELLS = 1 << 22
SEGMENT_CELLS = 1 << 13
LETTERS = np.concatenate((np.arange(ord("a"), ord("z") + 1), np.arange(0xC0, 0x100))).astype(np.uint8)
_FLUSH = 300_000
_PROBES = 1 << 17  # edits looked at together
_PLACES = 1 << 12  # places of a word looked at together


# ---- words ------------------------------------------------------------------------------
def words_of(doc_id: int | None, text: str, shortest: int = SHORTEST) -> Counter:
    """Words of a text with their counts: lower-cased runs, some with one letter deleted by hash."""
    run = re.compile("[a-zÀ-ÿ]{%d,}" % shortest)  # a deletion only shortens
    found = Counter(run.findall(text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")))
    start = zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    out: Counter = Counter()
    for word, n in found.items():
        h = zlib.crc32(word.encode(), start)
        if h % DROP == 0:
            at = h % len(word)
            word = word[:at] + word[at + 1:]
            if len(word) < shortest:
                continue
        out[word] += n
    return out


def vocabulary(docs: DataFrame, shortest: int = SHORTEST, least: int = TWICE) -> DataFrame:
    """(word, n): every word with at least ``least`` occurrences overall."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def flush() -> pa.RecordBatch:
            out = pa.record_batch({"word": pa.array(total.keys(), pa.string()), "n": pa.array(total.values(), pa.int64())})
            total.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                for word, n in words_of(doc_id, text or "", shortest).items():
                    total[word] = total.get(word, 0) + n
                if len(total) >= _FLUSH:
                    yield flush()
        yield flush()

    counts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(task, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


# ---- the filter -------------------------------------------------------------------------
def shard(length: int) -> int:
    return min(length, LONG)


def layout(counts: dict[int, int]) -> dict[int, tuple[int, int]]:
    """shard -> (first cell, number of cells) on one line."""
    out, at = {}, 0
    for s in sorted(counts):
        size = -(-counts[s] // PER_CELL)
        out[s] = (at, size)
        at += size
    return out


def place_values(lo: int, hi: int) -> np.ndarray:
    """(places, 256): the share of each byte at each place in the hash of a word."""
    return mix64(np.arange(lo << 8, hi << 8, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)).reshape(-1, 256)


def _cells(h: np.ndarray, first: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Cell and bits of each hash sum."""
    h = mix64(h)
    one, six = np.uint64(1), np.uint64(63)
    bits = one << (h & six)
    for k in (6, 12, 18):
        bits |= one << ((h >> np.uint64(k)) & six)
    return ((h >> np.uint64(32)) * np.uint64(size) >> np.uint64(32)).astype(np.int64) + first, bits


def by_length(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(positions in the list, bytes of the words) for the words of each length."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    order = np.argsort(size, kind="stable")
    ends = np.flatnonzero(np.diff(size[order], append=-1)) + 1
    for lo, hi in zip([0, *ends], ends):
        own = order[lo:hi]
        yield own, np.frombuffer("".join(words[i] for i in own).encode("latin-1"), np.uint8).reshape(len(own), -1)


def hashes(letters: np.ndarray) -> np.ndarray:
    """Sums of the words of one length, (words,)."""
    out = np.zeros(len(letters), np.uint64)
    for lo in range(0, letters.shape[1], _PLACES):
        part = letters[:, lo:lo + _PLACES]
        out += place_values(lo, lo + part.shape[1])[np.arange(part.shape[1]), part].sum(axis=1, dtype=np.uint64)
    return out


def build_filter(vocab: DataFrame, line: dict[int, tuple[int, int]], lo: int, hi: int) -> np.ndarray:
    """Cells lo to hi of the line. Each group is one segment, so no task holds more than its cells."""
    near = [s for s, (first, size) in line.items() if first < hi and first + size > lo]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, letters in by_length(batch.column("word").to_pylist()):
                cell, bits = _cells(hashes(letters), *line[shard(letters.shape[1])])
                inside = (cell >= lo) & (cell < hi)
                cell, bits = cell[inside] - lo, bits[inside]
                yield pa.record_batch({"segment": (cell // SEGMENT_CELLS).astype(np.int32), "cell": (cell % SEGMENT_CELLS).astype(np.int32),
                                       "bits": bits.view(np.int64)})

    def segment(rows: pa.Table) -> pa.Table:
        cells = np.zeros(SEGMENT_CELLS, np.uint64)
        np.bitwise_or.at(cells, rows.column("cell").to_numpy(), rows.column("bits").to_numpy().view(np.uint64))
        return pa.table({"segment": rows.column("segment")[:1], "cells": pa.array([cells.tobytes()], pa.binary())})

    own = vocab.filter(F.least(F.length("word"), F.lit(LONG)).isin(near)).select("word")
    out = np.zeros(-(-(hi - lo) // SEGMENT_CELLS) * SEGMENT_CELLS, np.uint64)
    for r in own.mapInArrow(place, "segment int, cell int, bits long").groupBy("segment").applyInArrow(segment, "segment int, cells binary").collect():
        out[r["segment"] * SEGMENT_CELLS:][:SEGMENT_CELLS] = np.frombuffer(r["cells"], np.uint64)
    return out[:hi - lo]


# ---- edits ------------------------------------------------------------------------------
class Prober:
    """Edits of words that the cells ``lo`` to ``lo + len(cells)`` of the line may hold."""

    def __init__(self, cells: np.ndarray, lo: int, line: dict[int, tuple[int, int]]) -> None:
        self.cells, self.lo, self.line = cells, lo, line

    def stretch(self, length: int) -> tuple[int, int] | None:
        """The stretch of words of a length, if these cells hold any of it."""
        first, size = self.line.get(shard(length), (0, 0))
        return (first, size) if size and first < self.lo + len(self.cells) and first + size > self.lo else None

    def holds(self, h: np.ndarray, stretch: tuple[int, int]) -> np.ndarray:
        cell, bits = _cells(h, *stretch)
        cell -= self.lo
        if stretch[0] < self.lo or stretch[0] + stretch[1] > self.lo + len(self.cells):
            inside = (cell >= 0) & (cell < len(self.cells))
            return inside & ((self.cells[np.where(inside, cell, 0)] & bits) == bits)
        return (self.cells[cell] & bits) == bits

    def deletions(self, letters: np.ndarray, at: tuple[int, int]) -> Iterator[tuple[int, int]]:
        """(word, place) of the deletions the filter holds; of equal neighbours only the last is deleted."""
        n, length = letters.shape
        places = np.arange(length)
        own = np.zeros((n, length), np.uint64)
        shifted = np.zeros((n, length), np.uint64)  # the letter one place further left
        for lo in range(0, length, _PLACES):
            part = places[lo:lo + _PLACES]
            table = place_values(max(lo - 1, 0), int(part[-1]) + 1)
            own[:, part] = table[part - max(lo - 1, 0), letters[:, part]]
            moved = part[part > 0]
            shifted[:, moved] = table[moved - 1 - max(lo - 1, 0), letters[:, moved]]
        before = np.cumsum(own, axis=1, dtype=np.uint64) - own
        behind = shifted.sum(axis=1, dtype=np.uint64)[:, None] - np.cumsum(shifted, axis=1, dtype=np.uint64)
        last = np.ones((n, length), bool)
        last[:, :-1] = letters[:, :-1] != letters[:, 1:]
        found = self.holds((before + behind).ravel(), at).reshape(n, length) & last
        yield from zip(*(x.tolist() for x in np.nonzero(found)))

    def replacements(self, letters: np.ndarray, at: tuple[int, int]) -> Iterator[tuple[int, int, int]]:
        """(word, place, letter) of the replacements by a greater letter that the filter holds."""
        n, length = letters.shape
        total = hashes(letters)
        for lo in range(0, length, _PLACES):
            table = place_values(lo, min(lo + _PLACES, length))
            for place in range(lo, min(lo + _PLACES, length)):
                values, old = table[place - lo], letters[:, place]
                h = (total - values[old])[:, None] + values[LETTERS][None, :]
                found = self.holds(h.ravel(), at).reshape(h.shape) & (LETTERS[None, :] > old[:, None])
                for i, j in zip(*(x.tolist() for x in np.nonzero(found))):
                    yield i, place, int(LETTERS[j])

    def edits(self, words: list[str]) -> Iterator[tuple[int, str]]:
        """(position of the word, edit)"""
        for own, letters in by_length(words):
            length = letters.shape[1]
            step = max(1, _PROBES // max(len(LETTERS), length))
            for lo in range(0, len(own), step):
                part, some = letters[lo:lo + step], own[lo:lo + step].tolist()
                if at := self.stretch(length - 1):
                    for i, place in self.deletions(part, at):
                        word = words[some[i]]
                        yield some[i], word[:place] + word[place + 1:]
                if at := self.stretch(length):
                    for i, place, letter in self.replacements(part, at):
                        word = words[some[i]]
                        yield some[i], word[:place] + chr(letter) + word[place + 1:]


def candidates(vocab: DataFrame, filter_cells: int = FILTER_CELLS) -> DataFrame:
    """(word, n, edit): edits that the filter holds; every near pair once, false positives among them."""
    spark = vocab.sparkSession
    sizes = {r["s"]: r["k"] for r in vocab.groupBy(F.least(F.length("word"), F.lit(LONG)).alias("s")).agg(F.count(F.lit(1)).alias("k")).collect()}
    line = layout(sizes)
    end = sum(size for _, size in line.values())
    tasks, out = int(spark.conf.get("spark.sql.shuffle.partitions")), None
    for lo in range(0, max(end, 1), filter_cells):
        hi = min(lo + filter_cells, end)
        sent = spark.sparkContext.broadcast(build_filter(vocab, line, lo, hi))  # at most filter_cells * 8 bytes
        touched = [s for s, (first, size) in line.items() if first < hi and first + size > lo]

        def task(batches: Iterator[pa.RecordBatch], sent=sent, lo=lo) -> Iterator[pa.RecordBatch]:
            prober = Prober(sent.value, lo, line)
            for batch in batches:
                words = batch.column("word").to_pylist()
                found = list(prober.edits(words))
                at = pa.array([i for i, _ in found], pa.int64())
                yield pa.record_batch({"word": batch.column("word").take(at), "n": batch.column("n").take(at),
                                       "edit": pa.array([e for _, e in found], pa.string())})

        size = F.least(F.length("word"), F.lit(LONG))
        # of the longest shard, words one longer lie in the shard itself
        own = vocab.filter(size.isin(touched) | (size - 1).isin(touched)).select("word", "n")
        own = own.repartition(max(tasks, -(-sum(sizes.values()) // PROBED)))  # probing costs far more than the words' bytes suggest
        rows = written(own.mapInArrow(task, "word string, n long, edit string"), "spelling_edits")
        sent.destroy()
        out = rows if out is None else out.unionByName(rows)
    return out


# ---- groups -----------------------------------------------------------------------------
def near_pairs(vocab: DataFrame, filter_cells: int = FILTER_CELLS) -> DataFrame:
    """(word, n, near, near_n): every word beside every near word, both ways."""
    listed = vocab.select(F.col("word").alias("edit"), F.col("n").alias("edit_n"))
    pairs = candidates(vocab, filter_cells).join(listed, "edit")
    one = F.struct("word", "n", F.col("edit").alias("near"), F.col("edit_n").alias("near_n"))
    other = F.struct(F.col("edit").alias("word"), F.col("edit_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    return pairs.select(F.explode(F.array(one, other)).alias("p")).select("p.*")


def roots(forms: DataFrame, largest: int) -> DataFrame:
    """(word, root) for every (word, form): the last word of the chain of forms."""
    links = forms.select("word", F.col("form").alias("root"))
    longest = max(1, math.ceil(math.log(max(largest, 2), RATIO)))  # links of a chain
    for _ in range(math.ceil(math.log2(longest))):
        further = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        links = written(links.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "spelling_roots")
    return links


def group(docs: DataFrame, shortest: int = SHORTEST, least: int = TWICE, filter_cells: int = FILTER_CELLS) -> DataFrame:
    """word, form, root, n, n_near, form_n; one row per word of the vocabulary."""
    with arrow_rows(docs.sparkSession, 1000):  # long texts
        vocab = written(vocabulary(docs, shortest, least), "spelling_words")
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), "near")).alias("best")
    per = near_pairs(vocab, filter_cells).groupBy("word", "n").agg(F.count(F.lit(1)).alias("n_near"), best)
    is_form = -F.col("best.minus") >= RATIO * F.col("n")
    per = written(per.select("word", "n_near", F.when(is_form, F.col("best.near")).alias("form"),
                             F.when(is_form, -F.col("best.minus")).alias("form_n")), "spelling_forms")
    largest = vocab.agg(F.max("n")).first()[0] or 0
    chains = roots(per.filter(F.col("form").isNotNull()).select("word", "form"), largest)
    return (vocab.join(per, "word", "left").join(chains, "word", "left")
            .select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n"))
