"""Language identification by rank-order n-gram profiles (out-of-place distance).

A profile is the list of a language's most frequent letter n-grams (1 to 3 letters, a word
boundary counts as a letter), most frequent first. A document's own most frequent n-grams are
ranked the same way; its distance to a language is the sum over its n-grams of how far each one
is out of place in the profile, ``profile_size`` for one that is missing. The nearest profile wins.

Training: every task adds up the n-grams of its documents per language, Spark sums those counts
over the whole corpus and ranks them; only ``languages x profile_size`` rows reach the driver.
Prediction is row-local, without a shuffle.

Cases: NULL, empty or letterless text -> ``und``, score 0. Equal counts rank by n-gram code,
equal distances by language name. Rows with NULL lang, text or id are never learned from; a NULL
id counts as not held out. Nothing to learn from -> every document is ``und``. Repeated rows are
separate rows; further columns are ignored. Long texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from croupier.llm.common import fold

PROFILE_SIZE = 400
BOUNDARY = 1  # code point of the word boundary; not a letter, so never met in a text
FOLDS = 5


@lru_cache(1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-gram codes (ascending) and their counts. A code packs 21-bit code points."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
    letter = _letters()[codes]
    if not letter.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.concatenate(([BOUNDARY], np.where(letter, codes, BOUNDARY), [BOUNDARY]))
    c = c[np.concatenate(([True], (c[1:] != BOUNDARY) | (c[:-1] != BOUNDARY)))]
    pairs = (c[:-1] << 21) | c[1:]
    triples = ((pairs[:-1] << 21) | c[2:])[c[1:-1] != BOUNDARY]
    return np.unique(np.concatenate((c[c != BOUNDARY], pairs, triples)), return_counts=True)


def _summed(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    k, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    return k, np.bincount(inverse, weights=np.concatenate(counts), minlength=len(k)).astype(np.int64)


def _count_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[str, tuple[list, list]] = {}
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            k, n = ngrams(text)
            keys, counts = totals.setdefault(lang, ([], []))
            keys.append(k)
            counts.append(n)
            if len(keys) >= 500:
                k, n = _summed(keys, counts)
                totals[lang] = ([k], [n])
    for lang, (keys, counts) in totals.items():
        k, n = _summed(keys, counts)
        yield pa.record_batch({"lang": pa.array([lang] * len(k), pa.string()), "gram": k, "n": n})


def learn_profiles(labelled: DataFrame, profile_size: int = PROFILE_SIZE) -> dict[str, list[int]]:
    """lang -> its ``profile_size`` most frequent n-gram codes, most frequent first."""
    counts = (labelled.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
              .mapInArrow(_count_task, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= profile_size)
    profiles: dict[str, list[tuple[int, int]]] = {}
    for row in ranked.select("lang", "rank", "gram").collect():
        profiles.setdefault(row.lang, []).append((row.rank, row.gram))
    return {lang: [gram for _, gram in sorted(ranks)] for lang, ranks in sorted(profiles.items())}


class Classifier:
    """Profiles as one table: a row per known n-gram, a column of ranks per language."""

    def __init__(self, profiles: dict[str, list[int]], profile_size: int = PROFILE_SIZE) -> None:
        self.size = profile_size
        self.langs = sorted(lang for lang, grams in profiles.items() if grams)
        self.grams = np.array(sorted({g for grams in profiles.values() for g in grams}), np.int64)
        self.ranks = np.full((len(self.grams), len(self.langs)), -1, np.int64)
        for j, lang in enumerate(self.langs):
            self.ranks[np.searchsorted(self.grams, profiles[lang]), j] = np.arange(len(profiles[lang]))

    def predict(self, text: str | None) -> tuple[str, float]:
        keys, counts = ngrams(text)
        if not len(keys) or not self.langs:
            return "und", 0.0
        own = keys[np.argsort(-counts, kind="stable")[:self.size]]
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        ranks = np.where((self.grams[at] == own)[:, None], self.ranks[at], -1)
        out = np.where(ranks >= 0, np.abs(ranks - np.arange(len(own))[:, None]), self.size).sum(axis=0)
        best = int(out.argmin())
        if len(out) == 1:
            return self.langs[0], 1.0
        second = float(np.delete(out, best).min())
        total = second + float(out[best])
        return self.langs[best], second / total if total else 0.5


def predict(docs: DataFrame, profiles: dict[str, list[int]], profile_size: int = PROFILE_SIZE) -> DataFrame:
    """doc_id, held_out, lang_pred, score (distance share of the runner-up: 0.5 a tie, 1 certain)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Classifier(profiles, profile_size)
        for batch in batches:
            found = [model.predict(t) for t in batch.column("text").to_pylist()]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "lang_pred": pa.array([x[0] for x in found], pa.string()),
                "score": pa.array([x[1] for x in found], pa.float64())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(fold(F.col("doc_id"), FOLDS) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(task, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, profile_size: int = PROFILE_SIZE) -> DataFrame:
    """Learn from the documents outside the held-out fold, then predict every document."""
    profiles = learn_profiles(docs.filter(fold(F.col("doc_id"), FOLDS) != 0), profile_size)
    return predict(docs, profiles, profile_size)
