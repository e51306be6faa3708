"""Quality classifier: a byte-level convolutional network in numpy.

A text is its UTF-8 bytes. Each byte carries one more bit: whether the ``REPEAT`` bytes that end
there already occurred earlier in the text. Filters of ``WIDTH`` positions slide over overlapping
chunks that cover the whole text; the largest response of each filter over all chunks (max-pool)
goes through a rectifier, one hidden layer and a logistic unit: one probability per text. A filter
is a table of weights per position and symbol, so a response is a sum of table rows.

Training: at most ``MAX_TRAIN`` labelled texts outside the held-out fold (smallest hash of the id
first), Adam on mini-batches, gradients through the arg-max positions only. The model is a few
hundred kilobytes and goes to every task; scoring is row-local without a shuffle.

Cases: NULL text is read as empty; a text shorter than a filter is padded with a symbol of its
own, so empty texts get a score too. Labels with NULL id or quality are not used, repeated labels
once. Without labels of both classes every score is the share of label 1 (1 without labels).
Repeated rows are scored alike; a NULL id is scored and counts as not held out. Long texts are
read whole, chunk by chunk. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.llm.common import fold, mix64

WIDTH = 8
FILTERS = 16
HIDDEN = 8
REPEAT = 16
SYMBOLS = 513  # bytes, bytes that end a repeat, padding
PAD = 512
CHUNK = 4096
MAX_TRAIN = 3000
MAX_TRAIN_CHARS = 200_000  # longer texts are scored, not learned from
EPOCHS = 8
BATCH = 32
RATE = 0.02
ACCEPT = 0.7
FOLDS, HELD_OUT = 4, 2


def symbols(text: str | None) -> np.ndarray:
    """Bytes of the whole text, plus 256 where a repeated stretch ends; padded to one filter width."""
    x = np.frombuffer((text or "").encode("utf-8", "surrogatepass"), np.uint8)
    out = x.astype(np.int16)
    if len(x) > REPEAT:
        words = np.lib.stride_tricks.sliding_window_view(x, 8)
        words = np.ascontiguousarray(words).view(np.uint64)[:, 0]
        ends = mix64(words[:-8]) + words[8:] * np.uint64(0x9E3779B97F4A7C15)  # one value per 16 bytes
        order = np.argsort(ends, kind="stable")
        again = np.zeros(len(ends), bool)
        again[order[1:]] = ends[order[1:]] == ends[order[:-1]]
        out[REPEAT - 1:] += np.int16(256) * again
    if len(out) < WIDTH:
        out = np.concatenate((out, np.full(WIDTH - len(out), PAD, np.int16)))
    return out


class Network:
    def __init__(self, seed: int = 0) -> None:
        r = np.random.default_rng(seed)
        self.filters = r.normal(0, 0.1, (WIDTH, SYMBOLS, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.w1 = r.normal(0, 0.4, (FILTERS, HIDDEN)).astype(np.float32)
        self.b1 = np.zeros(HIDDEN, np.float32)
        self.w2 = r.normal(0, 0.4, HIDDEN).astype(np.float32)
        self.b2 = np.zeros(1, np.float32)

    def pool(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Largest response of each filter over the text, and where it is."""
        best = np.full(FILTERS, -np.inf, np.float32)
        where = np.zeros(FILTERS, np.int64)
        last = len(x) - WIDTH + 1
        for lo in range(0, last, CHUNK):  # a chunk overlaps the next by a filter's width
            n = min(CHUNK, last - lo)
            response = self.filters[0][x[lo:lo + n]]
            for j in range(1, WIDTH):
                response += self.filters[j][x[lo + j:lo + j + n]]
            top = response.argmax(axis=0)
            value = response[top, np.arange(FILTERS)]
            where = np.where(value > best, lo + top, where)
            best = np.maximum(best, value)
        return best + self.bias, where

    def head(self, pooled: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        rectified = np.maximum(pooled, 0)
        hidden = np.maximum(rectified @ self.w1 + self.b1, 0)
        return 1 / (1 + np.exp(-np.clip(hidden @ self.w2 + self.b2[0], -30, 30))), rectified, hidden

    def score(self, text: str | None) -> float:
        return float(self.head(self.pool(symbols(text))[0])[0])


def fit(texts: list[str], labels: list[int], epochs: int = EPOCHS, seed: int = 0) -> Network:
    net = Network(seed)
    x = [symbols(t) for t in texts]
    y = np.array(labels, np.float32)
    params = [net.filters, net.bias, net.w1, net.b1, net.w2, net.b2]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    r = np.random.default_rng(seed)
    positions = np.arange(WIDTH)
    step = 0
    for epoch in range(epochs):
        order = r.permutation(len(x))
        rate = RATE * (1 - epoch / epochs)
        for lo in range(0, len(order), BATCH):
            rows = order[lo:lo + BATCH]
            pooled, where = map(np.stack, zip(*(net.pool(x[i]) for i in rows)))
            p, rectified, hidden = net.head(pooled)
            d = (p - y[rows]) / len(rows)
            d_hidden = np.outer(d, net.w2) * (hidden > 0)
            d_pooled = (d_hidden @ net.w1.T) * (pooled > 0) + 1e-3 * (pooled <= 0) * (d_hidden @ net.w1.T)
            d_filters = np.zeros_like(net.filters)
            for k, i in enumerate(rows):
                seen = x[i][where[k][:, None] + positions]  # filter x position
                np.add.at(d_filters, (positions[None, :], seen, np.arange(FILTERS)[:, None]), d_pooled[k][:, None])
            grads = [d_filters, d_pooled.sum(axis=0), rectified.T @ d_hidden, d_hidden.sum(axis=0), hidden.T @ d, d.sum(keepdims=True)]
            step += 1
            for q, g, m, v in zip(params, grads, first, second):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= rate * (m / (1 - 0.9 ** step)) / (np.sqrt(v / (1 - 0.999 ** step)) + 1e-8)
    return net


def train(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN) -> Network | float:
    """The network, or a constant score if the labels do not hold both classes."""
    known = (labels.select(F.col("doc_id").cast("long").alias("l_id"), F.col("quality").cast("int").alias("y"))
             .filter(F.col("y").isNotNull() & (fold(F.col("l_id"), FOLDS) != HELD_OUT)).dropDuplicates(["l_id"]))
    chosen = known.orderBy(F.xxhash64("l_id"), "l_id").limit(max_train)
    # at most max_train rows of two numbers: small enough to send to every task
    rows = (docs.select(F.col("doc_id").cast("long").alias("d_id"), "text").filter(F.length("text") <= MAX_TRAIN_CHARS)
            .join(F.broadcast(chosen), F.col("d_id") == F.col("l_id")).select("l_id", "text", "y").collect())
    rows.sort(key=lambda r: (r.l_id, r.text))
    ones = sum(r.y for r in rows)
    if not rows or ones in (0, len(rows)):
        return ones / len(rows) if rows else 1.0
    return fit([r.text for r in rows], [r.y for r in rows])


def score(docs: DataFrame, model: Network | float) -> DataFrame:
    """doc_id, held_out, score, predicted."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = [model if isinstance(model, float) else model.score(t.as_py()) for t in batch.column("text")]
            yield pa.record_batch({
                "doc_id": batch.column("doc_id"), "held_out": batch.column("held_out"),
                "score": pa.array(scores, pa.float64()), "predicted": pa.array([int(s >= ACCEPT) for s in scores], pa.int32())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce(fold(F.col("doc_id"), FOLDS) == HELD_OUT, F.lit(False)).alias("held_out"), "text")
    return rows.mapInArrow(task, "doc_id long, held_out boolean, score double, predicted int")


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return score(docs, train(docs, labels))
