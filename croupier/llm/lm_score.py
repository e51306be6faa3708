"""Cross-entropy difference scoring with matched bigram models over one vocabulary.

The target corpus is the documents labelled as wanted, the background all others. Both get a
bigram model of the same form over the same vocabulary, every word of all documents:

    P1(w) = (n(w) + 1) / (N + V)        P(w | h) = (n(h, w) + MU * P1(w)) / (n(h) + MU)

with natural counts for the target and, to match the corpora, background counts scaled by
N_target / N_background; V also counts the edge mark, with which a text begins and ends, and an
unknown word. A document's losses are the mean of -log P(w | h) over its words and the end mark;
its score is the target loss minus the background loss (lower: more like the target). Documents
are dealt into two folds by id, and a document is scored with the counts of the other fold, so no
document is scored by a model that has seen it. With ``vocabulary_size`` only so many words, the
most frequent of all documents, keep an identity and the others are the unknown word.

Work: 1. every task writes blocks of documents as numbers into the block's own sorted list of
words; a word is known by its 64-bit hash, a bigram by a 64-bit hash of both. The table is bucketed
by block. 2. The labels join the (block, document) list, not the texts. 3. Per block and bucket,
one hash range of words and bigrams, one row holds the counts per class; a word or bigram is in it
once, however often the block repeats it, and the number of buckets grows with the input. 4. Each bucket adds its rows up and answers every block
with the totals of the block's own words and bigrams, which are written. 5. The totals go back to
the blocks, where the losses are added per document. What reaches the driver is N and V.

Cases: a text without words (NULL, empty) has n_tokens 0, no losses and score 0, and counts
nowhere. A NULL id is background of fold 0. Labels count once per id. Repeated rows are scored
separately and count each. No target documents: all scores are 0. An empty table gives no rows.
Equal word counts are ordered by word. Further columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.llm.common import HashedWords, bucketed, fold, mix64, pack, unpack, written
from croupier.llm.quality_rules import bucket

MU = 50.0
BLOCK_CHARS = 12_000_000
BLOCK_DOCS = 50_000
# text per bucket: the counts of a bucket are added up in one Python group
BUCKET_BYTES = 16_000_000
ROWS = 500
UNKNOWN, EDGE = 0, 1
CLASSES = 4
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            part = batch.slice(lo, ROWS)
            yield from zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist())


def words_of(text: str | None) -> list[str]:
    return (text or "").lower().split()


def vocabulary(docs: DataFrame, size: int) -> list[str]:
    """The most frequent words of all documents, most frequent first."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter[str] = Counter()
        for _, text in _texts(batches):
            count.update(words_of(text))
            if len(count) > 400_000:
                yield pa.record_batch({"word": pa.array(list(count), pa.string()), "n": pa.array(list(count.values()), pa.int64())})
                count.clear()
        yield pa.record_batch({"word": pa.array(list(count), pa.string()), "n": pa.array(list(count.values()), pa.int64())})

    counts = docs.select("doc_id", "text").mapInArrow(task, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    counts = written(counts.withColumn("b", bucket(F.col("n"))), "lm-words")
    # a plain top-k would return its k rows from every task; the histogram of the counts (a few
    # hundred buckets) tells which words can be in it, and only those are ordered
    left, lowest = size, 0
    for r in sorted(counts.groupBy("b").agg(F.count(F.lit(1)).alias("words")).collect(), reverse=True):
        left, lowest = left - r.words, r.b
        if left <= 0:
            break
    chosen = counts.filter(F.col("b") >= lowest).orderBy(F.desc("n"), "word").limit(size)
    return [r.word for r in chosen.collect()]


def _pack64(values: np.ndarray) -> bytes:
    """Rows of equally many 64-bit numbers, as byte planes."""
    import zstandard

    planes = values.astype("<u8").reshape(len(values), -1, 1).view(np.uint8).transpose(0, 2, 1)
    return zstandard.compress(planes.tobytes(), 3)


def _unpack64(data: bytes, rows: int) -> np.ndarray:
    import zstandard

    planes = np.frombuffer(zstandard.decompress(data), np.uint8)
    return planes.reshape(rows, 8, len(planes) // (8 * rows)).transpose(0, 2, 1).copy().view("<u8")[:, :, 0]


def _blocks(docs: DataFrame, words: list[str] | None) -> DataFrame:
    """Rows (block, doc_ids, lengths, words, tokens): the hashes of the block's words (the edge mark
    among them) in order, and the words of all its documents as places in that list."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = None if words is None else set(words)
        number = HashedWords()
        base, blocks = TaskContext.get().partitionId() << 32, 0
        ids: list = []
        lengths: list[int] = []
        texts: list[np.ndarray] = []
        chars = 0

        def close() -> pa.RecordBatch:
            nonlocal blocks, chars
            block = base + blocks
            blocks += 1
            hashes, place = np.unique(np.concatenate([np.array([EDGE], np.uint64), *texts]), return_inverse=True)
            out = pa.record_batch({
                "block": pa.array([block], pa.int64()), "doc_ids": pa.array([list(ids)], pa.list_(pa.int64())),
                "lengths": pa.array([list(lengths)], pa.list_(pa.int64())),
                "words": pa.array([_pack64(np.diff(hashes, prepend=np.uint64(0))[None])], pa.binary()),
                "tokens": pa.array([pack(place[1:])], pa.binary())})
            ids.clear(), lengths.clear(), texts.clear()
            chars = 0
            return out

        for doc_id, text in _texts(batches):
            if ids and (chars + len(text or "") > BLOCK_CHARS or len(ids) >= BLOCK_DOCS):
                yield close()
            found = words_of(text)
            if found and known is not None:
                texts.append(np.fromiter((number[w] if w in known else UNKNOWN for w in found), np.uint64, len(found)))
            elif found:
                texts.append(number.of(found))
            ids.append(doc_id)
            lengths.append(len(found))
            chars += len(text or "")
        if ids:
            yield close()

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(task, "block long, doc_ids array<long>, lengths array<long>, words binary, tokens binary"))


def _classes(blocks: DataFrame, target: DataFrame) -> DataFrame:
    """(of_block, classes): per document of a block, 2 * fold + whether it belongs to the target."""
    each = blocks.select("block", F.posexplode("doc_ids").alias("i", "doc_id"))
    wanted = target.select(F.col("doc_id").cast("long").alias("t_id")).filter("t_id IS NOT NULL").distinct()
    kind = 2 * F.coalesce(fold(F.col("doc_id"), 2), F.lit(0)) + F.col("t_id").isNotNull().cast("int")
    joined = each.join(wanted, each.doc_id == wanted.t_id, "left").select("block", "i", kind.cast("int").alias("kind"))
    # a block holds at most BLOCK_DOCS documents
    return joined.groupBy(F.col("block").alias("of_block")).agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "kind"))), lambda x: x["kind"]).alias("classes"))


def _bigrams(block: pa.Table) -> tuple[np.ndarray, ...]:
    """Of one block: word hashes; per bigram as it occurs its document, word and number; per number
    (in the order of the hashes) the hash, history and word. Words are places in the word hashes."""
    words = np.cumsum(_unpack64(block.column("words")[0].as_py(), 1)[0], dtype=np.uint64)
    length = np.array(block.column("lengths")[0].as_py(), np.int64)
    edge = np.searchsorted(words, np.uint64(EDGE))
    held = np.flatnonzero(length)
    doc = np.repeat(held, length[held] + 1)
    word = np.full(len(doc), edge, np.int64)
    inner = np.ones(len(doc), bool)
    inner[np.cumsum(length[held] + 1) - 1] = False
    word[inner] = unpack(block.column("tokens")[0].as_py())
    history = np.concatenate(([edge], word[:-1])) if len(word) else word  # the end mark of a text is the begin mark of the next
    key, first, number = np.unique(mix64((mix64(words) * _SPREAD)[history] + words[word]), return_index=True, return_inverse=True)
    return words, doc, word, number, key, history[first], word[first]


def _class_counts(at: np.ndarray, kind: np.ndarray, size: int) -> np.ndarray:
    return np.bincount(kind * size + at, minlength=CLASSES * size).reshape(CLASSES, size)


def _per_bucket(keys: np.ndarray, counts: np.ndarray, buckets: int) -> dict[int, bytes]:
    """Hash range -> its keys (as steps) and their counts per class."""
    where = (((keys >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)
    edges = np.flatnonzero(np.diff(where, prepend=-1))
    return {int(where[lo]): _pack64(np.vstack((np.diff(keys[lo:hi], prepend=np.uint64(0)), counts[:, lo:hi].astype(np.uint64))))
            for lo, hi in zip(edges, [*edges[1:], len(keys)])}


def _counts(blocks: DataFrame, classes: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, words, pairs): what the block holds of the words and bigrams of the bucket."""

    def count(block: pa.Table, kinds: pa.Table) -> pa.Table:
        words, doc, word, number, key, _, _ = _bigrams(block)
        kind = np.array(kinds.column("classes")[0].as_py(), np.int64)[doc]
        rows = _per_bucket(words, _class_counts(word, kind, len(words)), buckets) if len(doc) else {}
        pairs = _per_bucket(key, _class_counts(number, kind, len(key)), buckets)
        named = sorted(rows.keys() | pairs.keys())
        return pa.table({"block": pa.array([block.column("block")[0].as_py()] * len(named), pa.int64()), "bucket": pa.array(named, pa.int32()),
                         "words": pa.array([rows.get(b) for b in named], pa.binary()), "pairs": pa.array([pairs.get(b) for b in named], pa.binary())})

    return blocks.groupBy("block").cogroup(classes.groupBy("of_block")).applyInArrow(count, "block long, bucket int, words binary, pairs binary")


def _sum(parts: list[bytes | None]) -> tuple[list[bytes | None], np.ndarray, np.ndarray]:
    """Per part the totals of its keys over all parts; the keys and their totals per class."""
    there = [_unpack64(p, 1 + CLASSES) for p in parts if p is not None]
    if not there:
        return list(parts), np.empty(0, np.uint64), np.zeros((CLASSES, 0), np.int64)
    known, at = np.unique(np.concatenate([np.cumsum(p[0], dtype=np.uint64) for p in there]), return_inverse=True)
    total = np.zeros((CLASSES, len(known)), np.int64)
    for c in range(CLASSES):
        np.add.at(total[c], at, np.concatenate([p[1 + c] for p in there]).astype(np.int64))
    places = iter(np.split(at, np.cumsum([p.shape[1] for p in there])[:-1]))
    return [None if p is None else _pack64(total[:, next(places)]) for p in parts], known, total


def _totals(counts: DataFrame) -> DataFrame:
    """(of_block, bucket, words, pairs, sizes): the totals of all blocks for each row's words and
    bigrams; one row per bucket without a block has the number of its words and their counts per class."""

    def add(rows: pa.Table) -> pa.Table:
        words, known, total = _sum(rows.column("words").to_pylist())
        pairs, _, _ = _sum(rows.column("pairs").to_pylist())
        n, sizes = rows.num_rows, [int((known > EDGE).sum()), *total.sum(axis=1).tolist()]
        return pa.table({"of_block": pa.array([*rows.column("block").to_pylist(), None], pa.int64()),
                         "bucket": pa.array([rows.column("bucket")[0].as_py()] * (n + 1), pa.int32()),
                         "words": pa.array([*words, None], pa.binary()), "pairs": pa.array([*pairs, None], pa.binary()),
                         "sizes": pa.array([*[None] * n, sizes], pa.list_(pa.int64()))})

    return counts.groupBy("bucket").applyInArrow(add, "of_block long, bucket int, words binary, pairs binary, sizes array<long>")


def losses(pair: np.ndarray, history: np.ndarray, word: np.ndarray, total: int, size: int, scale: float, mu: float = MU) -> np.ndarray:
    """-log P(w | h) from one model's counts of the pair, its history and its word, with the scale of the counts."""
    p1 = (word * scale + 1) / (total * scale + size)
    return -np.log((pair * scale + mu * p1) / (history * scale + mu))


def score(docs: DataFrame, target: DataFrame, vocabulary_size: int | None = None, mu: float = MU) -> DataFrame:
    """doc_id, n_tokens, h_target, h_background, score; ``target`` names the wanted documents by doc_id."""
    partitions = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(partitions, (docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BUCKET_BYTES)
    words = None if vocabulary_size is None else vocabulary(docs, vocabulary_size)
    blocks = bucketed(_blocks(docs, words), "lm_blocks", partitions)
    classes = _classes(blocks, target)
    totals = written(_totals(_counts(blocks, classes, buckets)), "lm-totals")
    sums = totals.filter("of_block IS NULL").agg(*[F.sum(F.col("sizes")[i]).alias(f"n{i}") for i in range(1 + CLASSES)]).first()
    size, n = (sums[0] or 0) + 2, [x or 0 for x in sums[1:]]
    scale = [n[2 * f + 1] / n[2 * f] if n[2 * f] else 0.0 for f in (0, 1)]

    def add(block: pa.Table, parts: pa.Table) -> pa.Table:
        ids, length = block.column("doc_ids")[0].as_py(), np.array(block.column("lengths")[0].as_py(), np.int64)
        sums = np.zeros((2, len(ids)))
        _, doc, _, number, _, history, word = _bigrams(block)
        if len(doc):
            rows = parts.to_pylist()
            kind = np.array(next(r["classes"] for r in rows if r["classes"] is not None), np.int64)
            rows = sorted((r for r in rows if r["classes"] is None), key=lambda r: r["bucket"])
            uni, pair = (np.hstack([_unpack64(r[c], CLASSES) for r in rows if r[c] is not None]).astype(np.int64) for c in ("words", "pairs"))
            side = kind[doc] >> 1
            for k in (0, 1):  # target, background
                # [fold of the document, bigram]: the models come from the other fold
                table = np.stack([losses(pair[m], uni[m][history], uni[m][word], n[m], size, scale[1 - f] if k else 1.0, mu)
                                  for f in (0, 1) for m in [2 * (1 - f) + 1 - k]])
                sums[k] = np.bincount(doc, weights=table[side, number], minlength=len(ids))
        sums /= length + 1
        none = length == 0
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_tokens": pa.array(length, pa.int64()),
                         "h_target": pa.array(sums[0], pa.float64(), mask=none), "h_background": pa.array(sums[1], pa.float64(), mask=none),
                         "score": pa.array(np.where(none, 0.0, sums[0] - sums[1]), pa.float64())})

    answers = totals.filter("of_block IS NOT NULL").drop("sizes").unionByName(classes, allowMissingColumns=True)
    return blocks.groupBy("block").cogroup(answers.groupBy("of_block")).applyInArrow(
        add, "doc_id long, n_tokens long, h_target double, h_background double, score double")
