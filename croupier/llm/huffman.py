"""Token ids in files of canonical, length-limited Huffman code, decoded by table in blocks.

1. All texts are encoded once and every id is counted (tasks add up, Spark sums; one row per id of
   the vocabulary reaches the driver). Package-merge gives the best code lengths of at most
   ``MAX_BITS``; ids of one length get consecutive codes in id order (canonical), so the lengths
   alone describe the code.
2. The documents are range-partitioned by id and each partition is encoded in ascending order and
   written as a shard of blocks.
3. Reading needs the code table and a block: the next ``MAX_BITS`` bits index a table that gives
   id and length. A block stores the bit offset of every ``LANE``-th id, so it decodes from all
   those checkpoints at once, and blocks decode independently.

File format (under one folder, written by Spark as Parquet):
  * ``code``: id, bits - the canonical code; ids that never occur are missing.
  * ``blocks``: shard, block, n_ids, doc_ids, doc_lengths, checkpoints (bit offset of ids 0, LANE,
    2 * LANE, ...), payload (big-endian bit string). A block holds whole documents: as many as fit
    ``BLOCK_IDS`` ids, at least one.
  * ``shards``: shard, start, n_ids - ids of all shards before this one; shards ascend by doc_id.

Cases: NULL text is read as empty and holds the end id only. NULL doc_ids come first; equal ids
are ordered by a hash of the text. An empty table gives empty files and no rows. A single id has a
code of one bit. A very long text is a block of its own. Further columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from croupier.llm.bpe import byte_characters, load, special_tokens
from croupier.llm.common import arrow_rows, scratch_dir, written

MAX_BITS = 20
LANE = 256
BLOCK_IDS = 400_000
END_ID = 1
ROWS = 500  # texts taken out of Arrow at a time


# Texts in Latin-1: lower-casing and composing them is the same everywhere, so their letter runs and
# symbol runs can be looked up on their own. A word with an apostrophe stays whole ('s, 'll, ...).
_LETTER = "a-z\\xaa\\xb5\\xba\\xdf-\\xf6\\xf8-\\xff"
_BLANK = "\\t-\\r \\x85\\xa0"
_RUNS = re.compile(f"[{_LETTER}]+(?![{_LETTER}'])|[^{_BLANK}{_LETTER}']+(?![^{_BLANK}{_LETTER}])|[^{_BLANK}]+")


_PLAIN = re.compile("[a-z\\xb5\\xdf-\\xf6\\xf8-\\xff]+|[!-&(-/:-@\\[-`{-~]+")  # one pre-token: no digit, no apostrophe


class WordIds:
    """Ids of texts through a bounded table of words; each new word is encoded by the tokenizer.

    The tokenizer drops white space before it looks at anything else and splits between letters
    and symbols, so the parts of a text encode to the ids of the text. Other texts, and texts that
    spell a special token, are cut at blanks and newlines only. A part that is a single run of
    letters or symbols goes straight to the tokenizer's BPE model, the others through all of it.
    """

    def __init__(self, path: str, limit: int = 300_000) -> None:
        self.tokenizer, self.special, self.limit = load(path), special_tokens(path), limit
        self.model = self.tokenizer.model
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.spelled = byte_characters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def cut(self, text: str) -> list[str]:
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return text.replace("\n", " ").split(" ")
        if any(s in text for s in self.special):
            return text.replace("\n", " ").split(" ")
        return _RUNS.findall(text.lower())

    def _encode(self, word: str) -> bytes:
        if _PLAIN.fullmatch(word):
            spelled = word if word.isascii() else "".join(map(self.spelled.__getitem__, word.encode()))
            ids = [t.id for t in self.model.tokenize(spelled)]
        else:
            ids = self.tokenizer.encode(word, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}{'H' if self.dtype == '<u2' else 'I'}", *ids)

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text with the end id."""
        if len(self.known) > self.limit:  # words still in use come back from the older half
            self.older, self.known = self.known, {}
        known, older = self.known, self.older
        end = np.array([END_ID], self.dtype).tobytes()
        for text in texts:
            words = self.cut(text or "")
            found = list(map(known.get, words))
            found.append(None)  # where the search for new words ends
            i = found.index(None)
            while i < len(words):
                word = words[i]
                if word not in known:
                    known[word] = older.get(word) or self._encode(word)
                found[i] = known[word]
                i = found.index(None, i)
            found[-1] = end
            yield np.frombuffer(b"".join(found), self.dtype)


@lru_cache(1)
def word_ids(path: str) -> WordIds:
    """One table per worker process: later tasks find most of their words."""
    return WordIds(path)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, ROWS):
            yield batch.slice(lo, ROWS)


def _squeeze(ids: np.ndarray) -> bytes:
    """Byte planes of the ids, compressed: what lies between encoding and the files."""
    return zstandard.compress(ids.view(np.uint8).reshape(-1, ids.itemsize).T.tobytes(), 1)


def _stretch(data: bytes, dtype: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(np.dtype(dtype).itemsize, -1)
    return planes.T.copy().view(dtype).reshape(-1)


def token_ids(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, order (a hash of the text, for equal ids), ids of every whole text."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for part in _slices(batches):
            yield pa.record_batch({"doc_id": part.column("doc_id"), "order": part.column("order"),
                                   "ids": pa.array([_squeeze(x) for x in words.of(part.column("text").to_pylist())], pa.binary())})

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("order"), "text")
    return rows.mapInArrow(task, "doc_id long, order long, ids binary")


def count_ids(encoded: DataFrame, dtype: str) -> DataFrame:
    """(id, n) over all texts, end ids included."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for part in _slices(batches):
            n = np.bincount(np.concatenate([_stretch(x, dtype) for x in part.column("ids").to_pylist()]), minlength=len(total))
            n[:len(total)] += total
            total = n
        ids = np.flatnonzero(total)
        yield pa.record_batch({"id": ids.astype(np.int32), "n": total[ids]})

    return encoded.select("ids").mapInArrow(task, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def code_lengths(counts: np.ndarray, limit: int = MAX_BITS) -> np.ndarray:
    """Lengths of an optimal prefix code with no code longer than ``limit`` (package-merge)."""
    n = len(counts)
    if n < 2:
        return np.ones(n, np.int64)
    while 1 << limit < n:
        limit += 1
    order = np.argsort(counts, kind="stable")
    leaf = counts[order].astype(np.float64)
    # per level: which entries of the merged list are leaves, in ascending weight
    levels = []
    weights = leaf
    is_leaf = np.ones(n, bool)
    for _ in range(limit - 1):
        levels.append(is_leaf)
        pairs = weights[:len(weights) // 2 * 2].reshape(-1, 2).sum(axis=1)
        merged = np.concatenate((leaf, pairs))
        at = np.argsort(merged, kind="stable")
        weights, is_leaf = merged[at], at < n
    levels.append(is_leaf)
    lengths = np.zeros(n, np.int64)
    take = 2 * n - 2  # entries used of the last list; packages stand for two of the list below
    for is_leaf in reversed(levels):
        used = int(is_leaf[:take].sum())
        lengths[:used] += 1
        take = 2 * (take - used)
    out = np.empty(n, np.int64)
    out[order] = lengths
    return out


class Code:
    """Canonical code of (ids, lengths): both directions as tables. Ids are below 2**24."""

    def __init__(self, ids: np.ndarray, lengths: np.ndarray) -> None:
        order = np.lexsort((ids, lengths))
        self.ids, self.lengths = ids[order].astype(np.int64), lengths[order].astype(np.int64)
        self.bits = int(self.lengths.max()) if len(ids) else 1
        # the first code of a length follows from the space the shorter ones take
        space = np.int64(1) << (self.bits - self.lengths)
        starts = np.cumsum(space) - space
        size = int(self.ids.max()) + 1 if len(ids) else 0
        # id -> length and code, and the next bits -> length and id, each in one number
        self.of_id = np.zeros(size, np.int64)
        self.of_id[self.ids] = (self.lengths << 32) | (starts >> (self.bits - self.lengths))
        self.of_bits = np.full(1 << self.bits, 1 << 24, np.uint32)  # a one-code table is not full
        self.of_bits[:int(space.sum())] = np.repeat((self.lengths << 24) | self.ids, space)

    def encode(self, ids: np.ndarray) -> tuple[bytes, np.ndarray]:
        """Payload and the bit offset of every LANE-th id."""
        found = self.of_id[ids]
        length = found >> 32
        end = np.cumsum(length)
        at = end - length
        word = at >> 5
        # a code lies in at most two 32-bit words; codes do not overlap, so sums set the bits
        shifted = ((found & 0xFFFFFFFF) << (64 - length - (at & 31))).view(np.uint64)
        n_words = (int(end[-1]) + 31) // 32 + 1 if len(ids) else 1
        out = np.zeros(n_words, np.uint64)
        first = np.flatnonzero(np.concatenate(([True], word[1:] != word[:-1]))) if len(ids) else np.empty(0, np.int64)
        if len(ids):
            out[word[first]] += np.add.reduceat(shifted >> np.uint64(32), first)
            out[word[first] + 1] += np.add.reduceat(shifted & np.uint64(0xFFFFFFFF), first)
        return out.astype(">u4").tobytes(), at[::LANE]

    def decode(self, payload: bytes, checkpoints: np.ndarray, n: int) -> np.ndarray:
        """The ids of a block, all lanes at once."""
        words = np.frombuffer(payload, ">u4").astype(np.uint64)
        words = (words << np.uint64(32)) | np.concatenate((words[1:], np.zeros(1, np.uint64)))  # 64 bits from each 32-bit word on
        at = checkpoints.astype(np.int64)
        out = np.empty((LANE, len(at)), np.uint32)
        drop = np.uint64(64 - self.bits)
        for k in range(LANE):
            bits = (words[np.minimum(at >> 5, len(words) - 1)] << (at & 31).astype(np.uint64)) >> drop
            found = self.of_bits[bits]
            out[k] = found
            at += found >> 24
        return (out & 0xFFFFFF).T.reshape(-1)[:n]


BLOCK_SCHEMA = ("shard int, block int, n_ids long, doc_ids array<long>, doc_lengths array<long>, "
                "checkpoints array<long>, payload binary")


def write(docs: DataFrame, path: str, folder: str, block_ids: int = BLOCK_IDS) -> None:
    """Encode every whole text and write the files of the format into ``folder``."""
    spark = docs.sparkSession
    dtype = "<u2" if load(path).get_vocab_size() <= 1 << 16 else "<u4"
    with arrow_rows(spark, ROWS):
        encoded = written(token_ids(docs, path), "huffman-ids")
        counts = count_ids(encoded, dtype).orderBy("id").collect()  # one row per id of the vocabulary
    ids, n = np.array([r.id for r in counts], np.int64), np.array([r.n for r in counts], np.int64)
    lengths = code_lengths(n)
    pairs = [f"{i}:{k}" for i, k in zip(ids.tolist(), lengths.tolist())]
    spark.range(1).select(F.explode(F.split(F.lit(",".join(pairs)), ",")).alias("p")).filter("p != ''").select(
        F.substring_index("p", ":", 1).cast("int").alias("id"), F.substring_index("p", ":", -1).cast("int").alias("bits")
    ).coalesce(1).write.parquet(f"{folder}/code")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = Code(ids, lengths)
        shard, block = TaskContext.get().partitionId(), 0
        held: list[np.ndarray] = []
        owners: list = []
        size = 0

        def close() -> pa.RecordBatch:
            nonlocal block, size
            payload, checkpoints = code.encode(np.concatenate(held))
            row = {"shard": pa.array([shard], pa.int32()), "block": pa.array([block], pa.int32()), "n_ids": pa.array([size], pa.int64()),
                   "doc_ids": pa.array([owners], pa.list_(pa.int64())), "doc_lengths": pa.array([[len(x) for x in held]], pa.list_(pa.int64())),
                   "checkpoints": pa.array([checkpoints.tolist()], pa.list_(pa.int64())), "payload": pa.array([payload], pa.binary())}
            block += 1
            size = 0
            held.clear()
            owners.clear()
            return pa.record_batch(row)

        for part in _slices(batches):
            for doc_id, packed in zip(part.column("doc_id").to_pylist(), part.column("ids").to_pylist()):
                found = _stretch(packed, dtype)
                if held and size + len(found) > block_ids:
                    yield close()
                held.append(found)
                owners.append(doc_id)
                size += len(found)
        if held:
            yield close()

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("order").asc()]
    rows = encoded.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    with arrow_rows(spark, ROWS):
        rows.select("doc_id", "ids").mapInArrow(task, BLOCK_SCHEMA).write.parquet(f"{folder}/blocks")

    # one row per shard: the list of files, as any sharded format keeps it
    totals = spark.read.parquet(f"{folder}/blocks").groupBy("shard").agg(F.sum("n_ids").alias("n_ids")).orderBy("shard").collect()
    starts, listed = 0, []
    for r in totals:
        listed.append(f"{r.shard}:{starts}:{r.n_ids}")
        starts += r.n_ids
    spark.range(1).select(F.explode(F.split(F.lit(",".join(listed)), ",")).alias("p")).filter("p != ''").select(
        F.split("p", ":").alias("p")).select(F.col("p")[0].cast("int").alias("shard"), F.col("p")[1].cast("long").alias("start"),
                                             F.col("p")[2].cast("long").alias("n_ids")).coalesce(1).write.parquet(f"{folder}/shards")


def read_code(spark: SparkSession, folder: str) -> Code:
    rows = spark.read.parquet(f"{folder}/code").collect()  # at most one row per id of the vocabulary
    return Code(np.array([r.id for r in rows], np.int64), np.array([r.bits for r in rows], np.int64))


def read(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32, one row per document, from the files alone."""
    code = read_code(spark, folder)
    lengths = np.array([code.ids, code.lengths])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Code(lengths[0], lengths[1])
        for batch in batches:
            for row in batch.to_pylist():
                ids = own.decode(row["payload"], np.array(row["checkpoints"], np.int64), row["n_ids"]).astype("<u4")
                size = np.array(row["doc_lengths"], np.int64)
                at = np.cumsum(size) - size
                yield pa.record_batch({
                    "shard": pa.array([row["shard"]] * len(size), pa.int32()), "block": pa.array([row["block"]] * len(size), pa.int32()),
                    "doc_id": pa.array(row["doc_ids"], pa.int64()), "within": at, "n_tokens": size,
                    "ids_crc32": pa.array([zlib.crc32(ids[a:a + n].data) for a, n in zip(at.tolist(), size.tolist())], pa.int64())})

    blocks = spark.read.parquet(f"{folder}/blocks")
    docs = blocks.mapInArrow(task, "shard int, block int, doc_id long, within long, n_tokens long, ids_crc32 long")
    places = blocks.groupBy("shard", "block").agg(F.sum("n_ids").alias("n"))
    earlier = F.sum("n").over(Window.partitionBy("shard").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    places = (places.withColumn("before", F.coalesce(earlier, F.lit(0))).join(spark.read.parquet(f"{folder}/shards").drop("n_ids"), "shard")
              .select("shard", "block", (F.col("start") + F.col("before")).alias("base")))
    return docs.join(places, ["shard", "block"]).select(
        "doc_id", (F.col("base") + F.col("within")).alias("start"), "n_tokens", "ids_crc32")


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """Write the files into the shared folder and read them back."""
    folder = scratch_dir(docs.sparkSession, "huffman")
    write(docs, path, folder)
    return read(docs.sparkSession, folder)
