"""BPE encoding through a distinct-word table, decoding through an id-to-piece table.

Encoding: 1. every task splits its texts into words (a run of non-space characters with the space
before it, or a run of spaces) and numbers the distinct words of each block of documents; a
document becomes the list of its word numbers. 2. The distinct words are dealt by hash to buckets;
a bucket meets each of its words from all blocks, encodes each distinct word once with the
tokenizer, and answers every block with the ids of its words. 3. Ids join back to the documents
of a block by word number, that is by position.

A block is at most ``BLOCK_CHARS`` characters (or one longer document), and a word crosses the
network once per block however often it occurs, so a very common word is no hot key and a bucket
holds ``1 / buckets`` of the distinct words. Words and positions are compressed. Step 1 is written
to the shared folder as a table bucketed by block, so the documents are not shuffled for step 3.

Words are the tokenizer's own pre-tokens joined at places where it always splits: before a single
space that stands between two non-space characters, and around runs of white space. A special
token in a text is a word of its own, as the library treats it.

Decoding: the vocabulary (one row per id, so bounded) goes to every task and is joined by id; the
bytes of the pieces are concatenated.

Cases: NULL text is read as empty and gives no ids. Repeated rows and repeated or NULL ids each
keep their own row. An empty table gives no rows. Very long texts are one block. Further columns
are ignored.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.llm.common import bucketed, pack, unpack

BLOCK_CHARS = 12_000_000
ROWS = 500  # texts taken out of Arrow at a time
# white space of the Unicode standard
_SPACE = r"\t-\r \x85\xa0" + "".join(map(chr, (0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_UNIT = re.compile(f" ?[^{_SPACE}]+|[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")


@lru_cache(1)
def load(path: str):
    """The tokenizer of a file, without truncation and padding; one per process, one thread."""
    from tokenizers import Tokenizer

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark deals out the cores
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def special_tokens(path: str) -> list[str]:
    return [t.content for t in load(path).get_added_tokens_decoder().values()]


def splitter(special: list[str]) -> Callable[[str], list[str]]:
    """text -> its words; their encodings, one after the other, are the encoding of the text."""
    if not special:
        return _UNIT.findall
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")")

    def split(text: str) -> list[str]:
        if not any(s in text for s in special):
            return _UNIT.findall(text)
        out: list[str] = []
        for i, part in enumerate(cut.split(text)):
            out += [part] if i % 2 else _UNIT.findall(part)
        return out

    return split


class _Numbers(dict):
    def __missing__(self, word: str) -> int:
        n = self[word] = len(self)
        return n


def _split_rows(docs: DataFrame, special: list[str], buckets: int) -> DataFrame:
    """Rows of a block, told apart by ``bucket``: documents (-1) with the numbers of their words,
    one header (-2) with the bucket of every word, and per bucket its words in number order."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = splitter(special)
        base, blocks = TaskContext.get().partitionId() << 32, 0
        words = _Numbers()
        ids: list = []
        numbers: list[np.ndarray] = []
        chars = 0

        def close() -> pa.RecordBatch:
            nonlocal blocks, chars
            block = base + blocks
            blocks += 1
            # renumber by falling frequency: small numbers pack well
            count = np.bincount(np.concatenate(numbers), minlength=len(words))
            order = np.argsort(-count, kind="stable")
            rank = np.empty(len(words), np.uint32)
            rank[order] = np.arange(len(words), dtype=np.uint32)
            listed = list(words)
            listed = [listed[i] for i in order]
            bucket = np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) % buckets for w in listed), np.int64, len(listed))
            of = np.argsort(bucket, kind="stable")
            edges = np.flatnonzero(np.diff(bucket[of], prepend=-1))
            groups = [of[lo:hi] for lo, hi in zip(edges, [*edges[1:], len(of)])]
            rows = {
                "block": pa.array([block] * (len(ids) + 1 + len(groups)), pa.int64()),
                "bucket": pa.array([-1] * len(ids) + [-2] + [int(bucket[g[0]]) for g in groups], pa.int32()),
                "doc_id": pa.array(ids + [None] * (1 + len(groups)), pa.int64()),
                "data": pa.array([pack(rank[n]) for n in numbers] + [pack(bucket)] +
                                 [zstandard.compress(json.dumps([listed[i] for i in g], ensure_ascii=False)
                                                     .encode("utf-8", "surrogatepass"), 9) for g in groups], pa.binary())}
            words.clear(), ids.clear(), numbers.clear()
            chars = 0
            return pa.record_batch(rows)

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    text = text or ""
                    if ids and chars + len(text) > BLOCK_CHARS:
                        yield close()
                    found = split(text)
                    ids.append(doc_id)
                    numbers.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                    chars += len(text)
        if ids:
            yield close()

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
            .mapInArrow(task, "block long, bucket int, doc_id long, data binary"))


def _encode_words(rows: DataFrame, path: str) -> DataFrame:
    """(block, bucket, lengths, ids) for every (block, bucket): each distinct word is encoded once."""

    def bucket(table: pa.Table) -> pa.Table:
        tokenizer = load(path)
        place = _Numbers()
        at = []
        for data in table.column("data").to_pylist():
            listed = json.loads(zstandard.decompress(data).decode("utf-8", "surrogatepass"))
            at.append(np.fromiter(map(place.__getitem__, listed), np.int64, len(listed)))
        distinct = list(place)
        ids: list[np.ndarray] = []
        for lo in range(0, len(distinct), 2000):
            ids += [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(distinct[lo:lo + 2000], add_special_tokens=False)]
        size = np.array([len(i) for i in ids], np.int64)
        flat, start = np.concatenate(ids), np.cumsum(size) - size
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"),
                         "lengths": pa.array([pack(size[a]) for a in at], pa.binary()),
                         "ids": pa.array([pack(flat[_spread(start[a], size[a])]) for a in at], pa.binary())})

    return rows.groupBy("bucket").applyInArrow(bucket, "block long, bucket int, lengths binary, ids binary")


def _spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes of the elements of many ranges, one range after the other."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - (ends - lengths), lengths)


def _join_back(rows: DataFrame, answers: DataFrame, finish: Callable[[np.ndarray], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    """doc_id plus ``finish(ids of the document)``, block by block."""

    def block(docs: pa.Table, words: pa.Table) -> pa.Table:
        header = docs.column("data")[docs.column("bucket").to_pylist().index(-2)].as_py()
        bucket = unpack(header)
        start, length = np.zeros(len(bucket), np.int64), np.zeros(len(bucket), np.int64)
        flat, at = [], 0
        for b, size, ids in zip(*(words.column(c).to_pylist() for c in ("bucket", "lengths", "ids"))):
            own, size = np.flatnonzero(bucket == b), unpack(size).astype(np.int64)
            length[own] = size
            start[own] = np.cumsum(size) - size + at
            flat.append(unpack(ids))
            at += len(flat[-1])
        ids = np.concatenate(flat) if flat else np.empty(0, np.uint32)
        out = []
        for b, doc_id, data in zip(docs.column("bucket").to_pylist(), docs.column("doc_id").to_pylist(), docs.column("data")):
            if b == -1:
                number = unpack(data.as_py())
                out.append((doc_id, *finish(ids[_spread(start[number], length[number])])))
        return pa.table([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)

    return rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(block, ddl)


def _encoded(docs: DataFrame, path: str, finish: Callable[[np.ndarray], tuple], schema: pa.Schema, ddl: str) -> DataFrame:
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = bucketed(_split_rows(docs, special_tokens(path), buckets), "bpe_words", buckets)
    answers = _encode_words(rows.filter("bucket >= 0").select("block", "bucket", "data"), path)
    return _join_back(rows.filter("bucket < 0"), answers, finish, schema, ddl)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, ids (array of int): the ids of every whole text."""
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
    return _encoded(docs, path, lambda ids: (ids.astype(np.int32),), schema, "doc_id long, ids array<int>")


def byte_characters() -> dict[int, str]:
    """How a byte-level vocabulary spells each byte: printable bytes as themselves, the others as
    the characters from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]  # fixed values
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


def pieces(path: str) -> list[bytes]:
    """id -> bytes of its piece."""
    tokenizer = load(path)
    spelled = {c: b for b, c in byte_characters().items()}
    out = [b""] * tokenizer.get_vocab_size(with_added_tokens=True)
    for piece, i in tokenizer.get_vocab(with_added_tokens=True).items():
        known = all(c in spelled for c in piece)
        out[i] = bytes(spelled[c] for c in piece) if known else piece.encode()
    return out


def decode_ids(ids: np.ndarray, by_id: list[bytes]) -> str:
    return b"".join(map(by_id.__getitem__, ids.tolist())).decode("utf-8", "replace")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id, text from (doc_id, ids): special tokens are kept."""
    by_id = pieces(path)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [decode_ids(np.array(ids, np.int64), by_id) for ids in batch.column("ids").to_pylist()]
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(task, "doc_id long, text string")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoded and decoded again."""
    by_id = pieces(path)

    def finish(ids: np.ndarray) -> tuple:
        return (len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(),
                hashlib.sha256(decode_ids(ids, by_id).encode("utf-8")).hexdigest())

    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return _encoded(docs, path, finish, schema, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
