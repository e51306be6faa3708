"""Best-fit packing into fixed-length sequences: hierarchical residual packing.

1. Every text is encoded and cut into pieces of at most ``size`` ids (only the first piece of a
   document may be shorter than ``size``). The pieces, with their ids and a checksum, are a written table.
2. Each partition of that table packs its pieces best-fit, longest first. Full and nearly full bins
   are final. So are bins that not even the shortest open bin would fit into.
3. The other bins are the items of the next round: neighbouring partitions merge, ``FAN`` to one, and
   pack their open bins best-fit again. A bin is never taken apart, it only gets a place in another.
   Rounds go on until one group is left or merging no longer helps; then the open bins are final too.

A group holds at most about ``FAN * ITEMS`` pieces: a partition packs ``ITEMS`` pieces at a time, and a round makes
no group of more than ``ITEMS`` open pieces on average. Rows of a piece are 60 bytes; ids are neither
shuffled nor sent to a packing task. Every round is written, so sequence numbers don't change
when a task is repeated.

Cases: NULL text is read as empty and gives the end id only. Repeated rows and repeated or NULL doc_ids
are pieces of their own. A very long text is many full pieces. An empty table gives no rows.
Further columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.llm.bpe import byte_characters, load, special_tokens, splitter
from croupier.llm.common import arrow_rows, written

SIZE = 2048
END_ID = 0
ITEMS = 200_000
FAN = 8
NEARLY = 1 / 256  # a bin with less room than this share of a sequence is nearly full
GAIN = 0.001  # rounds go on while they spare this share of the open bins
ROWS = 500  # texts taken out of Arrow at a time

# Latin-1 classes of the tokenizer's pattern: letters, numbers, white space
_L = "A-Za-z\\xaa\\xb5\\xba\\xc0-\\xd6\\xd8-\\xf6\\xf8-\\xff"
_N = "0-9\\xb2\\xb3\\xb9\\xbc-\\xbe"
_S = "\\t-\\r \\x85\\xa0"
_PARTS = re.compile(f" ?[{_L}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")


class PartIds:
    """Ids of whole texts through a bounded table of their parts; each new part is encoded by the tokenizer.

    A Latin-1 text is cut as the tokenizer's own pattern cuts it, so a part goes to its BPE model directly.
    Other texts, and texts that spell a special token, are cut where the tokenizer always splits,
    and those parts go through all of it.
    """

    def __init__(self, path: str, limit: int = 400_000) -> None:
        self.tokenizer, self.special, self.limit = load(path), special_tokens(path), limit
        self.model, self.split = self.tokenizer.model, splitter(special_tokens(path))
        self.dtype = "<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.spelled = byte_characters()
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.other: dict[str, bytes] = {}

    def _model(self, part: str) -> bytes:
        return np.array([t.id for t in self.model.tokenize("".join(map(self.spelled.__getitem__, part.encode())))], self.dtype).tobytes()

    def _whole(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, self.dtype).tobytes()

    def of(self, texts: list[str | None]) -> Iterator[np.ndarray]:
        """The ids of each text with the end id."""
        if len(self.parts) > self.limit:  # parts still in use come back from the older half
            self.older, self.parts = self.parts, {}
        if len(self.other) > self.limit:
            self.other = {}
        end = np.array([END_ID], self.dtype).tobytes()
        for text in texts:
            text = text or ""
            try:
                text.encode("latin-1")
                plain = not any(s in text for s in self.special)
            except UnicodeEncodeError:
                plain = False
            if plain:
                words, known, older, encode = _PARTS.findall(text), self.parts, self.older, self._model
            else:
                words, known, older, encode = self.split(text), self.other, {}, self._whole
            found = list(map(known.get, words))
            found.append(None)  # where the search for new parts ends
            i = found.index(None)
            while i < len(words):
                word = words[i]
                if word not in known:
                    known[word] = older.get(word) or encode(word)
                found[i] = known[word]
                i = found.index(None, i)
            found[-1] = end
            yield np.frombuffer(b"".join(found), self.dtype)


@lru_cache(1)
def part_ids(path: str) -> PartIds:
    """One table per worker process: later tasks find most of their parts."""
    return PartIds(path)


def cuts(n: int, size: int) -> list[int]:
    """Starts of the pieces of ``n`` ids: full pieces behind a first one of what is left over."""
    return [0, *range((n - 1) % size + 1, n, size)]


def pieces(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """Written: piece_id, doc_id, piece, start, length, ids_crc32 (of little-endian 32-bit ids), ids (compressed)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, squeeze = part_ids(path), zstandard.ZstdCompressor(1).compress
        piece_id = TaskContext.get().partitionId() << 40
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                out = []
                for doc_id, ids in zip(part.column("doc_id").to_pylist(), table.of(part.column("text").to_pylist())):
                    wide = ids.astype("<u4")
                    starts = cuts(len(ids), size)
                    for k, (a, b) in enumerate(zip(starts, [*starts[1:], len(ids)])):
                        out.append((piece_id, doc_id, k, a, b - a, zlib.crc32(wide[a:b]), squeeze(ids[a:b].tobytes())))
                        piece_id += 1
                yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), _PIECE)], schema=_PIECE)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(docs.sparkSession, 1000):
        return written(rows.mapInArrow(task, "piece_id long, doc_id long, piece int, start long, length long, ids_crc32 long, ids binary"), "pieces")


_PIECE = pa.schema([("piece_id", pa.int64()), ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                    ("ids_crc32", pa.int64()), ("ids", pa.binary())])


def best_fit(lengths: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Best fit, longest first: (bin, offset) of every item, and the fill of every bin."""
    place, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    open_bins: list[list[int]] = [[] for _ in range(size + 1)]  # by room left
    rooms = 0  # bit r: a bin with room r is open
    values = lengths.tolist()
    for i in np.argsort(-lengths, kind="stable").tolist():
        length = values[i]
        fitting = rooms >> length
        if fitting:
            room = length + (fitting & -fitting).bit_length() - 1  # the least room that is enough
            own = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, own = size, len(fill)
            fill.append(0)
        place[i], offset[i] = own, fill[own]
        fill[own] += length
        if room > length:
            open_bins[room - length].append(own)
            rooms |= 1 << (room - length)
    return place, offset, fill


_KEPT = ["piece_id", "doc_id", "piece", "start", "length", "ids_crc32"]
_PLACED = ", ".join(["piece_id long", "doc_id long", "piece int", "start long", "length long", "ids_crc32 long", "sequence_id long", "offset long", "fill long",
                     "node long"])


def _first(cut: DataFrame, size: int, items: int) -> DataFrame:
    """Every partition packs its pieces, ``items`` at a time."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node = TaskContext.get().partitionId()
        first = node << 40
        held: list[pa.RecordBatch] = []

        def close() -> pa.RecordBatch:
            nonlocal first
            rows = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held.clear()
            place, offset, fill = best_fit(rows.column("length").to_numpy(), size)
            more = {"sequence_id": place + first, "offset": offset, "fill": np.array(fill)[place], "node": np.full(len(place), node)}
            first += len(fill)
            return pa.record_batch({**{c: rows.column(c) for c in _KEPT}, **{k: pa.array(v, pa.int64()) for k, v in more.items()}})

        for batch in batches:
            for lo in range(0, batch.num_rows, items):
                part = batch.slice(lo, items)
                if held and sum(b.num_rows for b in held) + part.num_rows > items:
                    yield close()
                if part.num_rows:
                    held.append(part)
        if held:
            yield close()

    return cut.select(*_KEPT).mapInArrow(task, _PLACED)


def _merge(bins: DataFrame, nodes: int, groups: int, size: int, turn: int) -> DataFrame:
    """Neighbouring nodes merge into ``groups`` groups; each packs its open bins as items."""

    def task(rows: pa.Table) -> pa.Table:
        bin_ids, first_row, inverse = np.unique(rows.column("sequence_id").to_numpy(), return_index=True, return_inverse=True)
        place, offset, fill = best_fit(rows.column("fill").to_numpy()[first_row], size)
        group = rows.column("group")[0].as_py()
        new = {"sequence_id": (turn << 58) + (group << 32) + place[inverse], "offset": rows.column("offset").to_numpy() + offset[inverse],
               "fill": np.array(fill)[place][inverse], "node": np.full(len(inverse), group)}
        return pa.table({**{c: rows.column(c) for c in _KEPT}, **{k: pa.array(v, pa.int64()) for k, v in new.items()}})

    grouped = bins.withColumn("group", F.floor(F.col("node") * groups / nodes))
    return grouped.groupBy("group").applyInArrow(task, _PLACED)


def pack(cut: DataFrame, size: int = SIZE, items: int = ITEMS, fan: int = FAN) -> DataFrame:
    """piece_id, doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece."""
    placed = written(_first(cut, size, items), "packed")
    nodes = (placed.agg(F.max("node")).first()[0] or 0) + 1
    done = None
    for turn in range(1, 32):
        room = F.lit(size) - F.col("fill")
        bins = placed.filter(room > size * NEARLY).filter("offset = 0")  # the piece at offset 0 stands for its bin
        stats = bins.agg(F.count(F.lit(1)).alias("n"), F.min("fill").alias("least")).first()
        left = placed.filter((room > size * NEARLY) & (room >= (stats["least"] or size + 1)))
        pieces_left, bins_left = left.agg(F.count(F.lit(1)), F.count(F.when(F.col("offset") == 0, 1))).first()
        groups = max(-(-nodes // fan), -(-pieces_left // items))
        if bins_left < 2 or groups > nodes or (groups == nodes and turn > 1):
            break
        final = placed.filter((room <= size * NEARLY) | (room < stats["least"]))
        done = final if done is None else done.unionByName(final)
        placed = written(_merge(left, nodes, groups, size, turn), "packed")
        bins_now = placed.filter("offset = 0").count()
        if groups == 1 or bins_left - bins_now < GAIN * bins_left:
            break
        nodes = groups
    done = placed if done is None else done.unionByName(placed)
    return done.select(*_KEPT, "sequence_id", "offset")


def sequences(cut: DataFrame, placed: DataFrame) -> DataFrame:
    """sequence_id, ids (array), doc_ids and lengths of its pieces in order: the training rows."""
    wide = written(cut.select("piece_id", "ids").join(placed.select("piece_id", "doc_id", "length", "sequence_id", "offset"), "piece_id"), "sequences")

    def task(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("offset")
        raw = [zstandard.decompress(x) for x in rows.column("ids").to_pylist()]
        lengths = rows.column("length").to_pylist()
        ids = np.concatenate([np.frombuffer(b, f"<u{len(b) // n}") for b, n in zip(raw, lengths)]).astype(np.int32)
        return pa.table({"sequence_id": rows.column("sequence_id")[:1], "ids": pa.array([ids], pa.list_(pa.int32())),
                         "doc_ids": pa.array([rows.column("doc_id").to_pylist()], pa.list_(pa.int64())), "lengths": pa.array([lengths], pa.list_(pa.int64()))})

    return wide.groupBy("sequence_id").applyInArrow(task, "sequence_id long, ids array<int>, doc_ids array<long>, lengths array<long>")


def digests(docs: DataFrame, path: str, size: int = SIZE) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset; one row per piece."""
    return pack(pieces(docs, path, size), size).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
