"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared folder named by ``spark.checkpoint.dir``.

    Only a local session (tests) that names none gets a temporary folder; a cluster session
    without the setting is an error, because executors could not see each other's files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="llm-scratch-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage is cut, lost executors
    cost nothing, and the planner knows the real size of what follows."""
    spark = df.sparkSession
    path = scratch_dir(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def arrow_rows(spark: SparkSession, rows: int) -> Iterator[None]:
    """Jobs inside send at most ``rows`` rows at a time to Python: long texts then need little memory."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, str(rows))
    try:
        yield
    finally:
        spark.conf.set(key, before)


def bucketed(df: DataFrame, name: str, buckets: int) -> DataFrame:
    """Written into the shared folder, bucketed by block: a later grouping by block needs no shuffle."""
    spark = df.sparkSession
    table = f"{name}_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, "block").option("path", scratch_dir(spark, name)).format("parquet").saveAsTable(table)
    read = spark.table(table)
    spark.sql(f"DROP TABLE {table}")  # the catalog entry only; the files stay
    return read


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus`` (NULL for a NULL id)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalising bit mixer on uint64 (each input bit reaches each output bit)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class HashedWords(dict):
    """word -> 64-bit hash, filled on first use and emptied when it reaches ``limit`` words."""

    def __init__(self, limit: int = 400_000) -> None:
        super().__init__()
        self.limit = limit

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= self.limit:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


_SMALL = 255


def pack(values: np.ndarray) -> bytes:
    """Numbers below 2**32, small ones likelier: a byte each, and four more planes for the large."""
    import zstandard

    large = values[values >= _SMALL].astype("<u4") - np.uint32(_SMALL)
    planes = large.view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.int64(len(values)).tobytes() + np.minimum(values, _SMALL).astype(np.uint8).tobytes() + planes.tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    import zstandard

    raw = np.frombuffer(zstandard.decompress(data), np.uint8)
    n = int(raw[:8].view(np.int64)[0])
    out = raw[8:8 + n].astype(np.uint32)
    large = raw[8 + n:].reshape(4, -1).T.copy().view("<u4").reshape(-1)
    out[out == _SMALL] = large + np.uint32(_SMALL)
    return out


def distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (plain sort: quicker than numpy's hash table on short arrays)."""
    if len(values) < 2:
        return values
    values = np.sort(values)
    return values[np.concatenate(([True], values[1:] != values[:-1]))]


_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93,
                 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], dtype=np.uint64)


def shingles(words: np.ndarray, width: int = 5) -> np.ndarray:
    """Hashes of all ``width``-word windows, in order; a shorter non-empty text is one shingle."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    k = min(width, n)
    out = np.zeros(n - k + 1, np.uint64)
    for j in range(k):
        out += mix64(words[j:n - k + 1 + j] + _ODD[k - 1]) * _ODD[j]
    return mix64(out)


RUN = 256


def bind(name: str, value: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` is ``value``, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def totals(array: str, step: str, merge: str, start: str = "0") -> str:
    """SQL: for each element of ``array`` (a name) the fold of ``step`` over the elements before it.

    ``step`` adds the element ``x`` to ``{a}``, ``merge`` adds the total ``x`` of a run of elements;
    ``start`` is neutral. Runs of ``RUN`` elements are folded first, so that no list longer than
    that grows element by element: the work is linear for up to millions of elements.
    """
    def scan(items: str, first: str, by: str) -> str:
        return f"""aggregate({items}, struct({first} AS a, cast(array() AS array<int>) AS got),
            (_s, x) -> struct({by.format(a='_s.a')} AS a, concat(_s.got, array(_s.a)) AS got), _s -> _s.got)"""

    runs = f"transform(sequence(0, cast(greatest(size({array}) - 1, 0) div {RUN} AS int)), _c -> slice({array}, _c * {RUN} + 1, {RUN}))"
    whole = f"transform(_runs, _run -> aggregate(_run, {start}, (_a, x) -> {step.format(a='_a')}))"
    return bind("_runs", runs, f"flatten(zip_with(_runs, {scan(whole, start, merge)}, (_run, _from) -> {scan('_run', '_from', step)}))")


def places(text: str, regex: str) -> str:
    """SQL: (s, e, m) of every match of ``regex`` in the column ``text``, in code points, end exclusive.

    The pieces between the matches and the matches themselves have lengths that add up to places.
    """
    pieces = f"""zip_with(split({text}, r'{regex}', -1), regexp_extract_all({text}, r'{regex}', 0),
        (gap, m) -> struct(length(gap) AS g, coalesce(length(m), 0) AS l, m AS m))"""
    at = totals("_p", "{a} + x.g + x.l", "{a} + x")
    return bind("_p", pieces, f"""filter(zip_with(_p, {at}, (x, a) -> CASE WHEN x.m IS NOT NULL THEN
        struct(a + x.g AS s, a + x.g + x.l AS e, x.m AS m) END), x -> x IS NOT NULL)""")


def apart(spans: str, fixed: str) -> str:
    """SQL: the elements of the column ``spans`` that overlap none of the column ``fixed``, from sorted neighbours."""
    both = f"""sort_array(concat(transform({fixed}, x -> struct(x.s AS s, x.e AS e, true AS fixed, x AS span)),
        transform({spans}, x -> struct(x.s AS s, x.e AS e, false AS fixed, x AS span))))"""
    reach = totals("_both", "CASE WHEN x.fixed THEN greatest({a}, x.e) ELSE {a} END", "greatest({a}, x)")
    ahead = totals("_back", "CASE WHEN x.fixed THEN least({a}, x.s) ELSE {a} END", "least({a}, x)", "2147483647")
    sides = f"zip_with({reach}, reverse({bind('_back', 'reverse(_both)', ahead)}), (r, n) -> struct(r AS r, n AS n))"
    found = f"zip_with(_both, {sides}, (x, w) -> CASE WHEN NOT x.fixed AND w.r <= x.s AND w.n >= x.e THEN x.span END)"
    return f"""CASE WHEN size({fixed}) = 0 OR size({spans}) = 0 THEN {spans}
        ELSE {bind('_both', both, f"filter({found}, x -> x IS NOT NULL)")} END"""


def wide(text: str, name: str, body: str) -> str:
    """SQL: ``body``, in which ``name`` is the text with four bytes a character: ``cut`` finds a place in it
    without reading what is before it. Bound, as a binary column would be copied at each use."""
    return bind(name, f"encode({text}, 'UTF-32')", body)


def cut(name: str, at: str, n: str) -> str:
    """SQL: ``n`` characters from ``at`` (from 0) of a ``wide`` text; the mark in front keeps a mark of the text."""
    return f"decode(concat(x'0000FEFF', substring({name}, 4 * ({at}) + 1, 4 * ({n}))), 'UTF-32')"
