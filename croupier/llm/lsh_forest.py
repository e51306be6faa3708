"""Near-duplicate join: MinHash LSH forest with adaptively shortened prefixes, exact verification.

Two documents are linked if the Jaccard similarity of their sets of five-word shingles (words are
lower-cased and split at white space; a shorter text is one shingle) is at least ``threshold``.

1. Texts with the same shingle set form one class; everything below works on one document per
   class (the smallest id), so copies are never paired. Classes are pre-aggregated per task.
2. Each class gets ``TREES`` label strings of ``DEPTH`` min-hashes. A tree is the sorted trie of
   those strings; classes under one trie node of depth d share a prefix of length d, which is an
   equi-key, so the trie is walked by grouping on prefixes rather than by sorting on one machine.
3. Starting at the full depth, the classes of each node are compared. From the similarities found,
   ``sum(1) / sum(1 / P(found at this depth | similarity))`` estimates the recall. While it is
   below ``target`` the prefixes are shortened by one and only the pairs that are new at the
   shorter depth are compared.
4. A node is compared in units of at most two chunks of ``CHUNK`` classes, however many classes it
   holds. A unit returns a row per class (its number of links, and one neighbour structure), not
   the pairs. A pair is counted by the first tree that has it; a node all of whose classes
   already met in another node is dropped before any text moves.
5. Links are closed to components by min-label propagation with pointer jumping.

Result: doc_id, class_id (smallest doc_id of the component), n_links (documents linked to it,
copies included), n_copies (documents with the same shingle set, itself included).

Cases: texts without words (NULL, empty) link to nothing. Rows with the same id count as one node
of the component graph but each gets its row. A NULL id is matched only with its copies; its
class_id is NULL if no copy has an id. Ties do not matter: every class at or above the threshold
links. An empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from croupier.llm.common import HashedWords, arrow_rows, distinct, mix64, shingles, written

WIDTH = 5
THRESHOLD = 0.8
TREES = 32
DEPTH = 6
MIN_DEPTH = 1
TARGET = 0.9999
CHUNK = 256
ROWS = 500  # rows sent to Python at a time
_MULTIPLIERS = mix64(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) | np.uint64(1)


def shingle_set(text: str | None, words: HashedWords, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct shingle hashes of a text."""
    return distinct(shingles(words.of((text or "").lower().split()), width))


def set_key(found: np.ndarray) -> bytes | None:
    import xxhash

    return xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """One row of TREES * DEPTH 16-bit min-hash codes per non-empty set."""
    out = np.empty((len(sets), TREES * DEPTH), np.uint64)
    lo = 0
    while lo < len(sets):  # pieces that stay in the processor cache
        hi, size = lo, 0
        while hi < len(sets) and (hi == lo or size + len(sets[hi]) <= 30_000):
            size += len(sets[hi])
            hi += 1
        x = np.concatenate(sets[lo:hi])
        starts = np.cumsum([0] + [len(s) for s in sets[lo:hi - 1]])
        for k, a in enumerate(_MULTIPLIERS):
            out[lo:hi, k] = np.minimum.reduceat(x * a, starts)
        lo = hi
    return (mix64(out) >> np.uint64(48)).astype(np.uint16)


def _sign_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    words = HashedWords()
    for batch in batches:
        ids, texts = batch.column("doc_id"), batch.column("text").to_pylist()
        for lo in range(0, len(texts), 500):
            sets = [shingle_set(t, words) for t in texts[lo:lo + 500]]
            signed = iter(signatures([s for s in sets if len(s)]))
            yield pa.record_batch({
                "doc_id": ids[lo:lo + 500],
                "key": pa.array([set_key(s) for s in sets], pa.binary()),
                "signature": pa.array([next(signed).tobytes() if len(s) else None for s in sets], pa.binary())})


def _prefix(tree: int, depth: int) -> Column:
    return F.xxhash64(F.lit(tree), F.substring("signature", 2 * DEPTH * tree + 1, 2 * depth))


def _nodes(classes: DataFrame, depth: int) -> DataFrame:
    """(key, tree, node) rows of every class at one depth; signatures stay behind, they are long."""
    return classes.select("key", F.posexplode(F.array(*[_prefix(t, depth) for t in range(TREES)])).alias("tree", "node"))


def _units(classes: DataFrame, depth: int, chunk: int, name: str) -> DataFrame:
    """Rows (unit, part, tree, key, signature, rep, copies): what is to be compared with what.

    ``part`` 0/1 says to which chunk of the unit a class belongs; a unit of a single chunk has part 0.
    """
    shared = (_nodes(classes, depth).groupBy("node").agg(F.count("*").alias("members")).filter("members > 1"))
    rows = written(_nodes(classes, depth).join(shared, "node"), f"{name}-nodes")
    rows = written(rows.join(classes, "key"), f"{name}-members")
    # a node is covered if all its classes share a node of an earlier tree, or of any tree one level deeper
    tests = [(t, _prefix(t, depth)) for t in range(TREES)]
    if depth < DEPTH:
        tests += [(-1, _prefix(t, depth + 1)) for t in range(TREES)]
    same = [F.min(p) == F.max(p) for _, p in tests]
    stats = rows.groupBy("node", "tree", "members").agg(*[s.alias(f"s{i}") for i, s in enumerate(same)])
    covered = F.lit(False)
    for i, (t, _) in enumerate(tests):
        covered = covered | ((F.col("tree") > t) & F.col(f"s{i}"))
    kept = stats.filter(~covered).select("node")
    rows = rows.join(kept, "node", "left_semi")
    chunks = F.ceil(F.col("members") / chunk).cast("int")
    own = F.pmod(F.xxhash64("key", F.lit(7)), chunks).cast("int")
    other = F.explode(F.sequence(F.lit(0), chunks - 1))
    rows = rows.withColumn("own", own).withColumn("other", other)
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return rows.select(F.xxhash64("node", lo, hi).alias("unit"), F.when(F.col("own") > F.col("other"), 1).otherwise(0).alias("part"),
                       (F.col("own") != F.col("other")).alias("two"), "tree", "key", "signature", "rep", "copies")


def overlap(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by blocks of shared shingles."""
    m = len(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    values, column, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = times > 1
    number = np.cumsum(shared) - 1
    use = shared[column]
    owner, column = owner[use], number[column[use]]
    out = np.zeros((m, m), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    block = 4096
    edges = np.searchsorted(column, np.arange(0, int(shared.sum()) + block, block))
    for b, (lo, hi) in enumerate(zip(edges[:-1], edges[1:])):
        x = np.zeros((m, block), np.float32)
        x[owner[lo:hi], column[lo:hi] - b * block] = 1
        out += x @ x.T  # at most 2**24 shared shingles are exact in float32; longer texts add up below that per block
    return out


def _roots(links: np.ndarray) -> np.ndarray:
    """Smallest index of each connected component of a boolean adjacency matrix."""
    label = np.arange(len(links))
    while True:
        new = np.minimum(label, np.where(links, label[None, :], len(links)).min(axis=1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _verify_unit(rows: list[dict], depth: int, threshold: float, words: HashedWords) -> tuple[list, list, list, float, float]:
    """Per class with a link: rep, rep of its local component, documents linked; pairs found and their estimate."""
    seen: dict[bytes, dict] = {}
    for r in rows:
        if r["key"] not in seen:
            found = shingle_set(r["text"], words)
            if set_key(found) == r["key"]:  # an id may occur with another text
                seen[r["key"]] = r | {"set": found}
    use = list(seen.values())
    if len(use) < 2:
        return [], [], [], 0.0, 0.0
    sets = [r["set"] for r in use]
    size = np.array([len(s) for s in sets], np.float64)
    common = overlap(sets).astype(np.float64)
    similarity = common / (size[:, None] + size[None, :] - common)
    tree = rows[0]["tree"]
    codes = np.frombuffer(b"".join(r["signature"] for r in use), np.uint16).reshape(len(use), TREES, DEPTH)

    def share(t: int, d: int) -> np.ndarray:
        return (codes[:, None, t, :d] == codes[None, :, t, :d]).all(axis=2)

    fresh = ~np.eye(len(use), dtype=bool)
    if rows[0]["two"]:
        part = np.array([r["part"] for r in use])
        fresh &= part[:, None] != part[None, :]
    links = fresh & (similarity >= threshold)
    if links.any():
        for t in range(tree):
            links &= ~share(t, depth)
        if depth < DEPTH:
            for t in range(TREES):
                links &= ~share(t, depth + 1)
    if not links.any():
        return [], [], [], 0.0, 0.0
    copies = np.array([r["copies"] for r in use], np.int64)
    docs = links @ copies
    root = _roots(links)
    have = np.flatnonzero(docs)
    s = similarity[links]
    return ([use[i]["rep"] for i in have], [use[root[i]]["rep"] for i in have], docs[have].tolist(),
            float(len(s)) / 2, float((1 / found_at(s, depth)).sum()) / 2)


def found_at(similarity: np.ndarray, depth: int) -> np.ndarray:
    """Probability that a pair shares a prefix of ``depth`` in one of the trees."""
    return 1 - (1 - similarity ** depth) ** TREES


def _verify(units: DataFrame, docs: DataFrame, depth: int, threshold: float) -> DataFrame:
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = HashedWords()
        held: list[dict] = []
        out: list[tuple] = []

        def close() -> None:
            if held:
                reps, roots, links, pairs, estimate = _verify_unit(held, depth, threshold, words)
                out.extend(zip(reps, roots, links, [pairs] + [0.0] * len(reps), [estimate] + [0.0] * len(reps)))
                held.clear()

        def flush() -> pa.RecordBatch:
            cols = list(zip(*out))
            out.clear()
            return pa.record_batch({"rep": pa.array(cols[0], pa.int64()), "root": pa.array(cols[1], pa.int64()),
                                    "links": pa.array(cols[2], pa.int64()), "pairs": pa.array(cols[3], pa.float64()),
                                    "estimate": pa.array(cols[4], pa.float64())})

        for batch in batches:
            for row in batch.to_pylist():
                if held and held[0]["unit"] != row["unit"]:
                    close()
                held.append(row)
            if out:
                yield flush()
        close()
        if out:
            yield flush()

    texts = docs.select(F.col("doc_id").cast("long").alias("rep"), "text")
    rows = units.join(texts, "rep").repartition("unit").sortWithinPartitions("unit")
    return rows.mapInArrow(task, "rep long, root long, links long, pairs double, estimate double")


def components(edges: DataFrame) -> DataFrame:
    """(node, class) with the smallest node of each connected component of ``edges`` (a, b)."""
    both = written(edges.filter("a != b").select("a", "b").union(edges.filter("a != b").select("b", "a")).distinct(), "cc-edges")
    labels = written(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m"))
                     .select("node", F.least("node", "m").alias("label")), "cc-labels")
    while True:
        near = (both.join(labels, both.b == labels.node).groupBy(F.col("a").alias("n")).agg(F.min("label").alias("near")))
        new = labels.join(near, labels.node == near.n).select("node", F.least("label", "near").alias("label"), F.col("label").alias("old"))
        up = labels.select(F.col("node").alias("n"), F.col("label").alias("top"))
        new = written(new.join(up, new.label == up.n, "left")
                      .select("node", F.least("label", F.coalesce("top", "label")).alias("label"), "old"), "cc-labels")
        moved = new.filter("label != old").limit(1).count()
        labels = new.select("node", "label")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, target: float = TARGET, chunk: int = CHUNK) -> DataFrame:
    """doc_id, class_id, n_links, n_copies; one row per row of ``docs``."""
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    with arrow_rows(docs.sparkSession, ROWS):
        signed = written(texts.mapInArrow(_sign_task, "doc_id long, key binary, signature binary"), "forest-signatures")
    classes = written(signed.filter("key IS NOT NULL").groupBy("key").agg(
        F.first("signature").alias("signature"), F.min("doc_id").alias("rep"), F.count("*").alias("copies")), "forest-classes")

    found: DataFrame | None = None
    pairs = missing = 0.0
    for depth in range(DEPTH, MIN_DEPTH - 1, -1):
        name = f"forest-{depth}"
        with arrow_rows(docs.sparkSession, ROWS):
            got = written(_verify(_units(classes.filter("rep IS NOT NULL"), depth, chunk, name), texts, depth, threshold), name)
        found = got if found is None else found.union(got)
        total = got.agg(F.sum("pairs").alias("pairs"), F.sum("estimate").alias("estimate")).first()
        # the shorter prefix finds most of what was estimated to be missing, at the threshold the least
        missing = (total.estimate or 0.0) - (total.pairs or 0.0) if depth == DEPTH else missing * _left(depth, threshold)
        pairs += total.pairs or 0.0
        if pairs >= target * (pairs + missing):
            break

    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    per_class = (classes.join(links, "rep", "left").join(groups, classes.rep == groups.node, "left")
                 .select("key", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"),
                         F.coalesce("label", "rep").alias("class_id")))
    out = signed.select("doc_id", "key").join(written(per_class, "forest-result"), "key", "left")
    return out.select("doc_id", F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
                      F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      F.coalesce("copies", F.lit(1)).cast("long").alias("n_copies"))


def _left(depth: int, threshold: float) -> float:
    """Share of the pairs missed at depth + 1 that are still missed at ``depth``, at the threshold."""
    s = np.array([threshold])
    return float(((1 - found_at(s, depth)) / (1 - found_at(s, depth + 1)))[0])


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each component, with all its columns: the smallest doc_id, then the smallest hash of the text.

    Rows, not ids, are compared and removed: rows that share an id, or have none, are documents
    of their own, and unlike texts under one id all stay. A NULL id counts as the largest. Rows equal in id and text
    are copies. Texts without words link to nothing, so such rows all stay.
    """
    taken = {c.lower() for c in docs.columns}
    number = next(c for c in ("row", *(f"row_{i}" for i in range(len(taken) + 1))) if c not in taken)
    rows = written(docs.withColumn(number, F.monotonically_increasing_id()), "forest-rows")
    found = near_duplicates(rows.select(F.col(number).alias("doc_id"), "text")).select(F.col("doc_id").alias(number), "class_id")
    order = rows.select(number, F.col("doc_id").isNull().alias("last"), "doc_id", F.xxhash64("text").alias("text"))
    first = found.join(order, number).groupBy("class_id").agg(F.min(F.struct("last", "doc_id", "text", number)).alias("first"))
    kept = first.select(F.col(f"first.{number}").alias(number))
    return rows.join(kept, number, "left_semi").drop(number)
