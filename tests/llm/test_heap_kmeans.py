"""Centroid clustering against plain Lloyd rounds in Python integers."""

import hashlib
import math
import random

import numpy as np
import pytest

from croupier.llm import heap_kmeans as hk
from croupier.llm import registry
from tests.llm.conftest import SMALL

SCHEMA = "vec_id long, embedding array<float>, label int, block long, cluster int"


def brute(rows, clusters=16, rounds=3, size=64):
    """(vec_id, cluster, distance) per kept vector, and the centroids."""
    kept = [(i, [math.floor(64 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == size and all(x is not None and math.isfinite(x) and abs(x) <= 2**20 for x in v)]
    name = lambda i: hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest()
    centroids = [v for _, v in sorted(kept, key=lambda r: (name(r[0]), r[1]))[:clusters]]
    far = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c))
    for turn in range(rounds + 1):
        best = [min((far(v, c), k) for k, c in enumerate(centroids)) for _, v in kept]
        if turn < rounds:
            for k in range(len(centroids)):
                own = [v for (_, v), (_, b) in zip(kept, best) if b == k]
                if own:
                    centroids[k] = [sum(x) // len(own) for x in zip(*own)]
    return [(i, b, d) for (i, _), (d, b) in zip(kept, best)], centroids


def expected(rows, **kw):
    got, centroids = brute(rows, **kw)
    own = {}
    for _, c, d in got:
        own[c] = own.get(c, 0) + d
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, c, d, own[c], sum(own.values()), sha[c]) for i, c, d in got]


def key(rows):
    return sorted((tuple(r) for r in rows), key=repr)


def clumps(n, seed, spread=0.2):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(64)] for _ in range(9)]
    return [(i, [float(np.float32(x + r.gauss(0, spread))) for x in middle[i % 9]]) for i in range(n)]


def table(spark, rows, parts=3):
    return spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], SCHEMA).repartition(parts)


def test_query_equals_plain_rounds(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    assert key(registry.QUERIES["op13_centroid_clustering"](spark, SMALL).collect()) == key(expected(rows))


def test_odd_vectors_ties_and_repeats(spark):
    rows = clumps(60, 1)
    rows += [(None, rows[0][1]), (None, rows[1][1]), (1, rows[5][1]), (1, rows[5][1]), (200, None), (201, []), (202, [0.5] * 63), (203, [0.5] * 65),
             (204, [None] + [0.5] * 63), (205, [float("nan")] * 64), (206, [float("inf")] + [0.0] * 63), (207, [2.0**21] + [0.0] * 63),
             (208, [1000.0] * 64), (209, [-1000.0] * 64), (210, [0.0] * 64), (211, [0.0] * 64)]
    rows += [(300 + i, rows[2][1]) for i in range(120)]  # one vector holds half of all rows
    assert key(hk.digests(table(spark, rows)).collect()) == key(expected(rows))


@pytest.mark.parametrize("clusters", [1, 2, 16])
def test_small_blocks_and_cluster_counts(spark, clusters):
    rows = clumps(40, 2)
    found = hk.cluster(table(spark, rows), clusters=clusters, rounds=3, block=7)
    got, centroids = brute(rows, clusters=clusters)
    assert key(found.assigned.collect()) == key(got) and found.centroids.tolist() == centroids


def test_fewer_vectors_than_clusters_and_no_vectors(spark):
    rows = clumps(5, 3)
    assert key(hk.digests(table(spark, rows)).collect()) == key(expected(rows))
    empty = hk.digests(spark.createDataFrame([], SCHEMA))
    assert empty.collect() == [] and empty.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_vectors_whose_gap_holds_are_not_scanned_again(spark):
    rows = clumps(300, 4, spread=0.02)
    found = hk.cluster(table(spark, rows), clusters=9)
    assert found.scanned[0] == 300 and found.scanned[-1] < 150
    assert key(found.assigned.collect()) == key(brute(rows, clusters=9)[0])


def test_bounds_survive_any_movement_of_centroids():
    """Heaps against full scans while the centroids jump about."""
    r = np.random.default_rng(5)
    matrix = r.integers(-60, 60, (200, 8))
    centroids = r.integers(-60, 60, (5, 8))
    state, shift = hk.State.new(200, 5), np.zeros(5)
    state.scan(list(range(200)), matrix, centroids, shift)
    for step in (1, 3, 0, 20, 1, 1):
        after = centroids + r.integers(-step, step + 1, centroids.shape)
        shift = shift + hk.drifts(centroids, after)
        centroids = after
        state = hk.State.load(*state.dump())
        state.scan(state.expired(shift), matrix, centroids, shift)
        assert (state.cluster == hk.squared(matrix, centroids).argmin(axis=1)).all()
