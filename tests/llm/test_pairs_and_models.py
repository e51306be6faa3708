"""Near-duplicate join, decontamination, language-model scores and the pipeline against brute force."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from croupier.llm import decontam, lm_score, lsh_forest
from croupier.llm.common import written

from .conftest import words


def shingle_sets(rows):
    out = {}
    for i, t in rows:
        w = (t or "").lower().split()
        out[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_links(rows, threshold=0.8):
    sets = shingle_sets(rows)
    by = {}
    for i, s in sets.items():
        for x in s:
            by.setdefault(x, []).append(i)
    links = {i: set() for i in sets}
    for a, b in {(a, b) for l in by.values() for a in l for b in l if a < b}:
        n = len(sets[a] & sets[b])
        if n >= threshold * (len(sets[a]) + len(sets[b]) - n) - 1e-12:
            links[a].add(b)
            links[b].add(a)
    label = {i: i for i in sets}
    moved = True
    while moved:
        moved = False
        for i in sets:
            low = min([label[i], *(label[j] for j in links[i])])
            if low < label[i]:
                label[i], moved = low, True
    return links, label


def near_copies(n, seed=0, edits=1):
    r = random.Random(seed)
    base = words(seed, 120).split()
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, edits)):
            w[r.randrange(len(w))] = "edit%d" % r.randrange(10**6)
        out.append(" ".join(w))
    return out


def check_links(spark, rows, **how):
    links, label = brute_links(rows)
    got = {r.doc_id: r for r in lsh_forest.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), **how).collect()}
    assert len(got) == len(rows)
    assert {i: r.class_id for i, r in got.items()} == label
    assert {i: r.n_links for i, r in got.items()} == {i: len(x) for i, x in links.items()}


def test_links_equal_brute_force(spark, documents):
    rows = [(d.doc_id, d.text) for d in documents.collect()]
    rows += [(1000 + i, t) for i, t in enumerate(near_copies(80, 1, 3) + near_copies(30, 2, 2) + [words(3, 4), words(3, 4), "one", "one", "", None])]
    check_links(spark, rows)


def test_large_group_in_many_chunks(spark):
    """More classes under one node than a chunk holds, copies among them."""
    texts = near_copies(120, 5, 1)
    check_links(spark, list(enumerate(texts + texts[:40])), chunk=16)


def test_shorter_prefixes_find_what_the_full_depth_misses(spark):
    """Pairs of a similarity around 0.4 rarely share six min-hashes; the target drives the prefix down."""
    rows = list(enumerate(near_copies(60, 9, 14)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    some = lsh_forest.near_duplicates(df, threshold=0.3, target=0.0).agg(F.sum("n_links")).first()[0]
    more = lsh_forest.near_duplicates(df, threshold=0.3, target=0.99).agg(F.sum("n_links")).first()[0]
    true = sum(len(x) for x in brute_links(rows, 0.3)[0].values())
    assert some < more <= true and more >= 0.95 * true


def test_components_of_a_long_chain(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (103, 102), (102, 101), (200, 200)]
    got = {r.node: r.label for r in lsh_forest.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[i] == 100 for i in range(100, 104)) and 200 not in got


def test_overlap_equals_sets():
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 20_000, n).astype(np.uint64)) for n in (5000, 9000, 3, 12_000)]
    got = lsh_forest.overlap(sets)
    for i in range(4):
        for j in range(4):
            if i != j:
                assert got[i, j] == len(np.intersect1d(sets[i], sets[j]))


def test_near_duplicates_odd_rows(odd, nothing):
    got = lsh_forest.near_duplicates(odd).collect()
    assert len(got) == odd.count() and lsh_forest.near_duplicates(nothing).count() == 0
    by_id = {r.doc_id: r for r in got}
    assert by_id[2].class_id == 1 and by_id[2].n_links == 2 and by_id[3].class_id == 3 and by_id[3].n_links == 0
    kept = lsh_forest.keep_one(odd)
    assert kept.columns == odd.columns
    ids = sorted(r.doc_id for r in kept.collect() if r.doc_id is not None)
    assert ids == [1, 3, 4, 5, 6, 7, 8, 9, 10] and kept.filter("doc_id IS NULL").count() == 2
    assert lsh_forest.keep_one(nothing).count() == 0


def test_keep_one_removes_rows_not_ids(spark):
    """Unlike texts that share an id, or have none, all stay; of near copies the smallest id stays."""
    a, b = words(21, 90), words(22, 90)
    near = a.split()
    near[40] = "changed"
    rows = [(1, a), (7, b), (7, words(23, 90)), (9, b), (3, " ".join(near)), (None, words(24, 90)), (None, b), (None, words(25, 90)),
            (2, None), (2, None), (2, ""), (11, words(26, 90)), (11, words(26, 90))]
    docs = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, row int").repartition(3)
    kept = lsh_forest.keep_one(docs)
    numbers = {r.row for r in kept.collect()}
    assert numbers - {11, 12} == {0, 1, 2, 5, 7, 8, 9, 10} and len(numbers) == 9 and kept.columns == docs.columns



def brute_matches(docs, items, threshold=0.8):
    cut = lambda t: re.findall(r"\w+", (t or "").lower())
    out = {}
    for k, it in items:
        w = cut(it)
        if not w:
            continue
        width = min(5, len(w))
        bag = Counter(tuple(w[j:j + width]) for j in range(len(w) - width + 1))
        m = sum(bag.values())
        for i, t in docs:
            d = cut(t)
            s = [tuple(d[j:j + width]) for j in range(len(d) - width + 1)]
            best = 0
            for lo in range(max(0, len(s) - m) + 1) if s else ():
                win = Counter(s[lo:lo + m])
                common = sum((win & bag).values())
                best = max(best, common / (m + sum(win.values()) - common))
            if best >= threshold:
                out[i, k] = best
    return out


def test_matches_equal_brute_force(spark):
    r = random.Random(3)
    items = [(k, words(100 + k, r.randint(8, 50))) for k in range(25)] + [(25, "two words"), (26, ""), (27, None), (28, words(7, 300))]
    docs = []
    for i in range(60):
        body = words(500 + i, 150).split()
        if i % 2:
            passage = (items[r.choice([*range(26), 28])][1] or "").split()
            for _ in range(i % 3):
                passage[r.randrange(len(passage))] = "other"
            at = r.randrange(len(body))
            body[at:at] = passage
        docs.append((i, " ".join(body).replace(" e", ", E") if i % 5 == 0 else " ".join(body)))
    docs += [(90, None), (91, ""), (92, items[0][1]), (93, " ".join(items[1][1].split()[:-1])), (94, "two words"), (95, (items[2][1] + " ") * 30)]
    want = brute_matches(docs, items)
    assert len(want) > 15
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for passes in (100_000, 7):
        got = {(x.doc_id, x.item_id): x.similarity for x in decontam.matches(d, b, max_items=passes).collect()}
        assert got.keys() == want.keys()
        assert all(abs(got[k] - want[k]) < 1e-12 for k in got)
    kept = {x.doc_id for x in decontam.clean(d, b, max_items=7).collect()}
    assert kept == {i for i, _ in docs} - {i for i, _ in want}


def test_index_finds_every_fingerprint_within_the_radius():
    r = np.random.default_rng(4)
    items = [decontam.Item(k, r.integers(0, 2**63, 30).astype(np.uint64)) for k in range(130)]
    index = decontam.HammingIndex(items)
    prints = []
    for k in range(400):
        bits = np.unpackbits(items[k % 130].print)
        flip = r.choice(decontam.BITS, r.integers(0, 45), replace=False)
        bits[flip] ^= 1
        prints.append(np.packbits(bits))
    prints = np.stack(prints)
    want = {(i, x.number) for i, p in enumerate(prints) for x in items if int(np.bitwise_count(p ^ x.print).sum()) <= decontam.RADIUS}
    assert {(i, x.number) for i, x in index.within(prints)} == want


@pytest.mark.parametrize("seed", [393, 50012, 56921])
def test_pair_at_the_threshold_with_far_fingerprints(seed):
    """22 words with the last two changed share 16 of 18 shingles, similarity 0.8; these differ in 32 to 36 bits."""
    text = words(seed, 22)
    changed = " ".join(text.split()[:20] + [f"new{seed}", f"end{seed}"])
    assert decontam.Matcher([(7, text)]).search(changed) == {7: (0.8, 0)}


def test_decontamination_odd_rows(odd, nothing, benchmark_items, spark):
    assert decontam.matches(odd, benchmark_items).count() == 0 and decontam.clean(odd, benchmark_items).count() == odd.count()
    assert decontam.clean(odd, benchmark_items).columns == odd.columns
    assert decontam.matches(nothing, benchmark_items).count() == 0 and decontam.clean(odd, benchmark_items.limit(0)).count() == odd.count()


def brute_scores(rows, wanted, size, mu):
    cut = {i: (t or "").lower().split() for i, t in enumerate(t for _, t in rows)}
    count = Counter(w for v in cut.values() for w in v)
    number = {w: k + 2 for k, (w, _) in enumerate(sorted(count.items(), key=lambda x: (-x[1], x[0].encode()))[:size])}
    n_words = len(number) + 2
    uni, pairs, own = [Counter() for _ in range(4)], [Counter() for _ in range(4)], {}
    for i, w in cut.items():
        if w:
            n = [number.get(x, 0) for x in w]
            doc_id = rows[i][0]
            kind = (2 * (zlib.crc32(str(doc_id).encode()) % 2) if doc_id is not None else 0) + (doc_id in wanted)
            own[i] = (kind, list(zip([1] + n, n + [1])))
            uni[kind].update(n + [1])
            pairs[kind].update(own[i][1])
    total = [sum(u.values()) for u in uni]
    out = {}
    for i, (kind, ps) in own.items():
        f = 1 - (kind >> 1)
        loss = []
        for m, scale in ((2 * f + 1, 1.0), (2 * f, total[2 * f + 1] / total[2 * f] if total[2 * f] else 0.0)):
            p1 = lambda w: (uni[m][w] * scale + 1) / (total[m] * scale + n_words)  # noqa: E731, B023
            loss.append(sum(-math.log((pairs[m][p] * scale + mu * p1(p[1])) / (uni[m][p[0]] * scale + mu)) for p in ps) / len(ps))
        out[i] = loss
    return out


@pytest.mark.parametrize("size", [50_000, 300])
def test_scores_equal_brute_force(documents, labels, size):
    rows = [(d.doc_id, d.text) for d in documents.orderBy("doc_id").collect()]
    wanted = labels.filter("quality = 1")
    want = brute_scores(rows, {r.doc_id for r in wanted.collect()}, size, lm_score.MU)
    got = {r.doc_id: r for r in lm_score.score(documents, wanted, size).collect()}
    assert len(got) == len(rows)
    for k, (t, b) in want.items():
        r = got[rows[k][0]]
        assert abs(r.h_target - t) < 1e-5 and abs(r.h_background - b) < 1e-5 and abs(r.score - (t - b)) < 2e-5


def test_scores_with_every_word(spark):
    """More words than 16 bits can number, nearly all of them rare; each keeps its own counts."""
    r = random.Random(4)
    rows = [(i, " ".join(["word%d" % r.randrange(300_000) for _ in range(900)] * (1 + i % 2))) for i in range(90)]
    assert len({w for _, t in rows for w in t.split()}) > 1 << 16
    wanted = [(i,) for i in range(0, 90, 3)]
    want = brute_scores(rows, {i for i, in wanted}, 1 << 60, lm_score.MU)
    got = {x.doc_id: x for x in lm_score.score(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(wanted, "doc_id long")).collect()}
    assert len(got) == len(rows)
    for k, (t, b) in want.items():
        assert abs(got[k].h_target - t) < 1e-9 and abs(got[k].h_background - b) < 1e-9


def test_scores_group_counts_not_occurrences(spark, monkeypatch):
    """A hot bigram is one entry per block in its bucket; smaller buckets hold less and score the same."""
    rows = [(i, "hot pair " * 4000 + words(i, 50)) for i in range(12)]
    docs, wanted = spark.createDataFrame(rows, "doc_id long, text string").repartition(3), spark.createDataFrame([(1,), (5,)], "doc_id long")
    blocks = written(lm_score._blocks(docs, None), "test-blocks")
    groups = lm_score._counts(blocks, lm_score._classes(blocks, wanted), 4).collect()
    entries = sum(lm_score._unpack64(r.pairs, 5).shape[1] for r in groups if r.pairs)
    assert blocks.count() <= 3 and entries <= 12 * 52 + 3 * 3
    plain = {r.doc_id: r for r in lm_score.score(docs, wanted).collect()}
    seen, of = [], lm_score._counts
    monkeypatch.setattr(lm_score, "_counts", lambda blocks, classes, buckets: seen.append(buckets) or of(blocks, classes, buckets))
    monkeypatch.setattr(lm_score, "BUCKET_BYTES", 5_000)
    split = {r.doc_id: r for r in lm_score.score(docs, wanted).collect()}
    assert seen[0] == sum(len(t) for _, t in rows) // 5_000
    assert plain.keys() == split.keys() and all(abs(plain[i].score - split[i].score) < 1e-12 for i in plain)


def test_scores_odd_rows(odd, nothing, spark):
    none = spark.createDataFrame([], "doc_id long")
    got = lm_score.score(odd, none).collect()
    assert len(got) == odd.count() and all(abs(r.score) < 1e-9 for r in got)
    assert all(r.h_target is None and r.n_tokens == 0 for r in got if r.doc_id in (3, 4, 5))
    some = spark.createDataFrame([(1,), (1,), (9,), (None,)], "doc_id long")
    assert lm_score.score(odd, some).count() == odd.count() and lm_score.score(nothing, some).count() == 0


def test_pipeline_equals_brute_force(spark, tmp_path):
    import hashlib

    import corpus_pipeline
    import public_tokenizers

    from croupier.llm import bpe, pii, quality_rules

    from .test_pii_and_secrets import brute

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    kept = {r.doc_id for r in quality_rules.assess(docs).filter("kept").collect()}
    rows = sorted((r.doc_id, r.text) for r in docs.collect() if r.doc_id in kept)
    label = brute_links(rows)[1]
    rows = [(i, t) for i, t in rows if label[i] == i]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    leaks = {i for i, _ in brute_matches(rows, items)}
    rows = [(i, t) for i, t in rows if i not in leaks]
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf).collect()}
    assert out.keys() == {i for i, _ in rows}
    tokenizer = bpe.load(public_tokenizers.path("byte_bpe_50k.json"))
    plain = 0
    for i, text in rows:
        if not brute(text)[1] and not re.search(r"[0-9]{3}", text):
            ids = tokenizer.encode(text, add_special_tokens=False).ids
            assert (out[i].n_tokens, out[i].decoded_sha256) == (len(ids), hashlib.sha256(text.encode()).hexdigest())
            plain += 1
    assert plain > 20
    stages = [name for name, _ in corpus_pipeline.STAGES]
    assert len(stages) == 5 and corpus_pipeline.ORACLE_SQL is None
    kept_columns = docs.columns
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf)
        assert docs.columns == kept_columns
    assert pii.KINDS == ("email", "ip", "card", "phone")
