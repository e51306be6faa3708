"""Language id, quality rules and quality classifier."""

import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from croupier.llm import langid, quality_cnn, quality_rules


def brute_grams(text):
    out, run = Counter(), []
    padded = [1]
    for c in (text or "").lower():
        if c.isalpha():
            padded.append(ord(c))
        elif padded[-1] != 1:
            padded.append(1)
    if padded[-1] != 1:
        padded.append(1)
    if len(padded) == 1:
        return out
    for n in (1, 2, 3):
        for i in range(len(padded) - n + 1):
            gram = padded[i:i + n]
            if (n == 1 and gram == [1]) or (n == 3 and gram[1] == 1):
                continue
            code = 0
            for g in gram:
                code = code << 21 | g
            out[code] += 1
    return out


@pytest.mark.parametrize("text", ["Hello, wörld 42!", "a", "", None, "...", "İstanbul ñandú", "x  y\n\nz"])
def test_ngrams_equal_brute_force(text):
    keys, counts = langid.ngrams(text)
    assert dict(zip(keys.tolist(), counts.tolist())) == dict(brute_grams(text))


def test_profiles_and_distances_equal_brute_force(documents):
    train = documents.filter("crc32(cast(cast(doc_id AS string) AS binary)) % 5 != 0")
    profiles = langid.learn_profiles(train, 50)
    want = {}
    for row in train.collect():
        want.setdefault(row.lang, Counter()).update(brute_grams(row.text))
    ranked = {g: [k for k, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:50]] for g, c in want.items()}
    assert profiles == dict(sorted(ranked.items()))
    text = documents.first().text
    own = [k for k, _ in sorted(brute_grams(text).items(), key=lambda x: (-x[1], x[0]))[:50]]
    far = {g: sum(abs(r - p.index(k)) if k in p else 50 for r, k in enumerate(own)) for g, p in ranked.items()}
    assert langid.Classifier(profiles, 50).predict(text)[0] == min(sorted(far), key=far.get)


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.identify(docs).join(docs, "doc_id").filter("held_out")
    assert got.select(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] >= 0.97


def test_language_odd_rows(odd, nothing):
    rows = langid.identify(odd).collect()
    assert len(rows) == odd.count()
    by_id = {r.doc_id: r for r in rows if r.doc_id is not None}
    for i in (3, 4, 5, 7, 10):
        assert (by_id[i].lang_pred, by_id[i].score) == ("und", 0.0)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows if r.doc_id is not None)
    assert not any(r.held_out for r in rows if r.doc_id is None)
    assert langid.identify(nothing).count() == 0
    assert {r.lang_pred for r in langid.predict(odd, {}).collect()} == {"und"}


def brute_counts(text):
    text = text or ""
    ws = [w for w in re.split(r"[\x20\x09-\x0D]+", text) if w]
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    tri = Counter(zip(ws, ws[1:], ws[2:]))
    hit = {i + d for i in range(len(ws) - 2) if tri[tuple(ws[i:i + 3])] > 1 for d in range(3)}
    return (len(ws), sum(map(len, ws)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit))


def test_base_counts_equal_brute_force(spark, documents, odd):
    extra = spark.createDataFrame([(100 + i, t) for i, t in enumerate([
        "a a a a", "a b c a b c", "a b c d a b c e b c d", "x\ny\nx\n \nx", "a\x0bb\x0cc a b c", "b " * 5000, "é é é é"])], "doc_id long, text string")
    for docs in (documents.select("doc_id", "text"), odd.select("doc_id", "text"), extra):
        docs = docs.withColumns({"lang": F.lit("en"), "source": F.lit("s")})
        got = quality_rules.features(docs, ["doc_id", "text"]).collect()
        for r in got:
            assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_counts(r.text), (r.text or "")[:80]
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)


def test_clashing_window_hashes_fall_back_to_the_words(spark, monkeypatch):
    """With no hash bits left every window clashes; the exact branch must give the same counts."""
    steps = dict(quality_rules._STEPS)
    steps["_keys"] = re.sub(r"xxhash64\([^)]*\)", "cast(0 AS bigint)", steps["_keys"])
    monkeypatch.setattr(quality_rules, "_STEPS", steps)
    texts = ["a b c d e f a b c", "a a a a", "q w e r t y", "a b"]
    docs = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    for r in quality_rules.features(docs, ["doc_id", "text"]).collect():
        assert r.n_repeat_words == brute_counts(r.text)[4]


def test_bucket_is_a_lower_bound_within_one_part_in_32(spark):
    df = spark.range(0, 200_000, 7).select(F.col("id"), quality_rules.bucket(F.col("id")).alias("b"))
    df = df.withColumn("lo", quality_rules.bucket_floor(F.col("b")))
    assert df.filter("lo > id OR (id - lo) * 32 > id").count() == 0


def test_sketches_merge_by_addition(documents):
    feats = quality_rules.features(documents, ["doc_id", "lang", "source"])
    keys = ["lang", "source", "metric", "bucket"]
    whole = quality_rules.sketch(feats).select(*keys, "n")
    parts = quality_rules.sketch(feats.filter("doc_id % 2 = 0")).union(quality_rules.sketch(feats.filter("doc_id % 2 = 1")))
    merged = parts.groupBy(*keys).agg(F.sum("n").alias("n"))
    assert whole.exceptAll(merged).count() == 0 and merged.exceptAll(whole).count() == 0


def test_rules_keep_clean_and_drop_junk(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marked = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_rules.assess(docs).join(marked, "doc_id").filter("NOT base_failed")
    assert got.filter("quality = 1 AND NOT kept").count() == 0
    assert got.filter("quality = 0 AND kept").count() <= 2


def test_rules_odd_rows_and_pass_through(odd, nothing):
    got = quality_rules.assess(odd)
    assert got.count() == odd.count()
    assert got.filter("doc_id IN (3, 4, 5) AND (kept OR NOT base_failed)").count() == 0
    clean = quality_rules.clean(odd)
    assert clean.columns == odd.columns
    kept = got.filter("kept").count()
    assert clean.count() == kept > 0
    assert clean.exceptAll(odd).count() == 0
    assert quality_rules.assess(nothing).count() == 0 and quality_rules.clean(nothing).count() == 0


def test_classifier_separates_held_out_labels(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    marked = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality_cnn.classify(docs, marked)
    assert got.count() == docs.count()
    rows = got.join(marked, "doc_id").filter("held_out").collect()
    good = [r.score for r in rows if r.quality == 1]
    bad = [r.score for r in rows if r.quality == 0]
    wins = sum((g > b) + 0.5 * (g == b) for g in good for b in bad) / (len(good) * len(bad))
    assert wins >= 0.95
    assert sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.93


def test_pooling_over_chunks_equals_whole_text():
    import numpy as np

    net = quality_cnn.Network(3)
    x = quality_cnn.symbols("lorem ipsum dolor " * 1500)
    whole = sum(net.filters[j][x[j:len(x) - quality_cnn.WIDTH + 1 + j]] for j in range(quality_cnn.WIDTH))
    pooled, where = net.pool(x)
    assert np.allclose(pooled, whole.max(axis=0)) and np.allclose(whole[where, range(quality_cnn.FILTERS)], pooled)


def test_repeat_channel_equals_brute_force():
    text = "abcdefghijklmnopqrstuvwxyz abcdefghijklmnopqrstuvwxyz!" * 2
    raw, got = text.encode(), quality_cnn.symbols(text)
    for i in range(len(raw)):
        again = i >= 15 and raw[i - 15:i + 1] in [raw[k - 15:k + 1] for k in range(15, i)]
        assert got[i] == raw[i] + 256 * again


def test_classifier_odd_rows(odd, nothing, spark):
    few = spark.createDataFrame([(1, 1, 0), (10, 0, 0), (10, 0, 0), (None, 1, 0), (6, None, 0), (7, 0, 0), (9, 1, 0)], "doc_id long, quality int, toxic int")
    rows = quality_cnn.classify(odd, few).collect()
    assert len(rows) == odd.count() and all(0 <= r.score <= 1 for r in rows)
    assert all(r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality_cnn.classify(nothing, few).count() == 0
    assert {r.score for r in quality_cnn.classify(odd, few.limit(0)).collect()} == {1.0}
