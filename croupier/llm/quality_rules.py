"""Quality rules with thresholds learned from mergeable quantile sketches.

Fixed base rules come first (see ``features``). The adaptive part replaces fixed cutoffs: four
rates per document (symbols per word, repeated lines, words inside repeated three-word windows,
mean word length) are held against fences learned per language and source.

Sketch: a log-linear histogram. A rate is an integer; it falls into a bucket with a relative
width of 1/32, and a sketch is the table (lang, source, metric, bucket, n). Two sketches merge by
adding ``n``, so every task pre-aggregates before the shuffle, a hot source shrinks to its
buckets, and the language and global sketches are sums of the source sketches. Quantiles do not
depend on partitioning. Fences are ``q75 + spread * (q75 - q25) + slack`` (mean word length also
has the mirrored lower fence). Groups under ``min_docs`` documents use the sketch of their
language, then the global one.

The fences (one row per language and source) are written to the shared folder; Spark broadcasts
them only if the written size is under its threshold and sort-merge joins them otherwise.

Everything is DataFrame expressions. Cases: NULL or empty text has no words and fails the base
rules; NULL lang or source is a group of its own; repeated rows each count and each get a row;
ties sit in one bucket; an empty table gives no rows; further columns pass through ``keep``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from croupier.llm.common import written

MIN_WORDS = 50
SPREAD = 3
MIN_DOCS = 200
SUB_BITS = 5  # 2**5 buckets per power of two
# metric -> slack added to its fence, in the metric's own unit
SLACK = {"symbols": 100, "dup_lines": 350, "repeats": 400, "word_length": 100}
LOWER = ("word_length",)

SPACE = r"[\\x20\\x09-\\x0D]"
POSITION_BITS = 20
_LOW = (1 << POSITION_BITS) - 1

#: Columns added one after the other; each reads the ones before. A three-word window is one long:
#: the upper 44 bits of its hash, then its position, so that a sort of longs puts equal windows
#: side by side. Should two different windows share the 44 bits, or the text be too long for the
#: position bits, the words themselves are sorted instead (``_exact``).
_STEPS = {
    "_words": rf"filter(split(coalesce(text, ''), '{SPACE}+'), x -> x != '')",
    "_lines": rf"filter(split(coalesce(text, ''), '\\n'), x -> x rlike '[^\\x20\\x09-\\x0D]')",
    "n_words": "cast(size(_words) AS bigint)",
    "_keys": f"""sort_array(CASE WHEN n_words < 3 OR n_words > {1 << POSITION_BITS} THEN cast(array() AS array<bigint>)
        ELSE transform(sequence(0, cast(n_words AS int) - 3),
            i -> (xxhash64(_words[i], _words[i + 1], _words[i + 2]) & {~_LOW}L) | i) END)""",
    "_twins": f"""filter(transform(_keys, (x, i) -> CASE
        WHEN i > 0 AND shiftright(x, {POSITION_BITS}) = shiftright(_keys[i - 1], {POSITION_BITS}) THEN
            struct(cast(_keys[i - 1] & {_LOW}L AS int) AS a, cast(x & {_LOW}L AS int) AS b) END), t -> t IS NOT NULL)""",
    "_clash": f"""n_words > {1 << POSITION_BITS} OR exists(_twins, t -> _words[t.a] != _words[t.b]
        OR _words[t.a + 1] != _words[t.b + 1] OR _words[t.a + 2] != _words[t.b + 2])""",
    "_exact": """CASE WHEN _clash THEN sort_array(transform(sequence(0, cast(n_words AS int) - 3),
        i -> struct(_words[i] AS x, _words[i + 1] AS y, _words[i + 2] AS z, i AS p))) END""",
    "_hits": """sort_array(array_distinct(CASE WHEN _clash THEN flatten(transform(_exact, (e, i) -> CASE
            WHEN i > 0 AND e.x = _exact[i - 1].x AND e.y = _exact[i - 1].y AND e.z = _exact[i - 1].z
            THEN array(_exact[i - 1].p, e.p) ELSE cast(array() AS array<int>) END))
        ELSE flatten(transform(_twins, t -> array(t.a, t.b))) END))""",
    "n_repeat_words": """aggregate(zip_with(_hits, slice(_hits, 2, size(_hits)), (x, y) -> least(3, coalesce(y - x, 3))),
        0L, (s, x) -> s + x)""",
    "word_chars": rf"cast(length(regexp_replace(coalesce(text, ''), '{SPACE}+', '')) AS bigint)",
    "n_symbols": "cast(regexp_count(coalesce(text, ''), '[#*$%&|<>]') AS bigint)",
    "_n_lines": "cast(size(_lines) AS bigint)",
    "n_dup_lines": "cast(size(_lines) - size(array_distinct(_lines)) AS bigint)",
}
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def features(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns of ``docs`` plus the base counts, ``base_failed`` and the four rates.

    The counts are over the whole text; ``n_repeat_words`` is the number of words that lie in a
    three-word window found twice or more in the text.
    """
    df = docs.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*keep, "text"])])
    for name, sql in _STEPS.items():
        df = df.withColumn(name, F.expr(sql))
    df = df.select(
        *[F.col(f"`{c}`") for c in keep], *BASE,
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))).alias("base_failed"),
        F.expr("n_symbols * 1000 div greatest(n_words, 1)").alias("symbols"),
        F.expr("n_dup_lines * 1000 div greatest(_n_lines, 1)").alias("dup_lines"),
        F.expr("n_repeat_words * 1000 div greatest(n_words, 1)").alias("repeats"),
        F.expr("word_chars * 100 div greatest(n_words, 1)").alias("word_length"),
    )
    # one row out per row in: a filter above is not pushed below it, where it would repeat every step
    return df.select(F.inline(F.array(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))


def bucket(value: Column) -> Column:
    """Log-linear bucket of a non-negative integer: exact below 2**SUB_BITS, then 1/32 wide."""
    shift = F.greatest(F.length(F.bin(value)) - 1 - SUB_BITS, F.lit(0))
    return (shift * (1 << SUB_BITS) + F.call_function("shiftright", value, shift)).cast("int")


def bucket_floor(b: Column) -> Column:
    """Smallest value of a bucket."""
    size = 1 << SUB_BITS
    shift = F.greatest(F.floor(b / size).cast("int") - 1, F.lit(0))
    return F.call_function("shiftleft", (b - shift * size).cast("bigint"), shift)


def sketch(feats: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) over the documents that pass the base rules."""
    values = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), bucket(F.col(m)).alias("bucket")) for m in SLACK]))
    return (feats.filter(~F.col("base_failed")).select("lang", "source", values.alias("v"))
            .groupBy("lang", "source", F.col("v.metric").alias("metric"), F.col("v.bucket").alias("bucket"))
            .agg(F.count("*").alias("n")).withColumn("every", F.lit(1)))


def _fences(merged: DataFrame, keys: list[str], spread: int) -> DataFrame:
    """One row per ``keys``: n_docs and lo/hi per metric, from a sketch merged to ``keys``."""
    counts = merged.groupBy(*keys, "metric", "bucket").agg(F.sum("n").alias("n"))
    # the metric is part of every window, so a partition is one sketch: a few hundred buckets
    part = Window.partitionBy(*keys, "metric")
    ranked = counts.withColumns({"cum": F.sum("n").over(part.orderBy("bucket")), "total": F.sum("n").over(part)})

    def quantile(percent: int) -> Column:
        return F.min(F.when(F.col("cum") * 100 >= F.col("total") * percent, bucket_floor(F.col("bucket"))))

    q = ranked.groupBy(*keys, "metric").agg(quantile(25).alias("q25"), quantile(75).alias("q75"), F.max("total").alias("total"))
    slack = F.create_map(*[F.lit(x) for kv in SLACK.items() for x in kv])
    width = F.col("q75") - F.col("q25")
    q = q.withColumns({"hi": F.col("q75") + spread * width + slack[F.col("metric")],
                       "lo": F.col("q25") - spread * width - slack[F.col("metric")]})
    named = [F.max(F.when(F.col("metric") == m, F.col("hi"))).alias(f"hi_{m}") for m in SLACK]
    named += [F.max(F.when(F.col("metric") == m, F.col("lo"))).alias(f"lo_{m}") for m in LOWER]
    return q.groupBy(*keys).agg(F.max("total").alias("n_docs"), *named)


def thresholds(feats: DataFrame, spread: int = SPREAD, min_docs: int = MIN_DOCS) -> DataFrame:
    """Fences for every (lang, source) of ``feats``, from the smallest sketch with enough documents."""
    base = written(sketch(feats), "quality-sketch")
    own = _fences(base, ["lang", "source"], spread)
    by_lang = _fences(base, ["lang"], spread)
    overall = _fences(base, ["every"], spread)
    fences = [c for c in own.columns if c.startswith(("hi_", "lo_"))]
    pairs = base.groupBy("lang", "source").agg(F.max("every").alias("e")).select(F.col("lang").alias("pl"), F.col("source").alias("ps"), "e")
    own = (own.select("lang", "source", F.struct("n_docs", *fences).alias("own"))
           .join(pairs, F.col("lang").eqNullSafe(F.col("pl")) & F.col("source").eqNullSafe(F.col("ps"))))
    by_lang = by_lang.select(F.col("lang").alias("l"), F.struct("n_docs", *fences).alias("by_lang"))
    overall = overall.select("every", F.struct("n_docs", *fences).alias("overall"))
    joined = (own.join(by_lang, F.col("lang").eqNullSafe(F.col("l")), "left")
              .join(overall, F.col("e") == F.col("every"), "left"))
    chosen = (F.when(F.col("own.n_docs") >= min_docs, F.col("own"))
              .when(F.col("by_lang.n_docs") >= min_docs, F.col("by_lang")).otherwise(F.col("overall")))
    return written(joined.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"),
                                 chosen.alias("f")).select("t_lang", "t_source", *[F.col("f")[c].alias(c) for c in fences]),
                   "quality-thresholds")


def judge(feats: DataFrame, limits: DataFrame) -> DataFrame:
    """Add ``kept``: false if the base rules fail, else whether every rate is inside its fences."""
    inside = F.lit(True)
    for m in SLACK:
        inside = inside & (F.col(m) <= F.col(f"hi_{m}"))
    for m in LOWER:
        inside = inside & (F.col(m) >= F.col(f"lo_{m}"))
    joined = feats.join(limits, F.col("lang").eqNullSafe(F.col("t_lang")) & F.col("source").eqNullSafe(F.col("t_source")), "left")
    return joined.select(*[F.col(f"`{c}`") for c in feats.columns],
                         (~F.col("base_failed") & F.coalesce(inside, F.lit(True))).alias("kept"))


def assess(docs: DataFrame) -> DataFrame:
    """doc_id, the base counts, base_failed, kept and the four rates, one row per document."""
    feats = written(features(docs, ["doc_id", "lang", "source"]), "quality-features")
    out = judge(feats, thresholds(feats))
    return out.select("doc_id", *BASE, "base_failed", "kept", *SLACK)


def clean(docs: DataFrame) -> DataFrame:
    """The kept documents with all their columns; texts are never shuffled."""
    limits = thresholds(written(features(docs, ["lang", "source"]), "quality-features"))
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "text", "lang", "source")
    kept = judge(features(packed, ["_row", "lang", "source"]), limits).filter("kept")
    return kept.select(*[F.col("_row")[c].alias(c) for c in columns])
