"""Secret scan: wide candidate patterns, then a random forest that removes false positives.

Candidates are long runs of key-like characters with a digit or a provider prefix, and values assigned to a name such
as ``password`` or ``token``. Each gets the features the forest sees:
  * length and character transitions (changes between lower case, upper case, digits and other
    characters, distinct characters, shares of digits and capitals);
  * dictionary coverage: the share of its characters inside letter runs that are words of the
    corpus (found in ``MIN_WORD_COUNT`` places or more; counted over all documents);
  * path: slashes, and whether it stands in a URL or file path;
  * neighbouring words: naming words, assignment and quotes before it, words such as ``commit``,
    ``sha256`` or ``order`` that speak against it.

The forest learns from labelled findings: a table (m, near, label), or, when none is given, the
findings that fixed rules can tell (provider formats and named random values are secrets; numbers,
placeholders, identifiers of commits and files are not). At most about ``MAX_TRAIN`` of them are
used. All candidates are then scored by the forest, and kept at ``ACCEPT`` or more.

Everything is DataFrame expressions and Spark's own forest. Texts are never shuffled; the word
counts are pre-aggregated per task, and coverage is looked up once per distinct candidate string.

Cases: NULL or empty text has no candidates. Repeated rows give repeated findings, NULL ids are
carried. Without labelled findings of both classes every candidate is kept with the share of
secrets among the labels (1 without any). Two patterns that meet at one place give one finding,
the assigned one. Very long texts, and texts with very many candidates, are read whole in linear time. An empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from croupier.llm.common import apart, cut, places, wide, written

MIN_LENGTH = 16
MIN_WORD_COUNT = 5
MAX_TRAIN = 100_000
TREES = 40
DEPTH = 6
ACCEPT = 0.5

_CHARS = "[A-Za-z0-9_+/-]"
# Names that secrets are assigned to, words that speak against a secret, formats.
_NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|bearer|credential"
_AGAINST = "commit|sha1|sha256|md5|checksum|digest|hash|uuid|guid|order|invoice|isbn|card|version|build|revision"
_FORMATS = (r"AKIA[0-9A-Z]{16}|ASIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|"
            r"[sr]k_live_[A-Za-z0-9]{16,}|AIza[0-9A-Za-z_-]{35}|eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{5,}")
_PLACEHOLDER = "example|sample|dummy|changeme|placeholder|your[_-]|xxxx|0123456|1234567|abcdef0"

PATTERNS = {
    "token": rf"(?<![A-Za-z0-9_+/=-])(?=[A-Za-z_+/-]*+[0-9]|A[KS]IA[A-Z]{{16}}){_CHARS}{{{MIN_LENGTH},}}+={{0,2}}",
    "assigned": rf"(?<=(?:{_NAMES}).? ?[:=]{{1,2}} ?.?)(?<=[\s:=.'])[^\s',;<>]{{6,}}+".replace("'", "\\x22\\x27"),
}
_GUARDS = {
    "token": r"_t rlike r'[0-9]'",
    "assigned": rf"_low rlike r'(?:{_NAMES}).? ?[:=]'",
}
_SPAN = "struct<s:int,e:int,m:string>"


def _found(kind: str) -> str:
    """SQL: every match with its place in code points."""
    regex = "(?i)" + PATTERNS[kind] if kind == "assigned" else PATTERNS[kind]
    return f"CASE WHEN {_GUARDS[kind]} THEN {places('_t', regex)} ELSE cast(array() AS array<{_SPAN}>) END"


def candidates(docs: DataFrame) -> DataFrame:
    """id, doc_id, kind, s, e, m, before, after: one row per candidate."""
    df = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    df = df.withColumn("_low", F.lower("_t"))
    for kind in PATTERNS:
        df = df.withColumn(f"_{kind}", F.expr(_found(kind)))
    df = df.withColumn("_free", F.expr(apart("_token", "_assigned")))
    fields = f"""x.s AS s, x.e AS e, x.m AS m, {cut('_u', 'greatest(x.s - 40, 0)', 'least(x.s, 40)')} AS before,
        {cut('_u', 'x.e', '20')} AS after"""
    every = f"""concat(transform(_assigned, x -> struct('assigned' AS kind, {fields})), transform(_free, x -> struct('token' AS kind, {fields})))"""
    df = df.withColumn("_all", F.expr(wide("CASE WHEN size(_assigned) + size(_free) > 0 THEN _t ELSE '' END", "_u", every)))
    # one row out per row in: the filter that goes with the next explode is not pushed below, where it would repeat every step
    df = df.select(F.inline(F.array(F.struct("doc_id", "_all"))))
    return (df.select("doc_id", F.explode("_all").alias("x")).select("doc_id", "x.*")
            .withColumn("id", F.monotonically_increasing_id()))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of all lower-cased letter runs of 3 to 15 letters in all documents."""
    words = F.expr("explode(filter(split(lower(coalesce(text, '')), '[^a-z]+'), x -> length(x) BETWEEN 3 AND 15))")
    return docs.select(words.alias("word")).groupBy("word").agg(F.count("*").alias("n"))


def coverage(found: DataFrame, words: DataFrame) -> DataFrame:
    """(string, covered): share of a candidate's characters that lie in words of the corpus."""
    distinct = found.select(F.col("m").alias("string")).distinct()
    runs = distinct.select("string", F.explode(F.expr("regexp_extract_all(lower(string), r'[a-z]{3,}', 0)")).alias("run"))
    known = words.filter(F.col("n") >= MIN_WORD_COUNT).select("word")
    return (runs.join(known, runs.run == known.word).groupBy("string")
            .agg((F.sum(F.length("run")) / F.first(F.length("string"))).alias("covered")))


_L = "greatest(length(m), 1)"
FEATURES = {
    "length": "cast(length(m) AS double)",
    "transitions": rf"size(regexp_extract_all(m, r'[a-z]+|[A-Z]+|[0-9]+|[^A-Za-z0-9]+', 0)) / {_L}",
    "distinct": f"size(array_distinct(split(m, ''))) / {_L}",
    "digits": f"regexp_count(m, '[0-9]') / {_L}",
    "capitals": f"regexp_count(m, '[A-Z]') / {_L}",
    "covered": "coalesce(covered, 0D)",
    "slashes": f"regexp_count(m, '[/]') / {_L}",
    "path": r"cast(before rlike r'(?:[:]//|www\.|[A-Za-z0-9]/|\./)[^ ]*$' OR after rlike r'^\.[a-z]{2,4}(?![a-z])' AS double)",
    "named": rf"cast(lower(before) rlike r'(?:{_NAMES})' AS double)",
    "assigned": r"cast(before rlike r'[:=] ?.?$' AS double)",
    "quoted": r"cast(before rlike r'[\x22\x27]$' AND after rlike r'^[\x22\x27]' AS double)",
    "against": rf"cast(lower(concat(before, ' ', after)) rlike r'(?<![a-z])(?:{_AGAINST})(?![a-z])' AS double)",
}

#: What the fixed rules can tell: 1 a secret, 0 not, NULL unknown.
RULE = rf"""CASE
    WHEN lower(m) rlike r'{_PLACEHOLDER}' THEN 0
    WHEN m rlike r'^(?:{_FORMATS})$' THEN 1
    WHEN m rlike r'^[0-9_+/-]+$' THEN 0
    WHEN lower(before) rlike r'(?<![a-z])(?:{_AGAINST})(?![a-z])[^A-Za-z]*$' THEN 0
    WHEN before rlike r'(?:[:]//|www\.)[^ ]*$' THEN 0
    WHEN m rlike r'^[a-z]+[0-9]{{1,4}}$' THEN 0
    WHEN lower(before) rlike r'(?:{_NAMES}).? ?[:=]{{1,2}} ?.?$' AND m rlike r'^(?=.*[0-9])(?=.*[A-Za-z])[A-Za-z0-9_+/=-]{{16,}}$' THEN 1 END"""


def features(found: DataFrame, words: DataFrame) -> DataFrame:
    covered = coverage(found, words)
    joined = found.join(covered, found.m == covered.string, "left")
    return joined.select("id", "doc_id", "kind", "s", "e", F.expr(RULE).alias("rule"), *[F.expr(sql).cast("double").alias(f"f_{k}") for k, sql in FEATURES.items()])


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, start, end, kind, probability, kept: one row per candidate.

    ``labelled`` has the columns m, before, after, label of findings judged by hand.
    """
    found = written(candidates(docs), "secret-candidates")
    words = word_counts(docs)
    rows = written(features(found, words), "secret-features")
    if labelled is None:
        known = rows.filter("rule IS NOT NULL").withColumn("label", F.col("rule").cast("double"))
    else:
        judged = labelled.select("m", "before", "after", F.col("label").cast("double").alias("label"), F.lit(None).cast("long").alias("id"),
                                 F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("kind"), F.lit(0).alias("s"), F.lit(0).alias("e"))
        ready = features(judged.drop("label").withColumn("id", F.xxhash64("m", "before", "after")), words)
        labels = judged.select(F.xxhash64("m", "before", "after").alias("l_id"), "label").dropDuplicates(["l_id"])
        known = written(ready.join(labels, ready.id == labels.l_id).drop("l_id"), "secret-labelled")
    counts = {r.label: r.n for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values())
    if len(counts) < 2:
        p = F.lit(float(counts.get(1.0, 0)) / total if total else 1.0)
        scored = rows.withColumn("probability", p)
    else:
        share = min(1_000_000, MAX_TRAIN * 1_000_000 // total)
        chosen = known.filter(F.pmod(F.xxhash64("id", "s"), F.lit(1_000_000)) < share)
        inputs = VectorAssembler(inputCols=[f"f_{k}" for k in FEATURES], outputCol="features")
        forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=7, cacheNodeIds=False).fit(inputs.transform(chosen))
        scored = forest.transform(inputs.transform(rows)).withColumn("score", vector_to_array("probability")[1]).drop("probability").withColumnRenamed("score", "probability")
    return scored.select("doc_id", F.col("s").cast("long").alias("start"), F.col("e").cast("long").alias("end"), "kind",
                         "probability", (F.col("probability") >= ACCEPT).alias("kept"))
