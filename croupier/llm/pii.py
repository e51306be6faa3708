"""Personal data by weak supervision: labelers vote, EM weighs them, a span classifier decides.

Base spans (email, ip, card, phone) come from fixed patterns and checks and always stay. Further
candidates are base matches that failed their check and matches of wider patterns (written-out
email addresses, phone numbers without ``+``, IPv6 addresses, 15-digit cards).

Every candidate gets four votes (-1 against, 0 none, 1 for):
  * pattern: the base pattern and its check; * gazetteer: known endings, calling codes, issuer
  prefixes, public address ranges; * context: cue words beside the span; * shape: checksum,
  length and form.

The votes are counted per kind and vote pattern in Spark (at most 4 x 3^4 rows whatever the
input). Expectation-maximisation on that table estimates how often each labeler votes which way
on true and on false candidates, and so a probability per pattern. Those are the soft labels of a
logistic regression over features of the span itself (kind, length, digits, neighbouring
characters, separators), again trained on counts per feature pattern. A candidate that is no base
span is added if the classifier gives it ``ACCEPT`` or more and it overlaps no base span.

Everything is DataFrame expressions; the texts are never shuffled. The patterns use possessive
quantifiers and fixed starts, so a long run of digits or letters costs linear time. Places are
running sums, overlaps are found among sorted neighbours, and contexts are cut from a copy of the
text with four bytes a character (only of texts with a candidate): linear in the matches too.

Cases: NULL text is read as empty (no spans, the digest of the empty string). Repeated rows each
get a row and NULL ids are carried. Two added spans that overlap: the earlier one stays, at equal
starts the longer, of equal spans one. Without candidates nothing is trained or added. An empty table gives no rows.
Further columns are ignored by ``find`` and kept by ``redact``.
"""

from __future__ import annotations

import math

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from croupier.llm.common import apart, bind, cut, places, totals, wide, written

KINDS = ("email", "ip", "card", "phone")
ACCEPT = 0.5
EM_ROUNDS = 40
VOTES = ("v_pattern", "v_gazetteer", "v_context", "v_shape")

_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20]?[0-9]|-[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
WIDE = {
    "email": rf"(?<!{_LOCAL}){_LOCAL}++ ?[(\[]at[)\]] ?[A-Za-z0-9-]++(?: ?(?:\.|[(\[]dot[)\]]) ?[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){3,7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z])[0-9]{4}[ -]?[0-9]{6}[ -]?[0-9]{5}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.(])(?:\([0-9]{2,4}\) ?|00[0-9]{1,3}[ .-])?[0-9]{2,4}[ .-][0-9]{3,4}[ .-][0-9]{3,4}(?![0-9A-Za-z])",
}
#: Quick tests that a text can hold a match at all.
_GUARD = {
    ("email", 0): "contains(_t, '@')", ("ip", 0): r"_digits AND _t rlike r'[0-9]\.[0-9]'", ("card", 0): "_digits",
    ("phone", 0): "_digits AND contains(_t, '+')", ("email", 1): r"_t rlike r'[(\[]at[)\]]'",
    ("ip", 1): r"_t rlike r'[0-9A-Fa-f]:[0-9A-Fa-f]'", ("card", 1): r"_digits AND _t rlike r'[0-9]{4}[ -]?[0-9]{6}'",
    ("phone", 1): r"_digits AND _t rlike r'[0-9]{2}\)?[ .-] ?[0-9]{2}'",
}

# Public top-level names, calling codes, card issuer prefixes, cue words.
_ENDINGS = "com|org|net|edu|gov|int|info|biz|io|de|fr|es|uk|it|nl|eu|us|ca|ch|at|be|pt|pl|se|no|dk|fi|jp|cn|in|br|au|ru|mx"
_CODES = "1|7|20|27|30|31|32|33|34|36|39|40|41|43|44|45|46|47|48|49|51|52|54|55|56|57|58|60|61|62|63|64|65|66|81|82|84|86|90|91|92|98"
_ISSUERS = "4|5[1-5]|2[2-7]|34|37|36|6011|65"
_CUES = {
    "email": "mail|contact|write|reply|address|courriel|correo|kontakt",
    "ip": "ip|host|server|address|login|from|adresse",
    "card": "card|visa|credit|debit|payment|pay|karte|carte|tarjeta",
    "phone": "phone|call|tel|fax|mobile|cell|whatsapp|telefon|handy|appel",
}
_AGAINST = "version|release|section|chapter|isbn|issn|order|invoice|page|figure|table|ratio|score|build"

_CANDIDATE = "struct<kind:int,s:int,e:int,m:string,ok:boolean,wide:boolean>"


def _found(kind: str, wide: bool) -> str:
    """SQL: every match of one pattern in ``_t`` with its place in code points and the verdict of its check."""
    spans = places("_t", (WIDE if wide else BASE)[kind])
    return rf"""CASE WHEN {_GUARD[kind, int(wide)]} THEN transform({spans}, x -> struct({KINDS.index(kind)} AS kind, x.s AS s, x.e AS e, x.m AS m,
        coalesce({_check(kind)}, false) AS ok, {str(wide).lower()} AS wide)) ELSE cast(array() AS array<{_CANDIDATE}>) END"""


_DIGITS = "regexp_replace(x.m, '[^0-9]', '')"


def _luhn(text: str) -> str:
    """SQL: the checksum of a string of at most 19 digits."""
    digit = f"cast(substring(reverse({text}), i, 1) AS int)"
    return f"aggregate(sequence(1, length({text})), 0, (a, i) -> a + CASE WHEN i % 2 = 1 THEN {digit} ELSE {digit} * 2 - 9 * cast({digit} > 4 AS int) END) % 10 = 0"


def _check(kind: str) -> str:
    if kind == "ip":
        part = "trim(LEADING '0' FROM p)"
        return rf"forall(split(x.m, r'\.'), p -> length({part}) <= 3 AND coalesce(try_cast({part} AS int), 0) <= 255)"
    if kind == "card":
        return f"CASE WHEN length({_DIGITS}) BETWEEN 16 AND 19 THEN {_luhn(_DIGITS)} ELSE false END"
    if kind == "phone":
        return f"length({_DIGITS}) BETWEEN 8 AND 15"
    return "true"


def _vote(yes: str, no: str) -> str:
    return f"CASE WHEN {yes} THEN 1 WHEN {no} THEN -1 ELSE 0 END"


def _votes() -> dict[str, str]:
    """SQL of each vote and feature for a candidate ``x`` of the text ``_u`` (four bytes a character)."""
    d = _DIGITS
    near = f"lower(concat({cut('_u', 'greatest(x.s - 40, 0)', 'least(x.s, 40)')}, ' ', {cut('_u', 'x.e', '20')}))"
    cue = " ".join(f"WHEN {i} THEN {near} rlike r'(?<![a-z])(?:{_CUES[k]})(?![a-z])'" for i, k in enumerate(KINDS))
    by_kind = {
        "gazetteer": [
            _vote(rf"lower(x.m) rlike r'(?:\.|dot[)\]]) ?(?:{_ENDINGS})$'", "true"),
            _vote(r"x.m rlike r'^(?:[1-9]|[1-9][0-9]|1[0-9][0-9]|2[01][0-9]|22[0-3])\.'", "NOT x.wide"),
            _vote(f"{d} rlike r'^(?:{_ISSUERS})'", "true"),
            _vote(rf"x.m rlike r'^\+(?:{_CODES})' OR x.m rlike r'^(?:\(|00)'", "NOT x.wide"),
        ],
        "shape": [
            _vote(r"length(x.m) <= 254 AND NOT x.m rlike r'\.\.|^[.]'", "true"),
            _vote(r"x.m rlike r'[0-9]{2}' AND length(x.m) >= 8", "true"),
            _vote(f"length({d}) BETWEEN 13 AND 19 AND CASE WHEN length({d}) BETWEEN 13 AND 19 THEN {_luhn(d)} ELSE false END", "true"),
            _vote(f"length({d}) BETWEEN 9 AND 14", "true"),
        ],
    }
    pick = {name: "CASE x.kind " + " ".join(f"WHEN {i} THEN {sql}" for i, sql in enumerate(listed)) + " END" for name, listed in by_kind.items()}
    side = "CASE WHEN {c} = '' OR {c} rlike r'^\\s$' THEN 0 WHEN {c} rlike r'^[A-Za-z0-9]$' THEN 1 ELSE 2 END"
    return {
        "v_pattern": "CASE WHEN x.wide THEN 0 WHEN x.ok THEN 1 ELSE -1 END",
        "v_gazetteer": pick["gazetteer"],
        "v_context": _vote(f"CASE x.kind {cue} END", f"{near} rlike r'(?<![a-z])(?:{_AGAINST})(?![a-z])'"),
        "v_shape": pick["shape"],
        "f_length": "least(x.e - x.s, 39) div 5",
        "f_digits": f"(length({d}) * 4) div greatest(x.e - x.s, 1)",
        "f_before": side.format(c=f"CASE WHEN x.s = 0 THEN '' ELSE {cut('_u', 'x.s - 1', '1')} END"),
        "f_after": side.format(c=cut("_u", "x.e", "1")),
        "f_parts": r"least(size(regexp_extract_all(x.m, r'[ ().:@-]+', 0)), 4)",
    }


FEATURES = ("f_length", "f_digits", "f_before", "f_after", "f_parts")


def candidates(docs: DataFrame, keep: list[str]) -> DataFrame:
    """``keep`` columns and ``found``: every candidate span of the text with its votes and features."""
    df = docs.select(*[F.col(f"`{c}`") for c in keep], F.coalesce(F.col("text"), F.lit("")).alias("_t"))
    df = df.withColumn("_digits", F.expr("_t rlike '[0-9]'"))
    for kind in KINDS:
        df = df.withColumn(f"_{kind}", F.expr(_found(kind, False))).withColumn(f"_{kind}_wide", F.expr(_found(kind, True)))
    base = ", ".join(f"filter(_{k}, x -> x.ok)" for k in KINDS)
    other = ", ".join([f"filter(_{k}, x -> NOT x.ok)" for k in KINDS] + [f"_{k}_wide" for k in KINDS])
    df = df.withColumn("_base", F.expr(f"concat({base})")).withColumn("_other", F.expr(f"concat({other})"))
    # what overlaps a base span is not a candidate of its own
    df = df.withColumn("_free", F.expr(apart("_other", "_base")))
    votes = ", ".join(f"{sql} AS {name}" for name, sql in _votes().items())
    fields = f"struct(x.kind AS kind, x.s AS s, x.e AS e, x.ok AND NOT x.wide AS base, {votes})"
    return df.select(*[F.col(f"`{c}`") for c in keep], "_t", 
                     F.expr(f"""{wide("CASE WHEN size(_base) + size(_free) > 0 THEN _t ELSE '' END", '_u', f'transform(concat(_base, _free), x -> {fields})')}""").alias("found"))


def _em(rows: list, rounds: int = EM_ROUNDS) -> dict[tuple, float]:
    """(kind, votes...) -> probability of being personal data, from counts per vote pattern.

    Two latent classes; each labeler has its own table P(vote | class), kinds have their own
    prior. The start is the majority vote; every table is smoothed by one virtual vote each.
    """
    table = {(r["kind"], *(r[v] for v in VOTES)): float(r["n"]) for r in rows}
    p = {k: 0.5 + 0.45 * max(-1, min(1, sum(k[1:]))) for k in table}
    for _ in range(rounds):
        prior, given = {}, {}
        for kind in {k[0] for k in table}:
            own = [k for k in table if k[0] == kind]
            total = sum(table[k] for k in own)
            prior[kind] = (sum(table[k] * p[k] for k in own) + 1) / (total + 2)
            for j in range(len(VOTES)):
                for side in (0, 1):
                    weight = {v: 1.0 for v in (-1, 0, 1)}
                    for k in own:
                        weight[k[1 + j]] += table[k] * (p[k] if side else 1 - p[k])
                    whole = sum(weight.values())
                    for v in weight:
                        given[kind, j, side, v] = weight[v] / whole
                for v, toward in ((1, 1), (-1, 0)):  # a labeler is never held to be worse than chance
                    if given[kind, j, toward, v] < given[kind, j, 1 - toward, v]:
                        given[kind, j, 0, v] = given[kind, j, 1, v] = (given[kind, j, 0, v] + given[kind, j, 1, v]) / 2
        for k in table:
            odds = math.log(prior[k[0]] / (1 - prior[k[0]]))
            odds += sum(math.log(given[k[0], j, 1, v] / given[k[0], j, 0, v]) for j, v in enumerate(k[1:]))
            p[k] = 1 / (1 + math.exp(-max(-30.0, min(30.0, odds))))
    return p


def _inputs(row: str) -> list[str]:
    """SQL terms of the classifier: indicators of every feature value within its kind's reach."""
    terms = [f"cast({row}.kind = {i} AS double)" for i in range(1, len(KINDS))]
    terms += [f"cast({row}.{f} = {v} AS double)" for f, top in zip(FEATURES, (7, 4, 2, 2, 4)) for v in range(1, top + 1)]
    return terms


def train(found: DataFrame) -> str | None:
    """SQL expression: the classifier's probability for a candidate ``x``; None without candidates."""
    each = found.select(F.explode("found").alias("x"))
    votes = each.groupBy("x.kind", *[f"x.{v}" for v in VOTES]).agg(F.count("*").alias("n")).collect()
    if not votes:
        return None
    belief = F.create_map(*[F.lit(x) for k, p in sorted(_em(votes).items()) for x in ("|".join(map(str, k)), p)])
    key = F.concat_ws("|", "x.kind", *[f"x.{v}" for v in VOTES])
    counts = (each.select("x", belief[key].alias("p")).groupBy("x.kind", *[f"x.{f}" for f in FEATURES])
              .agg(F.sum("p").alias("yes"), F.sum(1 - F.col("p")).alias("no")))
    data = counts.select(F.struct("kind", *FEATURES).alias("x"), F.explode(F.array(
        F.struct(F.lit(1.0).alias("label"), F.col("yes").alias("weight")),
        F.struct(F.lit(0.0).alias("label"), F.col("no").alias("weight")))).alias("y"))
    terms = _inputs("x")
    data = data.select(*[F.expr(t).alias(f"i{n}") for n, t in enumerate(terms)], "y.label", (F.col("y.weight") + 1e-6).alias("weight"))
    data = VectorAssembler(inputCols=[f"i{n}" for n in range(len(terms))], outputCol="features").transform(data)
    model = LogisticRegression(weightCol="weight", regParam=0.001, maxIter=100, standardization=False).fit(data.coalesce(1))
    weights = " + ".join(f"({w!r}D) * {t}" for w, t in zip(model.coefficients.toArray().tolist(), terms))
    return f"1 / (1 + exp(-(({model.intercept!r}D) + {weights})))"


_PLAIN = "struct<kind:int,s:int,e:int>"


def _decided(found: DataFrame, score: str | None) -> DataFrame:
    """``base`` and ``added`` spans (kind, s, e), each by kind, then start."""
    plain = "x -> struct(x.kind AS kind, x.s AS s, x.e AS e)"
    df = found.withColumn("base", F.expr(f"array_sort(transform(filter(found, x -> x.base), {plain}))"))
    if score is None:
        return df.withColumn("added", F.expr(f"cast(array() AS array<{_PLAIN}>)"))
    df = df.withColumn("_new", F.expr(f"transform(filter(found, x -> NOT x.base AND {score} >= {ACCEPT}), {plain})"))
    order = "sort_array(transform(_new, x -> struct(x.s AS s, -x.e AS e, x.kind AS kind)))"
    free = f"zip_with(_o, {totals('_o', 'greatest({a}, -x.e)', 'greatest({a}, x)')}, (x, a) -> CASE WHEN a <= x.s THEN struct(x.kind AS kind, x.s AS s, -x.e AS e) END)"
    return df.withColumn("added", F.expr(f"array_sort(filter({bind('_o', order, free)}, x -> x IS NOT NULL))"))


def _listed(spans: str) -> Column:
    names = "array(" + ", ".join(f"'{k}'" for k in KINDS) + ")"
    return F.expr(f"array_join(transform({spans}, x -> concat({names}[x.kind], ':', x.s, ':', x.e)), ',')")


def find(docs: DataFrame) -> DataFrame:
    """doc_id, counts of the base spans by kind, their digest, and all spans."""
    found = written(candidates(docs, ["doc_id"]).drop("_t"), "pii-candidates")
    df = _decided(found, train(found))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {i})) AS bigint)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return df.select("doc_id", *counts, F.sha2(_listed("base"), 256).alias("base_sha256"),
                     _listed("array_sort(concat(base, added))").alias("spans"))


def redact(docs: DataFrame) -> DataFrame:
    """The documents with every span replaced by its kind in brackets; NULL texts stay NULL."""
    score = train(written(candidates(docs, []).select("found"), "pii-candidates"))
    columns = docs.columns
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), "text")
    df = _decided(candidates(packed, ["_row"]), score)
    # spans by start; one that begins inside what is already replaced only extends it
    df = df.withColumn("_all", F.expr("array_sort(transform(concat(base, added), x -> struct(x.s AS s, x.e AS e, x.kind AS kind)))"))
    names = "array(" + ", ".join(f"'[{k.upper()}]'" for k in KINDS) + ")"
    end = totals("_all", "greatest({a}, x.e)", "greatest({a}, x)")
    pieces = f"zip_with(_all, {end}, (x, a) -> CASE WHEN x.s < a THEN '' ELSE concat({cut('_u', 'a', 'x.s - a')}, {names}[x.kind]) END)"
    rest = bind("_end", "array_max(transform(_all, x -> x.e))", cut("_u", "_end", "length(_t) - _end"))
    whole = wide("_t", "_u", f"concat(array_join({pieces}, ''), {rest})")
    text = F.expr(f"CASE WHEN size(_all) > 0 THEN {whole} END")
    text = F.when(F.col("_row.text").isNull() | (F.size("_all") == 0), F.col("_row.text")).otherwise(text)
    return df.select(*[text.alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in columns])
