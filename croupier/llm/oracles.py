"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations


def quality_rules_ctes(docs: str) -> str:
    """CTEs ending in ``judged``: every row of ``docs`` with its counts, base_failed and kept.

    Built from plain counts per (lang, source, rate): quantiles are read from a window over the
    log-linear buckets, independent of the sketch tables of the Spark side.
    """
    return f"""
    src AS (SELECT row_number() OVER () AS rid, * FROM {docs}),
    cut AS (SELECT *, [x FOR x IN regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+') IF x <> ''] AS ws,
                   [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '[^\\x20\\x09-\\x0D]')] AS ls
            FROM src),
    pos AS (SELECT rid, unnest(ws) AS w, generate_subscripts(ws, 1) AS p FROM cut),
    tri AS (SELECT rid, p, w AS a, lead(w) OVER o AS b, lead(w, 2) OVER o AS c FROM pos WINDOW o AS (PARTITION BY rid ORDER BY p)),
    rep AS (SELECT rid, p, count(*) OVER (PARTITION BY rid, a, b, c) AS k FROM tri WHERE c IS NOT NULL),
    cov AS (SELECT rid, count(DISTINCT p + d) AS n FROM rep, (VALUES (0), (1), (2)) AS s(d) WHERE k > 1 GROUP BY rid),
    feat AS (SELECT cut.*, len(ws)::BIGINT AS n_words,
                    coalesce(list_sum([length(x) FOR x IN ws]), 0)::BIGINT AS word_chars,
                    len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
                    (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
                    coalesce(cov.n, 0)::BIGINT AS n_repeat_words
             FROM cut LEFT JOIN cov USING (rid)),
    rate AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                    n_symbols * 1000 // greatest(n_words, 1) AS symbols,
                    n_dup_lines * 1000 // greatest(len(ls), 1) AS dup_lines,
                    n_repeat_words * 1000 // greatest(n_words, 1) AS repeats,
                    word_chars * 100 // greatest(n_words, 1) AS word_length
             FROM feat),
    long AS (SELECT coalesce(lang, chr(1)) AS g, coalesce(source, chr(1)) AS s, m, v
             FROM (SELECT lang, source, unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS m,
                          unnest([symbols, dup_lines, repeats, word_length]) AS v FROM rate WHERE NOT base_failed)),
    -- a value is cut down to its six leading binary digits
    cutv AS (SELECT g, s, m, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS v FROM long),
    lev AS (SELECT g, s, m, v, 1 AS l FROM cutv UNION ALL SELECT g, '', m, v, 2 FROM cutv UNION ALL SELECT '', '', m, v, 3 FROM cutv),
    agg AS (SELECT l, g, s, m, v, count(*) AS n FROM lev GROUP BY ALL),
    cum AS (SELECT *, sum(n) OVER (PARTITION BY l, g, s, m ORDER BY v) AS c, sum(n) OVER (PARTITION BY l, g, s, m) AS t FROM agg),
    qua AS (SELECT l, g, s, m, max(t) AS t, min(v) FILTER (c * 100 >= t * 25) AS q1, min(v) FILTER (c * 100 >= t * 75) AS q3
            FROM cum GROUP BY l, g, s, m),
    fen AS (SELECT l, g, s, m, t, q3 + 3 * (q3 - q1) + k AS hi, q1 - 3 * (q3 - q1) - k AS lo
            FROM qua JOIN (VALUES ('symbols', 100), ('dup_lines', 350), ('repeats', 400), ('word_length', 100)) AS z(m, k) USING (m)),
    lim AS (SELECT a.g, a.s, a.m,
                   CASE WHEN a.t >= 200 THEN a.hi WHEN b.t >= 200 THEN b.hi ELSE c.hi END AS hi,
                   CASE WHEN a.t >= 200 THEN a.lo WHEN b.t >= 200 THEN b.lo ELSE c.lo END AS lo
            FROM fen a JOIN fen b ON b.l = 2 AND b.g = a.g AND b.m = a.m JOIN fen c ON c.l = 3 AND c.m = a.m WHERE a.l = 1),
    bad AS (SELECT DISTINCT rid FROM rate r
            JOIN lim ON lim.g = coalesce(r.lang, chr(1)) AND lim.s = coalesce(r.source, chr(1))
            WHERE (m = 'symbols' AND symbols > hi) OR (m = 'dup_lines' AND dup_lines > hi) OR (m = 'repeats' AND repeats > hi)
               OR (m = 'word_length' AND (word_length > hi OR word_length < lo))),
    judged AS (SELECT rate.*, NOT base_failed AND bad.rid IS NULL AS kept FROM rate LEFT JOIN bad USING (rid))"""


QUALITY_RULES = f"""WITH {quality_rules_ctes('documents')}
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept,
           symbols, dup_lines, repeats, word_length FROM judged"""


#: crc32 of a column ``key`` of ASCII text, bit by bit.
CRC32 = """xor(list_reduce(list_concat([4294967295::UBIGINT], list_transform(string_split(key, ''), lambda ch: ascii(ch)::UBIGINT)),
        lambda a, b: list_reduce(list_concat([xor(a, b)], [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]),
        lambda x, y: CASE WHEN (x & 1::UBIGINT) = 1 THEN xor(x >> 1, 3988292384::UBIGINT) ELSE x >> 1 END)), 4294967295::UBIGINT)"""


def _ranked(source: str, by: str, top: int) -> str:
    """The ``top`` most frequent grams per ``by``: by count, then by length and code points."""
    return f"""SELECT {by}, gram, row_number() OVER (PARTITION BY {by} ORDER BY n DESC, length(gram), gram) - 1 AS place
            FROM (SELECT {by}, gram, count(*) AS n FROM {source} GROUP BY {by}, gram) QUALIFY place < {top}"""


# A word boundary is chr(1), which sorts below every letter; grams that are a boundary alone or have
# one in the middle do not count.
LANGUAGE_ID = f"""WITH
    docs AS (SELECT row_number() OVER () AS rid, doc_id, lang, CAST(doc_id AS VARCHAR) AS key,
                    chr(1) || trim(regexp_replace(lower(coalesce(text, '')), '[^\\p{{L}}]+', chr(1), 'g'), chr(1)) || chr(1) AS t FROM documents),
    lettered AS (SELECT * FROM docs WHERE length(t) > 2),
    grams AS (SELECT rid, lang, doc_id, substr(t, i, k) AS gram
              FROM (SELECT *, unnest(generate_series(1, length(t))) AS i FROM lettered), (VALUES (1), (2), (3)) AS s(k) WHERE i + k - 1 <= length(t)),
    useful AS (SELECT * FROM grams WHERE gram <> chr(1) AND NOT (length(gram) = 3 AND substr(gram, 2, 1) = chr(1))),
    held AS (SELECT rid, doc_id, {CRC32} % 5 = 0 AS held_out FROM docs),
    learned AS (SELECT u.lang, u.gram FROM useful u JOIN held h USING (rid) WHERE NOT h.held_out AND u.lang IS NOT NULL),
    profile AS ({_ranked('learned', 'lang', 400)}),
    own AS ({_ranked('useful', 'rid', 400)}),
    langs AS (SELECT DISTINCT lang FROM profile),
    far AS (SELECT o.rid, l.lang, sum(CASE WHEN p.place IS NULL THEN 400 ELSE abs(o.place - p.place) END) AS d
            FROM own o CROSS JOIN langs l LEFT JOIN profile p ON p.lang = l.lang AND p.gram = o.gram GROUP BY o.rid, l.lang),
    best AS (SELECT rid, lang, d, lead(d) OVER (PARTITION BY rid ORDER BY d, lang) AS second, row_number() OVER (PARTITION BY rid ORDER BY d, lang) AS r FROM far)
    SELECT h.doc_id, h.held_out, coalesce(b.lang, 'und') AS lang_pred,
           CASE WHEN b.lang IS NULL THEN 0.0 ELSE CAST(b.second AS DOUBLE) / CAST(b.second + b.d AS DOUBLE) END AS score
    FROM held h LEFT JOIN best b ON b.rid = h.rid AND b.r = 1"""


# Every pair that shares a shingle is compared, so this is exact where the Spark side is an LSH forest.
NGRAM_JACCARD_JOIN = r"""WITH RECURSIVE
    docs AS (SELECT row_number() OVER () AS rid, doc_id, [x FOR x IN regexp_split_to_array(lower(coalesce(text, '')), '\s+') IF x <> ''] AS ws FROM documents),
    shingles AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS s FROM (SELECT rid, ws, unnest(generate_series(1, greatest(len(ws) - 4, 1))) AS i FROM docs WHERE len(ws) > 0)),
    sizes AS (SELECT rid, count(*) AS n FROM shingles GROUP BY rid),
    common AS (SELECT a.rid AS a, b.rid AS b, count(*) AS c FROM shingles a JOIN shingles b ON a.s = b.s AND a.rid <> b.rid GROUP BY 1, 2),
    links AS (SELECT a, b, c = x.n AND c = y.n AS same FROM common JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b WHERE 10 * c >= 8 * (x.n + y.n - c)),
    reach AS (SELECT a AS rid, b AS other FROM links UNION SELECT r.rid, l.b FROM reach r JOIN links l ON l.a = r.other),
    classes AS (SELECT r.rid, min(d.doc_id) AS low FROM reach r JOIN docs d ON d.rid = r.other GROUP BY r.rid),
    counted AS (SELECT a AS rid, count(*) AS n_links, count(*) FILTER (same) AS twins FROM links GROUP BY a)
    SELECT d.doc_id, least(d.doc_id, coalesce(k.low, d.doc_id)) AS class_id, coalesce(c.n_links, 0) AS n_links, coalesce(c.twins, 0) + 1 AS n_copies
    FROM docs d LEFT JOIN classes k USING (rid) LEFT JOIN counted c USING (rid)"""


# Every window of a document that shares a shingle with an item is compared; items have five words or more here.
DECONTAMINATION = r"""WITH
    cut_docs AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents),
    cut_items AS (SELECT row_number() OVER () AS iid, item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM benchmark),
    docs AS (SELECT rid, doc_id, [array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)] AS s FROM cut_docs WHERE len(w) >= 5),
    items AS (SELECT iid, item_id, [array_to_string(w[i:i + 4], ' ') FOR i IN generate_series(1, len(w) - 4)] AS s FROM cut_items WHERE len(w) >= 5),
    bag AS (SELECT iid, t, count(*) AS n FROM (SELECT iid, unnest(s) AS t FROM items) GROUP BY ALL),
    near AS (SELECT DISTINCT d.rid, b.iid FROM (SELECT rid, unnest(s) AS t FROM docs) d JOIN bag b USING (t)),
    starts AS (SELECT n.rid, n.iid, len(i.s) AS m, d.s, unnest(generate_series(0, greatest(len(d.s) - len(i.s), 0))) AS lo FROM near n JOIN docs d USING (rid) JOIN items i USING (iid)),
    windows AS (SELECT rid, iid, m, least(m, len(s)) AS size, lo, unnest(s[lo + 1:lo + m]) AS t FROM starts),
    counted AS (SELECT rid, iid, m, size, lo, t, count(*) AS n FROM windows GROUP BY ALL),
    shared AS (SELECT c.rid, c.iid, c.m, c.size, c.lo, sum(least(c.n, b.n)) AS k FROM counted c JOIN bag b USING (iid, t) GROUP BY ALL),
    best AS (SELECT *, CAST(k AS DOUBLE) / CAST(m + size - k AS DOUBLE) AS similarity FROM shared
             QUALIFY row_number() OVER (PARTITION BY rid, iid ORDER BY similarity DESC, lo) = 1)
    SELECT d.doc_id, i.item_id, similarity, lo AS start_word FROM best JOIN docs d USING (rid) JOIN items i USING (iid) WHERE similarity >= 0.8"""


def _centroid_clustering(rounds: int = 3) -> str:
    """Plain Lloyd rounds: every vector against every centroid, in whole numbers."""
    near = """SELECT rid, any_value(vec_id) AS vec_id, any_value(v) AS v, min({{'d': d, 'c': c}}) AS m FROM (
                SELECT k.rid, k.vec_id, k.v, z.c, list_sum([(k.v[i] - z.v[i]) * (k.v[i] - z.v[i]) FOR i IN range(1, 65)])::BIGINT AS d
                FROM kept k, c{r} z) GROUP BY rid"""
    steps = []
    for r in range(rounds):
        steps.append(f"""a{r} AS ({near.format(r=r)}),
        s{r} AS (SELECT c, i, sum(x) AS t, count(*) AS n
                 FROM (SELECT m.c AS c, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{r}) GROUP BY c, i),
        m{r} AS (SELECT c, list(((t - ((t % n) + n) % n) // n)::BIGINT ORDER BY i) AS v FROM s{r} GROUP BY c),
        c{r + 1} AS (SELECT o.c, coalesce(w.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} w USING (c))""")
    return f"""WITH kept AS (
            SELECT row_number() OVER () AS rid, vec_id, [floor(64 * x::DOUBLE)::BIGINT FOR x IN embedding] AS v FROM embeddings
            WHERE len(embedding) = 64 AND len([1 FOR x IN embedding IF x IS NOT NULL AND isfinite(x) AND abs(x) <= 1000000]) = 64),
        c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id), v) - 1 AS c, v FROM kept
               QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id), v) <= 16),
        {", ".join(steps)},
        last AS ({near.format(r=rounds)}),
        per AS (SELECT m.c AS c, sum(m.d)::BIGINT AS own FROM last GROUP BY 1)
        SELECT vec_id, m.c::INT AS cluster, m.d AS distance, own AS cluster_inertia, (SELECT sum(own)::BIGINT FROM per) AS inertia,
               sha256(array_to_string(z.v, ',')) AS centroid_sha256
        FROM last JOIN per ON per.c = last.m.c JOIN c{rounds} z ON z.c = last.m.c"""


CENTROID_CLUSTERING = _centroid_clustering()
