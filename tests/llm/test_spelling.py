"""Spelling variants against wildcard patterns in plain Python."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from croupier.llm import registry, spelling
from tests.llm.conftest import SMALL


def brute_words(docs):
    total = Counter()
    for doc_id, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            if h % 31 == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1:]
            total[word] += 1
    return total


def brute(docs, shortest=7, least=2):
    n = {w: k for w, k in brute_words(docs).items() if len(w) >= shortest and k >= least}
    same, near = defaultdict(set), defaultdict(set)
    for w in n:
        for i in range(len(w)):
            same[w[:i], w[i + 1:]].add(w)
            shorter = w[:i] + w[i + 1:]
            if shorter in n:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in same.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(out)


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert rows(registry.QUERIES["op12_spelling_variants"](spark, SMALL)) == brute(docs)


def variants(seed):
    """Texts of a few frequent words, rarer variants of them and variants of the variants."""
    r = random.Random(seed)
    letters = "abcdeéÿ÷×"
    stem = ["".join(r.choice(letters) for _ in range(r.randint(6, 10))) for _ in range(12)]
    words = []
    for w in stem:
        words += [w] * r.randint(100, 2500)
        for _ in range(8):
            v, k = w, r.choice([2, 9, 30, 150])
            for _ in range(2):
                i, c = r.randrange(len(v)), r.choice(letters)
                v = r.choice([v[:i] + v[i + 1:], v[:i] + c + v[i + 1:], v[:i] + c + v[i:]])
                words += [v.upper() if r.random() < 0.1 else v] * k
                k = max(2, k // 12)
    words += ["Z" * 70, "z" * 70, "z" * 71, "z" * 71, "z" * 69 + "y", "z" * 69 + "y", "q" * 5000, "q" * 5000, "q" * 5001, "q" * 5001]
    r.shuffle(words)
    return [(i, " ".join(words[i::40])) for i in range(40)]


ODD = [(None, None), (5, None), (6, ""), (7, "  \n "), (None, "abcdeabcde abcdeabcde"), (None, "Abcdeabcde abcdeabcdd, abcdeabcdd"),
       (9, "short 1234567 Ābcdefghij"), (9, "short 1234567 Ābcdefghij"), (10, "ÀBCDEFGÉ ÀBCDEFGÉ àbcdefgé àbcdefgé")]


@pytest.mark.parametrize("cells", [spelling.FILTER_CELLS, 7])
def test_made_variants_and_odd_rows(spark, cells):
    """With 7 cells a round, the filter is probed in several rounds and stretches are split."""
    docs = variants(1) + ODD
    table = spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], "doc_id long, text string, word string, edit string, n long").repartition(4)
    want = brute(docs)
    assert rows(spelling.group(table, filter_cells=cells)) == want
    assert any(r[1] is not None and r[2] != r[1] for r in want)  # a chain of forms


def test_empty_table_and_table_without_words(spark):
    schema = "doc_id long, text string"
    assert spelling.group(spark.createDataFrame([], schema)).collect() == []
    assert spelling.group(spark.createDataFrame([(1, None), (2, "a b c")], schema)).collect() == []


def test_filter_holds_every_word_and_few_others():
    r = random.Random(3)
    words = sorted({"".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(7, 12))) for _ in range(20000)})
    line = spelling.layout(Counter(spelling.shard(len(w)) for w in words))
    cells = np.zeros(sum(size for _, size in line.values()), np.uint64)
    for _, letters in spelling.by_length(words):
        cell, bits = spelling._cells(spelling.hashes(letters), *line[letters.shape[1]])
        np.bitwise_or.at(cells, cell, bits)
    prober = spelling.Prober(cells, 0, line)
    other = ["".join(r.choice("qrstuvwxyz") for _ in range(9)) for _ in range(20000)]
    for listed, low, high in ((words, 1.0, 1.0), (other, 0.0, 0.02)):
        held = [prober.holds(spelling.hashes(x), line[x.shape[1]]).mean() for _, x in spelling.by_length(listed)]
        assert all(low <= h <= high for h in held)


def test_edits_of_a_filter_that_holds_everything_are_all_edits():
    word = "abbcdeé"
    line = {6: (0, 1), 7: (1, 1)}
    prober = spelling.Prober(np.full(2, 2**64 - 1, np.uint64), 0, line)
    letters = [chr(c) for c in spelling.LETTERS]
    want = {word[:i] + word[i + 1:] for i in range(7)} | {word[:i] + c + word[i + 1:] for i in range(7) for c in letters if c > word[i]}
    got = [e for _, e in prober.edits([word])]
    assert set(got) == want and len(got) == len(want)
