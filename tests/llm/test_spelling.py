import random
import re
import zlib
from collections import Counter

import pytest

from ledgerlens.llm import spelling
from tests.oracle import DATA

UP = str.maketrans(spelling.UPPER, spelling.LOWER)


def plain_words(docs):
    n = Counter()
    for doc_id, text in docs:
        for run in re.findall(spelling.RUN, (text or "").translate(UP)):
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 6 and k >= 5}


def edits(w, letters):
    """All strings at one edit of w, from the definition."""
    return {w[:i] + x + w[i + 1 :] for i in range(len(w)) for x in letters} | {w[:i] + x + w[i:] for i in range(len(w) + 1) for x in letters} | {w[:i] + w[i + 1 :] for i in range(len(w))}


def plain_variants(n, ratio=5):
    letters, form, near = {x for w in n for x in w}, {}, {}
    for w in n:
        close = (edits(w, letters) & n.keys()) - {w}
        near[w] = len(close)
        best = min(close, key=lambda x: (-n[x], x), default=None)
        if best and n[best] >= ratio * n[w]:
            form[w] = best
    out = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], near[w], n[form[w]] if w in form else None))
    return sorted(out, key=repr)


@pytest.mark.parametrize(("letters", "least", "most", "block"), [("ab", 1, 9, 5), ("aé", 6, 11, 3), ("abc", 3, 8, 40), ("abcd", 6, 7, 2000)])
def test_variants_match_brute_force(spark, letters, least, most, block):
    rng = random.Random(block)
    vocabulary = {"".join(rng.choice(letters) for _ in range(rng.randint(least, most))): rng.choice([5, 5, 25, 26, 130, 700]) for _ in range(500)}
    got = spelling.variants(spark.createDataFrame(list(vocabulary.items()), "word string, n long").repartition(3), block=block)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_variants(vocabulary)


def test_long_words_and_common_beginnings(spark):
    """A beginning shared by all, words of 3,000 letters, and more than FEW of them in a block."""
    long = ["q" * 3000 + f"{i:05b}".replace("0", "a").replace("1", "b") for i in range(32)]
    vocabulary = dict.fromkeys([*long, long[0] + "z", "z" + long[0], "common" + "x" * 6], 5) | {f"common{a}{b}{c}": 5 for a in "abcde" for b in "abcde" for c in "abcde"}
    vocabulary["commonaaa"] = 1000
    got = spelling.variants(spark.createDataFrame(list(vocabulary.items()), "word string, n long"), block=20)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_variants(vocabulary)


def test_each_pair_belongs_to_one_block():
    words = sorted({a + b + c + d for a in "xy" for b in "xy" for c in ["x", "y", ""] for d in ["", "x", "yx"]})
    for a in words:
        for b in words:
            if len(a) <= len(b) <= len(a) + 1 and a != b and spelling.first_difference(a, b) >= 0:
                p, size = spelling.first_difference(a, b), len(a)
                assert b in edits(a, "xy")
                assert sum(lo <= p and (p < hi or hi == size) for lo, hi in [(0, size // 2), (size // 2, size)]) == 1


def test_words_of_documents(spark):
    rng = random.Random(2)
    bits = ["Straße", "strasse", "STRASSE", "Éclair", "éclair", "a", "don't", "naïve×÷", "number1word", "x" * 40000]
    rows = [(rng.choice([None, *range(60)]), " ".join(rng.choice(bits[:-1]) for _ in range(120)), 1, 2) for _ in range(80)]
    rows += [(7, None, 1, 1), (8, "", 1, 1), (9, " ".join(bits), 1, 1), (9, " ".join(bits), 1, 1), (10, (bits[-1] + " ") * 5, 0, 0)]
    got = spelling.words(spark.createDataFrame(rows, "doc_id long, text string, word long, n long"))
    assert {r.word: r.n for r in got.collect()} == plain_words([r[:2] for r in rows])
    assert any(len(w) == 40000 for w in plain_words([r[:2] for r in rows]))


def test_nothing(spark):
    none = spelling.words(spark.createDataFrame([], "doc_id long, text string"))
    assert spelling.variants(none).count() == 0
    one = spark.createDataFrame([("single", 5)], "word string, n long")
    assert [tuple(r) for r in spelling.variants(one).collect()] == [("single", None, "single", 5, 0, None)]


def test_query_matches_brute_force(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()]
    got = spelling.op12_half_dictionaries(spark, DATA).collect()
    assert sorted(map(tuple, got), key=repr) == plain_variants(plain_words(docs))
    assert any(r.form for r in got)
