import random
import re
import time

import pytest

from ledgerlens import catalog
from ledgerlens.functions import unicode_text as U
from ledgerlens.operators import lexicons as L
from tests.oracle import DATA


def plain(raw, phrases):
    """All hits by trying every phrase at every token."""
    raw = raw or ""
    text, pieces = U.mapped(raw)
    own, out = U.prose_tokens(raw), []
    for phrase in phrases:
        words = L.phrase_tokens(phrase)
        for i in range(len(own) - len(words) + 1):
            run = own[i : i + len(words)]
            if words and [w for w, _, _ in run] == words and all(re.fullmatch(r"[ \t\n_\-'’]*", text[a[2] : b[1]]) for a, b in zip(run, run[1:], strict=False)):
                out.append((phrase, *U.raw_span(pieces, run[0][1], run[-1][2])))
    return out


def kept(hits):
    out, end = [], 0
    for phrase, a, b in sorted(hits, key=lambda h: (h[1], -h[2], h[0])):
        if a >= end:
            out.append((phrase, a, b))
            end = b
    return out


def test_automaton_finds_what_ends_inside_longer_phrases():
    words = [["a"], ["a", "b"], ["b"], ["b", "c"], ["a", "b", "c", "d"], ["c", "c"]]
    automaton = L.TokenAutomaton(enumerate(words))
    rng = random.Random(1)
    for _ in range(500):
        own = [rng.choice("abcdx") for _ in range(rng.randrange(0, 15))]
        joined = [i > 0 and rng.random() < 0.85 for i in range(len(own))]
        want = {(k, i, i + len(w) - 1) for k, w in enumerate(words) for i in range(len(own)) if own[i : i + len(w)] == w and all(joined[i + 1 : i + len(w)])}
        got = list(automaton.hits(own, joined))
        assert set(got) == want and len(got) == len(want)


@pytest.fixture(scope="module")
def case(spark):
    rng = random.Random(3)
    bits = ["do", "not", "Don't", "never", "if", "this", "كتاب", "می‌روم", ",", ".", "-", "\n", "\n```\nnot code\n```\n", "é", "é", "x" * 30, "that", "is", "do not do"]
    texts = [(i, " ".join(rng.choice(bits) for _ in range(rng.randrange(0, 40))), "clash") for i in range(80)] + [(900, None, ""), (901, "", ""), (None, "do not", ""), (902, "not " * 4000, "")]
    phrases = {"one": ["do not", "not", "never", "do not do", "not do not", "Do  NOT"], "two": ["if this", "this", "é", "کتاب", "", None, "...", "می روم"], "three": ["don t", "do"]}
    rows = [(name, p) for name, ps in phrases.items() for p in ps] + [("one", "not")]
    return texts, phrases, spark.createDataFrame(texts, "k long, text string, start string").repartition(4), spark.createDataFrame(rows, "lexicon string, phrase string")


@pytest.mark.parametrize("most", [L.MOST_TOKENS, 0])
def test_both_ways_find_all_hits(case, most):
    texts, phrases, df, lexicons = case
    want = sorted(repr((k, name, *h)) for k, raw, _ in texts for name, ps in phrases.items() for h in plain(raw, [p for p in ps if p]))
    found = L.all_hits(df, "k", "text", lexicons, most=most)
    assert sorted(repr(tuple(r)) for r in found.collect()) == want
    best = sorted(repr((k, name, *h)) for k, raw, _ in texts for name, ps in phrases.items() for h in kept(plain(raw, [p for p in ps if p])))
    assert sorted(repr(tuple(r)) for r in L.resolved(found, "k").collect()) == best


def test_nothing(spark, case):
    _, _, df, lexicons = case
    assert L.find(df.limit(0), "k", "text", lexicons).count() == 0
    assert L.find(df, "k", "text", lexicons.limit(0)).count() == 0
    assert L.find(df, "k", "text", lexicons.where("phrase = ''")).count() == 0


def test_queries_match_brute_force(spark):
    q = catalog.queries()
    fixed = {"negation": U.NEGATIONS + U.CONTRACTIONS, "supposition": U.SUPPOSITIONS, "deictic": U.DEICTICS}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    few = dict(list(sorted(docs.items()))[:60])
    got = q["f12_lexicon_hits"](spark, DATA).collect()
    items = {r.text for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()}
    held = {k for k, x in docs.items() if any(i in x for i in items)}
    assert held and {r.doc_id for r in got if r.lexicon == "benchmark"} >= held
    mine = {(r.doc_id, r.lexicon): (r.hits, r.start, r.end) for r in got if r.doc_id in few and r.lexicon != "benchmark"}
    want = {(k, name): kept(plain(raw, ps)) for k, raw in few.items() for name, ps in fixed.items()}
    assert mine == {k: (len(h), *h[0][1:]) for k, h in want.items() if h}
    assert all(r.evidence == docs[r.doc_id][r.start : r.end] for r in got)
    over = {(r.doc_id, r.lexicon): (r.hits, r.kept) for r in q["k07_overlaps"](spark, DATA).collect() if r.doc_id in few and r.lexicon != "benchmark"}
    assert over == {(k, n): (len(plain(few[k], fixed[n])), len(h)) for (k, n), h in want.items() if h}
    messages = {(r.conv_id, r.turn): r.text for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    found = sorted((r.conv_id, r.turn, r.start, r.end) for r in q["f09_all_phrases"](spark, DATA).collect())
    assert found == sorted((*k, a, b) for k, raw in messages.items() for _, a, b in kept(plain(raw, fixed["negation"])))


def test_latin_texts_are_laid_out_as_others_are(monkeypatch):
    """Latin texts without fences take a short way; both ways give the same."""
    rng = random.Random(4)
    some = [*map(chr, range(0x20, 0x250)), *" \n\t\xa0_-' ,." * 12, *"abcÉß" * 20]
    texts = ["".join(rng.choice(some) for _ in range(rng.randrange(0, 40))) for _ in range(1500)] + ["", " ", "a", " a ", "a\n```\nb\n```\n"]
    made = lambda: [(U.parts(x), U.mapped(x), U.prose_tokens(x), L.laid_out(x)) for x in texts]
    short = made()
    assert sum(map(U.latin, texts)) > 500
    monkeypatch.setattr(U, "latin", lambda raw: False)
    assert short == made()


@pytest.mark.parametrize("word", ["word ", "wоrd "])
def test_time_of_a_text_grows_with_its_length(word):
    """Spans of a text's tokens are looked up in one list of its pieces (the second word has a Cyrillic letter)."""
    def seconds(n):
        t = time.process_time()
        L.laid_out(word * n)
        return time.process_time() - t

    seconds(100)
    assert seconds(40_000) < 40 * max(seconds(4_000), 0.005)
