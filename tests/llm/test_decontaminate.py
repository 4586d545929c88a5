import random

import numpy as np

from ledgerlens.llm.decontaminate import RECALL, Index, edit_match, leaking, leaks, words


def least_edits(p, t):
    row = [0] * (len(t) + 1)
    for i, a in enumerate(p, 1):
        new = [i]
        for j, b in enumerate(t, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (a != b)))
        row = new
    return min(row)


def test_bit_parallel_distance():
    rng = random.Random(1)
    for _ in range(300):
        p = [rng.randrange(6) for _ in range(rng.randrange(1, 90))]
        t = [rng.randrange(6) for _ in range(rng.randrange(0, 60))]
        assert edit_match(np.array(p, np.uint64), np.array(t, np.uint64))[0] == least_edits(p, t)


def test_finds_edited_passages_and_nothing_else(spark):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.choice([2, 3, 6]))) for _ in range(900)]
    items = {i: [rng.choice(vocab) for _ in range(rng.choice([2, 8, 20, 36, 60]))] for i in range(40)}
    docs, want = {}, set()
    for d in range(160):
        w = [rng.choice(vocab) for _ in range(rng.choice([0, 30, 200, 900]))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            i = rng.randrange(40)
            p = list(items[i])
            for _ in range(rng.choice([0, 0, len(p) // 8, len(p) // 5])):
                at = rng.randrange(len(p))
                what = rng.random()
                if what < 0.5:
                    p[at] = rng.choice(vocab)
                elif what < 0.75 and len(p) > 2:
                    del p[at]
                else:
                    p.insert(at, rng.choice(vocab))
            at = rng.randrange(len(w) + 1)
            w[at:at] = p
        docs[d] = w
    for d, w in docs.items():
        for i, p in items.items():
            if least_edits(p, w) <= len(p) // 4:
                want.add((d, i))
    text = spark.createDataFrame([(d, ", ".join(w).upper() if d % 2 else " ".join(w), d) for d, w in docs.items()], "doc_id long, text string, item_id int").repartition(4)
    bench = spark.createDataFrame([(i, " ".join(p)) for i, p in items.items()] + [(90, None), (91, ""), (92, "one")], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in leaks(text, bench).collect()}
    assert set(got) <= want
    assert len(got) >= 0.98 * len(want)
    for (d, i), r in got.items():
        assert r.edits == least_edits(items[i], docs[d])
        assert least_edits(items[i], docs[d][r.first_word : r.first_word + 2 * r.item_words]) == r.edits
    assert {(r.doc_id, r.item_id) for r in leaks(text, bench, block=9).collect()} == set(got)


def test_edge_cases(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")
    rows = [(1, None), (2, ""), (None, "x alpha beta gamma delta epsilon zeta y"), (3, "alpha beta gamma delta epsilon zeta"), (3, "alpha beta gamma delta epsilon zeta")]
    got = leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id or 0, r.edits) for r in got) == [(0, 0), (3, 0)]
    none = spark.createDataFrame([], "doc_id long, text string")
    assert leaks(none, bench).count() == 0
    assert leaks(spark.createDataFrame(rows, "doc_id long, text string"), bench.limit(0)).count() == 0


def edited(rng, p, edits):
    p = list(p)
    for _ in range(edits):
        at, what = rng.randrange(len(p)), rng.random()
        if what < 0.4:
            p[at] = f"n{rng.getrandbits(40)}"
        elif what < 0.7:
            del p[at]
        else:
            p.insert(at, f"n{rng.getrandbits(40)}")
    return p


def test_long_items_reach_the_target_at_the_edit_limit():
    rng = random.Random(3)
    vocab = [f"v{i}" for i in range(4000)]
    for size, tries in ((16, 300), (64, 100), (200, 40)):
        items = [[rng.choice(vocab) for _ in range(size)] for _ in range(10)]
        index = Index(list(enumerate(" ".join(p) for p in items)))
        docs = [[rng.choice(vocab) for _ in range(50)] + edited(rng, items[d % 10], size // 4) + [rng.choice(vocab) for _ in range(50)] for d in range(tries)]
        true = {d for d, w in enumerate(docs) if edit_match(words(" ".join(items[d % 10])), words(" ".join(w)))[0] <= size // 4}
        got = {d for d, i, *_ in index.leaks([words(" ".join(w)) for w in docs]) if i == d % 10}
        assert len(got & true) >= (RECALL - 0.02) * len(true), (size, len(got & true), len(true))


def test_sizes_beyond_the_walks_are_compared_exactly(monkeypatch):
    from ledgerlens.llm import decontaminate

    monkeypatch.setattr(decontaminate, "MOST", 3)
    rng = random.Random(5)
    item = [f"v{i}" for i in range(60)]
    index = Index([(7, " ".join(item)), (8, " ".join(reversed(item)))])
    assert not len(index.groups[0][5])
    assert [(d, i) for d, i, *_ in index.leaks([words(" ".join(edited(rng, item, 12)))])] == [(0, 7)]


def test_rows_keep_their_columns_and_very_long_texts(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta"
    rows = [(1, "x " * 400_000 + item, "a", 5), (1, "clean words only", "b", 6), (None, item, "c", 7), (None, "nothing", None, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, whole string, found int")
    bench = spark.createDataFrame([(1, item), (2, item)], "item_id long, text string")
    got = leaking(docs, bench, block=1)
    assert got.columns == ["doc_id", "text", "whole", "found", "leaks"]
    assert sorted((r.found, sorted(x.item_id for x in r.leaks)) for r in got.collect()) == [(5, [1, 2]), (6, []), (7, [1, 2]), (8, [])]
