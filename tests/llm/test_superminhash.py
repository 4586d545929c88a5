import random

import numpy as np

from ledgerlens.llm.components import components
from ledgerlens.llm.superminhash import near_duplicates, signatures
from ledgerlens.llm.superminhash import op6_superminhash as superminhash_query


def brute(rows):
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    comp = {i: i for i in sets}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def corpus():
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    rows, i = [], 0
    for group in range(30):
        base = [word() for _ in range(rng.choice([3, 6, 40, 150, 400]))]
        for _ in range(rng.choice([1, 1, 2, 5, 20])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 3, 5])):
                w[rng.randrange(len(w))] = word()
            rows.append((i, " ".join(w)))
            i += 1
    rng.shuffle(rows)
    rows += [(i + 1, None), (i + 2, ""), (i + 3, " \n\t "), (i + 4, "One two"), (i + 5, "one  TWO"), (i + 6, "x " * 60000)]
    return rows


def test_matches_brute_force(spark):
    rows = corpus()
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_empty_table_null_ids_repeats_and_clashing_columns(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(None, "a b c d e f", 1), (4, "a b c d e f", 1), (4, "a b c d e f", 1), (2, "a b c d e f", 1), (None, "no one else says this", 1), (None, None, 1)]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int")).collect()
    assert sorted((r.doc_id or -1, r.component_id or -1) for r in got) == [(-1, -1), (-1, -1), (-1, 2), (2, 2), (4, 2), (4, 2)]
    assert sorted((r.doc_id or -1) for r in got if r.first) == [-1, -1, 2]


def test_ids_that_repeat_with_other_texts(spark):
    rng = random.Random(8)
    say = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(60))
    a, b, more = say(), say(), []
    for i in range(40):
        t = say()
        more += [(100 + i % 7, t), (200 + i % 11, t + " tail")]
    rows = [(1, a), (2, a + " zz"), (3, b), (3, a + " yy"), (4, b + " q"), *more]
    rng.shuffle(rows)
    got = near_duplicates(spark.createDataFrame([(*r, n) for n, r in enumerate(rows)], "doc_id long, text string, n long").repartition(3), key="n").collect()
    want = brute([(n, t) for n, (_, t) in enumerate(rows)])
    groups = {}
    for n, (_, root, _) in want.items():
        groups.setdefault(root, []).append(n)
    assert len(got) == len(rows)
    for r in got:
        members = groups[want[r.n][1]]
        head = min(members, key=lambda n: (rows[n][0], n))
        assert r.doc_id == rows[r.n][0] and r.component_id == rows[head][0] and r.first == (r.n == head)
    assert {r.component_id for r in got if r.doc_id == 3} == {1, 3}


def test_large_buckets_meet_in_pieces(spark, monkeypatch):
    from ledgerlens.llm import superminhash

    monkeypatch.setattr(superminhash, "CHUNK", 3)
    monkeypatch.setattr(superminhash, "HUBS", 0)
    rows = corpus()[:150]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows)


def test_query_on_its_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    got = superminhash_query(spark, folder)
    assert dict(got.dtypes) == {"doc_id": "bigint", "n_shingles": "bigint", "component_id": "bigint", "kept": "boolean"}
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got.collect()} == brute(rows)


def test_signature_estimates_jaccard():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 1500, dtype=np.int64).astype(np.uint64)
    for share in (0.5, 0.75, 0.95):
        both = int(1000 * share)
        a, b = x[:1000], x[1000 - both : 2000 - both]
        sig = signatures(np.concatenate([a, b]), np.repeat([0, 1], [len(a), len(b)]), 2, 400)
        true = both / (2000 - both)
        assert abs((sig[0] == sig[1]).mean() - true) < 0.09


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(300)] + [(1000, 1001), (7, 7)], "a long, b long").repartition(7)
    for few in (0, 10_000):
        got = {r.node: r.component for r in components(edges, few=few).collect()}
        assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000}
    assert components(edges.limit(0), few=0).count() == 0 and components(edges.limit(0)).count() == 0
