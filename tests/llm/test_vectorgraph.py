import tracemalloc

import numpy as np

from ledgerlens.llm.vectorgraph import audit, link_vectors, range_search, robust_prune, spread


def brute(rows):
    n, comp = {}, {i: i for i, _, _ in rows}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    good = []
    for i, label, e in rows:
        v = np.array(e if e is not None else [], float)
        n[i] = 0
        if label is not None and len(v) and None not in (e or []) and np.isfinite(v).all() and (v @ v) > 0:
            good.append((i, label, v / np.sqrt(v @ v)))
    for a, la, va in good:
        for b, lb, vb in good:
            if a != b and la == lb and len(va) == len(vb) and va @ vb >= 0.93:
                n[a] += 1
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: (n[i], root(i)) for i in n}


def rows_of(seed, count):
    rng = np.random.default_rng(seed)
    rows, i = [], 0
    while i < count:
        base = rng.normal(size=16)
        for _ in range(rng.choice([1, 1, 2, 6, 60])):
            e = base + rng.normal(size=16) * rng.choice([0, 0.1, 0.28])
            rows.append((i, int(rng.choice([1, 1, 1, 2])), [float(np.float32(x)) for x in e]))
            i += 1
    rows += [(i + 1, None, rows[0][2]), (i + 2, 1, None), (i + 3, 1, [0.0] * 16), (i + 4, 1, [float("nan")] * 16), (i + 5, 1, [1.0, None] * 8), (i + 6, 1, []), (i + 7, 1, [1.0] * 8), (i + 8, 1, [2.0] * 8)]
    return rows


def test_recall_and_counts(spark):
    rows = rows_of(1, 900)
    df = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, label int, embedding array<float>, n_links int")
    links = link_vectors(df, block=120, sample=400)
    got = {r.vec_id: (r.n_links, r.component_id) for r in links.collect()}
    want = brute(rows)
    assert set(got) == set(want)
    assert all(got[i][0] <= want[i][0] for i in want)
    assert sum(n for n, _ in got.values()) >= 0.97 * sum(n for n, _ in want.values())
    assert np.mean([got[i][1] == want[i][1] for i in want]) > 0.98
    assert audit(df, links, queries=60) > 0.95


def test_one_block_is_exact_here_and_edges(spark):
    rows = rows_of(2, 150)
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>")
    assert {r.vec_id: (r.n_links, r.component_id) for r in link_vectors(df).collect()} == brute(rows)
    assert link_vectors(df.limit(0)).count() == 0
    same = spark.createDataFrame([(5, 1, [1.0, 2.0])] * 2 + [(None, 1, [1.0, 2.0])], "vec_id long, label int, embedding array<float>")
    assert sorted((r.vec_id or 0, r.n_links) for r in link_vectors(same).collect()) == [(0, 0), (5, 1), (5, 1)]


def test_pruning_keeps_the_nearest():
    v = np.random.default_rng(0).normal(size=(50, 8))
    v /= np.linalg.norm(v, axis=1)[:, None]
    sims = v @ v.T
    np.fill_diagonal(sims, -2)
    assert (robust_prune(v @ v.T, 5, 20)[:, 0] == sims.argmax(axis=1)).all()


def test_large_group_of_near_copies_keeps_its_links(spark):
    rng = np.random.default_rng(7)
    base = rng.normal(size=64)
    group = base + rng.normal(size=(600, 64)) * 0.21
    far = rng.normal(size=(1200, 64))
    rows = [(i, 1, [float(x) for x in e]) for i, e in enumerate(np.concatenate([group, far]))]
    df = spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>")
    links = link_vectors(df, block=60, sample=1800)
    v = np.concatenate([group, far])
    v /= np.linalg.norm(v, axis=1)[:, None]
    want = (v @ v.T >= 0.93).sum(axis=1) - 1
    assert want[:600].mean() > 300
    assert [r.n_links for r in links.orderBy("vec_id").collect()] == want.tolist()
    assert audit(df, links, queries=100) == 1.0


def test_search_gathers_few_vectors_at_once():
    """Results do not depend on how many pairs are gathered at once, and many queries do not take a copy of their vectors for each pair."""
    rng = np.random.default_rng(3)
    v = rng.normal(size=(500, 64))
    v[:40] = v[0] + rng.normal(size=(40, 64)) * 0.2
    v /= np.linalg.norm(v, axis=1)[:, None]
    asked = np.concatenate([v, v + rng.normal(size=v.shape) * 0.02, rng.normal(size=(3000, 64))])
    asked /= np.linalg.norm(asked, axis=1)[:, None]
    edges = [np.unique(r[r >= 0]) for r in robust_prune(v @ v.T)]
    tracemalloc.start()
    q, x, c = range_search(asked, v, edges, 0.93)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 100e6  # 140 MB when 200,000 pairs were gathered at once, 65 MB now
    true = asked @ v.T
    assert (true[q, x] >= 0.93 - 1e-12).all() and np.allclose(true[q, x], c) and len(set(zip(q, x, strict=True))) == len(q) >= 0.99 * (true >= 0.93).sum()
    few = range_search(asked[:70], v, edges, 0.93)  # steps of few pairs
    assert sorted(zip(*few[:2], strict=True)) == sorted((a, b) for a, b in zip(q, x, strict=True) if a < 70)


def test_spread_is_the_number_of_directions():
    """Vectors that point anywhere spread over all dimensions (28 of 64 when centroids were taken for means); those of a plane over two."""
    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1)[:, None]
    v = unit(rng.normal(size=(3000, 64)))
    assert spread(v, unit(rng.normal(size=(8, 64)) + v[:8])) > 50
    flat = np.zeros((500, 64))
    flat[:, :2] = rng.normal(size=(500, 2))
    assert spread(unit(flat), unit(flat[:20])) < 2.5
