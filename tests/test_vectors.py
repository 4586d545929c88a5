import numpy as np
import pytest

from ledgerlens.operators import vectors
from ledgerlens.operators.vectors import PivotSearch

SCHEMA = "scope string, id long, vec array<double>"


def plain(rows, queries, k):
    unit = {}
    for s, i, v in rows:
        a = np.array([np.nan if x is None else x for x in v], float) if v else np.zeros(0)
        if a.size and np.isfinite(a).all() and a.any():
            unit.setdefault(s, []).append((i, a / np.sqrt(a @ a)))
    out = []
    for s, q, v in queries:
        a = np.array([np.nan if x is None else x for x in v], float) if v else np.zeros(0)
        if a.size and np.isfinite(a).all() and a.any():
            a = a / np.sqrt(a @ a)
            best = sorted((-round(float(u @ a), 6), i) for i, u in unit.get(s, ()) if i != q)[:k]
            out += [(q, i, -x, r) for r, (x, i) in enumerate(best, 1)]
    return sorted(out)


def clustered(n, scopes, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, 8))
    return [(f"s{i % scopes}", i, (centres[rng.integers(12)] + 0.05 * rng.normal(size=8)).tolist()) for i in range(n)]


@pytest.mark.parametrize(("pivots", "block", "scopes"), [(40, 2048, 2), (40, 37, 2), (400, 64, 3), (2, 64, 3), (0, 50, 1)])
def test_search_is_exact(spark, pivots, block, scopes):
    rows = clustered(1500, scopes) + [("s0", 9000 + i, v) for i, v in enumerate([None, [], [0.0] * 8, [1.0, None] + [0.0] * 6, [float("nan")] + [1.0] * 7, [float("inf")] + [1.0] * 7])]
    rows += [("s0", 8000 + i, [1.0] + [0.0] * 7) for i in range(30)] + [("lonely", 7000, [1.0] * 8), ("lonely", 7001, [-1.0] * 8)]
    queries = [(s, i, v) for s, i, v in rows if i % 25 == 0 or i >= 7000] + [("nowhere", 1, [1.0] * 8)]
    index = PivotSearch(spark.createDataFrame(rows, SCHEMA).repartition(3), pivots=pivots, block=block)
    got = index.search(spark.createDataFrame(queries, "scope string, query long, vec array<double>"), 7).collect()
    assert sorted((r["query"], r.id, r.score, r.rank) for r in got) == plain(rows, queries, 7)


def test_shards_are_skipped(spark):
    rows = clustered(4000, 1)
    queries = spark.createDataFrame([(s, i, v) for s, i, v in rows if i % 40 == 0], "scope string, query long, vec array<double>")
    found = PivotSearch(spark.createDataFrame(rows, SCHEMA), pivots=64).skipped(queries, 10).first()
    assert found.pairs == 4000 * 100 and found.skipped > 0.5


def test_nothing(spark):
    none = spark.createDataFrame([], SCHEMA)
    index = PivotSearch(none)
    assert index.search(none.withColumnRenamed("id", "query"), 3).count() == 0


@pytest.mark.parametrize("name", ["m01_cosine", "r05_vector_top20"])
def test_blocks_give_what_pairs_give(spark, tmp_path, monkeypatch, name):
    """Several blocks of a scope, with vectors that have no direction among them; pairs are not compared by expressions."""
    import random

    from ledgerlens import catalog

    rng = random.Random(2)
    rows = [(i, [0.0] * 4 if i in (20, 41) else [rng.gauss(0, 1) for _ in range(4)], i % 3 if i != 60 else None) for i in range(240)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    e = spark.read.parquet(f"{tmp_path}/embeddings.parquet").collect()
    f = lambda x, y: sum(p * q for p, q in zip(x, y, strict=True))
    cos = lambda x, y: round(f(x, y) / (f(x, x) * f(y, y)) ** 0.5, 6) if f(x, x) * f(y, y) else 0.0
    want = [(a.vec_id, b.vec_id, cos(a.embedding, b.embedding)) for a in e for b in e if a.vec_id % 20 == 0 and a.label is not None and a.label == b.label and a.vec_id != b.vec_id]
    if name != "m01_cosine":
        want = [w for q in {w[0] for w in want} for w in sorted((w for w in want if w[0] == q), key=lambda w: (-w[2], w[1]))[:20]]
    monkeypatch.setattr(vectors, "PAIRS", 7)
    got = catalog.queries()[name](spark, str(tmp_path))
    assert {tuple(r)[:2]: tuple(r)[2] for r in got.collect()} == pytest.approx({w[:2]: w[2] for w in want}, abs=2e-6)
    assert got.count() == len(want) and "CoGroupsInArrow" in got._jdf.queryExecution().toString()
