import random

import numpy as np

from ledgerlens.llm.resample import TOKENS, best_cut, grams, kth_largest, op3_gumbel_resampling, resample


def test_kth_largest(spark):
    rng = np.random.default_rng(1)
    x = [*rng.normal(size=3000).tolist(), *[0.5] * 500, 1e9, -1e9]
    df = spark.createDataFrame([(v,) for v in x], "v double")
    order = sorted(x, reverse=True)
    for k in (1, 2, 700, 1200, 3400, 3502):
        assert kth_largest(df, "v", k, fits=50) == (order[k - 1] if k < len(x) else -np.inf)


def test_rejects_junk_and_keeps_clean(spark):
    rng = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    rows, labels = [], []
    for i in range(700):
        bad = i % 7 == 0
        w = [rng.choice(vocab) for _ in range(rng.choice([5, 30, 300]))]
        rows.append((i, " ".join(x + ("%%%" if bad else "") for x in w), None, True))
        if i % 2:
            labels.append((i, int(not bad)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept boolean").repartition(4)
    got = {r.doc_id: r.kept for r in resample(docs, spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    assert len(got) == 700
    assert np.mean([got[i] for i in got if i % 7]) > 0.99
    assert np.mean([not got[i] for i in got if i % 7 == 0]) > 0.95


def test_k_and_sampling_follow_the_weights(spark):
    docs = spark.createDataFrame([(i, "a" if i % 2 else "b") for i in range(2000)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1) for i in range(1, 1200, 2)] + [(i, 1) for i in range(0, 400, 2)], "doc_id long, quality int")
    got = resample(docs, labels, k=500, tokens=1.0).collect()
    kept = [r for r in got if r.kept]
    assert len(kept) == 500
    odd = sum(r.doc_id % 2 for r in kept) / 500
    want = np.exp(next(r.log_ratio for r in got if r.doc_id == 1)) / (np.exp(next(r.log_ratio for r in got if r.doc_id == 1)) + np.exp(next(r.log_ratio for r in got if r.doc_id == 0)))
    assert abs(odd - want) < 0.12 and odd > 0.55


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y " * 50000), (3, "y")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert resample(docs, none).count() == 5
    assert resample(docs.limit(0), none).count() == 0
    assert best_cut([(0.1, 1), (0.2, 1)]) == 0.0 and 0.1 < best_cut([(0.1, 0), (0.2, 1)]) < 0.2


def test_query_samples_and_is_no_threshold(spark):
    """The query's own parameters: weights by plain counting, k as estimated, and a kept set that is not the k largest weights."""
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in op3_gumbel_resampling(spark, folder).collect()}
    docs = pq.read_table(f"{folder}/documents.parquet").to_pydict()
    labels = pq.read_table(f"{folder}/labels.parquet").to_pydict()
    quality = dict(zip(labels["doc_id"], labels["quality"], strict=True))
    own = {d: grams(t) for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
    raw, good = np.ones(1 << 16), np.ones(1 << 16)
    for d, g in own.items():
        np.add.at(raw, g, 1)
        if quality.get(d) == 1:
            np.add.at(good, g, 1)
    ratio = np.log(good / good.sum()) - np.log(raw / raw.sum())
    weight = {d: float(ratio[g].mean()) if len(g) else 0.0 for d, g in own.items()}
    assert all(abs(got[d].log_ratio - w) < 1e-9 for d, w in weight.items())
    k = sum(w >= best_cut([(weight[d], q) for d, q in quality.items()]) for w in weight.values())
    kept = {d for d in got if got[d].kept}
    assert len(kept) == k
    order = sorted(got, key=lambda d: -got[d].key)
    assert kept == set(order[:k])
    noise = np.array([got[d].key - TOKENS * got[d].log_ratio for d in got])
    assert abs(noise.mean() - 0.5772) < 0.15 and abs(noise.std() - 1.2825) < 0.15
    largest = set(sorted(got, key=lambda d: -weight[d])[:k])
    assert 5 < len(largest - kept) < 100  # the noise decides near the edge, and only there


def test_kept_share_follows_the_weights_at_the_default_tokens(spark):
    from ledgerlens.llm.resample import noise
    from pyspark.sql import functions as F

    rows = [(i, 7 * i, 0.0 if i % 2 else -1 / TOKENS) for i in range(40_000)]
    df = spark.createDataFrame(rows, "doc_id long, text_hash long, log_ratio double").withColumn("key", F.col("log_ratio") * TOKENS + noise())
    cut = kth_largest(df, "key", 400)
    n = {r.odd: r["count"] for r in df.where(F.col("key") >= cut).groupBy((F.col("doc_id") % 2).alias("odd")).count().collect()}
    assert abs(n[1] / 400 - 1 / (1 + np.exp(-1))) < 0.06


def test_ties_repeats_and_carried_columns(spark):
    rows = [(1, "a b c", 1, "x"), (1, "a b c", 1, "x"), (1, "other words", 2, "y"), (2, "a b c", 3, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, label_ int, `odd name` string")
    got = resample(docs, spark.createDataFrame([(2, 1)], "doc_id long, quality int"), k=1, carry=docs.columns).collect()
    assert got[0].__fields__[:4] == ["doc_id", "text", "label_", "odd name"] and len(got) == 4
    same = [r for r in got if r.text == "a b c" and r.doc_id == 1]
    assert same[0].key == same[1].key and same[0].kept == same[1].kept
    assert {r.text for r in got if r.doc_id == 1} == {"a b c", "other words"}
