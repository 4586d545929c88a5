import random

from ledgerlens.llm.toxicity import SWAPS, counterfactual, score, train


def corpus(seed, n):
    rng = random.Random(seed)
    bland = [f"word{i}" for i in range(200)]
    rude = ["vile", "rotten", "filthy"]
    rows = []
    for i in range(n):
        toxic = rng.random() < 0.3
        w = [rng.choice(bland) for _ in range(rng.randrange(5, 60))]
        # group names come mostly with insults in the labels: the bias that the penalty is against
        if rng.random() < (0.7 if toxic else 0.05):
            w.append("muslims")
        if toxic:
            w.insert(rng.randrange(len(w)), rng.choice(rude))
        rows.append((i, " ".join(w), int(toxic)))
    return rows


def test_learns_and_ignores_neutral_mentions(spark):
    rows = corpus(1, 800)
    docs = spark.createDataFrame([(i, t, 0.5) for i, t, _ in rows], "doc_id long, text string, score double").repartition(4)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4] + [(1, None), (9999, 1)], "doc_id long, toxic int")
    fair, plain = train(docs, labels), train(docs, labels, weight=0.0)
    got = {r.doc_id: r.score for r in score(docs, fair).collect()}
    held = [(got[i] >= 0.3) == bool(y) for i, _, y in rows if i % 4 == 0]
    assert sum(held) / len(held) > 0.97
    neutral, other = "word1 word2 muslims word3", "word1 word2 christians word3"
    gap = lambda m: abs(m.score(neutral) - m.score(other))
    assert gap(fair) < 0.3 * gap(plain) or gap(plain) < 0.01
    assert fair.score("word5 VILE word6") > 0.5 > fair.score(neutral)


def test_edges(spark):
    docs = spark.createDataFrame([(1, None), (2, ""), (None, "x"), (3, "y " * 50000), (3, "y")], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = train(docs, none)
    assert [round(r.score, 3) for r in score(docs, model).collect()] == [0.5] * 5
    assert score(docs.limit(0), model).count() == 0


def test_swaps_stay_in_kind_and_change_the_word():
    assert all(a != b for a, b in SWAPS.items())
    assert counterfactual({"women", "x"}) == {"men", "x"}
    assert counterfactual({"x"}) is None


def test_query_on_its_table(spark):
    """Folds and columns as promised; ties and repeated texts score alike; held-out rows are told apart."""
    import zlib

    from ledgerlens.llm.toxicity import op1_counterfactual_toxicity

    folder = "/root/testdata/sf0.1"
    got = op1_counterfactual_toxicity(spark, folder)
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = {r.doc_id: r for r in got.collect()}
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    assert rows.keys() == texts.keys()
    by_text = {}
    for d, r in rows.items():
        assert r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3)
        by_text.setdefault(texts[d], set()).add(r.score)
    assert all(len(s) == 1 for s in by_text.values())
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    held = [(rows[d].score, y) for d, y in labels.items() if d in rows and rows[d].held_out and y is not None]
    pairs = [(a > b) + 0.5 * (a == b) for a, x in held if x for b, y in held if not y]
    assert sum(pairs) / len(pairs) > 0.95
