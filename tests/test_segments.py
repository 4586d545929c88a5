import random
from collections import Counter
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerlens.operators import joins
from ledgerlens.operators.segments import SegmentedIndex

SCHEMA = "k long, text string, deleted boolean"


def plain(state):
    out = []
    for k, text in state.items():
        words = (text or "").lower().split()
        out += [(w, k, len(words), n) for w, n in Counter(words).items()]
    return sorted(out)


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_increments_agree_with_a_rebuild(spark, tmp_path):
    rng = random.Random(6)
    text = lambda: rng.choice([None, "", " ".join(rng.choice("a b c d e ff gg é".split()) for _ in range(rng.randrange(1, 12)))])
    state = {k: text() for k in range(40)}
    index = SegmentedIndex(spark, f"file://{tmp_path}/grown", "k")
    assert index.segments() == []
    index.rebuild(spark.createDataFrame([(k, x) for k, x in state.items()], "k long, text string"))
    for step in range(4):
        keys = rng.sample(range(60), 15)
        changes = [(k, text(), rng.choice([True, False, None])) for k in keys]
        for k, x, gone in changes:
            state.pop(k, None)
            if not gone:
                state[k] = x
        index.append(spark.createDataFrame(changes, SCHEMA))
        if step == 2:
            assert len(index.segments()) == 4 and index.merge(least=9) is None
            index.merge()
            assert len(index.segments()) == 1
        assert rows(index.postings()) == plain(state)
    docs = spark.createDataFrame(list(state.items()), "k long, text string")
    fresh = SegmentedIndex(spark, f"file://{tmp_path}/fresh", "k")
    fresh.rebuild(docs)
    assert rows(fresh.postings()) == rows(index.postings()) and rows(fresh.documents()) == rows(index.documents())
    assert index.consistency(docs).first().asDict() == {"authoritative": len(state), "indexed": len(state), "missing": 0, "surplus": 0, "stale": 0, "consistent": True}
    asked = spark.createDataFrame([("a",), ("ff",), ("none",)], "term string")
    assert rows(index.postings(asked)) == [r for r in plain(state) if r[0] in ("a", "ff")]
    kept = sorted(state)
    wrong = docs.where(F.col("k") != kept[0]).withColumn("text", F.when(F.col("k") == kept[1], F.lit("other")).otherwise(F.col("text"))).unionByName(spark.createDataFrame([(999, "new")], "k long, text string"))
    found = index.consistency(wrong).first()
    assert (found.missing, found.surplus, found.stale, found.consistent) == (1, 1, 1, False)


def test_a_lost_run_leaves_the_index_as_it_was(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/x", "k")
    index.rebuild(spark.createDataFrame([(1, "a b")], "k long, text string"))
    bad = spark.createDataFrame([(1, "c", False)], SCHEMA).withColumn("text", F.raise_error(F.lit("lost")).cast("string"))
    try:
        index.append(bad)
        raise AssertionError("the run was to be lost")
    except Exception as e:  # noqa: BLE001
        assert "lost" in str(e)
    assert rows(index.postings()) == [("a", 1, 2, 1), ("b", 1, 2, 1)]
    index.append(spark.createDataFrame([(1, "c", False)], SCHEMA))
    assert rows(index.postings()) == [("c", 1, 1, 1)]
    index.append(spark.createDataFrame([(7, None, True)], SCHEMA))
    assert rows(index.postings()) == [("c", 1, 1, 1)] and index.documents().count() == 1


def test_as_of_matches_all_pairs(spark):
    rng = random.Random(8)
    start = datetime(2024, 1, 1)
    at = lambda: start + timedelta(microseconds=rng.choice([0, 1, 10**6, rng.randrange(10**13)]))

    def span():
        a = at()
        return a, rng.choice([None, a, a - timedelta(days=1), a + timedelta(microseconds=rng.choice([1, 10**6, 2 * 10**6, rng.randrange(10**12)]))])

    versions = [(rng.choice([1, 1, 1, 2, None]), i, *span(), *span()) for i in range(300)] + [(1, 900, None, None, start, None), (1, 901, start, None, None, None)]
    probes = [(rng.choice([1, 1, 2, 3, None]), i, rng.choice([at(), versions[i][2] or at()]), rng.choice([at(), versions[i][5] or at(), None])) for i in range(200)]
    v = spark.createDataFrame(versions, "k long, version long, valid_from timestamp, valid_until timestamp, known_from timestamp, known_until timestamp")
    p = spark.createDataFrame(probes, "k long, probe long, valid_at timestamp, known_at timestamp")
    inside = lambda a, b, x: a is not None and x is not None and a <= x and (b is None or x < b)
    want = sorted((q[1], w[1]) for q in probes for w in versions if q[0] is not None and q[0] == w[0] and inside(w[2], w[3], q[2]) and inside(w[4], w[5], q[3]))
    out = joins.as_of(p, v, "k").select("probe", "version")
    assert rows(out) == want and len(want) > 500
    assert "Cartesian" not in out._jdf.queryExecution().executedPlan().toString()
    assert joins.as_of(p, v.limit(0), "k").count() == 0


def test_as_of_sends_no_side_through_the_driver(spark, tmp_path):
    """Both sides are many times their small files, so neither is broadcast."""
    v = spark.createDataFrame([(1, 1, datetime(2024, 1, 1), None, datetime(2024, 1, 1), None)], "k int, version int, valid_from timestamp, valid_until timestamp, known_from timestamp, known_until timestamp")
    p = spark.createDataFrame([(1, 1, datetime(2024, 1, 2), datetime(2024, 1, 2))], "k int, probe int, valid_at timestamp, known_at timestamp")
    v.write.parquet(f"{tmp_path}/v")
    p.write.parquet(f"{tmp_path}/p")
    p, v = (spark.read.parquet(f"{tmp_path}/{name}") for name in "pv")
    assert "BroadcastHashJoin" not in joins.as_of(p, v, "k")._jdf.queryExecution().executedPlan().toString()


def test_postings_are_written_as_zstd(spark, tmp_path):
    index = SegmentedIndex(spark, f"file://{tmp_path}/index", "k")
    index.rebuild(spark.createDataFrame([(1, "a b"), (2, "b")], "k long, text string"))
    files = [p.name for p in tmp_path.rglob("postings/**/*.parquet")]
    assert files and all(".zstd." in f for f in files)
