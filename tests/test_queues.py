import uuid

import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import ijson
from ledgerlens.operators import blocks, consolidation, coverage, graphs, joins, queues, trees
from ledgerlens.sources import exports
from ledgerlens.streaming import ledger


def test_uuid5_and_faults(spark):
    space = "6ba7b810-9dad-11d1-80b4-00c04fd430c8"
    names = ["", "a", "example.org", "سلام", "x" * 500]
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", ijson.uuid5(space, F.col("n")).alias("u")).collect()
    assert {r.n: r.u for r in got} == {n: str(uuid.uuid5(uuid.UUID(space), n)) for n in names}
    cases = {'{"a":1}': None, '{"a":1,"a":2}': "duplicate_key", "[9007199254740992]": "unsafe_integer", "[1e999]": "non_finite", "[NaN]": "non_finite", "{": "malformed", '{"x_at":"2024-01-01"}': "bad_timestamp", '{"x_until":5}': "bad_timestamp", '["\\ud800"]': "lone_surrogate"}
    assert {t: ijson.fault(t) for t in cases} == cases and ijson.fault(None) == "malformed"


def test_fences_and_retries(spark):
    results = spark.createDataFrame([(1, 2, 5), (1, 1, 5), (1, 2, 11), (2, 0, 1)], "job long, generation long, at long")
    leases = spark.createDataFrame([(1, 2, 10)], "job long, generation long, until long")
    assert sorted(tuple(r) for r in queues.fenced(results, leases, "job").collect()) == [(1, 1, 5, False), (1, 2, 5, True), (1, 2, 11, False), (2, 0, 1, False)]
    rows = spark.createDataFrame([("E", "a timeout", 0), ("E", "429", 3), ("E", "429", 4), ("E", "400", 0), ("E", "secret x", 0)], "k string, m string, n long")
    got = rows.select(queues.failure(F.col("k"), F.col("m")).alias("f"), "n").select("f.class", queues.after_failure(F.col("f.retryable"), F.col("n"), 5).alias("s")).collect()
    assert [(r["class"], r.s.state, r.s.delay) for r in got] == [("retryable_network", "queued", 10), ("retryable_provider_429", "queued", 80), ("retryable_provider_429", "failed", None), ("invalid_request", "failed", None), ("configuration_error", "failed", None)]


def test_deliver_once_survives_replays(spark, tmp_path):
    spark.createDataFrame([(1, "a"), (2, "b"), (2, "b")], "id long, v string").write.parquet(f"{tmp_path}/in")
    stream = lambda: spark.readStream.schema("id long, v string").parquet(f"{tmp_path}/in")
    run = lambda c: sorted(r.id for r in ledger.deliver_once(stream(), "id", f"file://{tmp_path}/sink", f"file://{tmp_path}/{c}").collect())
    assert run("one") == [1, 2] and run("two") == [1, 2]
    spark.createDataFrame([(3, "c"), (1, "a")], "id long, v string").write.mode("append").parquet(f"{tmp_path}/in")
    assert run("one") == [1, 2, 3] and run("three") == [1, 2, 3]


def test_consolidation_streams_over_a_hot_key(spark):
    rows = [(1, i, "ready", "likes", f"t{i // 2}", "affirmed" if i % 7 else "negated") for i in range(3000)] + [(None, 0, "ready", "x", "a", None), (2, 0, "rejected", "x", "a", None), (2, 1, "ready", "forget_request", "a", None)]
    df = spark.createDataFrame(rows, "key long, seq long, status string, predicate string, text string, polarity string").repartition(4)
    got = {(r.key, r.seq): (r.operation, r.version) for r in consolidation.consolidate(df).collect()}
    text, pol, version = None, None, 0
    for _, i, _, _, x, p in rows[:3000]:
        op = "ADD" if version == 0 else "REINFORCE" if x == text else "CONTRADICT" if p != pol else "SUPERSEDE"
        if op in ("ADD", "SUPERSEDE"):
            text, pol, version = x, p, version + 1
        assert got[1, i] == (op, version)
    assert got[None, 0] == ("ADD", 1) and got[2, 0] == ("REJECT", 0) and got[2, 1] == ("MANUAL_REVIEW", 0)


def test_undo_twice_is_a_redo(spark):
    history = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (2, 1, "x")], "key long, version long, text string")
    ops = lambda *o: spark.createDataFrame([(1, i, x, "c") for i, x in enumerate(o)], "key long, seq long, operation string, value string")
    one = lambda *o: next((r.text, r.version, r.status) for r in consolidation.corrected(history, ops(*o)).collect() if r.key == 1)
    assert one("undo") == ("a", 3, "active") and one("undo", "undo") == ("b", 4, "active")
    assert one("correct", "confirm") == ("c", 4, "active") and one("correct", "retract") == ("c", 3, "retracted")
    assert one("correct", "undo") == ("b", 4, "active")
    assert {r.key: r.text for r in consolidation.corrected(history, ops("undo")).collect()}[2] == "x"


def test_cycles_and_leaves(spark):
    rows = [(1, 1, None), (1, 2, 1), (1, 3, 5), (1, 4, 3), (1, 5, 4), (1, 6, 5), (2, 1, 1), (2, 2, 9)]
    nodes = spark.createDataFrame(rows, "conv long, node long, parent long")
    leaves = spark.createDataFrame([(1, 2), (2, 7)], "conv long, leaf long")
    got = {(r.conv, r.node, r.issue) for r in trees.validate(nodes, leaves).collect()}
    assert got == {(1, 3, "message_cycle"), (1, 4, "message_cycle"), (1, 5, "message_cycle"), (2, 1, "self_parent"), (2, 2, "missing_parent"), (2, 7, "missing_active_leaf")}


def test_either_keeps_equal_rows_and_overlap_by_sweep(spark):
    rows = spark.createDataFrame([(1, 9), (1, 9), (2, 8), (None, 8), (3, 7)], "a long, b long")
    k = lambda *x: spark.createDataFrame([(v,) for v in x], "k long")
    assert sorted(map(tuple, joins.in_either(rows, ("a", k(1, 1), "k"), ("b", k(8), "k")).collect()), key=str) == sorted([(1, 9), (1, 9), (2, 8), (None, 8)], key=str)
    import random

    rng = random.Random(1)
    span = lambda: (rng.randrange(3), (s := rng.randrange(60)), s + rng.randrange(0, 9))
    mine, taken = [(*span(), i) for i in range(80)], [span() for _ in range(12)]
    got = joins.without_overlap(spark.createDataFrame(mine, "k long, start long, end long, i long"), spark.createDataFrame(taken, "k long, start long, end long"), ["k"])
    assert sorted(r.i for r in got.collect()) == [i for k_, s, e, i in mine if not any(k_ == x and b < e and s < c for x, b, c in taken)]
    inner = joins.contained(spark.createDataFrame(mine, "k long, start long, end long, i long"), spark.createDataFrame(taken, "k long, start long, end long"), ["k"], width=5)
    assert sorted((r.i, r.outer_start, r.outer_end) for r in inner.collect()) == sorted((i, b, c) for k_, s, e, i in mine for x, b, c in taken if k_ == x and b <= s and e <= c)


def test_units_are_validated_in_order(spark):
    raw = "alpha beta gamma"
    rows = [(1, 0, "u1", 0, 5, "alpha"), (1, 1, "u1", 6, 10, "beta"), (1, 2, "u2", 3, 8, "ha be"), (1, 3, "u3", 6, 10, "betX"), (1, 4, "u4", 6, 10, "beta"), (1, 5, "u5", 8, 8, ""), (1, 6, None, 0, 1, "a"), (1, 7, "u6", 11, 99, "gamma")]
    units = spark.createDataFrame([(*r, raw) for r in rows], "message long, at int, id string, start int, end int, evidence string, raw string")
    got = {r["at"]: r.reason for r in coverage.validated(units).collect()}
    assert got == {0: None, 1: "duplicate_unit_id", 2: "units_overlap", 3: "evidence_mismatch", 4: None, 5: "span_inverted", 6: "malformed_record", 7: "span_out_of_range"}
    tokens = spark.createDataFrame([(1, 0, 0, 5), (1, 1, 6, 10), (1, 2, 11, 16), (1, 3, 17, 20)], "message long, place long, start long, end long")
    spans = spark.createDataFrame([(1, 5, 10), (1, 6, 9)], "message long, start long, end long")
    assert sorted((r.start, r.end, r.tokens) for r in coverage.uncovered(tokens, spans).collect()) == [(0, 5, 1), (11, 20, 2)]


def test_blocks_and_graphs(spark):
    items = spark.createDataFrame([("b", 1, "aaaa"), ("b", 2, "b" * 50), ("b", 3, "cc"), ("b", 4, "dddd"), ("x", 1, "e" * 99)], "block string, place long, line string")
    assert {r.block: (r.body, r.items, r.omitted) for r in blocks.rendered(items, 8).collect()} == {"b": ("aaaa\ncc", 2, 2), "x": ("", 0, 1)}
    edges = spark.createDataFrame([(1, 2), (1, 2), (3, 4)], "a long, b long")
    once = graphs.merged(edges.limit(0), edges, ["a", "b"])
    assert graphs.merged(once, edges, ["a", "b"]).count() == 2


def test_json_and_archive_sources(spark, tmp_path):
    import io
    import zipfile

    lines = spark.createDataFrame([('{"k": 1}',), ('{"k": ',), ("",), ('{"k": "x"}',), ("[]",)], "value string")
    assert [r.k for r in exports.json_records(lines, "k long").collect()] == [1]
    (tmp_path / "t.md").write_text("# Title here\nbody")
    assert [(r.title, r.messages) for r in exports.read_transcripts(spark, str(tmp_path / "*.md")).collect()] == [("Title here", 0)]
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("a/conversations.json", "[]")
        z.writestr("b.bin", b"\x00" * 3_000_000)
    got = exports.staged(spark.createDataFrame([("z", bytearray(buf.getvalue()))], "path string, content binary")).collect()
    assert [(r.name, r.staged, r.size, r.role) for r in got] == [("a/conversations.json", "artifact-000000", 2, "conversations"), ("b.bin", "artifact-000001", 3_000_000, "attachment")]


def test_snapshots_do_not_depend_on_order(spark):
    a = spark.createDataFrame([("b", 1, 1), ("b", 2, 1)], "block string, source long, version long")
    assert blocks.snapshots(a).collect() == blocks.snapshots(a.orderBy(F.col("source").desc())).collect()
    with pytest.raises(Exception, match="order what it was given"):
        from ledgerlens.operators.retrieval import reranked

        reranked(a.select("source", "version"), lambda d: d.select((F.col("source") + 5).alias("source"), F.lit(1).alias("key")), "source", "version")
