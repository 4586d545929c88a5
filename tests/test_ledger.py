import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import consolidation, evaluation, joins, retrieval, sets, trees
from ledgerlens.sources import exports, package
from ledgerlens.streaming import ledger


def test_event_indexes_go_on_over_batches(spark, tmp_path):
    src, schema = f"{tmp_path}/in", "k long, seq long"
    spark.createDataFrame([(1, 5), (1, 3), (2, 1)], schema).coalesce(1).write.parquet(src)
    stream = lambda: ledger.numbered(spark.readStream.schema(schema).parquet(src), "k", "seq")
    ledger.run_available(stream(), f"{tmp_path}/s")
    spark.createDataFrame([(1, 9), (2, 7), (2, 8)], schema).coalesce(1).write.mode("append").parquet(src)
    got = sorted(tuple(r) for r in ledger.run_available(stream(), f"{tmp_path}/s").collect())
    assert got == [(1, 3, 0), (1, 5, 1), (1, 9, 2), (2, 1, 0), (2, 7, 1), (2, 8, 2)]


def test_leases(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)
    src, schema = f"{tmp_path}/in", "job long, kind string, ts timestamp"
    stream = lambda: ledger.leases(spark.readStream.schema(schema).parquet(src), "job", "ts", 60)
    for rows in ([(1, "claim", at(0)), (1, "done", at(30)), (2, "claim", at(0)), (3, "done", at(5))], [(9, "claim", at(1000))], [(9, "done", at(1001)), (2, "done", at(1002))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        got = ledger.run_available(stream(), f"{tmp_path}/s")
    assert sorted(tuple(r) for r in got.collect()) == [(1, "done"), (2, "fenced"), (2, "requeued"), (3, "fenced"), (9, "done")]


def test_batch_windows_equal_the_stream(spark, tmp_path):
    rows = [(i % 3, dt.datetime(2024, 1, 1, 0, i % 60), float(i)) for i in range(200)]
    df = spark.createDataFrame(rows, "k long, ts timestamp, value double")
    df.write.parquet(f"{tmp_path}/in")
    s = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    got = ledger.run_available(ledger.windowed(s, "ts", "10 minutes", ["k"]), f"{tmp_path}/s", "complete")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, ledger.windowed(df, "ts", "10 minutes", ["k"]).collect()))


def test_consolidation_sequence(spark):
    c = [("k", i, "ready", "p", x, p) for i, (x, p) in enumerate([("a", "affirmed"), ("a", "affirmed"), ("b", "unknown"), ("b", "affirmed"), ("c", "negated"), ("d", "affirmed")], 1)]
    c += [("k", 7, "rejected", "p", "z", "unknown"), ("k", 8, "ready", "forget_request", "z", "unknown")]
    df = spark.createDataFrame(c, "key string, seq long, status string, predicate string, text string, polarity string")
    d = consolidation.consolidate(df)
    assert [r.operation for r in d.orderBy("seq").collect()] == ["ADD", "REINFORCE", "SUPERSEDE", "REINFORCE", "SUPERSEDE", "CONTRADICT", "REJECT", "MANUAL_REVIEW"]
    v = consolidation.versions(d, df).orderBy("version").collect()
    assert [(r.version, r.text, r.tx_until, r.evidence) for r in v] == [(1, "a", 3, 2), (2, "b", 5, 2), (3, "c", None, 1)]


def test_trees_with_cycles_and_missing_parents(spark):
    n = spark.createDataFrame([(1, i, i - 1 if i else None) for i in range(40)] + [(2, 0, 1), (2, 1, 0), (2, 5, 9), (3, 0, None), (3, 1, 0), (3, 2, 0)], "conv long, node long, parent long")
    assert {(r.conv, r.node): r.depth for r in trees.depths(n).collect()} == {(1, i): i for i in range(40)} | {(3, 0): 0, (3, 1): 1, (3, 2): 1}
    path = trees.active_path(n, spark.createDataFrame([(1, 30), (3, 2), (2, 1)], "conv long, leaf long")).collect()
    assert sorted((r.conv, r.node, r.position) for r in path) == [(1, i, i) for i in range(31)] + [(3, 0, 0), (3, 2, 1)]
    assert {(r.conv, r.node, r.issue) for r in trees.validate(n).collect()} == {(2, 5, "missing_parent"), (2, 0, "message_cycle"), (2, 1, "message_cycle")}
    assert [(r.conv, r.node, r.children) for r in trees.branch_points(n).collect()] == [(3, 0, 2)]


def test_packing_skips_and_continues(spark):
    df = spark.createDataFrame([("g", 0, 50), ("g", 1, 60), ("g", 2, 40), ("g", 3, 20), ("g", 4, 10)], "g string, o long, s long")
    assert [r.taken for r in retrieval.packed(df, "g", "o", "s", 100).orderBy("o").collect()] == [True, False, True, False, True]


def test_selection_abstains(spark):
    df = spark.createDataFrame([(1, 1, 0.5, False), (1, 2, 0.1, False), (2, 1, 0.1, False), (3, 1, 0.9, False), (3, 2, 0.8, True)], "q long, k long, score double, conflict boolean")
    got = sorted((r.q, r.k or 0, r.abstain) for r in retrieval.select(df, "q", "k").collect())
    assert got == [(1, 1, False), (2, 0, True), (3, 1, True), (3, 2, True)]


def test_metrics_of_empty_cases(spark):
    r = spark.createDataFrame([("a", "x", 1), ("a", "y", 2), ("b", "z", 1)], "case string, key string, rank int")
    e = spark.createDataFrame([("a", "y"), ("a", "w"), ("c", "q")], "case string, key string")
    got = {m.case: (m.recall, m.precision, m.mrr, m.ndcg) for m in evaluation.metrics(r, e, spark.createDataFrame([(c,) for c in "abcd"], "case string"), 10).collect()}
    assert got == {"a": (0.5, 0.5, 0.5, pytest.approx(0.386853, abs=1e-5)), "b": (1, 0, 1, 1), "c": (0, 0, 0, 0), "d": (1, 1, 1, 1)}


def test_exports(spark, tmp_path):
    tree = [{"id": "c1", "title": "t", "current_node": "b", "mapping": {"a": {"id": "a", "parent": None, "message": {"author": {"role": "user"}, "content": {"content_type": "text", "parts": ["hi", "there"]}, "create_time": 1.5}}, "b": {"id": "b", "parent": "a", "message": {"author": {"role": "assistant"}, "content": {"content_type": "text", "parts": ["yo"]}}}}}]
    history = [{"id": "h", "title": "t", "chat": {"history": {"currentId": "2", "messages": {"1": {"id": "1", "role": "user", "content": "x", "parentId": None}, "2": {"id": "2", "role": "assistant", "content": "y", "parentId": "1"}}}}}]
    files = {"tree": tree, "history": history, "linear": [{"uuid": "l", "name": "n", "chat_messages": [{"uuid": "1", "sender": "human", "text": "q"}]}], "activity": [{"time": "2024-01-01T00:00:00Z", "title": "searched"}], "manual": "just text", "generic": {"format": "conversation-import"}}
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in files.items()], "path string, value string")
    assert {r.path: r.format for r in exports.probe(df).collect()} == {k: k for k in files}
    got = {r.node: (r.parent, r.role, r.text, r.active) for r in exports.read_tree(df.where("path = 'tree'")).collect()}
    assert got == {"a": (None, "user", "hi\nthere", False), "b": ("a", "assistant", "yo", True)}
    assert {r.node: r.active for r in exports.read_history(df.where("path = 'history'")).collect()} == {"1": False, "2": True}
    assert exports.read_activity(df.where("path = 'activity'")).first().text == "searched"
    assert spark.createDataFrame([("<p>a <b>b</b></p><!-- c -->d",)], "h string").select(exports.html_text("h")).first()[0] == "a\nb\nd"


def test_archives(spark):
    rows = [("ok", "a.txt", 10, 20, 0), ("up", "../a", 1, 1, 0), ("bomb", "a", 1, 10**6, 0), ("link", "a", 1, 1, 0o120777 << 0), ("nest", "a.zip", 9, 9, 0), ("nest", "b.zip", 9, 9, 0)]
    got = {r.archive: r.reason for r in exports.archive_verdict(spark.createDataFrame(rows, "archive string, name string, packed long, size long, mode int")).collect()}
    assert got == {"ok": None, "up": "unsafe_path", "bomb": "ratio", "link": "special_file", "nest": "nested"}


def test_package_round_trip(spark, tmp_path):
    t = {"a": spark.createDataFrame([(1, "x"), (2, None)], "id long, s string"), "b": spark.range(5).toDF("n")}
    package.write_package(t, f"{tmp_path}/p")
    assert {r.table: r.status for r in package.verify_package(spark, f"{tmp_path}/p").collect()} == {"a": "ok", "b": "ok"}
    spark.range(6).toDF("n").write.mode("overwrite").json(f"{tmp_path}/p/b")
    assert {r.table: r.status for r in package.verify_package(spark, f"{tmp_path}/p").collect()} == {"a": "ok", "b": "checksum_mismatch"}


def test_digest_and_sets(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y"), (2, "y")], "i long, s string")
    assert sets.digest(a).first() == sets.digest(a.repartition(3)).first()
    assert sets.digest(a).first() != sets.digest(a.distinct()).first()
    r = sets.replays(a.withColumn("o", F.monotonically_increasing_id()), "i", "s", ["o"])
    assert sorted(x.outcome for x in r.collect()) == ["new", "new", "replay"]
    spans = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 9, 12), (1, 1, 2)], "doc long, start long, end long")
    assert sorted((x.start, x.end) for x in sets.merged_spans(spans, ["doc"]).collect()) == [(0, 7), (9, 12)]


def test_alias_resolution(spark):
    q = spark.createDataFrame([(1, "name", "ann", 1), (1, "mail", "a@x", 2), (2, "name", "bob", 1), (3, "name", "zed", 1)], "request long, alias_type string, alias string, priority int")
    a = spark.createDataFrame([("name", "ann", 7), ("name", "ann", 8), ("mail", "a@x", 7), ("name", "bob", 1), ("name", "bob", 2)], "alias_type string, alias string, target long")
    assert sorted(tuple(r) for r in joins.resolve_aliases(q, a).collect()) == [(1, 7, "resolved"), (2, None, "ambiguous"), (3, None, "unknown")]


def test_packing_in_blocks_with_whole_sizes(spark, tmp_path):
    import random

    from ledgerlens import catalog

    rng = random.Random(5)
    rows = [(rng.choice(["a", "a", "a", "b", None]), i, rng.choice([0, 10, 900, 3000, 5000, 7000, 19000, 30000])) for i in range(400)] + [("b", 500, None)]
    want, left = {}, {}
    for g, i, n in rows:
        want[i] = n is not None and n <= left.setdefault(g, 20000)
        left[g] -= n if want[i] else 0
    spark.createDataFrame(rows, "source string, doc_id long, n_chars long").repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    out = catalog.queries()["n05_budget_packing"](spark, str(tmp_path))
    assert {r.position: (r.size, r.taken) for r in out.collect()} == {i: (n, want[i]) for _, i, n in rows}
    same = spark.createDataFrame([("g", 1, 60), ("g", 1, 60), ("g", 1, 40)], "g string, o long, s long")
    assert sorted((r.s, r.taken) for r in retrieval.packed(same, "g", "o", "s", 100).collect()) == [(40, True), (60, False), (60, True)]
    assert retrieval.packed(same.limit(0), "g", "o", "s", 100).count() == 0


def test_aliases_that_many_requests_name(spark, monkeypatch):
    monkeypatch.setattr(joins, "OFTEN", 3)
    q = [(i, "name", "nobody" if i % 2 else f"a{i % 8}", 1) for i in range(40)] + [(i, "segment", None if i % 5 == 0 else "s", 2) for i in range(40)]
    requests = spark.createDataFrame(q, "request int, alias_type string, alias string, priority int")
    aliases = spark.createDataFrame([("name", "a0", 1), ("name", "a2", 2), ("name", "a2", 3), ("segment", "s", 4), ("segment", "s", 5)], "alias_type string, alias string, target int")
    got = joins.resolve_aliases(requests, aliases)
    named = lambda i: (1, "resolved") if i % 2 == 0 and i % 8 == 0 else (None, "ambiguous" if i % 5 or i % 8 == 2 else "unknown")
    assert sorted(map(tuple, got.collect())) == [(i, *named(i)) for i in range(40)]
    assert "BroadcastHashJoin" in got._jdf.queryExecution().executedPlan().toString()


def test_merged_spans_of_fractions_and_nulls_equal_sql(spark, tmp_path):
    from ledgerlens import catalog
    from tests.oracle import connect, spark_rows, sql_rows

    rows = [(1, 1, 20.6), (1, 2, 5.0), (2, 1, 2.5), (2, 1, None), (2, 1, 3.5), (3, 1, None), (4, 1, 19.5), (4, 2, 0.5)]
    spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_quantity double").toPandas().to_parquet(tmp_path / "lineitem.parquet")
    q, sql = catalog.queries()["a26_merged_spans"], catalog.oracle_sql()["a26_merged_spans"]
    assert spark_rows(q(spark, str(tmp_path))) == sql_rows(connect(str(tmp_path)), sql)
