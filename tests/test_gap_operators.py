import hashlib
import json
import random
import zipfile

import pytest
from pyspark.sql import functions as F

from ledgerlens import catalog
from ledgerlens.functions import registered
from ledgerlens.functions import unicode_text as U
from ledgerlens.operators import coverage, overrides, spans
from ledgerlens.sources import heritage
from tests.oracle import DATA


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["a", "B", " ", "  ", "\n", "é", "é", "كتاب", "كِ", "می‌روم", "ـ", "‮", "۱۲", "```\ncode  X\n```\n", "ﬁ", "ß", "İ", "\t"]
    return ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 30))) for _ in range(n)] + ["", " \n ", "plain", None]


@pytest.fixture(scope="module")
def mapped(spark):
    rows = list(enumerate(texts(4, 60)))
    df = spark.createDataFrame(rows, "k long, text string").repartition(3)
    return rows, spans.pieces_of(df, "k", "text")


def test_projection_to_raw(spark, mapped):
    rows, pieces = mapped
    asked, want = [], []
    for k, raw in rows:
        text, own = U.mapped(raw or "")
        for i, (a, b) in enumerate((a, b) for a in range(len(text)) for b in range(a + 1, min(len(text), a + 6) + 1)):
            asked.append((k, i, a, b))
            want.append((k, i, a, b, *U.raw_span(own, a, b)))
    got = spans.to_raw(spark.createDataFrame(asked, "key long, span int, start int, stop int"), pieces)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_projection_to_normalized(spark, mapped):
    rows, pieces = mapped
    asked, want = [], []
    for k, raw in rows:
        text, own = U.mapped(raw or "")
        for i, (a, b) in enumerate((a, b) for a in range(len(raw or "")) for b in range(a + 1, min(len(raw), a + 6) + 1)):
            if own:
                asked.append((k, i, a, b))
                want.append((k, i, a, b, *(U.normalized_span(own, len(text), a, b) or (None, None))))
    got = spans.to_normalized(spark.createDataFrame(asked, "key long, span int, start int, stop int"), pieces)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert any(w[4] is None for w in want)


def test_span_queries(spark):
    messages = {(r.conv_id, r.turn): r.text or "" for r in spark.read.parquet(f"{DATA}/conversations.parquet").collect()}
    got = catalog.queries()["f03_raw_spans"](spark, DATA).collect()
    want = set()
    for k, raw in messages.items():
        text, own = U.mapped(raw)
        want |= {(*k, i, a, b, *U.raw_span(own, a, b)) for i, (_, a, b) in enumerate(U.tokens(text))}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def failing(texts_, reasons):
    if any("bad" in x for x in texts_):
        raise RuntimeError("bad text")
    if any("short" in x for x in texts_):
        return []
    return [None if "skip" in x else ("keep", ["model", *r]) for x, r in zip(texts_, reasons, strict=True)]


def test_a_classifier_may_fail(spark):
    rows = [(i, x, "drop", ["rule"]) for i, x in enumerate(["ok", "bad", "skip", None, "short", "ok", "bad", *["ok"] * 200])] + [(999, "ok", None, None)]
    df = spark.createDataFrame(rows, "k long, text string, decision string, reasons array<string>").coalesce(1)
    got = {r.k: (r.decision, r.reasons, r.by, r.error) for r in overrides.overridden(df, failing, batch=16).collect()}
    assert got[0] == ("keep", ["model", "rule"], "model", None) == got[3] == got[5]
    assert got[1] == got[6] == ("drop", ["rule", "model_classifier_failed"], "rules", "RuntimeError: bad text")
    assert got[2] == ("drop", ["rule"], "rules", None)
    assert got[4][2:] == ("rules", "ValueError: 0 answers for 1 texts") and got[999] == ("keep", ["model"], "model", None)
    assert {(r.by, r.error): r.rows for r in overrides.report(overrides.overridden(df, failing)).collect()} == {("model", None): 204, ("rules", None): 1, ("rules", "RuntimeError"): 2, ("rules", "ValueError"): 1}
    assert overrides.overridden(df.limit(0), failing).count() == 0


def package(folder, files):
    for name, content in files.items():
        path = folder / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)


def test_packages_in_folders_and_archives(spark, tmp_path):
    good = {"data/a.ijsonl": b'{"a":1}\n\n{"a":2}\n', "data/b.bin": bytes(range(256))}
    sums = "\n".join(f"{hashlib.sha256(v).hexdigest()}  {k}" for k, v in good.items()).encode()
    manifest = json.dumps({"format": "mine", "n": 1}).encode()
    cases = {
        "good": good | {"manifest.ijson": manifest, "checksums.sha256": sums, "extra.txt": b"x"},
        "bare": good,
        "nosums": good | {"manifest.ijson": manifest},
        "broken": {"data/a.ijsonl": b'{"a":1,"a":2}\n{"b":1e999}\nnope', "manifest.ijson": b'{"format":"other"}', "checksums.sha256": sums + b"\nno line\n" + b"0" * 64 + b"  data/a.ijsonl"},
        "odd": {"manifest.ijson": b"{", "checksums.sha256": b"\n"},
    }
    for name, files in cases.items():
        package(tmp_path / "in" / name, files)
        with zipfile.ZipFile(tmp_path / f"{name}.zip", "w") as z:
            for path, content in files.items():
                z.writestr(f"top/{path}", content)
    want = {
        ("bare", "missing_manifest", "manifest.ijson", None), ("nosums", "missing_checksums", "checksums.sha256", None), ("broken", "unsupported_format", "manifest.ijson", None), ("broken", "malformed_checksum", "checksums.sha256", 3),
        ("broken", "missing_payload", "data/b.bin", None), ("broken", "checksum_mismatch", "data/a.ijsonl", None), ("broken", "invalid_ijson", "data/a.ijsonl", 1), ("broken", "invalid_ijson", "data/a.ijsonl", 2), ("broken", "invalid_ijson", "data/a.ijsonl", 3), ("odd", "invalid_manifest", "manifest.ijson", None),
    }
    folders = heritage.read_folders(spark, f"file://{tmp_path}/in")
    zips = heritage.members(spark.read.format("binaryFile").load(f"{tmp_path}/*.zip").select(F.regexp_extract("path", r"([^/]+)\.zip$", 1).alias("package"), "content"))
    for files in (folders, zips):
        got = [(r.package, r.issue_code, r.path, r.line) for r in heritage.issues(files, "mine").collect()]
        assert set(got) == want and len(got) == len(want) + 1  # a mismatch for each of the two lines that name the file
        assert {r.package: r.valid for r in heritage.verify(files, "mine").collect()} == {n: n == "good" for n in cases}
    unsafe = spark.createDataFrame([("p", "../x", b""), ("p", "manifest.ijson", b'{"format":"mine"}'), ("p", "checksums.sha256", b"")], "package string, path string, content binary")
    assert [(r.issue_code, r.path) for r in heritage.issues(unsafe, "mine").collect()] == [("unsafe_path", "../x")]


def test_functions_in_sql(spark):
    names = registered.register(spark)
    assert len(names) == len(set(names)) and all(spark.catalog.functionExists(n) for n in names if n not in registered.table_functions())
    row = spark.sql("SELECT ledger_normalize('  A  كتاب') AS n, ledger_polarity('do not').polarity AS p, ledger_words('x, y') AS w, ledger_label(NULL) AS l, ledger_as_of(TIMESTAMP'2024-01-01', NULL, TIMESTAMP'2024-01-01') AS a").first()
    assert (row.n, row.p, row.w, row.l, row.a) == ("a کتاب", "negated", ["x", "y"], None, True)
    got = spark.sql("SELECT * FROM ledger_sentence_units('One. Two!')").collect()
    assert [tuple(r) for r in got] == [(1, 0, 4, "high", None), (2, 4, 9, "high", None)]
    assert spark.sql("SELECT * FROM ledger_units(NULL)").count() == 0
    sql = {(r.doc_id, r.what): r.n for r in catalog.queries()["e19_table_functions"](spark, DATA).collect()}
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = {}
    for k, x in docs.items():
        for kind, _, _ in U.units(x):
            want[k, f"unit {kind}"] = want.get((k, f"unit {kind}"), 0) + 1
        for what, n in (("sentence", len(U.sentences(x))), ("word", len(U.prose_tokens(x)))):
            if n:
                want[k, what] = n
    assert sql == want


def test_plans_are_complete(spark):
    from ledgerlens.plans.classify import planned

    t = lambda name: spark.read.parquet(f"{DATA}/{name}.parquet")
    units, tokens = planned(t)
    items = coverage.plan(units, tokens)
    assert coverage.faults(items, units).count() == 0
    kinds = {r.disposition for r in items.select("disposition").distinct().collect()}
    assert kinds == {"needs_review", "unresolved_reference", "context_only", "transient_instruction", "unsupported", "durable_candidate"}
    one = items.where("unit_id is not null").limit(1)
    found = {r.fault for r in coverage.faults(items.unionByName(one), units).collect()}
    assert found == {"not_one_item_per_unit", "item_identity_collision"}
    assert coverage.faults(items.limit(0), units).where("fault = 'not_one_item_per_unit'").count() == items.where("unit_id is not null").count()
    by_authority = coverage.plan(units, tokens.withColumn("authority", F.col("place") % 2), "authority")
    assert by_authority.where("unit_id is null").count() >= items.where("unit_id is null").count()


@pytest.mark.parametrize("project", [spans.to_raw, spans.to_normalized])
def test_spans_and_pieces_are_dealt_once(spark, project):
    n = spark.createDataFrame([(1, 0, 0, 3)], "key int, span int, start int, stop int")
    texts = spark.createDataFrame([(1, "a  b c")], "k int, text string")
    plan = project(n, spans.pieces_of(texts, "k", "text"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert "unboundedfollowing" not in plan.lower()


def test_table_functions_return_arrow_columns(spark):
    """Spans of table functions leave Python as columns and not row by row; tokens are those of prose_tokens."""
    registered.register(spark)
    rows = list(enumerate([*texts(6, 80), "²ª_º½ a B", "Ⱥx İ ǅ", "a" * 9 + "\n```\nb c\n```\nD"]))
    spark.createDataFrame(rows, "k long, text string").createOrReplaceTempView("said")
    out = spark.sql("SELECT k, w.* FROM said, LATERAL ledger_words_at(text) w")
    assert "UDTF" not in out._jdf.queryExecution().executedPlan().toString()
    want = [(k, i, *w) for k, x in rows for i, w in enumerate(U.prose_tokens(x or ""), 1)]
    assert sorted(map(tuple, out.collect())) == sorted(want) and out.columns == ["k", "place", "word", "start", "end"]
