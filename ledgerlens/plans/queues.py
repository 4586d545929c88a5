"""Queries of queues, sinks, packages and further sources over the test tables."""

from __future__ import annotations

import io
import uuid
import zipfile

import pyarrow as pa
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..checkpoints import shared_folder
from ..operators import graphs, queues, sets
from ..registry import query
from ..sources import exports, heritage, package

LONG = lambda c: c.cast("long")


def _folder(t, name: str) -> str:
    return f"{shared_folder(t('region').sparkSession)}/{name}-{uuid.uuid4().hex}"


@query("x03_session_resolution", "WITH r AS (SELECT event_id, user_id, event_type, user_id % 3 <> 0 AS known, user_id % 7 = 0 AS legacy FROM events) SELECT event_id, CASE WHEN known THEN user_id % 50 WHEN legacy THEN user_id + 1000 END AS session, CASE WHEN known THEN 'chat' WHEN legacy THEN 'legacy' ELSE 'created' END AS how, CASE WHEN known THEN 0.95 WHEN legacy THEN 0.6 ELSE 1.0 END::DOUBLE AS confidence FROM r")
def _(t):
    """Requests by their aliases: an alias of one session decides (an event type belongs to many and does not), then the legacy
    id, and else a session is created."""
    from ..operators.joins import resolve_aliases

    users = t("events").select("user_id").distinct()
    aliases = users.where("user_id % 3 <> 0").select(F.lit("chat").alias("alias_type"), F.concat(F.lit("u"), "user_id").alias("alias"), (F.col("user_id") % 50).alias("target"))
    aliases = aliases.unionByName(users.where("user_id % 7 = 0").select(F.lit("legacy").alias("alias_type"), F.concat(F.lit("u"), "user_id").alias("alias"), (F.col("user_id") + 1000).alias("target")))
    asked = F.array(*(F.struct(F.lit(k).alias("alias_type"), F.concat(F.lit("u"), "user_id").alias("alias"), F.lit(i).alias("priority")) for i, k in enumerate(("chat", "legacy"))))
    # requests of a user have the same aliases, so each user is resolved once
    found = resolve_aliases(users.select(F.col("user_id").alias("request"), F.explode(asked).alias("a")).select("request", "a.*"), aliases)
    how = F.when(F.col("target").isNull(), "created").when(F.col("target") >= 1000, "legacy").otherwise("chat")
    out = t("events").join(found.withColumnRenamed("request", "user_id"), "user_id").withColumn("how", how)
    return out.select("event_id", F.col("target").alias("session"), "how", F.when(F.col("how") == "chat", 0.95).when(F.col("how") == "legacy", 0.6).otherwise(1.0).alias("confidence"))


@query("x04_job_claims", "SELECT event_type, worker, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts, event_id) - 1 AS worker FROM events WHERE event_id % 4 <> 0) WHERE worker < 4")
def _(t):
    """Four workers of each queue claim different jobs: the first in order of priority and time."""
    got = queues.claimed(t("events").where("event_id % 4 <> 0"), "event_type", [F.col("value").desc(), F.col("ts"), F.col("event_id")], 4)
    return got.select("event_type", LONG(F.col("worker")).alias("worker"), "event_id")


@query("x05_expired_leases", "SELECT event_id, CASE WHEN ts + INTERVAL 1 HOUR >= (SELECT max(ts) FROM events) - INTERVAL 5 DAY THEN 'running' WHEN event_id % 5 >= 3 THEN 'dead' ELSE 'pending' END AS state FROM events")
def _(t):
    e = t("events")
    now = e.agg((F.max("ts") - F.expr("interval 5 days")).alias("now"))  # one row
    state = queues.after_lease(F.col("now"), F.col("ts") + F.expr("interval 1 hour"), F.col("event_id") % 5, 3)
    return e.crossJoin(now).select("event_id", state.alias("state"))


@query("x06_fenced_results", "WITH l AS (SELECT user_id AS job, max(event_id % 3) AS generation, max(event_id) AS until FROM events WHERE event_id % 10 <> 0 GROUP BY 1) SELECT event_id, coalesce(event_id % 3 = generation AND event_id <= until, false) AS accepted FROM events LEFT JOIN l ON job = user_id")
def _(t):
    """Results of an outdated generation, or after the lease, are not written."""
    e = t("events")
    leases = e.where("event_id % 10 <> 0").groupBy(F.col("user_id").alias("job")).agg(F.max(F.col("event_id") % 3).alias("generation"), F.max("event_id").alias("until"))
    results = e.select(F.col("user_id").alias("job"), "event_id", (F.col("event_id") % 3).alias("generation"), F.col("event_id").alias("at"))
    return queues.fenced(results, leases, "job").select("event_id", "accepted")


_ERRORS = ["read timeout", "HTTP 429 slow down", "HTTP 503", "privacy acknowledgement is missing", "HTTP 400", "other"]


@query("x07_retries", f"""WITH f AS (SELECT event_id, event_id % 6 AS retries, [{", ".join(f"'{x}'" for x in _ERRORS)}][event_id % 6 + 1 + (event_id // 6) % 2 * 0] AS message, event_id % 11 = 0 AS conn FROM events), c AS (SELECT *, CASE WHEN conn OR contains(message, 'timeout') THEN 'retryable_network' WHEN contains(message, '429') THEN 'retryable_provider_429' WHEN contains(message, '503') THEN 'retryable_provider_5xx' WHEN contains(message, 'privacy') THEN 'configuration_error' WHEN contains(message, '400') THEN 'invalid_request' ELSE 'worker_error' END AS class FROM f)
SELECT event_id, class, CASE WHEN class LIKE 'retryable%' AND retries + 1 < 5 THEN 'queued' ELSE 'failed' END AS state, CASE WHEN class LIKE 'retryable%' AND retries + 1 < 5 THEN least(900, 10 * (1 << retries)) END::BIGINT AS delay FROM c""")
def _(t):
    message = F.element_at(F.array(*map(F.lit, _ERRORS)), (F.col("event_id") % 6 + 1).cast("int"))
    e = t("events").select("event_id", (F.col("event_id") % 6).alias("retries"), queues.failure(F.when(F.col("event_id") % 11 == 0, "ConnectionError").otherwise("RuntimeError"), message).alias("f"))
    return e.select("event_id", F.col("f.class").alias("class"), queues.after_failure(F.col("f.retryable"), F.col("retries"), 5).alias("n")).select("event_id", "class", "n.*")


@query("x12_resumable_commits", "WITH b AS (SELECT event_id // 500 AS batch, count(*) AS n, sum(event_id) AS s FROM events GROUP BY 1) SELECT batch, CASE WHEN batch % 4 = 0 THEN 'skip' WHEN batch % 4 = 1 THEN 'conflict' ELSE 'commit' END AS action FROM b")
def _(t):
    """Batches by id range; some were committed before, some of them with other rows."""
    mark = F.sha2(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "event_id", "value"))), "\n"), 256)
    b = t("events").groupBy(F.floor(F.col("event_id") / 500).alias("batch")).agg(mark.alias("mark"))
    done = b.where("batch % 4 < 2").select("batch", F.when(F.col("batch") % 4 == 0, F.col("mark")).otherwise(F.lit("other")).alias("mark"))
    return queues.commits(b, done)


@query("x13_run_states", """WITH i AS (SELECT o_custkey AS run, CASE WHEN o_custkey % 4 = 0 THEN CASE WHEN o_orderkey % 9 = 0 THEN 'failed' ELSE 'committed' END WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'committed' END AS status FROM orders), n AS (SELECT run, count(*) FILTER (WHERE status = 'pending') AS "open", count(*) FILTER (WHERE status = 'failed') AS failed FROM i GROUP BY 1)
SELECT run, CASE WHEN "open" = 0 AND failed > 0 THEN 'completed_with_errors' WHEN "open" = 0 THEN 'completed' WHEN run % 3 = 0 THEN 'cancelling' WHEN run % 3 = 1 THEN 'paused' ELSE 'running' END AS state, "open", failed FROM n""")
def _(t):
    status = F.when(F.col("o_custkey") % 4 == 0, F.when(F.col("o_orderkey") % 9 == 0, "failed").otherwise("committed")).when(F.col("o_orderstatus") == "O", "pending").otherwise("committed")
    items = t("orders").select(F.col("o_custkey").alias("run"), status.alias("status"))
    requests = t("customer").where("c_custkey % 3 < 2").select(F.col("c_custkey").alias("run"), F.when(F.col("c_custkey") % 3 == 0, "cancel").otherwise("pause").alias("request"))
    return queues.run_state(items, requests)


@query("x14_recovery_plan", "SELECT 'import' AS kind, o_orderkey::VARCHAR AS id, 'paused' AS state FROM orders WHERE o_orderstatus = 'P' UNION ALL SELECT 'privacy', s_suppkey::VARCHAR, 'partial_failure' FROM supplier WHERE s_acctbal < 0 UNION ALL SELECT 'job', event_id::VARCHAR, CASE WHEN event_id % 5 >= 3 THEN 'dead' ELSE 'pending' END FROM events WHERE value > 100")
def _(t):
    jobs = F.when(F.col("event_id") % 5 >= 3, "dead").otherwise("pending")
    return queues.recovery([("import", t("orders"), "o_orderkey", F.col("o_orderstatus") == "P", F.lit("paused")), ("privacy", t("supplier"), "s_suppkey", F.col("s_acctbal") < 0, F.lit("partial_failure")), ("job", t("events"), "event_id", F.col("value") > 100, jobs)])


@query("w03_replaced_reports", "SELECT user_id AS k, arg_max(event_type, event_id) AS report FROM events GROUP BY 1")
def _(t):
    """A report of a key replaces the one before."""
    e = t("events").select(F.col("user_id").alias("k"), F.col("event_type").alias("report"), "event_id")
    return e.groupBy("k").agg(F.max_by("report", "event_id").alias("report"))


@query("w05_package", "SELECT 'nation' AS \"table\", 'ok' AS status UNION ALL SELECT 'region', 'ok' UNION ALL SELECT 'supplier', 'ok'")
def _(t):
    """Tables written as JSON lines with a manifest of counts and digests, and verified."""
    folder = _folder(t, "package")
    package.write_package({n: t(n) for n in ("nation", "region", "supplier")}, folder)
    return package.verify_package(t("region").sparkSession, folder)


@query("s15_package_source", "SELECT s_suppkey, s_name, s_nationkey FROM supplier")
def _(t):
    """A table read back from a package after its checksum was verified."""
    folder, spark = _folder(t, "package"), t("region").sparkSession
    package.write_package({"supplier": t("supplier")}, folder)
    bad = package.verify_package(spark, folder).where("status <> 'ok'").limit(1).count()
    if bad:
        raise ValueError("the package does not verify")
    return package.read_table(spark, folder, "supplier", "s_suppkey long, s_name string, s_nationkey int")


@query("w06_copied_tables", "SELECT 'customer' AS \"table\", count(*) AS rows, true AS same FROM customer UNION ALL SELECT 'orders', count(*), true FROM orders")
def _(t):
    """Tables copied to another store, with counts and content digests of both sides."""
    folder, spark, out = _folder(t, "copy"), t("region").sparkSession, None
    for name in ("customer", "orders"):
        df = t(name)
        df.write.parquet(f"{folder}/{name}")
        a, b = sets.digest(df).alias("a"), sets.digest(spark.read.schema(df.schema).parquet(f"{folder}/{name}")).alias("b")
        row = a.crossJoin(b).select(F.lit(name).alias("table"), F.col("a.rows").alias("rows"), ((F.col("a.rows") == F.col("b.rows")) & (F.col("a.digest") == F.col("b.digest"))).alias("same"))  # one row each
        out = row if out is None else out.unionByName(row)
    return out


@query("w09_graph_merge", "SELECT kind, count(*) AS n FROM (SELECT DISTINCT 'SUPPLIES' AS kind, l_suppkey AS a, l_partkey AS b FROM lineitem UNION ALL SELECT DISTINCT 'ORDERED', o_custkey, l_partkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1")
def _(t):
    """Edges merged in two batches that overlap; a replay of the second one adds nothing."""
    li, keys = t("lineitem"), ["kind", "a", "b"]
    supplies = li.select(F.lit("SUPPLIES").alias("kind"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b"))
    ordered = li.join(t("orders"), F.col("o_orderkey") == F.col("l_orderkey")).select(F.lit("ORDERED").alias("kind"), F.col("o_custkey").alias("a"), F.col("l_partkey").alias("b"))
    edges = supplies.unionByName(ordered)
    first, second = edges.where("a % 3 < 2").dropDuplicates(keys), edges.where("a % 3 > 0")
    return graphs.merged(graphs.merged(first, second, keys), second, keys).groupBy("kind").agg(F.count("*").alias("n"))


@query("s05_json_lines", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 50 <> 0")
def _(t):
    """JSON text with a malformed record now and then, which is skipped."""
    value = F.when(F.col("event_id") % 50 == 0, F.substring("props", 1, 5)).otherwise(F.col("props"))
    return exports.json_records(t("events").select("event_id", value.alias("value")), "k long")


def zipped(pages):
    """archive, path, content: at most 20 pages in each ZIP."""

    def run(key: tuple, group: pa.Table) -> pa.Table:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
            for i, html in sorted(zip(group.column("page_id").to_pylist(), group.column("html").to_pylist(), strict=True)):
                z.writestr(zipfile.ZipInfo(f"pages/{i:09d}.html"), html)
        return pa.table({"path": [f"archive-{key[0].as_py()}.zip"], "content": pa.array([out.getvalue()], pa.binary())})

    return pages.select(F.floor(F.col("page_id") / 20).alias("archive"), "page_id", "html").groupBy("archive").applyInArrow(run, "path string, content binary")


@query("s06_staged_archives", "SELECT 'archive-' || page_id // 20 || '.zip' AS archive, 'pages/' || lpad(page_id::VARCHAR, 9, '0') || '.html' AS name, 'artifact-' || lpad((row_number() OVER (PARTITION BY page_id // 20 ORDER BY page_id) - 1)::VARCHAR, 6, '0') AS staged, CAST(octet_length(encode(html)) AS BIGINT) AS size, sha256(html) AS sha256, 'activity' AS role FROM pages")
def _(t):
    return exports.staged(zipped(t("pages"))).drop("place")


@query("s14_manual_transcripts", "SELECT doc_id::VARCHAR AS path, trim(string_split(text, chr(10))[1]) AS title, 0.2::DOUBLE AS confidence, 0 AS messages FROM documents")
def _(t):
    files = t("documents").select(F.col("doc_id").cast("string").alias("path"), "text")
    return exports.transcripts(files).select("path", "title", "confidence", "messages")


@query("s17_evaluation_cases", "SELECT 'case-' || item_id AS case_id, text AS query, CAST(item_id % 3 AS BIGINT) AS must, item_id % 5 = 0 AS abstain FROM benchmark")
def _(t):
    """Evaluation cases as JSON lines, read with their nested schema."""
    must = F.slice(F.array(F.lit("a"), F.lit("b")), 1, (F.col("item_id") % 3).cast("int"))
    case = F.struct(F.concat(F.lit("case-"), "item_id").alias("case_id"), F.struct("text").alias("query"), F.struct(must.alias("must_retrieve_memory_keys"), (F.col("item_id") % 5 == 0).alias("expected_abstention")).alias("expected"))
    lines = t("benchmark").select(F.to_json(case).alias("value"))
    got = exports.json_records(lines, "case_id string, query struct<text:string>, expected struct<must_retrieve_memory_keys:array<string>,expected_abstention:boolean>")
    return got.select("case_id", F.col("query.text").alias("query"), LONG(F.size("expected.must_retrieve_memory_keys")).alias("must"), F.col("expected.expected_abstention").alias("abstain"))


@query("j13_nine_checks", """SELECT check_name, n FROM (SELECT 'orders' AS check_name, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lines', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'line parts', count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part) UNION ALL SELECT 'line suppliers', count(*) FROM lineitem WHERE l_suppkey NOT IN (SELECT s_suppkey FROM supplier)
UNION ALL SELECT 'customer nations', count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4) UNION ALL SELECT 'supplier nations', count(*) FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 4) UNION ALL SELECT 'nation regions', count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region WHERE r_regionkey > 0) UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'event users', count(*) FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))""")
def _(t):
    """Nine referential checks in one result; parents are cut for some, so that there is something to find."""
    from ..operators.joins import orphans

    checks = [
        ("orders", t("orders"), t("customer"), "o_custkey", "c_custkey"), ("lines", t("lineitem"), t("orders"), "l_orderkey", "o_orderkey"), ("line parts", t("lineitem"), t("part"), "l_partkey", "p_partkey"),
        ("line suppliers", t("lineitem"), t("supplier"), "l_suppkey", "s_suppkey"), ("customer nations", t("customer"), t("nation").where("n_regionkey < 4"), "c_nationkey", "n_nationkey"), ("supplier nations", t("supplier"), t("nation").where("n_regionkey < 4"), "s_nationkey", "n_nationkey"),
        ("nation regions", t("nation"), t("region").where("r_regionkey > 0"), "n_regionkey", "r_regionkey"), ("labels", t("labels"), t("documents"), "doc_id", "doc_id"), ("event users", t("events"), t("customer").where("c_acctbal > 0"), "user_id", "c_custkey"),
    ]
    out = None
    for name, rows, parents, foreign, key in checks:
        one = orphans(rows.select(foreign), parents, foreign, key).agg(F.lit(name).alias("check_name"), F.count("*").alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


def heritage_files(t):
    """A package for each nation with its customers in payloads of a hundred keys; five of six are spoilt in one way each, in their first payload or their manifest."""
    c = t("customer").select("c_nationkey", F.floor(F.col("c_custkey") / 100).alias("part"), "c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")).alias("line"))
    payload = c.groupBy("c_nationkey", "part").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("c_custkey", "line"))), lambda x: x["line"]), "\n").alias("text"))
    first = F.col("part") == F.min("part").over(Window.partitionBy("c_nationkey"))
    kind = F.col("c_nationkey") % 6
    odd = payload.withColumn("first", first).withColumn("text", F.when(F.col("first") & (kind == 3), F.concat("text", F.lit('\n{"a": NaN}'))).otherwise(F.col("text")))
    path = F.concat(F.lit("data/part-"), "part", F.lit(".ijsonl"))
    own = odd.select("c_nationkey", "first", path.alias("path"), F.encode("text", "UTF-8").alias("content"))
    digest = F.when(F.col("first") & (kind == 1), F.sha2(F.lit("other"), 256)).otherwise(F.sha2("content", 256))
    sums = own.groupBy("c_nationkey").agg(F.array_join(F.array_sort(F.collect_list(F.concat(digest, F.lit("  "), "path"))), "\n").alias("text")).select("c_nationkey", F.lit("checksums.sha256").alias("path"), F.encode("text", "UTF-8").alias("content"))
    manifest = sums.where(kind != 4).select("c_nationkey", F.lit("manifest.ijson").alias("path"), F.encode(F.when(kind == 5, '{"format":"other"}').otherwise('{"format":"ledger-package"}'), "UTF-8").alias("content"))
    kept = own.where(~(F.col("first") & (kind == 2))).drop("first")
    return kept.unionByName(sums).unionByName(manifest).select(F.concat(F.lit("n"), "c_nationkey").alias("package"), "path", "content")


@query(
    "e15_package_issues",
    """SELECT 'n' || c_nationkey AS package, CASE c_nationkey % 6 WHEN 1 THEN 'checksum_mismatch' WHEN 2 THEN 'missing_payload' WHEN 3 THEN 'invalid_ijson' WHEN 4 THEN 'missing_manifest' ELSE 'unsupported_format' END AS issue_code,
    CASE WHEN c_nationkey % 6 > 3 THEN 'manifest.ijson' ELSE 'data/part-' || min(c_custkey // 100) || '.ijsonl' END AS path, CASE c_nationkey % 6 WHEN 3 THEN 'non_finite' WHEN 5 THEN 'other' END AS detail FROM customer WHERE c_nationkey % 6 > 0 GROUP BY c_nationkey""",
)
def _(t):
    return heritage.issues(heritage_files(t), "ledger-package").select("package", "issue_code", "path", "detail")


@query("e15_package_verdicts", "SELECT DISTINCT 'n' || c_nationkey AS package, c_nationkey % 6 = 0 AS valid, CASE WHEN c_nationkey % 6 = 0 THEN 0 ELSE 1 END::BIGINT AS issues FROM customer")
def _(t):
    return heritage.verify(heritage_files(t), "ledger-package")
