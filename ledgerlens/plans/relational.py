"""Queries of joins, aggregates, windows, top-k, sets and subqueries over the test tables.

Stand-ins: customer is a memory, its orders are versions (newest order date current), line items are evidence,
conversations are messages, events are jobs and usage, nations and regions are scopes.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import joins, sets
from ..registry import query

LONG = lambda c: F.col(c).cast("long") if isinstance(c, str) else c.cast("long")
MONEY = lambda c: F.sum(F.col(c).cast("decimal(18,2)")).cast("double")
NEWEST = lambda: [F.col("o_orderdate").desc(), F.col("o_orderkey").desc()]
NEWEST_SQL = "row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC)"


@query("s01_point_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 42")
def _(t):
    return t("customer").where("c_custkey = 42").select("c_custkey", "c_name", "c_acctbal")


@query("s02_ordered_child_scan", "SELECT conv_id, turn, role, text FROM conversations WHERE conv_id < 20")
def _(t):
    return t("conversations").where("conv_id < 20").orderBy("conv_id", "turn").select("conv_id", "turn", "role", "text")


@query("s03_paged_scan", "SELECT event_id, ts, event_type FROM events WHERE event_type = (SELECT min(event_type) FROM events) ORDER BY ts, event_id LIMIT 50 OFFSET 100")
def _(t):
    """A page is the feature; the tie-break makes it stable."""
    e = t("events")
    first = e.agg(F.min("event_type").alias("event_type"))
    return e.join(F.broadcast(first), "event_type").orderBy("ts", "event_id").offset(100).limit(50).select("event_id", "ts", "event_type")


@query("s04_rows_for_ids", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_quantity >= 49)")
def _(t):
    return t("orders").join(t("lineitem").where("l_quantity >= 49").select(F.col("l_orderkey").alias("o_orderkey")), "o_orderkey", "left_semi").select("o_orderkey", "o_totalprice")


@query("p01_scope_filter", "SELECT c_custkey FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey IN (1, 3)")
def _(t):
    """A semi-join to the scopes; no scope gives no row."""
    scopes = t("nation").where(F.col("n_regionkey").isin(1, 3)).select(F.col("n_nationkey").alias("scope"))
    return t("customer").join(scopes, F.col("c_nationkey").eqNullSafe(F.col("scope")), "left_semi").select("c_custkey")


@query("p02_current_versions", f"SELECT o_custkey, o_orderkey FROM (SELECT *, {NEWEST_SQL} AS rn FROM orders) WHERE rn = 1")
def _(t):
    return joins.latest(t("orders"), ["o_custkey"], NEWEST()).select("o_custkey", "o_orderkey")


@query("p05_null_safe_match", "SELECT a.n_name, b.n_name AS other FROM nation a JOIN nation b ON nullif(a.n_regionkey, 0) IS NOT DISTINCT FROM nullif(b.n_regionkey, 0) AND a.n_nationkey < b.n_nationkey")
def _(t):
    n = t("nation").withColumn("r", F.nullif("n_regionkey", F.lit(0)))
    a, b = n.alias("a"), n.alias("b")
    return a.join(b, F.col("a.r").eqNullSafe(F.col("b.r")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey"))).select("a.n_name", F.col("b.n_name").alias("other"))


@query(
    "p07_eligibility_reasons",
    """SELECT conv_id, turn, CASE WHEN role = 'system' THEN 'system_role' WHEN text IS NULL OR trim(text) = '' THEN 'empty' WHEN length(text) < 40 THEN 'too_short' WHEN turn = 0 THEN 'first_turn' END AS reason FROM conversations""",
)
def _(t):
    reason = F.when(F.col("role") == "system", "system_role").when(F.col("text").isNull() | (F.trim("text") == ""), "empty").when(F.length("text") < 40, "too_short").when(F.col("turn") == 0, "first_turn")
    return t("conversations").select("conv_id", "turn", reason.alias("reason"))


@query("p10_status_set", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus IN ('O', 'P')")
def _(t):
    return t("orders").where(F.col("o_orderstatus").isin("O", "P")).select("o_orderkey", "o_orderstatus")


@query("p11_time_gate", "SELECT event_id FROM events WHERE ts IS NULL OR ts <= TIMESTAMP '2024-01-15 00:00:00'")
def _(t):
    return t("events").where("ts is null or ts <= timestamp '2024-01-15 00:00:00'").select("event_id")


@query(
    "p16_section_fan_out",
    """SELECT section, count(*) AS items FROM (SELECT unnest(list_filter([CASE WHEN p_size > 45 THEN 'directives' END, CASE WHEN p_retailprice > 1000 THEN 'current' END, 'relevant', CASE WHEN p_size < 5 THEN 'historical' END], lambda x: x IS NOT NULL)) AS section FROM part) GROUP BY section""",
)
def _(t):
    s = F.array_compact(F.array(F.when(F.col("p_size") > 45, "directives"), F.when(F.col("p_retailprice") > 1000, "current"), F.lit("relevant"), F.when(F.col("p_size") < 5, "historical")))
    return t("part").select(F.explode(s).alias("section")).groupBy("section").agg(F.count("*").alias("items"))


@query("j01_current_version_join", f"SELECT c_custkey, c_name, o_orderkey, o_totalprice FROM customer JOIN (SELECT *, {NEWEST_SQL} AS rn FROM orders) ON c_custkey = o_custkey AND rn = 1")
def _(t):
    current = joins.latest(t("orders"), ["o_custkey"], NEWEST())
    return t("customer").join(current, F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "c_name", "o_orderkey", "o_totalprice")


@query("j02_all_versions_join", "SELECT c_custkey, o_orderkey, o_orderdate FROM customer JOIN orders ON c_custkey = o_custkey")
def _(t):
    return t("customer").join(t("orders"), F.col("c_custkey") == F.col("o_custkey")).select("c_custkey", "o_orderkey", "o_orderdate")


@query(
    "j03_first_evidence_chain",
    """SELECT o_orderkey, l_linenumber, p_name FROM orders LEFT JOIN (SELECT l_orderkey, l_linenumber, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey) AS rn FROM lineitem) l ON l_orderkey = o_orderkey AND rn = 1 LEFT JOIN part ON p_partkey = l_partkey""",
)
def _(t):
    first = joins.latest(t("lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey")])
    return t("orders").join(first, F.col("o_orderkey") == F.col("l_orderkey"), "left").join(t("part"), F.col("p_partkey") == F.col("l_partkey"), "left").select("o_orderkey", "l_linenumber", "p_name")


@query(
    "j04_five_way_distinct",
    """SELECT DISTINCT r_name, p_brand FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN part ON l_partkey = p_partkey WHERE o_orderstatus = 'F'""",
)
def _(t):
    places = t("customer").join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("c_custkey").alias("o_custkey"), "r_name")
    o = t("orders").where("o_orderstatus = 'F'").join(places, "o_custkey").select(F.col("o_orderkey").alias("l_orderkey"), "r_name")
    return t("lineitem").select("l_orderkey", "l_partkey").join(o, "l_orderkey").join(t("part"), F.col("l_partkey") == F.col("p_partkey")).select("r_name", "p_brand").distinct()


@query(
    "j05_preaggregated_children",
    """SELECT o_orderkey, coalesce(flags, '') AS flags, coalesce(n_lines, 0) AS n_lines, c_mktsegment FROM orders JOIN customer ON c_custkey = o_custkey LEFT JOIN (SELECT l_orderkey, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags, count(*) AS n_lines FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey""",
)
def _(t):
    """Each child is aggregated before the join, so rows never multiply."""
    lines = t("lineitem").groupBy("l_orderkey").agg(F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"), F.count("*").alias("n_lines"))
    o = t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.coalesce("flags", F.lit("")).alias("flags"), F.coalesce("n_lines", F.lit(0)).alias("n_lines"), "c_mktsegment")


@query(
    "j06_lineage_chain",
    """SELECT l_orderkey, l_linenumber, coalesce(s_name, 'supplier:' || l_suppkey) AS supplier, n.n_name AS nation, r_name, p_name FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation n ON n.n_nationkey = c_nationkey JOIN region ON r_regionkey = n.n_regionkey LEFT JOIN supplier ON s_suppkey = l_suppkey LEFT JOIN part ON p_partkey = l_partkey WHERE o_totalprice > 400000""",
)
def _(t):
    o = t("orders").where("o_totalprice > 400000").select("o_orderkey", "o_custkey")
    base = t("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey").join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    base = base.join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).join(t("region"), F.col("r_regionkey") == F.col("n_regionkey"))
    base = base.join(t("supplier").select("s_suppkey", "s_name"), F.col("s_suppkey") == F.col("l_suppkey"), "left").join(t("part").select("p_partkey", "p_name"), F.col("p_partkey") == F.col("l_partkey"), "left")
    return base.select("l_orderkey", "l_linenumber", F.coalesce("s_name", F.concat(F.lit("supplier:"), "l_suppkey")).alias("supplier"), F.col("n_name").alias("nation"), "r_name", "p_name")


@query("j08_latest_with_ties", "SELECT user_id, event_id FROM (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY date_trunc('hour', ts) DESC) AS rk FROM events) WHERE rk = 1")
def _(t):
    return joins.latest_with_ties(t("events").withColumn("h", F.date_trunc("hour", "ts")), ["user_id"], "h").select("user_id", "event_id")


@query(
    "j09_prior_turns",
    """SELECT a.conv_id, a.turn, count(b.turn) AS prior, CAST(coalesce(sum(length(b.text)), 0) AS BIGINT) AS prior_chars FROM conversations a LEFT JOIN conversations b ON a.conv_id = b.conv_id AND b.turn < a.turn GROUP BY a.conv_id, a.turn""",
)
def _(t):
    """Everything before a turn, as a frame over the conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    return t("conversations").select("conv_id", "turn", F.count("turn").over(w).alias("prior"), F.coalesce(F.sum(F.length("text")).over(w), F.lit(0)).alias("prior_chars"))


@query(
    "j10_contained_spans",
    """WITH o AS (SELECT l_orderkey AS k, l_linenumber * 10 AS a, l_linenumber * 10 + CAST(l_quantity AS INT) AS b FROM lineitem) SELECT x.k AS doc, x.a AS "start", x.b AS "end", count(*) AS inside FROM o x JOIN o y ON x.k = y.k AND y.a <= x.a AND x.b <= y.b AND NOT (x.a = y.a AND x.b = y.b) GROUP BY ALL""",
)
def _(t):
    spans = t("lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 10).alias("start"), (F.col("l_linenumber") * 10 + F.col("l_quantity").cast("int")).alias("end"))
    met = joins.contained(spans, spans, ["doc"]).where("not (start = outer_start and end = outer_end)")
    return met.groupBy("doc", "start", "end").agg(F.count("*").alias("inside"))


@query(
    "j11_uncovered_spans",
    """WITH s AS (SELECT l_orderkey AS doc, l_linenumber * 10 AS "start", l_linenumber * 10 + 8 AS "end", l_returnflag AS f FROM lineitem), c AS (SELECT l_orderkey AS doc, l_linenumber * 10 AS "start", l_linenumber * 10 + CAST(l_quantity AS INT) AS "end" FROM lineitem WHERE l_returnflag = 'R') SELECT doc, "start", "end" FROM s WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.doc = s.doc AND c."start" < s."end" AND s."start" < c."end")""",
)
def _(t):
    li = t("lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 10).alias("start"), F.col("l_quantity").cast("int").alias("q"), "l_returnflag")
    spans = li.select("doc", "start", (F.col("start") + 8).alias("end"))
    return joins.without_overlap(spans, li.where("l_returnflag = 'R'").select("doc", "start", (F.col("start") + F.col("q")).alias("end")), ["doc"])


@query("j12_semi_join_either", "SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) OR c_nationkey IN (SELECT n_nationkey FROM nation WHERE n_regionkey = 2)")
def _(t):
    return joins.in_either(t("customer").select("c_custkey", "c_nationkey"), ("c_custkey", t("orders").where("o_totalprice > 450000"), "o_custkey"), ("c_nationkey", t("nation").where("n_regionkey = 2"), "n_nationkey")).select("c_custkey")


@query("j13_orphans", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    return joins.orphans(t("documents").select("doc_id"), t("labels").select(F.col("doc_id").alias("labelled")), "doc_id", "labelled")


@query("j14_no_open_item", "SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_linestatus = 'O')")
def _(t):
    return joins.orphans(t("orders").select("o_orderkey"), t("lineitem").where("l_linestatus = 'O'").select("l_orderkey"), "o_orderkey", "l_orderkey")


@query("j15_fence_guard", "SELECT user_id FROM (SELECT DISTINCT user_id FROM events) e WHERE EXISTS (SELECT 1 FROM events x WHERE x.user_id = e.user_id AND x.value > 90) AND NOT EXISTS (SELECT 1 FROM events y WHERE y.user_id = e.user_id AND y.value < 1)")
def _(t):
    e = t("events")
    return e.select("user_id").distinct().join(e.where("value > 90").select("user_id"), "user_id", "left_semi").join(e.where("value < 1").select("user_id"), "user_id", "left_anti")


@query("j16_count_distinct_of_either", "SELECT count(DISTINCT c_custkey) AS n FROM customer WHERE c_acctbal > 9000 OR c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def _(t):
    rich = t("customer").where("c_acctbal > 9000").select("c_custkey")
    pending = t("customer").select("c_custkey").join(t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_semi")
    return rich.unionByName(pending).agg(F.count_distinct("c_custkey").alias("n"))


@query(
    "j17_alias_resolution",
    """WITH a AS (SELECT 'segment' AS ty, c_mktsegment AS al, c_custkey AS target FROM customer UNION ALL SELECT 'name', c_name, c_custkey FROM customer), q AS (SELECT o_orderkey AS request, 'name' AS ty, CASE WHEN o_orderkey % 3 = 0 THEN 'nobody' ELSE c_name END AS al, 1 AS pr FROM orders JOIN customer ON c_custkey = o_custkey UNION ALL SELECT o_orderkey, 'segment', CASE WHEN o_orderkey % 2 = 0 THEN 'nothing' ELSE c_mktsegment END, 2 FROM orders JOIN customer ON c_custkey = o_custkey), h AS (SELECT request, pr, count(DISTINCT target) AS n, min(target) AS target FROM q LEFT JOIN a USING (ty, al) GROUP BY request, pr) SELECT request, arg_min(target, pr) FILTER (WHERE n = 1) AS target, CASE WHEN bool_or(n = 1) THEN 'resolved' WHEN max(n) > 1 THEN 'ambiguous' ELSE 'unknown' END AS status FROM h GROUP BY request""",
)
def _(t):
    c = t("customer")
    aliases = c.select(F.lit("segment").alias("alias_type"), F.col("c_mktsegment").alias("alias"), F.col("c_custkey").alias("target")).unionByName(c.select(F.lit("name").alias("alias_type"), F.col("c_name").alias("alias"), F.col("c_custkey").alias("target")))
    # alias targets are counted before the join, so an alias with many targets stays one row
    counted = aliases.groupBy("alias_type", "alias").agg(F.min("target").alias("lo"), F.max("target").alias("hi")).select("alias_type", "alias", F.explode(F.array_distinct(F.array("lo", "hi"))).alias("target"))
    oc = t("orders").join(c, F.col("c_custkey") == F.col("o_custkey"))
    by_name = oc.select(F.col("o_orderkey").alias("request"), F.lit("name").alias("alias_type"), F.when(F.col("o_orderkey") % 3 == 0, "nobody").otherwise(F.col("c_name")).alias("alias"), F.lit(1).alias("priority"))
    by_segment = oc.select(F.col("o_orderkey").alias("request"), F.lit("segment").alias("alias_type"), F.when(F.col("o_orderkey") % 2 == 0, "nothing").otherwise(F.col("c_mktsegment")).alias("alias"), F.lit(2).alias("priority"))
    return joins.resolve_aliases(by_name.unionByName(by_segment), counted)


@query("j18_label_set_probe", "SELECT a.n_nationkey, b.r_regionkey, CAST(len(list_intersect(list_distinct(string_split(lower(a.n_name), '')), list_distinct(string_split(lower(b.r_name), '')))) AS BIGINT) AS common FROM nation a JOIN region b ON a.n_regionkey = b.r_regionkey")
def _(t):
    letters = lambda c: F.array_distinct(F.split(F.lower(c), ""))
    return t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_regionkey", LONG(F.size(F.array_intersect(letters("n_name"), letters("r_name")))).alias("common"))


PREFIXES = [("STANDARD", 8, 0), ("SMALL", 4, 1), ("MEDIUM", 16, 2), ("S", 1, 3), ("PROMO", 32, 4)]


@query(
    "j19_prefix_rules",
    "SELECT p_partkey, (CASE WHEN starts_with(p_type, 'STANDARD') THEN 8 WHEN starts_with(p_type, 'SMALL') THEN 4 WHEN starts_with(p_type, 'MEDIUM') THEN 16 WHEN starts_with(p_type, 'S') THEN 1 WHEN starts_with(p_type, 'PROMO') THEN 32 END)::BIGINT AS size_limit FROM part",
)
def _(t):
    p = t("part").select("p_partkey", "p_type")
    rules = p.sparkSession.createDataFrame(PREFIXES, "prefix string, size_limit long, rule_order int")
    return joins.longest_rule_first(p, "p_type", rules).select("p_partkey", "size_limit")


@query("j20_impact", "SELECT DISTINCT c_custkey FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size = 1)")
def _(t):
    touched = t("lineitem").select("l_orderkey", "l_partkey").join(t("part").where("p_size = 1").select(F.col("p_partkey").alias("l_partkey")), "l_partkey", "left_semi")
    return t("orders").join(touched, F.col("o_orderkey") == F.col("l_orderkey"), "left_semi").select(F.col("o_custkey").alias("c_custkey")).distinct().join(t("customer"), "c_custkey", "left_semi")


@query("a01_counts", "SELECT 'orders' AS name, count(*) AS n FROM orders UNION ALL SELECT 'open orders', count(*) FROM orders WHERE o_orderstatus = 'O'")
def _(t):
    o = t("orders")
    return o.agg(F.count("*").alias("a"), F.count_if(F.col("o_orderstatus") == "O").alias("b")).selectExpr("stack(2, 'orders', a, 'open orders', b) as (name, n)")


@query("a02_remapped_status", "SELECT CASE o_orderstatus WHEN 'O' THEN 'ready' WHEN 'F' THEN 'done' ELSE 'other' END AS status, count(*) AS n FROM orders GROUP BY 1")
def _(t):
    return t("orders").groupBy(F.when(F.col("o_orderstatus") == "O", "ready").when(F.col("o_orderstatus") == "F", "done").otherwise("other").alias("status")).agg(F.count("*").alias("n"))


@query("a03_distinct_over_join", "SELECT n_regionkey, count(DISTINCT o_custkey) AS customers FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey GROUP BY 1")
def _(t):
    return t("orders").join(t("customer"), F.col("c_custkey") == F.col("o_custkey")).join(t("nation"), F.col("n_nationkey") == F.col("c_nationkey")).groupBy("n_regionkey").agg(F.count_distinct("o_custkey").alias("customers"))


@query("a04_filtered_distincts", "SELECT event_type, count(DISTINCT user_id) FILTER (WHERE value > 50) AS high, count(DISTINCT user_id) FILTER (WHERE value <= 50) AS low, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("event_type").agg(F.count_distinct(F.when(F.col("value") > 50, F.col("user_id"))).alias("high"), F.count_distinct(F.when(F.col("value") <= 50, F.col("user_id"))).alias("low"), F.count_distinct("user_id").alias("users"))


@query("a05_usage_by_stage", "SELECT l_returnflag AS role, l_linestatus AS status, count(*) AS calls, CAST(sum(CAST(coalesce(l_extendedprice, 0) AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM lineitem GROUP BY 1, 2")
def _(t):
    return t("lineitem").groupBy(F.col("l_returnflag").alias("role"), F.col("l_linestatus").alias("status")).agg(F.count("*").alias("calls"), F.coalesce(MONEY("l_extendedprice"), F.lit(0.0)).alias("cost"))


@query("a06_errors_and_latency", "SELECT event_type, CAST(sum(CASE WHEN value > 95 THEN 1 ELSE 0 END) AS BIGINT) AS errors, max(value) AS max_latency, max(ts) AS last_used, quantile_disc(value, 0.95) AS p95_latency FROM events GROUP BY 1")
def _(t):
    """The true 95th percentile stands beside the maximum."""
    return t("events").groupBy("event_type").agg(F.sum(F.when(F.col("value") > 95, 1).otherwise(0)).alias("errors"), F.max("value").alias("max_latency"), F.max("ts").alias("last_used"), F.expr("percentile_disc(0.95) within group (order by value)").alias("p95_latency"))


@query("a07_daily_cost", "SELECT CAST(o_orderdate AS DATE) AS day, o_orderpriority AS role, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS cost FROM orders GROUP BY 1, 2")
def _(t):
    return t("orders").groupBy(F.to_date("o_orderdate").alias("day"), F.col("o_orderpriority").alias("role")).agg(MONEY("o_totalprice").alias("cost"))


@query("a08_conditional_counters", "SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS terminal, count(*) FILTER (WHERE l_returnflag = 'R') AS failed, count(*) AS total FROM lineitem GROUP BY 1")
def _(t):
    return t("lineitem").groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("terminal"), F.count_if(F.col("l_returnflag") == "R").alias("failed"), F.count("*").alias("total"))


@query("a09_duplicate_keys", "SELECT coalesce(text, '') AS k, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return t("documents").groupBy(F.coalesce("text", F.lit("")).alias("k")).agg(F.count("*").alias("n")).where("n > 1")


@query("a10_distinct_strings", "SELECT user_id, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("a11_next_index", "SELECT conv_id, max(turn) + 1 AS next_turn FROM conversations GROUP BY 1")
def _(t):
    return t("conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn"))


@query("a12_status_pivot", "SELECT l_orderkey, count(*) FILTER (WHERE l_linestatus = 'F') AS F, count(*) FILTER (WHERE l_linestatus = 'O') AS O, bool_and(l_linestatus = 'F') AS all_terminal FROM lineitem GROUP BY 1")
def _(t):
    li = t("lineitem")
    return li.groupBy("l_orderkey").agg(F.count_if(F.col("l_linestatus") == "F").alias("F"), F.count_if(F.col("l_linestatus") == "O").alias("O"), F.bool_and(F.col("l_linestatus") == "F").alias("all_terminal"))


@query(
    "a13_provider_breakdown",
    """WITH a AS (SELECT l_suppkey AS k, count(*) AS calls FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), b AS (SELECT l_suppkey AS k, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS tokens, CASE WHEN count(DISTINCT l_linestatus) = 1 THEN min(l_linestatus) END AS role FROM lineitem WHERE l_discount > 0.05 GROUP BY 1) SELECT coalesce(a.k, b.k) AS provider, coalesce(calls, 0) AS calls, coalesce(tokens, 0) AS tokens, role FROM a FULL JOIN b ON a.k = b.k""",
)
def _(t):
    li = t("lineitem")
    a = li.where("l_returnflag = 'R'").groupBy(F.col("l_suppkey").alias("provider")).agg(F.count("*").alias("calls"))
    b = li.where("l_discount > 0.05").groupBy(F.col("l_suppkey").alias("provider")).agg(F.sum(F.col("l_quantity").cast("long")).alias("tokens"), F.when(F.count_distinct("l_linestatus") == 1, F.min("l_linestatus")).alias("role"))
    return a.join(b, "provider", "full").select("provider", F.coalesce("calls", F.lit(0)).alias("calls"), F.coalesce("tokens", F.lit(0)).alias("tokens"), "role")


@query("a14_table_digest")
def _(t):
    return sets.digest(t("orders"))


@query(
    "a15_coverage_ratio",
    "SELECT o_orderpriority, CASE WHEN count(*) = 0 THEN 1.0::DOUBLE ELSE count(*) FILTER (WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R'))::DOUBLE / count(*) END AS coverage FROM orders GROUP BY 1",
)
def _(t):
    covered = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey")).distinct().withColumn("hit", F.lit(True))
    return t("orders").join(covered, "o_orderkey", "left").groupBy("o_orderpriority").agg(F.coalesce(F.count_if("hit").cast("double") / F.count("*"), F.lit(1.0)).alias("coverage"))


@query("a16_dry_run_reasons", "SELECT CASE WHEN text IS NULL THEN 'null' WHEN length(text) < 100 THEN 'short' WHEN lang <> 'en' THEN 'language' ELSE 'ok' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def _(t):
    return t("documents").groupBy(F.when(F.col("text").isNull(), "null").when(F.length("text") < 100, "short").when(F.col("lang") != "en", "language").otherwise("ok").alias("reason")).agg(F.count("*").alias("n"))


@query("a17_nearest_rank", "SELECT event_type, list_sort(list(value))[greatest(1, CAST(ceil(0.9 * count(*)) AS INT))] AS p90 FROM events GROUP BY 1")
def _(t):
    """percentile_disc is the nearest rank, and it is computed from counts and not from a collected list."""
    return t("events").groupBy("event_type").agg(F.expr("percentile_disc(0.9) within group (order by value)").alias("p90"))


def _ranked_percentile(t, index):
    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    e = t("events").withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(Window.partitionBy("event_type")))
    return e.where(F.col("i") == F.least(F.col("n") - 1, index(F.col("n")).cast("long"))).select("event_type", F.col("value").alias("p"))


@query("a18_floor_index_percentile", "SELECT event_type, list_sort(list(value))[least(count(*), CAST(floor(count(*) * 50 / 100.0) AS INT) + 1)] AS p FROM events GROUP BY 1")
def _(t):
    return _ranked_percentile(t, lambda n: F.floor(n * 50 / 100))


@query("a19_rounded_index_percentile", "SELECT event_type, list_sort(list(value))[CAST(round_even(0.75 * (count(*) - 1), 0) AS INT) + 1] AS p FROM events GROUP BY 1")
def _(t):
    return _ranked_percentile(t, lambda n: F.bround(F.lit(0.75) * (n - 1)))


@query("a20_mean_of_cases", "SELECT avg(CAST(quality AS DOUBLE)) AS quality, avg(CASE WHEN quality = 1 AND toxic = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS accuracy, count(*) AS cases FROM labels")
def _(t):
    return t("labels").agg(F.avg("quality").alias("quality"), F.avg(F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 1.0).otherwise(0.0)).alias("accuracy"), F.count("*").alias("cases"))


@query("a21_merged_counters", "SELECT k, CAST(sum(n) AS BIGINT) AS n FROM (SELECT l_returnflag AS k, count(*) AS n FROM lineitem GROUP BY 1 UNION ALL SELECT o_orderstatus, count(*) FROM orders GROUP BY 1) GROUP BY 1")
def _(t):
    parts = [t("lineitem").groupBy(F.col("l_returnflag").alias("k")).agg(F.count("*").alias("n")), t("orders").groupBy(F.col("o_orderstatus").alias("k")).agg(F.count("*").alias("n"))]
    return parts[0].unionByName(parts[1]).groupBy("k").agg(F.sum("n").alias("n"))


@query("a22_closure_keys", "SELECT 'lake:' || event_type || ':' || CASE WHEN value > 50 THEN 'erase' ELSE 'keep' END AS k, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(F.concat_ws(":", F.lit("lake"), "event_type", F.when(F.col("value") > 50, "erase").otherwise("keep")).alias("k")).agg(F.count("*").alias("n"))


@query("a23_zero_filled_lanes", "SELECT lane, count(event_id) AS depth, min(ts) AS oldest FROM (SELECT unnest(['click', 'view', 'purchase', 'idle']) AS lane) LEFT JOIN events ON event_type = lane GROUP BY 1")
def _(t):
    e = t("events").groupBy(F.col("event_type").alias("lane")).agg(F.count("*").alias("depth"), F.min("ts").alias("oldest"))
    lanes = e.sparkSession.createDataFrame([("click",), ("view",), ("purchase",), ("idle",)], "lane string")
    return lanes.join(e, "lane", "left").select("lane", F.coalesce("depth", F.lit(0)).alias("depth"), "oldest")


@query("a24_hourly_throughput", "SELECT date_trunc('hour', ts) AS hour, count(*) / 3600.0::DOUBLE AS per_second FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(F.window("ts", "1 hour").alias("w")).agg((F.count("*") / 3600.0).alias("per_second")).select(F.col("w.start").alias("hour"), "per_second")


@query("a25_branching_parents", "SELECT n_regionkey AS parent, count(*) AS children FROM nation GROUP BY 1 HAVING count(*) > 1")
def _(t):
    return t("nation").groupBy(F.col("n_regionkey").alias("parent")).agg(F.count("*").alias("children")).where("children > 1")


@query(
    "a26_merged_spans",
    """WITH s AS (SELECT l_orderkey AS doc, l_linenumber * 20 AS a, l_linenumber * 20 + CAST(l_quantity AS INT) AS b FROM lineitem), m AS (SELECT *, max(b) OVER (PARTITION BY doc ORDER BY a, b ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS past FROM s), i AS (SELECT *, sum(CASE WHEN past IS NULL OR a > past THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY a, b ROWS UNBOUNDED PRECEDING) AS isl FROM m) SELECT doc, min(a) AS "start", max(b) AS "end" FROM i GROUP BY doc, isl""",
)
def _(t):
    spans = t("lineitem").select(F.col("l_orderkey").alias("doc"), (F.col("l_linenumber") * 20).alias("start"), (F.col("l_linenumber") * 20 + F.rint("l_quantity").cast("int")).alias("end"))
    return sets.merged_spans(spans, ["doc"])


@query(
    "a27_adjacent_groups",
    """WITH x AS (SELECT conv_id, turn, role, CASE WHEN role = lag(role) OVER (PARTITION BY conv_id ORDER BY turn) THEN 0 ELSE 1 END AS b FROM conversations), r AS (SELECT *, sum(b) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM x) SELECT conv_id, CAST(run AS BIGINT) AS run, min(role) AS role, count(*) AS turns FROM r GROUP BY conv_id, run""",
)
def _(t):
    w = Window.partitionBy("conv_id").orderBy("turn")
    out = sets.runs(t("conversations"), ["conv_id"], ["turn"], F.lag("role").over(w) != F.col("role"))
    return out.groupBy("conv_id", "run").agg(F.min("role").alias("role"), F.count("*").alias("turns"))


@query("a28_cost_estimate", "SELECT o_orderkey, round(CAST((CAST(o_totalprice AS DECIMAL(18,2)) * 3 + o_custkey * 15) AS DOUBLE) / 1000, 6) AS cost FROM orders")
def _(t):
    cost = (F.col("o_totalprice").cast("decimal(18,2)") * 3 + F.col("o_custkey") * 15).cast("double") / 1000
    return t("orders").select("o_orderkey", F.round(cost, 6).alias("cost"))


@query("a29_retained_rows", "SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id = 7 UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id = 7 UNION ALL SELECT 'conversations', count(*) FROM conversations WHERE conv_id = 7")
def _(t):
    one = lambda name, key: t(name).where(F.col(key) == 7).agg(F.lit(name).alias("name"), F.count("*").alias("n"))
    return one("documents", "doc_id").unionByName(one("labels", "doc_id")).unionByName(one("conversations", "conv_id"))


@query("a30_first_wins_majority", "WITH c AS (SELECT conv_id, role, count(*) AS n, min(turn) AS f FROM conversations GROUP BY 1, 2) SELECT conv_id, role FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, f) AS rn FROM c) WHERE rn = 1")
def _(t):
    c = t("conversations").groupBy("conv_id", "role").agg(F.count("*").alias("n"), F.min("turn").alias("f"))
    return joins.latest(c, ["conv_id"], [F.col("n").desc(), F.col("f")]).select("conv_id", "role")


@query(
    "n01_latest_per_stage",
    "SELECT user_id, event_type, event_id, ok, bad FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn, max(CASE WHEN value <= 50 THEN ts END) OVER (PARTITION BY user_id, event_type) AS ok, max(CASE WHEN value > 50 THEN ts END) OVER (PARTITION BY user_id, event_type) AS bad FROM events) WHERE rn = 1",
)
def _(t):
    """One aggregate with max_by does the work of the windows, with a map-side combine."""
    g = t("events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max(F.when(F.col("value") <= 50, F.col("ts"))).alias("ok"), F.max(F.when(F.col("value") > 50, F.col("ts"))).alias("bad"))
    return g.select("user_id", "event_type", "event_id", "ok", "bad")


@query("n03_rank_in_list", "SELECT o_orderpriority, o_orderkey, rank FROM (SELECT o_orderpriority, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 20")
def _(t):
    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return t("orders").select("o_orderpriority", "o_orderkey", F.row_number().over(w).alias("rank")).where("rank <= 20").withColumn("rank", LONG("rank"))


@query(
    "n04_look_back",
    "SELECT a.conv_id, a.turn, coalesce(string_agg(b.role, ',' ORDER BY b.turn), '') AS before FROM conversations a LEFT JOIN (SELECT * FROM conversations) b ON a.conv_id = b.conv_id AND b.turn BETWEEN a.turn - 2 AND a.turn - 1 GROUP BY 1, 2",
)
def _(t):
    return joins.look_back(t("conversations"), ["conv_id"], ["turn"], F.col("role"), 2, "b").select("conv_id", "turn", F.array_join("b", ",").alias("before"))


@query("n07_close_previous", "SELECT o_custkey, o_orderkey, o_orderdate AS tx_from, lead(o_orderdate) OVER w AS tx_until, row_number() OVER w AS version FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)")
def _(t):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return t("orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("tx_from"), F.lead("o_orderdate").over(w).alias("tx_until"), LONG(F.row_number().over(w)).alias("version"))


@query("k01_top_k", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def _(t):
    return t("orders").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(25).select("o_orderkey", "o_totalprice")


@query("k02_multi_key_top", "SELECT p_partkey FROM part ORDER BY p_size DESC, p_retailprice DESC, p_partkey DESC LIMIT 30")
def _(t):
    return t("part").orderBy(F.col("p_size").desc(), F.col("p_retailprice").desc(), F.col("p_partkey").desc()).limit(30).select("p_partkey")


@query("k03_claim_order", "SELECT event_id FROM events ORDER BY value DESC, ts, event_id LIMIT 10")
def _(t):
    return t("events").orderBy(F.col("value").desc(), "ts", "event_id").limit(10).select("event_id")


@query("k05_route_choice", "SELECT user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY (event_type <> 'purchase'), value DESC, event_id) AS rn FROM events) WHERE rn = 1")
def _(t):
    return joins.latest(t("events"), ["user_id"], [(F.col("event_type") != "purchase").asc(), F.col("value").desc(), F.col("event_id")]).select("user_id", "event_id")


@query("k08_threshold_select", "SELECT label, vec_id, score FROM (SELECT label, vec_id, score, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS rn FROM (SELECT label, vec_id, round(embedding[1]::DOUBLE, 6) AS score FROM embeddings) WHERE score >= 0.18) WHERE rn <= 8")
def _(t):
    s = t("embeddings").select("label", "vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("score")).where("score >= 0.18")
    w = Window.partitionBy("label").orderBy(F.col("score").desc(), "vec_id")
    return s.withColumn("rn", F.row_number().over(w)).where("rn <= 8").drop("rn")


@query("u02_distinct", "SELECT DISTINCT lang, source FROM documents")
def _(t):
    return t("documents").select("lang", "source").distinct()


@query("u03_missing_keys", "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders")
def _(t):
    return t("customer").select(F.col("c_custkey").alias("k")).exceptAll(t("orders").select(F.col("o_custkey").alias("k"))).distinct().join(t("orders").select(F.col("o_custkey").alias("k")), "k", "left_anti")


@query("u05_keep_max", "WITH b AS (SELECT user_id AS k, max(value) AS score, 0 AS src FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT user_id, max(value), 1 FROM events WHERE event_type <> 'click' GROUP BY 1) SELECT k, score, src::BIGINT AS generator FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, src) AS rn FROM b) WHERE rn = 1")
def _(t):
    e = t("events")
    one = lambda cond, i: e.where(cond).groupBy(F.col("user_id").alias("k")).agg(F.max("value").alias("score")).withColumn("generator", F.lit(i).cast("long"))
    return sets.keep_max(one("event_type = 'click'", 0), one("event_type <> 'click'", 1), ["k"])


@query(
    "u06_diversity",
    "WITH d AS (SELECT *, row_number() OVER (PARTITION BY source, lower(lang), (n_chars > 9000) ORDER BY n_chars DESC, doc_id) AS rn FROM documents), k AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rank FROM d WHERE n_chars > 9000 OR rn = 1) SELECT source, doc_id, rank FROM k WHERE rank <= 8",
)
def _(t):
    d = t("documents").select("source", "lang", "n_chars", "doc_id")
    return sets.diverse(d, ["source"], F.lower("lang"), F.col("n_chars") > 9000, [F.col("n_chars").desc(), F.col("doc_id")], 8).select("source", "doc_id", LONG("rank").alias("rank"))


@query("u07_drop_repeats", "SELECT doc_id FROM (SELECT doc_id, text, first_value(text) OVER (PARTITION BY source ORDER BY doc_id) AS f, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn = 1 OR text IS DISTINCT FROM f")
def _(t):
    return sets.drop_repeats_of_first(t("documents").select("doc_id", "source", "text"), "source", "text", ["doc_id"]).select("doc_id")


@query("u09_replay_or_conflict", "SELECT doc_id, CASE WHEN row_number() OVER w = 1 THEN 'new' WHEN md5(text) = first_value(md5(text)) OVER w THEN 'replay' ELSE 'conflict' END AS outcome FROM documents WINDOW w AS (PARTITION BY source, lang, n_chars ORDER BY doc_id)")
def _(t):
    d = t("documents").select("doc_id", F.struct("source", "lang", "n_chars").alias("k"), F.md5(F.col("text").cast("binary")).alias("h"))
    return sets.replays(d, "k", "h", ["doc_id"]).select("doc_id", "outcome")


@query("u10_enqueue_once", "SELECT min(doc_id) AS doc_id, sha256(text) AS payload FROM documents GROUP BY 2")
def _(t):
    return t("documents").groupBy(F.sha2("text", 256).alias("payload")).agg(F.min("doc_id").alias("doc_id"))


@query("u11_table_diff", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def _(t):
    return t("documents").select("doc_id").exceptAll(t("labels").select("doc_id"))


@query("u12_union_dedup", "SELECT DISTINCT k FROM (SELECT 'doc:' || doc_id AS k FROM documents UNION ALL SELECT 'doc:' || doc_id FROM labels)")
def _(t):
    return t("documents").select(F.concat(F.lit("doc:"), "doc_id").alias("k")).unionByName(t("labels").select(F.concat(F.lit("doc:"), "doc_id").alias("k"))).dropDuplicates(["k"])


@query("q01_latest_by_subquery", "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 1) AS latest FROM customer")
def _(t):
    newest = t("orders").groupBy("o_custkey").agg(F.max_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("latest"))
    return t("customer").join(newest, F.col("c_custkey") == F.col("o_custkey"), "left").select("c_custkey", "latest")


@query("q03_state_transition", "SELECT event_id, CASE WHEN value >= 80 THEN 'dead' WHEN value >= 40 THEN 'pending' ELSE 'done' END AS state FROM events")
def _(t):
    return t("events").select("event_id", F.when(F.col("value") >= 80, "dead").when(F.col("value") >= 40, "pending").otherwise("done").alias("state"))


@query("w01_insert_or_ignore", "SELECT DISTINCT user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)")
def _(t):
    target = t("customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("user_id"))
    return sets.insert_new(target, t("events").select("user_id"), ["user_id"])


@query("w02_upsert", "WITH n AS (SELECT user_id AS k, arg_max(value, struct_pack(a := ts, b := event_id)) AS v FROM events GROUP BY 1) SELECT coalesce(n.k, c_custkey) AS k, CASE WHEN n.k IS NULL THEN c_acctbal ELSE v END AS v FROM customer FULL JOIN n ON n.k = c_custkey")
def _(t):
    target = t("customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"), F.lit(None).cast("timestamp").alias("ts"), F.lit(None).cast("long").alias("event_id"))
    rows = t("events").select(F.col("user_id").alias("k"), F.col("value").alias("v"), "ts", "event_id")
    return sets.upsert(target, rows, ["k"], F.struct("ts", "event_id").desc()).select("k", "v")


@query("w08_append_index", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) + coalesce(m, 0) AS event_index FROM events LEFT JOIN (SELECT o_custkey, count(*) AS m FROM orders GROUP BY 1) ON o_custkey = user_id")
def _(t):
    had = t("orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("m"))
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return t("events").join(had, "user_id", "left").select("event_id", (LONG(F.row_number().over(w)) + F.coalesce("m", F.lit(0))).alias("event_index"))
