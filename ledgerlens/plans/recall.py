"""Queries of retrieval, consolidation, trees, evaluation and governance over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed, shared_folder
from ..operators import consolidation, evaluation, joins, retrieval, segments, substrings, trees, vectors
from ..registry import query

LONG = lambda c: (F.col(c) if isinstance(c, str) else c).cast("long")
WORDS_SQL = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda w: w <> '')"


def _query_terms(t):
    """The five rarest-looking (longest, then first by name) words of each benchmark item."""
    words = F.array_distinct(retrieval.terms(F.col("text")))
    ranked = t("benchmark").select(F.col("item_id").alias("query"), F.explode(words).alias("term"))
    w = Window.partitionBy("query").orderBy(F.length("term").desc(), "term")
    return ranked.withColumn("n", F.row_number().over(w)).where("n <= 5").select("query", "term")


QT_SQL = f"""qt AS (SELECT query, term FROM (SELECT query, term, row_number() OVER (PARTITION BY query ORDER BY length(term) DESC, term) AS n FROM (SELECT item_id AS query, unnest(list_distinct({WORDS_SQL})) AS term FROM benchmark)) WHERE n <= 5)"""
BM_SQL = f"""d AS (SELECT doc_id, {WORDS_SQL} AS w FROM documents), st AS (SELECT count(*) AS n, avg(len(w)) AS m FROM d WHERE len(w) > 0),
p AS (SELECT term, doc_id, len, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM d) GROUP BY 1, 2, 3), {QT_SQL},
df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
sc AS (SELECT query, doc_id, round(sum(greatest(1e-6, ln((n - df + 0.5) / (df + 0.5))) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / m))), 6) AS score FROM qt JOIN p USING (term) JOIN df USING (term) CROSS JOIN st GROUP BY 1, 2),
bm AS (SELECT query, doc_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM sc) WHERE rank <= 20)"""


def bm25_list(t):
    q = _query_terms(t)
    index, stats = retrieval.asked(t("documents"), "doc_id", "text", q)
    return retrieval.bm25(index, q, "doc_id", "query", 20, stats)


@query("r04_postings", f"WITH d AS (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM documents), p AS (SELECT term, doc_id, count(*) AS tf FROM d GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY 1")
def _(t):
    return retrieval.postings(t("documents"), "doc_id", "text").groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query(
    "r04_incremental_index",
    f"""WITH f AS (SELECT doc_id, CASE WHEN toxic = 1 AND quality = 1 THEN 'restored ' || text WHEN toxic = 1 THEN NULL WHEN quality = 0 THEN text || ' revised' ELSE text END AS text FROM documents LEFT JOIN labels USING (doc_id)),
    d AS (SELECT doc_id, unnest({WORDS_SQL}) AS term FROM f), p AS (SELECT term, doc_id, count(*) AS tf FROM d GROUP BY 1, 2) SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS tf FROM p GROUP BY 1""",
)
def _(t):
    """The index after deletions, new texts, a merge and documents that come back, by segments."""
    d = t("documents").select("doc_id", "text")
    labelled = d.join(t("labels"), "doc_id")
    index = segments.SegmentedIndex(d.sparkSession, f"{shared_folder(d.sparkSession)}/index-{uuid.uuid4().hex}", "doc_id")
    index.rebuild(d)
    changed = labelled.where("toxic = 1 or quality = 0")
    index.append(changed.select("doc_id", F.concat("text", F.lit(" revised")).alias("text"), (F.col("toxic") == 1).alias("deleted")))
    index.merge()
    index.append(labelled.where("toxic = 1 and quality = 1").select("doc_id", F.concat(F.lit("restored "), "text").alias("text"), F.lit(False).alias("deleted")))
    return index.postings().groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))


@query("r03_bm25_top20", f"WITH {BM_SQL} SELECT query, doc_id, rank FROM bm")
def _(t):
    return bm25_list(t).select("query", "doc_id", "rank")


R05_SQL = "WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings), s AS (SELECT a.vec_id AS query, b.vec_id AS ver, round(list_dot_product(a.v, b.v) / (sqrt(list_dot_product(a.v, a.v)) * sqrt(list_dot_product(b.v, b.v))), 6) AS score FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0) SELECT query, ver, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, ver) AS rank FROM s) WHERE rank <= 20"


@query("r05_vector_top20", R05_SQL)
def _(t):
    """Queries are the vectors whose id 20 divides, against all vectors of their scope, in blocks; vectors without a direction meet the others one by one."""
    from ..functions.scoring import cosine

    e = t("embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    good = vectors.has_direction(F.col("vec"))
    query = F.col("id") % 20 == 0
    best = vectors.PivotSearch(e, pivots=0).search(e.where(query & good).select("scope", F.col("id").alias("query"), "vec"), 20)
    q, v = (x.select("scope", F.col("id").alias(name), F.col("vec").alias(c), good.alias(f"good_{c}")) for x, name, c in ((e.where(query), "query", "x"), (e, "ver", "y")))
    odd = lambda a, b: a.join(b, "scope").where("query <> ver").select("query", "ver", F.round(cosine(F.col("x"), F.col("y")), 6).alias("score"))
    s = best.select("query", F.col("id").alias("ver"), "score").unionByName(odd(q.where("not good_x"), v)).unionByName(odd(q.where("good_x"), v.where("not good_y")))
    return retrieval.top_k(s, ["query"], [F.col("score").desc(), F.col("ver")], 20)


@query("r05_pruned_search", R05_SQL)
def _(t):
    """The same as r05_vector_top20 by shards; those that cannot hold one of the 20 best are skipped."""
    e = t("embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    q = e.where("id % 20 = 0").select("scope", F.col("id").alias("query"), "vec")
    return vectors.PivotSearch(e).search(q, 20).select("query", F.col("id").alias("ver"), "score", "rank")


@query("r07_recency_top10", "SELECT user_id, event_id, rank FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rank FROM events) WHERE rank <= 10")
def _(t):
    return retrieval.top_k(t("events"), ["user_id"], [F.col("ts").desc(), F.col("event_id").desc()], 10).select("user_id", "event_id", "rank")


@query("r08_active_constraints", "SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderpriority, o_orderdate DESC, o_orderkey) AS rank FROM orders WHERE o_orderstatus = 'O') WHERE rank <= 10")
def _(t):
    return retrieval.top_k(t("orders").where("o_orderstatus = 'O'"), ["o_custkey"], [F.col("o_orderpriority"), F.col("o_orderdate").desc(), F.col("o_orderkey")], 10).select("o_custkey", "o_orderkey", "rank")


def hybrid(t):
    """BM25 and quality-labelled generators fused, best 30 of each query."""
    best = checkpointed(bm25_list(t))  # at most 20 rows a query, read twice
    lexical = best.select("query", "doc_id", F.lit("fts5_bm25").alias("generator"), "rank")
    good = t("labels").where("quality = 1 and toxic = 0").select("doc_id")
    recent = retrieval.top_k(best.join(good, "doc_id", "left_semi"), ["query"], [F.col("doc_id").desc()], 10).select("query", "doc_id", F.lit("recent_session").alias("generator"), "rank")
    return retrieval.fuse(lexical.unionByName(recent), "query", "doc_id")


HY_SQL = f"""WITH {BM_SQL}, rc AS (SELECT query, doc_id, rank FROM (SELECT query, doc_id, row_number() OVER (PARTITION BY query ORDER BY doc_id DESC) AS rank FROM bm WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1 AND toxic = 0)) WHERE rank <= 10),
f AS (SELECT query, doc_id, round(sum(w / (60 + rank)), 9) AS score FROM (SELECT query, doc_id, rank, 1.0::DOUBLE AS w FROM bm UNION ALL SELECT query, doc_id, rank, 0.6::DOUBLE FROM rc) GROUP BY 1, 2),
fu AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 30)"""


@query("r11_hybrid_fusion", HY_SQL + " SELECT query, doc_id, score, rank FROM fu")
def _(t):
    return hybrid(t).select("query", "doc_id", "score", "rank")


@query("r14_selection", HY_SQL + ", s AS (SELECT query, doc_id, score * 10 AS score, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc_id) AS rank FROM fu) SELECT query, doc_id, round(score, 6) AS score, rank, false AS abstain FROM s WHERE score >= 0.18 AND rank <= 8 UNION ALL SELECT DISTINCT query, NULL, NULL, NULL, true FROM s WHERE query NOT IN (SELECT query FROM s WHERE score >= 0.18 AND rank <= 8)")
def _(t):
    scored = hybrid(t).select("query", "doc_id", (F.col("score") * 10).alias("score"), F.lit(False).alias("conflict"))
    return retrieval.select(scored, "query", "doc_id").withColumn("score", F.round("score", 6))


@query("n05_budget_packing")
def _(t):
    items = t("documents").select("source", F.col("doc_id").alias("position"), F.col("n_chars").alias("size"))
    return retrieval.packed(items, "source", "position", "size", 20000)


@query("r17_query_terms", f"WITH {QT_SQL} SELECT query, count(*) AS n, string_agg(term, ' ' ORDER BY term) AS terms FROM qt GROUP BY 1")
def _(t):
    return _query_terms(t).groupBy("query").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("term")), " ").alias("terms"))


def _candidates(t):
    """Orders as candidates: the customer is the key, the priority the value, the status the polarity."""
    o = t("orders")
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    polarity = F.when(F.col("o_orderstatus") == "O", "affirmed").when(F.col("o_orderstatus") == "F", "negated").otherwise("unknown")
    status = F.when(F.col("o_orderkey") % 17 == 0, "rejected").when(F.col("o_orderkey") % 13 == 0, "needs_review").otherwise("ready")
    return o.select(F.col("o_custkey").alias("key"), LONG(F.row_number().over(w)).alias("seq"), status.alias("status"), F.lit("likes").alias("predicate"), F.substring("o_orderpriority", 1, 1).alias("text"), polarity.alias("polarity"))


CAND_SQL = """c AS (SELECT o_custkey AS key, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, CASE WHEN o_orderkey % 17 = 0 THEN 'rejected' WHEN o_orderkey % 13 = 0 THEN 'needs_review' ELSE 'ready' END AS status, left(o_orderpriority, 1) AS text, CASE o_orderstatus WHEN 'O' THEN 'affirmed' WHEN 'F' THEN 'negated' ELSE 'unknown' END AS pol FROM orders)"""
FOLD_SQL = f"""WITH RECURSIVE {CAND_SQL}, r AS (
SELECT key, 0::BIGINT AS seq, NULL::VARCHAR AS text, NULL::VARCHAR AS pol, 0::BIGINT AS version, NULL::VARCHAR AS operation FROM (SELECT DISTINCT key FROM c)
UNION ALL SELECT key, seq, CASE WHEN op IN ('ADD', 'SUPERSEDE') THEN ntext ELSE text END, CASE WHEN op IN ('ADD', 'SUPERSEDE') THEN npol ELSE pol END, version + CASE WHEN op IN ('ADD', 'SUPERSEDE') THEN 1 ELSE 0 END, op FROM (
SELECT r.key, c.seq, r.text, r.pol, r.version, c.text AS ntext, c.pol AS npol, CASE WHEN c.status = 'rejected' THEN 'REJECT' WHEN c.status = 'needs_review' THEN 'MANUAL_REVIEW' WHEN r.version = 0 THEN 'ADD' WHEN r.text = c.text THEN 'REINFORCE' WHEN r.pol <> 'unknown' AND c.pol <> 'unknown' AND r.pol <> c.pol THEN 'CONTRADICT' ELSE 'SUPERSEDE' END AS op FROM r JOIN c ON c.key = r.key AND c.seq = r.seq + 1))"""


@query("v02_consolidate", FOLD_SQL + " SELECT key, seq, operation, version FROM r WHERE seq > 0")
def _(t):
    return consolidation.consolidate(_candidates(t))


@query("v04_versions", FOLD_SQL + ", m AS (SELECT r.key, r.version, r.text, r.seq FROM r WHERE operation IN ('ADD', 'SUPERSEDE')) SELECT m.key, m.version, m.text, m.seq AS tx_from, lead(m.seq) OVER (PARTITION BY m.key ORDER BY m.version) AS tx_until, (SELECT count(*) FROM r x WHERE x.key = m.key AND x.version = m.version AND x.operation IN ('ADD', 'SUPERSEDE', 'REINFORCE')) AS evidence FROM m")
def _(t):
    c = _candidates(t)
    return consolidation.versions(consolidation.consolidate(c), c)


@query("v03_contradiction_table", "SELECT a.o_orderstatus AS x, b.o_orderstatus AS y, (a.o_orderstatus <> 'P' AND b.o_orderstatus <> 'P' AND a.o_orderstatus <> b.o_orderstatus) AS contradict FROM (SELECT DISTINCT o_orderstatus FROM orders) a, (SELECT DISTINCT o_orderstatus FROM orders) b")
def _(t):
    """All pairs of the three statuses that the table has, each status standing for a polarity."""
    s = t("orders").select("o_orderstatus").distinct()
    states = F.array(*map(F.lit, "FOP"))
    both = s.select(F.col("o_orderstatus").alias("x"), F.explode(states).alias("y")).join(s.select(F.col("o_orderstatus").alias("y")), "y")
    known = lambda c: F.when(F.col(c) == "P", "unknown").otherwise(F.col(c))
    return both.select("x", "y", consolidation.contradicts(known("x"), known("y")).alias("contradict"))


_OPS = ["confirm", "retract", "mark_incorrect", "undo", "correct", "undo", "pin"]


@query(
    "v07_corrections",
    FOLD_SQL + f""", h AS (SELECT key, version, max_by(text, seq) AS text FROM r WHERE operation IN ('ADD', 'SUPERSEDE') GROUP BY ALL), two AS (SELECT key, max(version) AS latest, max_by(text, version) AS cur FROM h GROUP BY 1),
base AS (SELECT two.*, coalesce(p.text, cur) AS prev FROM two LEFT JOIN h p ON p.key = two.key AND p.version = two.latest - 1),
o AS (SELECT user_id AS key, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS i, [{", ".join(f"'{x}'" for x in _OPS)}][event_id % 7 + 1] AS op, 'v' || (event_id % 5) AS val FROM events),
g AS (SELECT key, 0::BIGINT AS i, prev, cur, latest AS version, 'active' AS status FROM base UNION ALL SELECT g.key, o.i,
CASE WHEN op IN ('mark_incorrect', 'retract') OR (op = 'undo' AND version <= 1) THEN prev ELSE cur END, CASE WHEN op = 'undo' AND version > 1 THEN prev WHEN op = 'correct' THEN val ELSE cur END,
version + CASE WHEN op IN ('mark_incorrect', 'retract') OR (op = 'undo' AND version <= 1) THEN 0 ELSE 1 END, CASE op WHEN 'mark_incorrect' THEN 'needs_review' WHEN 'retract' THEN 'retracted' WHEN 'undo' THEN status ELSE 'active' END
FROM g JOIN o ON o.key = g.key AND o.i = g.i + 1) SELECT key, max_by(cur, i) AS text, max_by(version, i) AS version, max_by(status, i) AS status FROM g GROUP BY 1""",
)
def _(t):
    """All operations of a key in order; users' events stand for operations."""
    c = _candidates(t)
    history = consolidation.versions(consolidation.consolidate(c), c)
    kinds = F.element_at(F.array(*map(F.lit, _OPS)), (F.col("event_id") % 7 + 1).cast("int"))
    return consolidation.corrected(history, t("events").select(F.col("user_id").alias("key"), F.col("event_id").alias("seq"), kinds.alias("operation"), F.concat(F.lit("v"), F.col("event_id") % 5).alias("value")))


@query("v09_as_of", "SELECT o_custkey, o_orderkey FROM (SELECT *, lead(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS until FROM orders) WHERE o_orderdate <= TIMESTAMP '1995-06-17 00:00:00' AND (until IS NULL OR TIMESTAMP '1995-06-17 00:00:00' < until)")
def _(t):
    from ..functions.times import as_of

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    o = t("orders").withColumn("until", F.lead("o_orderdate").over(w))
    return o.where(as_of(F.col("o_orderdate"), F.col("until"), F.lit("1995-06-17").cast("timestamp"))).select("o_custkey", "o_orderkey")


_VERSIONS = """SELECT user_id, event_id AS version, ts - INTERVAL (event_id % 36) HOUR AS valid_from, CASE WHEN event_id % 11 <> 0 THEN ts - INTERVAL (event_id % 36) HOUR + INTERVAL (12 * (1 + event_id % 5)) HOUR END AS valid_until,
    ts AS known_from, lead(ts, 2) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS known_until FROM events"""


@query(
    "v09_bitemporal",
    f"WITH v AS ({_VERSIONS}), p AS (SELECT user_id, event_id AS probe, ts - INTERVAL 6 HOUR AS valid_at, ts + INTERVAL 30 MINUTE AS known_at FROM events) SELECT probe, version FROM p JOIN v USING (user_id) WHERE valid_from <= valid_at AND (valid_until IS NULL OR valid_at < valid_until) AND known_from <= known_at AND (known_until IS NULL OR known_at < known_until)",
)
def _(t):
    """Every event asks what was valid six hours before it, as it was known half an hour after it."""
    e = t("events").withColumn("ts", F.col("ts").cast("timestamp"))
    hours = lambda n: F.make_dt_interval(hours=n)
    since = F.col("ts") - hours((F.col("event_id") % 36).cast("int"))
    until = F.when(F.col("event_id") % 11 != 0, since + hours((12 * (1 + F.col("event_id") % 5)).cast("int")))
    later = F.lead("ts", 2).over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id"))
    v = e.select("user_id", F.col("event_id").alias("version"), since.alias("valid_from"), until.alias("valid_until"), F.col("ts").alias("known_from"), later.alias("known_until"))
    p = e.select("user_id", F.col("event_id").alias("probe"), (F.col("ts") - F.expr("INTERVAL 6 HOURS")).alias("valid_at"), (F.col("ts") + F.expr("INTERVAL 30 MINUTES")).alias("known_at"))
    return joins.as_of(p, v, "user_id").select("probe", "version")


def _nodes(t):
    """Turns as a tree: every third turn hangs two levels up, so conversations branch."""
    c = t("conversations")
    parent = F.when(F.col("turn") == 0, None).when((F.col("turn") % 3 == 0), F.col("turn") - 2).otherwise(F.col("turn") - 1)
    return c.select(F.col("conv_id").alias("conv"), F.col("turn").alias("node"), parent.alias("parent"))


NODE_SQL = "n AS (SELECT conv_id AS conv, turn AS node, CASE WHEN turn = 0 THEN NULL WHEN turn % 3 = 0 THEN turn - 2 ELSE turn - 1 END AS parent FROM conversations)"


@query("g01_active_path", f"WITH RECURSIVE {NODE_SQL}, l AS (SELECT conv, max(node) AS node FROM n GROUP BY 1), p AS (SELECT n.conv, n.node, n.parent FROM n JOIN l USING (conv, node) UNION ALL SELECT n.conv, n.node, n.parent FROM n JOIN p ON n.conv = p.conv AND n.node = p.parent) SELECT conv, node, row_number() OVER (PARTITION BY conv ORDER BY node) - 1 AS position FROM p")
def _(t):
    n = _nodes(t)
    return trees.active_path(n, n.groupBy("conv").agg(F.max("node").alias("leaf"))).select("conv", "node", LONG("position").alias("position"))


@query(
    "g02_validation",
    f"""WITH RECURSIVE {NODE_SQL}, k AS (SELECT conv, node, CASE WHEN node = 3 AND conv % 2 = 0 THEN 99 WHEN conv % 5 = 1 AND node = 1 THEN 2 WHEN conv % 5 = 1 AND node = 2 THEN 1 WHEN conv % 9 = 4 AND node = 0 THEN 0 ELSE parent END AS parent FROM n),
w AS (SELECT conv, node AS start, parent AS cur, 1 AS d FROM k WHERE parent IS NOT NULL AND parent <> node UNION ALL SELECT w.conv, w.start, k.parent, d + 1 FROM w JOIN k ON k.conv = w.conv AND k.node = w.cur WHERE w.cur <> w.start AND k.parent IS NOT NULL AND k.parent <> k.node AND d < 70),
l AS (SELECT conv, CASE WHEN conv % 7 = 0 THEN 999 ELSE max(node) END AS leaf FROM k GROUP BY conv)
SELECT conv, node, 'missing_parent' AS issue FROM k WHERE parent IS NOT NULL AND NOT EXISTS (SELECT 1 FROM k x WHERE x.conv = k.conv AND x.node = k.parent)
UNION ALL SELECT conv, node, 'self_parent' FROM k WHERE node = parent UNION ALL SELECT DISTINCT conv, start, 'message_cycle' FROM w WHERE cur = start
UNION ALL SELECT conv, leaf, 'missing_active_leaf' FROM l WHERE NOT EXISTS (SELECT 1 FROM k WHERE k.conv = l.conv AND k.node = l.leaf)""",
)
def _(t):
    """Trees with faults put in: parents that are missing, circles of two, a root that is its own parent, leaves that do not exist."""
    conv, node = F.col("conv"), F.col("node")
    parent = F.when((node == 3) & (conv % 2 == 0), 99).when((conv % 5 == 1) & (node == 1), 2).when((conv % 5 == 1) & (node == 2), 1).when((conv % 9 == 4) & (node == 0), 0).otherwise(F.col("parent"))
    nodes = _nodes(t).withColumn("parent", parent)
    return trees.validate(nodes, nodes.groupBy("conv").agg(F.max(F.when(conv % 7 == 0, 999).otherwise(node)).alias("leaf")))


@query("g03_branch_points", f"WITH {NODE_SQL} SELECT conv, parent AS node, count(*) AS children FROM n WHERE parent IS NOT NULL GROUP BY 1, 2 HAVING count(*) > 1")
def _(t):
    return trees.branch_points(_nodes(t))


@query("g06_lineage_edges", "SELECT kind, count(*) AS edges FROM (SELECT DISTINCT 'PLACED' AS kind, o_custkey AS a, o_orderkey AS b FROM orders UNION ALL SELECT DISTINCT 'CONTAINS', l_orderkey, l_partkey FROM lineitem UNION ALL SELECT DISTINCT 'SUPPLIED', l_suppkey, l_partkey FROM lineitem) GROUP BY 1")
def _(t):
    li = t("lineitem").select(F.explode(F.array(F.struct(F.lit("CONTAINS").alias("kind"), F.col("l_orderkey").alias("a"), F.col("l_partkey").alias("b")), F.struct(F.lit("SUPPLIED").alias("kind"), F.col("l_suppkey").alias("a"), F.col("l_partkey").alias("b")))).alias("e")).select("e.*")
    edges = t("orders").select(F.lit("PLACED").alias("kind"), F.col("o_custkey").alias("a"), F.col("o_orderkey").alias("b")).unionByName(li).dropDuplicates()
    return edges.groupBy("kind").agg(F.count("*").alias("edges"))


@query("g07_nested_lineage", "SELECT o_orderkey, count(l_linenumber) AS n, coalesce(string_agg(l_linenumber || ':' || l_partkey, ',' ORDER BY l_linenumber, l_partkey), '') AS parts FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def _(t):
    lines = t("lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("ls"))
    o = t("orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return o.select("o_orderkey", F.when(F.col("ls").isNull(), 0).otherwise(LONG(F.size("ls"))).alias("n"), F.coalesce(F.array_join(F.transform("ls", lambda x: F.concat_ws(":", x["l_linenumber"], x["l_partkey"])), ","), F.lit("")).alias("parts"))


@query(
    "e10_ranking_metrics",
    f"""WITH {BM_SQL}, w AS (SELECT DISTINCT item_id AS query, doc_id FROM benchmark JOIN documents ON contains(documents.text, benchmark.text)), n AS (SELECT query, count(*) AS want FROM w GROUP BY 1),
h AS (SELECT bm.*, (w.doc_id IS NOT NULL) AS hit FROM bm LEFT JOIN w ON w.query = bm.query AND w.doc_id = bm.doc_id),
g AS (SELECT query, count(*) FILTER (WHERE rank <= 10) AS shown, count(*) FILTER (WHERE rank <= 10 AND hit) AS found, min(rank) FILTER (WHERE hit) AS first, coalesce(sum(1 / log2(rank + 1.0)) FILTER (WHERE rank <= 10 AND hit), 0) AS gain FROM h GROUP BY 1)
SELECT item_id AS "case", round(CASE WHEN want IS NULL THEN 1.0 ELSE coalesce(found, 0) / want::DOUBLE END, 6) AS recall, round(CASE WHEN coalesce(shown, 0) = 0 THEN CASE WHEN want IS NULL THEN 1.0 ELSE 0.0 END ELSE found / shown::DOUBLE END, 6) AS precision,
round(CASE WHEN want IS NULL THEN 1.0 WHEN first IS NULL THEN 0.0 ELSE 1.0::DOUBLE / first END, 6) AS mrr, round(CASE WHEN want IS NULL THEN 1.0 ELSE coalesce(gain, 0) / list_sum(list_transform(range(1, least(want, 10) + 1), lambda i: 1 / log2(i + 1.0))) END, 6) AS ndcg
FROM benchmark LEFT JOIN n ON n.query = item_id LEFT JOIN g ON g.query = item_id""",
)
def _(t):
    """Documents that contain the item are what BM25 should find."""
    items = t("benchmark").select(F.col("item_id").alias("case"), F.col("text").alias("needle"))
    expected = substrings.containing(t("documents"), "doc_id", "text", items).join(items, "needle").select("case", F.col("doc_id").alias("key"))
    results = bm25_list(t).select(F.col("query").alias("case"), F.col("doc_id").alias("key"), "rank")
    return evaluation.metrics(results, expected, items, 10)


@query("e01_erasure_closure", "WITH t AS (SELECT c_custkey AS id FROM customer WHERE c_acctbal < -900), o AS (SELECT o_orderkey AS id FROM orders WHERE o_custkey IN (SELECT id FROM t)) SELECT 'target' AS record_type, id::VARCHAR AS record_id FROM t UNION ALL SELECT 'order', id::VARCHAR FROM o UNION ALL SELECT DISTINCT 'part', l_partkey::VARCHAR FROM lineitem WHERE l_orderkey IN (SELECT id FROM o)")
def _(t):
    return evaluation.erasure_closure(t("customer").where("c_acctbal < -900").select(F.col("c_custkey").alias("id")), [("order", t("orders"), "o_custkey", "o_orderkey"), ("part", t("lineitem"), "l_orderkey", "l_partkey")])


@query("e02_erased_projection", "SELECT conv_id, turn, CASE WHEN conv_id IN (SELECT doc_id FROM labels WHERE toxic = 1) THEN '[erased]' ELSE text END AS text FROM conversations")
def _(t):
    return evaluation.erased(t("conversations"), t("labels").where("toxic = 1").select(F.col("doc_id").alias("id")), "conv_id", ["text"]).select("conv_id", "turn", "text")


@query("e04_residue", "SELECT 'documents' AS \"table\", doc_id::VARCHAR AS key FROM (SELECT doc_id FROM documents WHERE contains(text, 'MIT License') OR contains(text, 'CC BY-NC') ORDER BY doc_id LIMIT 20)")
def _(t):
    d = t("documents")
    return evaluation.residue([("documents", d, "doc_id", "text")], d.sparkSession.createDataFrame([("MIT License",), ("CC BY-NC",)], "fragment string"))


@query("e07_consistency", "SELECT 'orders without customer' AS check_name, count(*) AS n FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer) UNION ALL SELECT 'lines without order', count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders) UNION ALL SELECT 'duplicate documents', count(*) FROM (SELECT text FROM documents GROUP BY 1 HAVING count(*) > 1)")
def _(t):
    from ..operators.joins import orphans

    one = lambda df, name: df.agg(F.lit(name).alias("check_name"), F.count("*").alias("n"))
    return one(orphans(t("orders"), t("customer"), "o_custkey", "c_custkey"), "orders without customer").unionByName(one(orphans(t("lineitem"), t("orders"), "l_orderkey", "o_orderkey"), "lines without order")).unionByName(one(t("documents").groupBy("text").count().where("count > 1"), "duplicate documents"))


@query("c01_gate", "SELECT conv_id, turn, CASE WHEN lower(trim(text)) IN ('hi', 'ok', 'test', 'ping') THEN 'discard' WHEN contains(l, 'the ') OR contains(l, 'de ') THEN 'candidate' WHEN contains(l, 'token') THEN 'review' ELSE 'ignore' END AS decision FROM (SELECT *, lower(text) AS l FROM conversations)")
def _(t):
    from .gates import gate

    return t("conversations").select("conv_id", "turn", gate(F.col("text"), ["the ", "de "], ["hi", "ok", "test", "ping"], ["token"]).alias("decision"))


@query("c06_routes", "SELECT conv_id, turn, r AS route, CASE WHEN r = 'privacy' THEN 95 WHEN r = 'project' THEN 60 ELSE 20 END AS priority FROM (SELECT conv_id, turn, unnest(CASE WHEN role = 'system' THEN ['manual'] WHEN length(text) > 500 THEN ['project', 'personal'] WHEN role = 'user' THEN ['privacy'] ELSE ['manual'] END) AS r FROM conversations)")
def _(t):
    from .gates import routes

    rules = [(F.col("role") == "system", [("manual", 20)]), (F.length("text") > 500, [("project", 60), ("personal", 20)]), (F.col("role") == "user", [("privacy", 95)])]
    return routes(t("conversations"), rules, [("manual", 20)]).select("conv_id", "turn", "route", "priority")


@query("c19_disposition", "SELECT doc_id, CASE WHEN toxic = 1 AND quality = 0 THEN 'review' WHEN toxic = 1 THEN 'unsupported' WHEN quality = 0 THEN 'context_only' ELSE 'durable' END AS disposition FROM labels")
def _(t):
    from .gates import first_of

    return t("labels").select("doc_id", first_of([("review", (F.col("toxic") == 1) & (F.col("quality") == 0)), ("unsupported", F.col("toxic") == 1), ("context_only", F.col("quality") == 0)], "durable").alias("disposition"))


def flagship(spark, sf_dir):
    """Hybrid recall: BM25 and labelled candidates fused and selected for every benchmark item."""
    t = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return retrieval.select(hybrid(t).select("query", "doc_id", (F.col("score") * 10).alias("score"), F.lit(False).alias("conflict")), "query", "doc_id")
