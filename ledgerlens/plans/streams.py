"""Queries of sources, Unicode text functions and streams over the test tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from ..functions import ijson, registered
from ..functions import sentence_units as S
from ..functions import unicode_text as U
from ..operators import lexicons, sets, spans, trees
from ..registry import query
from ..sources import datasource, exports
from ..streaming import ledger


#: Fixed value: the namespace of URLs.
URL_NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def _json(rows: DataFrame) -> DataFrame:
    return rows.select(F.lit("conversations").alias("path"), F.to_json("v").alias("value"))


def _linear(t) -> DataFrame:
    """The conversations as a linear export, one file for each."""
    m = F.struct(F.concat_ws("-", "conv_id", "turn").alias("uuid"), F.col("role").alias("sender"), "text", F.lit("2024-01-01T00:00:00Z").alias("created_at"))
    g = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", m.alias("m")))).alias("ms"))
    return _json(g.select(F.array(F.struct(F.col("conv_id").cast("string").alias("uuid"), F.lit("chat").alias("name"), F.transform("ms", lambda x: x["m"]).alias("chat_messages"))).alias("v")))


@query("s08_format_probe", "SELECT 'linear' AS format, count(DISTINCT conv_id) AS files FROM conversations")
def _(t):
    return exports.probe(_linear(t)).groupBy("format").agg(F.count("*").alias("files"))


@query("s10_linear_adapter", "SELECT conv_id::VARCHAR AS conv, conv_id || '-' || turn AS node, CASE WHEN turn > 0 THEN conv_id || '-' || (turn - 1) END AS parent, role, text, turn = max(turn) OVER (PARTITION BY conv_id) AS active FROM conversations")
def _(t):
    return exports.read_linear(_linear(t)).select("conv", "node", "parent", "role", "text", "active")


@query("s09_tree_adapter", "SELECT conv_id::VARCHAR AS conv, turn::VARCHAR AS node, CASE WHEN turn > 0 THEN (turn - 1)::VARCHAR END AS parent, role, text FROM conversations")
def _(t):
    message = F.struct(F.struct("role").alias("author"), F.struct(F.lit("text").alias("content_type"), F.array("text").alias("parts")).alias("content"), F.lit(1700000000.0).alias("create_time"))
    node = F.struct(F.col("turn").cast("string").alias("id"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"), message.alias("message"))
    g = t("conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), node))).alias("mapping"), F.max("turn").cast("string").alias("leaf"))
    payload = _json(g.select(F.array(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("x").alias("title"), F.col("leaf").alias("current_node"), "mapping")).alias("v")))
    return exports.read_tree(payload).select("conv", "node", "parent", "role", "text")


@query(
    "s09_active_paths",
    """WITH RECURSIVE n AS (SELECT conv_id, turn, CASE WHEN turn = 0 THEN CASE WHEN conv_id % 5 = 0 THEN max(turn) OVER (PARTITION BY conv_id) END WHEN turn % 3 = 0 THEN turn - 2 ELSE turn - 1 END AS parent, turn = max(turn) OVER (PARTITION BY conv_id) AS leaf FROM conversations),
    p(conv_id, turn, steps) AS (SELECT conv_id, turn, 0 FROM n WHERE leaf UNION ALL SELECT n.conv_id, n.parent, p.steps + 1 FROM p JOIN n ON n.conv_id = p.conv_id AND n.turn = p.turn JOIN (SELECT conv_id, max(turn) AS most FROM conversations GROUP BY 1) m ON m.conv_id = p.conv_id WHERE n.parent IS NOT NULL AND p.steps <= m.most)
    SELECT conv_id::VARCHAR AS conv, turn::VARCHAR AS node, min(steps)::BIGINT AS steps FROM p GROUP BY 1, 2""",
)
def _(t):
    """Trees with branches, some with a root that hangs on its own leaf: what the walk from the active leaf meets, each node once."""
    c = t("conversations")
    last = F.max("turn").over(Window.partitionBy("conv_id"))
    parent = F.when(F.col("turn") == 0, F.when(F.col("conv_id") % 5 == 0, last)).when(F.col("turn") % 3 == 0, F.col("turn") - 2).otherwise(F.col("turn") - 1)
    node = F.struct(F.col("turn").cast("string").alias("id"), parent.cast("string").alias("parent"), F.struct(F.struct("role").alias("author"), F.struct(F.array("text").alias("parts")).alias("content")).alias("message"))
    made = c.select("conv_id", "turn", node.alias("n"))
    g = made.groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct("n.id", "n"))).alias("mapping"), F.max("turn").cast("string").alias("leaf"))
    payload = _json(g.select(F.array(F.struct(F.col("conv_id").cast("string").alias("id"), F.col("leaf").alias("current_node"), "mapping")).alias("v")))
    nodes = checkpointed(exports.read_tree(payload).select("conv", "node", "parent", "active"))
    return trees.walked(nodes.select("conv", "node", "parent"), nodes.where("active").select("conv", F.col("node").alias("leaf")))


def _mixed(t) -> DataFrame:
    """A JSON line for each conversation in one of four formats; every eleventh is cut off in the middle and every thirteenth is of no format."""
    m = t("conversations").select("conv_id", "turn", F.struct(F.col("turn").cast("string").alias("id"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"), "role", "text").alias("m"))
    g = m.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "m"))).alias("ms"), F.max("turn").cast("string").alias("leaf")).withColumn("ms", F.transform("ms", lambda x: x["m"]))
    conv = F.col("conv_id").cast("string").alias("id")
    by_id = lambda make: F.map_from_entries(F.transform("ms", lambda x: F.struct(x["id"], make(x))))
    tree = F.struct(conv, F.col("leaf").alias("current_node"), by_id(lambda x: F.struct(x["id"].alias("id"), x["parent"].alias("parent"), F.struct(F.struct(x["role"].alias("role")).alias("author"), F.struct(F.array(x["text"]).alias("parts")).alias("content")).alias("message"))).alias("mapping"))
    history = F.struct(conv, F.struct(F.struct(F.col("leaf").alias("currentId"), by_id(lambda x: F.struct(x["id"].alias("id"), x["parent"].alias("parentId"), x["role"].alias("role"), x["text"].alias("content"))).alias("messages")).alias("history")).alias("chat"))
    linear = F.struct(F.col("conv_id").cast("string").alias("uuid"), F.transform("ms", lambda x: F.struct(x["id"].alias("uuid"), x["role"].alias("sender"), x["text"].alias("text"))).alias("chat_messages"))
    generic = F.struct(F.lit("conversation-import").alias("format"), F.array(F.struct(conv, F.col("ms").alias("messages"))).alias("conversations"))
    kind = F.col("conv_id") % 4
    line = F.when(F.col("conv_id") % 11 == 0, F.expr("left(line, length(line) div 2)")).when(F.col("conv_id") % 13 == 0, F.lit('{"something": "else"}')).otherwise(F.col("line"))
    return g.withColumn("line", F.when(kind == 0, F.to_json(tree)).when(kind == 1, F.to_json(linear)).when(kind == 2, F.to_json(history)).otherwise(F.to_json(generic))).select(line.alias("value"))


def _imported(t) -> tuple[DataFrame, DataFrame]:
    folder = f"{_folder(t)}/exports"
    _mixed(t).write.text(folder)
    files = checkpointed(datasource.read_files(t("region").sparkSession, folder, kind="jsonl"))
    return datasource.imported(files)


@query("s05_mixed_exports", "SELECT conv_id::VARCHAR AS conv, turn::VARCHAR AS node, CASE WHEN turn > 0 THEN (turn - 1)::VARCHAR END AS parent, role, text, ['tree', 'linear', 'history', 'generic'][conv_id % 4 + 1] AS format FROM conversations WHERE conv_id % 11 <> 0 AND conv_id % 13 <> 0")
def _(t):
    """Conversations in four formats, written as files and read by the data source and the adapters."""
    return _imported(t)[0].select("conv", "node", "parent", "role", "text", "format")


@query("s05_import_faults", "SELECT CASE WHEN conv_id % 11 = 0 THEN 'malformed' ELSE 'unknown_format' END AS fault, count(DISTINCT conv_id) AS n FROM conversations WHERE conv_id % 11 = 0 OR conv_id % 13 = 0 GROUP BY 1")
def _(t):
    """What the same import could not read."""
    return _imported(t)[1].groupBy("fault").agg(F.count("*").alias("n"))


@query("s12_html_text")
def _(t):
    return t("pages").select("page_id", exports.html_text("html").alias("text"))


#: Archives of the pages by page_id % 9: a sound one, and those with a reason to refuse them.
_ARCHIVES = """WITH m AS (SELECT page_id % 9 AS a, CASE page_id % 9 WHEN 3 THEN '../etc/x' WHEN 4 THEN '/etc/x' WHEN 7 THEN 'in' || page_id || '.zip' ELSE 'f' || page_id END AS name,
    CASE page_id % 9 WHEN 1 THEN 60000000 WHEN 2 THEN 1000 WHEN 8 THEN 1 ELSE length(html) + 1 END AS packed, CASE page_id % 9 WHEN 2 THEN 300000000 WHEN 5 THEN (length(html) + 1) * 101 WHEN 8 THEN 1 ELSE length(html) END AS size FROM pages)"""


@query(
    "s07_archive_verdict",
    _ARCHIVES + """ SELECT 'z' || a AS archive, CASE WHEN sum(packed) > 50 * 1048576 THEN 'too_large' WHEN sum(size) > 250 * 1048576 THEN 'expands_too_far' WHEN a = 5 THEN 'ratio' WHEN a = 8 THEN 'too_many_files' WHEN a IN (3, 4) THEN 'unsafe_path' WHEN a = 6 THEN 'special_file' WHEN a = 7 AND count(*) > 1 THEN 'nested' END AS reason FROM m GROUP BY a""",
)
def _(t):
    """All pages as members of archives that are refused for every reason there is; in archive 8 one page stands for ten thousand members and one."""
    a = F.col("page_id") % 9
    size = F.length("html")
    name = F.when(a == 3, "../etc/x").when(a == 4, "/etc/x").when(a == 7, F.concat(F.lit("in"), "page_id", F.lit(".zip"))).otherwise(F.concat(F.lit("f"), "page_id"))
    packed = F.when(a == 1, F.lit(60_000_000)).when(a == 2, F.lit(1000)).when(a == 8, F.lit(1)).otherwise(size + 1)
    out = F.when(a == 2, F.lit(300_000_000)).when(a == 5, (size + 1) * 101).when(a == 8, F.lit(1)).otherwise(size)
    members = t("pages").select(F.concat(F.lit("z"), a).alias("archive"), name.alias("name"), packed.alias("packed"), out.alias("size"), F.when(a == 6, 0o120777).otherwise(0).alias("mode"), F.explode(F.sequence(F.lit(1), F.when(F.col("page_id") == 8, 10_001).otherwise(1))))
    return exports.archive_verdict(members).select("archive", "reason")


@query(
    "s16_generated_conversations",
    """WITH c AS (SELECT c_custkey AS id FROM customer)
    SELECT (SELECT count(*) FROM c) + (SELECT count(*) FROM c WHERE id % 10 = 0) AS conversations, (SELECT count(*) FROM c WHERE id % 7 = 0) + (SELECT count(*) FROM c WHERE id % 70 = 0) AS malformed,
    (SELECT count(*) FROM c WHERE id % 7 <> 0) * 12 + (SELECT count(*) FROM c WHERE id % 10 = 0 AND id % 7 <> 0) * 12 AS messages, (SELECT count(*) FROM c WHERE id % 7 <> 0) * 2 + (SELECT count(*) FROM c WHERE id % 10 = 0 AND id % 7 <> 0) * 2 AS branch_messages""",
)
def _(t):
    """A conversation for every customer, with branches, copies and malformed ones among them."""
    g = exports.generated(t("customer").select(F.col("c_custkey").alias("id")), 10, branches=3, duplicate_every=10, malformed_every=7)
    return g.agg(F.count_distinct("conv", "copy").alias("conversations"), F.count_distinct(F.when(F.col("node").isNull(), F.struct("conv", "copy"))).alias("malformed"), F.count("node").alias("messages"), F.count_if(F.contains("node", F.lit("branch"))).alias("branch_messages"))


@query("f01_normalize")
def _(t):
    return t("documents").select("doc_id", U.normalized(F.col("text")).alias("text"))


@query("f06_tokens", "SELECT conv_id, turn, coalesce(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}][\\p{L}\\p{N}\\p{M}]*')), 0) AS tokens FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", F.coalesce(F.size(U.words(F.col("text"))), F.lit(0)).cast("long").alias("tokens"))


@query("f13_sentences")
def _(t):
    return t("conversations").select("conv_id", "turn", "text", F.explode(U.sentences_udf("text")).alias("s")).select("conv_id", "turn", "s.start", "s.end", F.expr("substring(text, s.start + 1, s.end - s.start)").alias("sentence"))


@query("f15_units")
def _(t):
    return t("documents").select("doc_id", F.explode(U.units_udf("text")).alias("u")).groupBy("doc_id", "u.kind").agg(F.count("*").alias("n"))


@query("f05_blocks")
def _(t):
    """Every block of every document: its place, kind and span."""
    b = t("documents").select("doc_id", F.posexplode(U.blocks_udf("text")).alias("place", "b"))
    return b.select("doc_id", "place", "b.kind", "b.start", "b.end")


@query("f05_block_kinds")
def _(t):
    """Blocks of each kind in every document, fenced or not; an empty or null text has none."""
    fenced = F.contains("text", F.lit("```")) | F.contains("text", F.lit("~~~"))
    # a text without fences is one block of prose, so only the others go through the Arrow function
    b = t("documents").select("doc_id", "text", F.coalesce(fenced, F.lit(False)).alias("fenced")).select("doc_id", "fenced", (F.length("text") > 0).alias("any"), U.blocks_udf(F.when(F.col("fenced"), F.col("text"))).alias("b"))
    of = lambda kind: F.size(F.filter("b", lambda x: x["kind"] == kind)).cast("long").alias(kind)
    whole = F.when(F.coalesce("any", F.lit(False)), 1).otherwise(0).cast("long")
    return b.select("doc_id", F.when(F.col("fenced"), of("prose")).otherwise(whole).alias("prose"), F.when(F.col("fenced"), of("code")).otherwise(F.lit(0).cast("long")).alias("code"))


@query("f16_sentence_units")
def _(t):
    """Sentence units of all documents by lines, with ids made of the document, the place and the unit's digest."""
    each = t("documents").select("doc_id", "text", F.posexplode(S.sentence_units_udf("text")).alias("at", "u"))
    cut = each.select("doc_id", (F.col("at") + 1).alias("place"), "u.*", F.expr("substring(text, u.start + 1, u.end - u.start)").alias("sentence"))
    name = F.concat_ws(":", F.lit("unit"), "doc_id", "place", F.sha2("sentence", 256))
    return cut.withColumns({"script": S.script(F.col("sentence")), "unit_id": ijson.uuid5(URL_NAMESPACE, name)})


def _lexicons(t) -> DataFrame:
    """The fixed lexicons, and a large one of the clauses of the benchmark's items (a phrase has no marks inside) of three words and more."""
    fixed = {"negation": U.NEGATIONS + U.CONTRACTIONS, "supposition": U.SUPPOSITIONS, "deictic": U.DEICTICS}
    rows = t("benchmark").sparkSession.createDataFrame([(name, p) for name, ps in fixed.items() for p in ps], "lexicon string, phrase string")
    clauses = t("benchmark").select(F.lit("benchmark").alias("lexicon"), F.explode(F.split("text", r"[^\p{L}\p{N}\p{M} ]+")).alias("phrase"))
    return rows.unionByName(clauses.where(F.trim("phrase").rlike(r"\S+ +\S+ +\S+")))


@query("f12_lexicon_hits")
def _(t):
    """All lexicons over all documents: hits that do not overlap, the first one's raw span and text."""
    d = t("documents").select("doc_id", "text")
    found = lexicons.find(d, "doc_id", "text", _lexicons(t)).groupBy("doc_id", "lexicon").agg(F.count("*").alias("hits"), F.min(F.struct("start", "end")).alias("first"))
    cut = F.expr("substring(text, first.start + 1, first.end - first.start)")
    return found.join(d, "doc_id").select("doc_id", "lexicon", "hits", "first.start", "first.end", cut.alias("evidence"))


@query("f09_all_phrases")
def _(t):
    """Every negation of every message with its raw span, those that do not overlap."""
    m = t("conversations").select(F.struct("conv_id", "turn").alias("message"), "text")
    return lexicons.find(m, "message", "text", _lexicons(t).where("lexicon = 'negation'")).select("message.*", "phrase", "start", "end")


@query("k07_overlaps")
def _(t):
    """Of all hits in each document, overlapping ones too, how many are kept as leftmost and longest."""
    found = checkpointed(lexicons.all_hits(t("documents").select("doc_id", "text"), "doc_id", "text", _lexicons(t)))
    kept = lexicons.resolved(found, "doc_id").groupBy("doc_id", "lexicon").agg(F.count("*").alias("kept"))
    return found.groupBy("doc_id", "lexicon").agg(F.count("*").alias("hits")).join(kept, ["doc_id", "lexicon"])


@query("f03_raw_spans")
def _(t):
    """Every token of every message: its span in the normalised text and the raw span that it stands for."""
    m = t("conversations").select(F.struct("conv_id", "turn").alias("message"), "text")
    n = m.select("message", U.normalize_udf("text").alias("plain")).select(F.col("message").alias("key"), F.posexplode(U.tokens_udf("plain")).alias("span", "u")).select("key", "span", F.col("u.start").alias("start"), F.col("u.end").alias("stop"))
    return spans.to_raw(n, spans.pieces_of(m, "message", "text")).select("key.*", "span", "start", "stop", "raw_start", "raw_stop")


@query("f03_normalized_spans")
def _(t):
    """Every stretch of seven raw characters of every message: the normalised span that covers it, null if nothing of it is left."""
    m = t("conversations").select(F.struct("conv_id", "turn").alias("message"), "text")
    at = F.sequence(F.lit(0), F.greatest(F.length("text") - 1, F.lit(0)), F.lit(7))
    n = m.where("text <> ''").select(F.col("message").alias("key"), F.length("text").alias("size"), F.posexplode(at).alias("span", "start")).select("key", "span", "start", F.least(F.col("start") + 7, F.col("size")).alias("stop"))
    return spans.to_normalized(n, spans.pieces_of(m, "message", "text")).select("key.*", "span", "start", "stop", "plain_start", "plain_stop")


@query(
    "e19_sql_functions",
    r"""SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '\s+', '_', 'g'), '[^a-z0-9_\-]', '', 'g') AS slug, 'part:' || regexp_replace(regexp_replace(lower(trim(p_brand)), '\s+', '_', 'g'), '[^a-z0-9_\-]', '', 'g') || ':' || regexp_replace(regexp_replace(lower(trim(p_type)), '\s+', '_', 'g'), '[^a-z0-9_\-]', '', 'g') AS k,
    greatest(1, (length(p_name) + 3) // 4)::BIGINT AS tokens, CASE WHEN regexp_matches(p_name, '[A-Za-z]') THEN 'en' ELSE 'und' END AS language, round(0.6::DOUBLE / (60 + p_partkey), 9) AS rrf FROM part""",
)
def _(t):
    """Functions whose bodies are SQL, called from SQL."""
    p = t("part")
    registered.register(p.sparkSession)
    return p.sparkSession.sql("SELECT p_partkey, ledger_slug(p_name) AS slug, ledger_key('part', p_brand, p_type) AS k, ledger_tokens(p_name) AS tokens, ledger_language(p_name) AS language, round(ledger_rrf(0.6D, p_partkey), 9) AS rrf FROM {part}", part=p)


@query("e19_table_functions")
def _(t):
    """Units, sentences and words of all documents by table functions in SQL."""
    d = t("documents")
    registered.register(d.sparkSession)
    return d.sparkSession.sql(
        """SELECT doc_id, concat('unit ', u.kind) AS what, count(*) AS n FROM {d}, LATERAL ledger_units(text) u GROUP BY ALL
        UNION ALL SELECT doc_id, 'sentence', count(*) FROM {d}, LATERAL ledger_sentences(text) s GROUP BY ALL
        UNION ALL SELECT doc_id, 'word', count(*) FROM {d}, LATERAL ledger_words_at(text) w GROUP BY ALL""",
        d=d,
    )


@query("f20_label", "SELECT n_nationkey, trim(regexp_replace(lower(n_name), '\\s+', ' ', 'g')) AS label FROM nation")
def _(t):
    return t("nation").select("n_nationkey", U.label_udf("n_name").alias("label"))


def _streamed(t) -> DataFrame:
    """The events as a file stream, with an event time that has a zone."""
    e = t("events")
    folder, name = e.inputFiles()[0].rsplit("/", 1)
    s = e.sparkSession.readStream.schema(e.schema).option("pathGlobFilter", name if name.startswith("events") else "*.parquet").parquet(folder)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _plain(df: DataFrame, *columns: str) -> DataFrame:
    """Times back without a zone, as the tables have them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


def _folder(t) -> str:
    from ..checkpoints import shared_folder

    return f"{shared_folder(t('region').sparkSession)}/stream-{uuid.uuid4().hex}"


@query("x01_capture_dedup", "SELECT user_id, date_trunc('day', min(ts)) AS day, 1::BIGINT AS n FROM events GROUP BY user_id, date_trunc('day', ts)")
def _(t):
    """One capture for each user and day; the watermark is wider than the data, so none is lost to lateness."""
    s = _streamed(t)
    once = ledger.captured_once(s.withColumn("day", F.date_trunc("day", "ts")), ["user_id", "day"], "ts", "36500 days")
    return _plain(ledger.run_available(once.select("user_id", "day"), _folder(t)).groupBy("user_id", "day").agg(F.count("*").alias("n")), "day")


@query("x15_tumbling_windows", "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS events, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, max(value) AS most FROM events GROUP BY 1, 2")
def _(t):
    s = _streamed(t)
    return _plain(ledger.run_available(ledger.windowed(s, "ts", "1 hour", ["event_type"]), _folder(t), "complete"), "start")


@query("x15_session_windows", 'WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER w + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), i AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g) SELECT min(ts) AS "start", max(ts) + INTERVAL 30 MINUTE AS "end", user_id, count(*) AS events FROM i GROUP BY user_id, s')
def _(t):
    return ledger.sessions(t("events"), "ts", "30 minutes", ["user_id"])


@query("x02_event_index", "SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS event_index FROM events")
def _(t):
    s = _streamed(t)
    return ledger.run_available(ledger.numbered(s, "user_id", "event_id"), _folder(t))


@query("x08_outbox_once", "SELECT event_id, user_id FROM events")
def _(t):
    """All events are delivered by two runs of the stream, the second one without the first one's checkpoint; none arrives twice."""
    folder = _folder(t)
    rows = _streamed(t).select("event_id", "user_id")
    ledger.deliver_once(rows, "event_id", folder, f"{folder}/first")
    return ledger.deliver_once(rows, "event_id", folder, f"{folder}/second")


@query("s18_live_capture", "SELECT user_id, event_type, 1::BIGINT AS n FROM events GROUP BY ALL")
def _(t):
    """Requests as a stream: of those with the same idempotency key (user and type) the first is captured."""
    once = ledger.captured_once(_streamed(t).withColumn("key", F.concat_ws(":", "user_id", "event_type")), ["key"], "ts", "36500 days")
    return ledger.run_available(once.select("user_id", "event_type"), _folder(t)).groupBy("user_id", "event_type").agg(F.count("*").alias("n"))


@query("s11_history_adapter", "SELECT conv_id::VARCHAR AS conv, turn::VARCHAR AS node, CASE WHEN turn > 0 THEN (turn - 1)::VARCHAR END AS parent, role, text, turn = max(turn) OVER (PARTITION BY conv_id) AS active FROM conversations")
def _(t):
    node = F.struct(F.col("turn").cast("string").alias("id"), "role", F.col("text").alias("content"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parentId"), F.lit(1700000000.0).alias("timestamp"))
    g = t("conversations").groupBy("conv_id").agg(F.map_from_entries(F.collect_list(F.struct(F.col("turn").cast("string"), node))).alias("messages"), F.max("turn").cast("string").alias("leaf"))
    history = F.struct(F.struct(F.col("leaf").alias("currentId"), "messages").alias("history"))
    payload = _json(g.select(F.array(F.struct(F.col("conv_id").cast("string").alias("id"), F.lit("x").alias("title"), history.alias("chat"))).alias("v")))
    return exports.read_history(payload).select("conv", "node", "parent", "role", "text", "active")


@query("w04_idempotent_replay", "SELECT source, count(*) AS replays FROM (SELECT source, text, row_number() OVER (PARTITION BY source, text ORDER BY doc_id) AS n FROM documents) WHERE n > 1 GROUP BY 1")
def _(t):
    d = t("documents").select("source", "doc_id", F.struct("source", F.sha2("text", 256).alias("h")).alias("k"), F.sha2("text", 256).alias("h"))
    return sets.replays(d, "k", "h", ["doc_id"]).where("outcome = 'replay'").groupBy("source").agg(F.count("*").alias("replays"))
