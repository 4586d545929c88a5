"""Queries of predicates, windows, sets, text, time, score and JSON functions over the test tables."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import ijson, scoring, text
from ..functions import unicode_text as U
from ..registry import query
from .classify import SQL as MESSAGES
from .classify import _q, messages

LONG = lambda c: c.cast("long")
pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i.cast("int"))
listed = lambda values: "[" + ", ".join(map(_q, values)) + "]"


@query("p03_contains_any", "SELECT p_partkey FROM part WHERE lower(p_name) LIKE '%re_d%' OR lower(p_name) LIKE '%a%e%' OR lower(p_name) LIKE '%part 1%'")
def _(t):
    """Terms go into LIKE as they are, so % and _ in them match anything."""
    return t("part").where(reduce(lambda a, b: a | b, (F.lower("p_name").like(f"%{x}%") for x in ("re_d", "a%e", "part 1")))).select("p_partkey")


_VERSIONS = "v AS (SELECT conv_id, turn, i AS version, sha256(coalesce(text, '') || i) AS hash FROM conversations, range(1, 4) r(i) WHERE i <= 1 + turn % 3)"


def versions(t):
    """One to three versions of every turn; the last one's hash is the message's."""
    c = t("conversations").withColumn("version", F.explode(F.sequence(F.lit(1), (F.col("turn") % 3 + 1).cast("int"))))
    return c.select("conv_id", "turn", LONG(F.col("version")).alias("version"), F.sha2(F.concat(F.coalesce("text", F.lit("")), F.col("version").cast("string")), 256).alias("hash"))


@query("n02_latest_version", f"WITH {_VERSIONS} SELECT conv_id, turn, version, hash FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY version DESC, hash DESC) AS n FROM v) WHERE n = 1")
def _(t):
    w = Window.partitionBy("conv_id", "turn").orderBy(F.col("version").desc(), F.col("hash").desc())
    return versions(t).withColumn("n", F.row_number().over(w)).where("n = 1").drop("n")


@query("p04_visible_current", f"""WITH {_VERSIONS}, a AS (SELECT conv_id, turn, CASE WHEN conv_id % 4 = 0 THEN NULL ELSE 1 + conv_id % 3 END AS version, sha256(coalesce(text, '') || (1 + CASE WHEN conv_id % 4 = 0 THEN turn % 3 ELSE conv_id % 3 END)) AS hash, (conv_id + turn) % 13 = 0 AS deleted, turn % 7 = 6 AS hidden FROM conversations),
l AS (SELECT conv_id, turn, max(version) AS last, max_by(hash, version) AS now FROM v GROUP BY ALL)
SELECT a.conv_id, a.turn FROM a JOIN l USING (conv_id, turn) WHERE NOT deleted AND NOT hidden AND a.hash = l.now AND (a.version IS NULL OR a.version = l.last)""")
def _(t):
    """Analyses of messages that are not deleted or hidden and that say what the newest version says."""
    last = versions(t).groupBy("conv_id", "turn").agg(F.max("version").alias("last"), F.max_by("hash", "version").alias("now"))
    version = F.when(F.col("conv_id") % 4 != 0, F.col("conv_id") % 3 + 1)
    seen = F.when(F.col("conv_id") % 4 == 0, F.col("turn") % 3).otherwise(F.col("conv_id") % 3) + 1
    a = t("conversations").select("conv_id", "turn", version.alias("version"), F.sha2(F.concat(F.coalesce("text", F.lit("")), seen.cast("string")), 256).alias("hash"), ((F.col("conv_id") + F.col("turn")) % 13 == 0).alias("deleted"), (F.col("turn") % 7 == 6).alias("hidden"))
    return a.join(last, ["conv_id", "turn"]).where("not deleted and not hidden and hash = now and (version is null or version = last)").select("conv_id", "turn")


@query("p06_identity_tuple", "WITH d AS (SELECT doc_id, nullif(lang, 'en') AS a, nullif(source, 'web') AS b, CASE WHEN doc_id % 3 > 0 THEN doc_id % 3 END AS c FROM documents), k AS (SELECT a, b, c, min(doc_id) AS first FROM d GROUP BY ALL) SELECT d.doc_id, k.first FROM d JOIN k ON d.a IS NOT DISTINCT FROM k.a AND d.b IS NOT DISTINCT FROM k.b AND d.c IS NOT DISTINCT FROM k.c")
def _(t):
    d = t("documents").select("doc_id", F.when(F.col("lang") != "en", F.col("lang")).alias("a"), F.when(F.col("source") != "web", F.col("source")).alias("b"), F.when(F.col("doc_id") % 3 > 0, F.col("doc_id") % 3).alias("c"))
    k = d.groupBy("a", "b", "c").agg(F.min("doc_id").alias("first"))
    same = reduce(lambda x, y: x & y, (d[c].eqNullSafe(k[c]) for c in "abc"))
    return d.join(k, same).select(d["doc_id"], "first")


@query("p08_import_eligibility", "SELECT conv_id, turn, CASE WHEN (conv_id + turn) % 17 = 0 THEN 'null_source_message_node' WHEN trim(coalesce(text, '')) = '' OR turn % 5 = 4 THEN CASE WHEN conv_id % 3 = 0 THEN 'provider_internal_reasoning_quarantined' WHEN conv_id % 3 = 1 THEN 'unsupported_binary_only_attachment' ELSE 'empty_visible_text' END WHEN role NOT IN ('user', 'assistant') THEN 'unsupported_role_for_memory_processing' END AS reason FROM conversations")
def _(t):
    """Every fifth turn shows no text; what it has instead depends on the conversation."""
    hidden = (F.trim(F.coalesce("text", F.lit(""))) == "") | (F.col("turn") % 5 == 4)
    third = F.col("conv_id") % 3
    why = F.when((F.col("conv_id") + F.col("turn")) % 17 == 0, "null_source_message_node").when(hidden & (third == 0), "provider_internal_reasoning_quarantined").when(hidden & (third == 1), "unsupported_binary_only_attachment").when(hidden, "empty_visible_text").when(~F.col("role").isin("user", "assistant"), "unsupported_role_for_memory_processing")
    return t("conversations").select("conv_id", "turn", why.alias("reason"))


@query("p13_html_escaped", """SELECT page_id, replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS safe FROM pages""")
def _(t):
    return t("pages").select("page_id", text.html_escaped(F.col("html")).alias("safe"))


@query("p14_policy_cascade", """WITH r AS (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'user_' || o_custkey % 5 END AS u, CASE WHEN o_orderkey % 4 = 0 THEN 'chat_' || o_orderkey % 7 END AS c, CASE WHEN o_orderkey % 8 = 0 THEN CASE WHEN o_custkey % 2 = 0 THEN 'private' ELSE 'shared' END END AS a, CASE WHEN o_orderpriority = '1-URGENT' THEN 'turn' END AS t FROM orders)
SELECT o_orderkey, CASE WHEN t IS NOT NULL AND coalesce(a, '') <> 'private' THEN t ELSE coalesce(a, c, u, 'system') END AS policy, CASE WHEN t IS NOT NULL AND coalesce(a, '') <> 'private' THEN 'turn' WHEN a IS NOT NULL OR c IS NOT NULL THEN 'chat' WHEN u IS NOT NULL THEN 'user' ELSE 'system' END AS source FROM r""")
def _(t):
    """Later levels win: system, user, chat, actor in chat, turn; a private actor policy stops the turn's."""
    o = t("orders")
    user = F.when(F.col("o_custkey") % 3 == 0, F.concat(F.lit("user_"), F.col("o_custkey") % 5))
    chat = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("chat_"), F.col("o_orderkey") % 7))
    actor = F.when(F.col("o_orderkey") % 8 == 0, F.when(F.col("o_custkey") % 2 == 0, "private").otherwise("shared"))
    turn = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.coalesce(actor, F.lit("")) != "private"), "turn")
    source = F.when(turn.isNotNull(), "turn").when(actor.isNotNull() | chat.isNotNull(), "chat").when(user.isNotNull(), "user").otherwise("system")
    return o.select("o_orderkey", F.coalesce(turn, actor, chat, user, F.lit("system")).alias("policy"), source.alias("source"))


@query("p15_most_specific_default", """WITH d AS (SELECT s_suppkey, s_nationkey % 4 AS role, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey END AS nation, CASE WHEN s_suppkey % 3 < 2 THEN s_nationkey % 5 END AS region FROM supplier)
SELECT c_custkey, s_suppkey FROM (SELECT c_custkey, s_suppkey, row_number() OVER (PARTITION BY c_custkey ORDER BY CASE WHEN nation IS NOT NULL THEN 0 WHEN region IS NOT NULL THEN 1 ELSE 2 END, s_suppkey) AS n FROM customer JOIN d ON d.role = c_nationkey % 4 AND ((nation IS NOT NULL AND nation = c_nationkey) OR (nation IS NULL AND region IS NOT NULL AND region = c_nationkey % 5) OR (nation IS NULL AND region IS NULL))) WHERE n = 1""")
def _(t):
    """The default of a role: a nation's own before a region's before a global one. Each level is an equi-join on its key, so
    that only the best row of a level and key is met."""
    d = t("supplier").select("s_suppkey", (F.col("s_nationkey") % 4).alias("role"), F.when(F.col("s_suppkey") % 3 == 0, F.col("s_nationkey")).alias("nation"), F.when(F.col("s_suppkey") % 3 < 2, F.col("s_nationkey") % 5).alias("region"))
    best = lambda rows, *keys: rows.groupBy("role", *keys).agg(F.min("s_suppkey").alias("s"))
    c = t("customer").select("c_custkey", (F.col("c_nationkey") % 4).alias("role"), F.col("c_nationkey").alias("nation"), (F.col("c_nationkey") % 5).alias("region"))
    out = c.join(best(d.where("nation is not null"), "nation").withColumnRenamed("s", "s0"), ["role", "nation"], "left")
    out = out.join(best(d.where("nation is null and region is not null"), "region").withColumnRenamed("s", "s1"), ["role", "region"], "left")
    out = out.join(best(d.where("nation is null and region is null")).withColumnRenamed("s", "s2"), ["role"], "left")
    return out.select("c_custkey", F.coalesce("s0", "s1", "s2").alias("s_suppkey")).where("s_suppkey is not null")


_BLOCK_RULES = {"user_profile": ["identity", "preference"], "project_context": ["decision", "constraint", "definition", "unresolved_question", "fact"]}
_TYPES = ["identity", "preference", "decision", "constraint", "definition", "fact"]
_AUTHORITIES = ["user_explicit", "assistant_claim", "system_instruction", "tool_observation"]
SOURCES_SQL = f"s AS (SELECT p_partkey, {listed(_TYPES)}[p_partkey % 6 + 1] AS kind, {listed(_AUTHORITIES)}[p_size % 4 + 1] AS authority, p_partkey % 9 = 0 AS closed, p_partkey % 7 = 0 AS sensitive, p_retailprice AS price, CASE WHEN p_partkey % 5 = 0 THEN 'session' ELSE 'project' END AS scope, lower(p_name) || CASE WHEN p_size % 3 = 0 THEN ' style' ELSE '' END AS said FROM part)"


def sources(t):
    """Parts as facts: type, authority, whether closed or sensitive, scope and text."""
    p = t("part")
    return p.select("p_partkey", pick(_TYPES, F.col("p_partkey") % 6 + 1).alias("kind"), pick(_AUTHORITIES, F.col("p_size") % 4 + 1).alias("authority"), (F.col("p_partkey") % 9 == 0).alias("closed"), (F.col("p_partkey") % 7 == 0).alias("sensitive"), F.col("p_retailprice").alias("price"), F.when(F.col("p_partkey") % 5 == 0, "session").otherwise("project").alias("scope"), F.concat(F.lower("p_name"), F.when(F.col("p_size") % 3 == 0, " style").otherwise("")).alias("said"))


def block_kinds():
    """The block types that a fact may enter."""
    c = F.col
    rules = {
        "user_profile": c("kind").isin(_BLOCK_RULES["user_profile"]),
        "project_context": c("kind").isin(_BLOCK_RULES["project_context"]),
        "style_policy": (c("kind") == "preference") & (c("authority") == "user_explicit") & (F.contains("said", F.lit("style")) | F.contains("said", F.lit("answer")) | F.contains("said", F.lit("reply"))),
        "prompt_rules": (c("kind") == "constraint") & c("authority").isin("user_explicit", "system_instruction"),
        "safety_privacy": (c("kind") == "constraint") & (c("authority") == "system_instruction"),
        "current_session_state": c("scope") == "session",
    }
    usable = ~c("closed") & ~c("sensitive") & (c("authority") != "assistant_claim")
    return F.array_compact(F.array(*(F.when(usable & r, k) for k, r in rules.items())))


BLOCKS_SQL = f"""{SOURCES_SQL}, b AS (SELECT *, unnest(list_filter([CASE WHEN kind IN ('identity', 'preference') THEN 'user_profile' END, CASE WHEN kind IN ('decision', 'constraint', 'definition', 'unresolved_question', 'fact') THEN 'project_context' END, CASE WHEN kind = 'preference' AND authority = 'user_explicit' AND regexp_matches(said, 'style|answer|reply') THEN 'style_policy' END, CASE WHEN kind = 'constraint' AND authority IN ('user_explicit', 'system_instruction') THEN 'prompt_rules' END, CASE WHEN kind = 'constraint' AND authority = 'system_instruction' THEN 'safety_privacy' END, CASE WHEN scope = 'session' THEN 'current_session_state' END], lambda x: x IS NOT NULL)) AS block FROM s WHERE NOT closed AND NOT sensitive AND authority <> 'assistant_claim')"""


@query("p09_block_eligibility", f"WITH {BLOCKS_SQL} SELECT p_partkey, block FROM b")
def _(t):
    return sources(t).select("p_partkey", F.explode(block_kinds()).alias("block"))


@query("n06_section_packing", """WITH RECURSIVE s AS (SELECT o_custkey AS run, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS i, CAST(o_orderkey % 40 + 5 AS BIGINT) AS size FROM orders),
f AS (SELECT run, i, size AS used, true AS kept FROM s WHERE i = 1 UNION ALL SELECT s.run, s.i, CASE WHEN f.used + s.size <= 60 THEN f.used + s.size ELSE f.used END, f.used + s.size <= 60 FROM f JOIN s ON s.run = f.run AND s.i = f.i + 1) SELECT run, i, kept FROM f""")
def _(t):
    """Sections in order under a budget: one that does not fit is skipped and later ones may still fit; the first always stays."""
    from ..operators.blocks import packed_sections

    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    return packed_sections(t("orders").select(F.col("o_custkey").alias("run"), LONG(F.row_number().over(w)).alias("i"), (F.col("o_orderkey") % 40 + 5).alias("size")), 60)


@query("k04_constraints_first", f"WITH {SOURCES_SQL} SELECT p_partkey, row_number() OVER (PARTITION BY scope ORDER BY kind <> 'constraint', price DESC, p_partkey) AS place FROM s")
def _(t):
    w = Window.partitionBy("scope").orderBy(F.col("kind") != "constraint", F.col("price").desc(), "p_partkey")
    return sources(t).select("p_partkey", LONG(F.row_number().over(w)).alias("place"))


@query("u01_ordered_distinct", "SELECT item_id, list_filter(w, lambda x, i: list_position(w, x) = i) AS terms FROM (SELECT item_id, string_split(text, ' ') AS w FROM benchmark)")
def _(t):
    return t("benchmark").select("item_id", F.array_distinct(F.split("text", " ")).alias("terms"))


@query("u04_bag_union", "SELECT generator, count(*) AS n, sum(key) AS keys FROM (SELECT 'orders' AS generator, o_orderkey AS key FROM orders UNION ALL SELECT 'lines', l_orderkey FROM lineitem UNION ALL SELECT 'events', event_id FROM events) GROUP BY 1")
def _(t):
    one = lambda table, key, name: t(table).select(F.lit(name).alias("generator"), F.col(key).alias("key"))
    return one("orders", "o_orderkey", "orders").unionByName(one("lineitem", "l_orderkey", "lines")).unionByName(one("events", "event_id", "events")).groupBy("generator").agg(F.count("*").alias("n"), F.sum("key").alias("keys"))


@query("u08_duplicate_conversations", "WITH k AS (SELECT conv_id, sha256(string_agg(role || chr(31) || coalesce(text, ''), chr(30) ORDER BY turn, role, coalesce(text, ''))) AS mark FROM conversations GROUP BY 1), f AS (SELECT mark, min(conv_id) AS first FROM k GROUP BY 1) SELECT conv_id, CASE WHEN conv_id = first THEN 'new' ELSE 'duplicate' END AS decision FROM k JOIN f USING (mark)")
def _(t):
    """A conversation is a duplicate if an earlier one has the same fingerprint of roles and texts."""
    turn = F.struct("turn", "role", F.coalesce("text", F.lit("")).alias("text"))
    said = F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: F.concat(x["role"], F.lit("\x1f"), x["text"])), "\x1e")
    k = t("conversations").groupBy("conv_id").agg(F.sha2(said, 256).alias("mark"))
    first = k.groupBy("mark").agg(F.min("conv_id").alias("first"))
    return k.join(first, "mark").select("conv_id", F.when(F.col("conv_id") == F.col("first"), "new").otherwise("duplicate").alias("decision"))


@query("q02_claimed_jobs", "SELECT event_type, event_id, 'running' AS status, attempt + 1 AS attempt FROM (SELECT *, event_id % 3 AS attempt, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, ts, event_id) AS n FROM events WHERE event_id % 4 <> 0) WHERE n = 1")
def _(t):
    """The first open job of each queue goes to running with one more attempt."""
    w = Window.partitionBy("event_type").orderBy(F.col("value").desc(), "ts", "event_id")
    return t("events").where("event_id % 4 <> 0").withColumn("n", F.row_number().over(w)).where("n = 1").select("event_type", "event_id", F.lit("running").alias("status"), (F.col("event_id") % 3 + 1).alias("attempt"))


@query("q04_with_clause", "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE spent > 500000) SELECT c_mktsegment, count(*) AS n FROM top JOIN customer ON c_custkey = o_custkey GROUP BY c_mktsegment")
def _(t):
    spark = t("orders").sparkSession
    sql = "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS spent FROM {orders} GROUP BY o_custkey), top AS (SELECT * FROM big WHERE spent > 500000) SELECT c_mktsegment, count(*) AS n FROM top JOIN {customer} ON c_custkey = o_custkey GROUP BY c_mktsegment"
    return spark.sql(sql, orders=t("orders"), customer=t("customer"))


@query("q05_built_predicate", "SELECT count(*) AS n, sum(o_orderkey) AS keys FROM orders WHERE (o_orderstatus = 'O' AND o_totalprice > 1000) OR (o_orderstatus = 'F' AND o_totalprice > 200000) OR (o_orderpriority = '1-URGENT')")
def _(t):
    """A predicate from rules as data, as column expressions and never as text."""
    rules = [{"o_orderstatus": ("=", "O"), "o_totalprice": (">", 1000)}, {"o_orderstatus": ("=", "F"), "o_totalprice": (">", 200000)}, {"o_orderpriority": ("=", "1-URGENT")}]
    test = {"=": lambda c, v: c == v, ">": lambda c, v: c > v}
    one = lambda rule: reduce(lambda a, b: a & b, (test[op](F.col(k), F.lit(v)) for k, (op, v) in rule.items()))
    return t("orders").where(reduce(lambda a, b: a | b, map(one, rules))).agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("f02_letters_and_digits", f"{MESSAGES} SELECT conv_id, turn, translate(raw, 'يىك۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩', 'ییک01234567890123456789') AS plain FROM m")
def _(t):
    return messages(t).select("conv_id", "turn", F.translate("raw", "يىك۰۱۲۳۴۵۶۷۸۹٠١٢٣٤٥٦٧٨٩", "ییک01234567890123456789").alias("plain"))


CONTRACT = {"version": "v1", "unicode_form": "NFC", "unify_persian_letters": True, "remove_arabic_diacritics": True, "zwnj_policy": "boundary", "normalize_digits": True, "lowercase_letters": True, "compress_whitespace": True, "preserve_fenced_code": True}


@query("f04_contract_fingerprint", f"SELECT sha256({_q(json.dumps(CONTRACT, sort_keys=True, separators=(',', ':')))}) AS fingerprint")
def _(t):
    spark = t("region").sparkSession
    return spark.range(1).select(F.lit(hashlib.sha256(json.dumps(CONTRACT, sort_keys=True, separators=(",", ":")).encode()).hexdigest()).alias("fingerprint"))


_WANTED = ["the team", "don't", "from now on", "api key", "نباید", "project"]


@query("f07_contains_phrase", f"{MESSAGES} SELECT conv_id, turn, list_filter({listed(_WANTED)}, lambda p: CASE p " + " ".join(f"WHEN {_q(p)} THEN regexp_matches(plain, {_q(U.phrase_pattern([p]))})" for p in _WANTED) + " END) AS phrases FROM m")
def _(t):
    return messages(t).select("conv_id", "turn", F.array_compact(F.array(*(F.when(U.has(F.col("plain"), [p]), p) for p in _WANTED))).alias("phrases"))


@query("f08_first_phrase", f"{MESSAGES} SELECT conv_id, turn, nullif(regexp_extract(plain, {_q(U.phrase_pattern(_WANTED, group=True))}, 1), '') AS phrase FROM m")
def _(t):
    found = F.regexp_extract("plain", U.phrase_pattern(_WANTED, group=True), 1)
    return messages(t).select("conv_id", "turn", F.when(found != "", found).alias("phrase"))


@query("f10_find_token", f"{MESSAGES} SELECT conv_id, turn, list_contains(words, 'team') AS team, list_contains(words, 'token') AS token FROM m")
def _(t):
    return messages(t).select("conv_id", "turn", F.array_contains("words", "team").alias("team"), F.array_contains("words", "token").alias("token"))


@query("f11_identifiers", "SELECT page_id, regexp_extract_all(lower(url), '[a-z0-9]+(?:[_.-][a-z0-9]+)+') AS ids FROM pages")
def _(t):
    return t("pages").select("page_id", F.regexp_extract_all(F.lower("url"), F.lit("[a-z0-9]+(?:[_.-][a-z0-9]+)+"), F.lit(0)).alias("ids"))


@query("f17_language_variants", f"{MESSAGES} SELECT conv_id, turn, CASE WHEN regexp_matches(raw, '[؀-ۿ]') AND regexp_matches(raw, '[A-Za-z]') THEN 'mixed' WHEN regexp_matches(raw, '[؀-ۿ]') THEN 'fa' WHEN regexp_matches(raw, '[A-Za-z]') THEN 'en' ELSE 'unknown' END AS segmenter, CASE WHEN regexp_matches(raw, '[؀-ۿ]') THEN 'fa' ELSE 'en' END AS unitizer FROM m")
def _(t):
    fa, en = F.col("raw").rlike("[؀-ۿ]"), F.col("raw").rlike("[A-Za-z]")
    return messages(t).select("conv_id", "turn", F.when(fa & en, "mixed").when(fa, "fa").when(en, "en").otherwise("unknown").alias("segmenter"), F.when(fa, "fa").otherwise("en").alias("unitizer"))


_KEYED = "CASE WHEN doc_id % 5 = 0 THEN 'sk-proj-AbCd1234' WHEN doc_id % 5 = 1 THEN 'task-list sk-ab-cd' WHEN doc_id % 5 = 2 THEN 'sk_live_0123456789' ELSE '' END"


@query("f26_key_detector", f"SELECT doc_id, len(list_filter(regexp_extract_all(lower(text || ' ' || {_KEYED}), '(?:^|[^\\p{{L}}\\p{{N}}])sk[-_]([\\p{{L}}\\p{{N}}_-]*)', 1), lambda b: length(replace(replace(b, '-', ''), '_', '')) >= 8)) > 0 AS has_key FROM documents")
def _(t):
    """Secret keys: the body after the prefix counts over all its segments."""
    said = F.expr(_KEYED)
    return t("documents").select("doc_id", text.has_key(F.concat("text", F.lit(" "), said)).alias("has_key"))


@query("f32_imported_tokens", "WITH w AS (SELECT conv_id, turn, role, list_distinct(list_filter(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+'), lambda x: length(x) > 2)) AS own FROM conversations WHERE text IS NOT NULL) SELECT a.conv_id, a.turn, CAST(len(list_intersect(a.own, b.own)) AS BIGINT) AS shared, len(list_intersect(a.own, b.own)) >= 2 AS imported FROM w a JOIN w b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 AND b.role = 'assistant' WHERE a.role = 'user'")
def _(t):
    """User turns that say two or more words of the assistant turn before."""
    own = F.array_distinct(F.filter(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), lambda x: F.length(x) > 2))
    w = t("conversations").where("text is not null").select("conv_id", "turn", "role", own.alias("own"))
    before = w.where("role = 'assistant'").select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("own").alias("theirs"))
    shared = LONG(F.size(F.array_intersect("own", "theirs")))
    return w.where("role = 'user'").join(before, ["conv_id", "turn"]).select("conv_id", "turn", shared.alias("shared"), (shared >= 2).alias("imported"))


@query("f34_overlap_span", "WITH w AS (SELECT a.conv_id, a.turn, lower(a.text) AS response, list_filter(list_transform(list_filter(string_split_regex(trim(b.text), '\\s+'), lambda x: length(x) > 4), lambda x: lower(trim(x, ' .,:;'))), lambda x: contains(lower(a.text), x)) AS hits FROM conversations a JOIN conversations b ON b.conv_id = a.conv_id AND b.turn = a.turn - 1 WHERE a.text IS NOT NULL AND b.text IS NOT NULL) SELECT conv_id, turn, hits[1] AS term, CASE WHEN len(hits) > 0 THEN strpos(response, hits[1]) - 1 END AS start FROM w")
def _(t):
    """The first longer term of the turn before that a turn repeats, and where."""
    c = t("conversations").where("text is not null")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("text").alias("memory"))
    both = c.select("conv_id", "turn", F.lower("text").alias("response")).join(before, ["conv_id", "turn"])
    return both.withColumn("term", text.first_shared_term("memory", "response")).select("conv_id", "turn", "term", F.expr("CASE WHEN term IS NOT NULL THEN instr(response, term) - 1 END").cast("long").alias("start"))


@query("t05_valid_time_label", "SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND f IS NULL AND u IS NULL THEN 'current' WHEN u IS NOT NULL THEN 'historical until ' || u WHEN f IS NOT NULL THEN CASE WHEN o_orderstatus = 'O' THEN 'current from ' ELSE 'historical from ' END || f WHEN o_orderstatus = 'O' THEN 'current' ELSE 'historical' END AS label FROM (SELECT *, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS f, CASE WHEN o_orderkey % 5 = 0 THEN strftime(o_orderdate + INTERVAL 30 DAY, '%Y-%m-%d') END AS u FROM orders)")
def _(t):
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    since, until = F.when(F.col("o_orderkey") % 3 == 0, day(F.col("o_orderdate"))), F.when(F.col("o_orderkey") % 5 == 0, day(F.col("o_orderdate") + F.expr("interval 30 days")))
    return t("orders").select("o_orderkey", scoring.valid_time_label(since, until, F.col("o_orderstatus") == "O").alias("label"))


@query("t07_day_bucket", "SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"))


@query("m05_authority_score", f"WITH {SOURCES_SQL} SELECT authority, CASE authority WHEN 'user_explicit' THEN 1.0 WHEN 'system_instruction' THEN 0.95 WHEN 'tool_observation' THEN 0.8 WHEN 'assistant_claim' THEN 0.35 ELSE 0.55 END::DOUBLE AS score, count(*) AS n FROM s GROUP BY ALL")
def _(t):
    return sources(t).groupBy("authority", scoring.authority_score(F.col("authority")).alias("score")).agg(F.count("*").alias("n"))


@query("m06_scope_proximity", "SELECT scope, CASE scope WHEN 'session' THEN 1.0 WHEN 'project' THEN 0.85 WHEN 'workspace' THEN 0.65 ELSE 0.4 END::DOUBLE AS score, count(*) AS n FROM (SELECT ['session', 'project', 'workspace', 'user'][event_id % 4 + 1] AS scope FROM events) GROUP BY ALL")
def _(t):
    scope = pick(["session", "project", "workspace", "user"], F.col("event_id") % 4 + 1)
    return t("events").select(scope.alias("scope")).groupBy("scope", scoring.scope_proximity(F.col("scope")).alias("score")).agg(F.count("*").alias("n"))


@query("m07_confidence_label", "SELECT CASE WHEN x >= 0.8 THEN 'high' WHEN x >= 0.5 THEN 'medium' ELSE 'low' END AS label, count(*) AS n FROM (SELECT (event_id % 101) / 100.0 AS x FROM events) GROUP BY 1")
def _(t):
    return t("events").groupBy(scoring.confidence_label((F.col("event_id") % 101) / 100).alias("label")).agg(F.count("*").alias("n"))


@query("m08_conflict_penalty", "SELECT c_custkey, CASE WHEN c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P') THEN 0.35 ELSE 0 END::DOUBLE AS penalty FROM customer")
def _(t):
    """A flat penalty for what any contradicting decision points at."""
    hit = t("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"), F.lit(0.35).alias("p")).distinct()
    return t("customer").join(hit, "c_custkey", "left").select("c_custkey", F.coalesce("p", F.lit(0.0)).alias("penalty"))


@query("m15_graph_rank_score", "SELECT c_custkey, round(greatest(0.1, 1 - 0.05 * (row_number() OVER (PARTITION BY c_nationkey ORDER BY c_acctbal DESC, c_custkey) - 1)), 6)::DOUBLE AS score FROM customer")
def _(t):
    w = Window.partitionBy("c_nationkey").orderBy(F.col("c_acctbal").desc(), "c_custkey")
    return t("customer").select("c_custkey", F.round(scoring.positional_score(F.row_number().over(w) - 1, 0.05), 6).alias("score"))


@query("h02_canonical_json", """SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '","c_name":"' || c_name || '","note":null}' AS body FROM customer""")
def _(t):
    return t("customer").select("c_custkey", ijson.canonical(c_name=F.col("c_name"), c_custkey=F.col("c_custkey"), note=F.lit(None).cast("string"), c_mktsegment=F.col("c_mktsegment")).alias("body"))


@query("h04_canonical_hash", """SELECT c_custkey, sha256('{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}') AS digest FROM customer""")
def _(t):
    return t("customer").select("c_custkey", ijson.digest(ijson.canonical(c_name=F.col("c_name"), c_custkey=F.col("c_custkey"))).alias("digest"))


_ODD = """CASE event_id % 8 WHEN 1 THEN '{"k": 1, "k": 2}' WHEN 2 THEN '{"k": 9007199254740993}' WHEN 3 THEN '{"k": NaN}' WHEN 4 THEN '{"k": ' WHEN 5 THEN '{"made_at": "yesterday"}' WHEN 6 THEN '{"made_at": "2024-01-02T03:04:05Z"}' ELSE props END"""


@query("h03_ijson_faults", "SELECT event_id, CASE event_id % 8 WHEN 1 THEN 'duplicate_key' WHEN 2 THEN 'unsafe_integer' WHEN 3 THEN 'non_finite' WHEN 4 THEN 'malformed' WHEN 5 THEN 'bad_timestamp' END AS fault FROM events")
def _(t):
    """Events' properties, with faulty ones among them."""
    return t("events").select("event_id", ijson.fault_udf(F.expr(_ODD)).alias("fault"))


@query("h05_name_uuid")
def _(t):
    return t("customer").select("c_custkey", ijson.uuid5("6ba7b810-9dad-11d1-80b4-00c04fd430c8", F.col("c_name")).alias("id"))


@query("h06_unit_fingerprint", "SELECT l_orderkey, sha256('{\"lines\":[' || string_agg('{\"part\":' || l_partkey || ',\"supplier\":' || l_suppkey || '}', ',' ORDER BY l_partkey, l_suppkey) || ']}') AS mark FROM lineitem GROUP BY 1")
def _(t):
    """Order, row numbers and other ids leave no trace in the fingerprint."""
    line = F.struct(F.col("l_partkey").alias("part"), F.col("l_suppkey").alias("supplier"))
    return t("lineitem").groupBy("l_orderkey").agg(ijson.digest(F.to_json(F.struct(F.array_sort(F.collect_list(line)).alias("lines")))).alias("mark"))


@query("h08_profile_fingerprint", """SELECT c_custkey, sha256('{' || CASE WHEN c_custkey % 3 > 0 THEN '"model":"' || c_mktsegment || '",' ELSE '' END || '"name":"' || c_name || '"' || CASE WHEN c_custkey % 4 > 0 THEN ',"window":' || c_nationkey ELSE '' END || '}') AS mark FROM customer""")
def _(t):
    """Only the keys that are there count."""
    own = ijson.present(name=F.col("c_name"), model=F.when(F.col("c_custkey") % 3 > 0, F.col("c_mktsegment")), window=F.when(F.col("c_custkey") % 4 > 0, F.col("c_nationkey")))
    return t("customer").select("c_custkey", ijson.digest(own).alias("mark"))


@query("h10_content_parts", "SELECT conv_id, turn, CASE WHEN turn % 4 = 3 THEN 'provider_internal_reasoning' WHEN turn % 4 = 2 THEN 'unknown' ELSE 'text' END AS part_type, turn % 4 = 3 AS quarantined, CASE WHEN turn % 4 = 3 THEN NULL ELSE text END AS text FROM conversations")
def _(t):
    """Parts by type: reasoning is quarantined and shows no text; a part without type is unknown."""
    kind = pick(["text", "text", "", "model_Reasoning_summary"], F.col("turn") % 4 + 1)
    secret = F.contains(F.lower(kind), F.lit("reasoning"))
    return t("conversations").select("conv_id", "turn", F.when(secret, "provider_internal_reasoning").when(kind == "", "unknown").otherwise(kind).alias("part_type"), secret.alias("quarantined"), F.when(~secret, F.col("text")).alias("text"))


@query("h13_json_fragments", """SELECT c_custkey, [c_name, c_mktsegment, 'x' || c_nationkey] AS fragments FROM customer""")
def _(t):
    nested = F.to_json(F.struct(F.struct(F.col("c_name").alias("n"), F.col("c_custkey").alias("k")).alias("a"), F.array(F.struct(F.col("c_mktsegment").alias("m")), F.struct(F.concat(F.lit("x"), F.col("c_nationkey")).alias("m"))).alias("b")))
    return t("customer").select("c_custkey", ijson.fragments_udf(nested).alias("fragments"))


@query("h14_comma_list", "SELECT p_partkey, list_filter(list_transform(string_split(p_type || ', ,' || p_brand, ','), lambda x: trim(x)), lambda x: x <> '') AS parts FROM part")
def _(t):
    parts = F.transform(F.split(F.concat("p_type", F.lit(", ,"), "p_brand"), ","), lambda x: F.trim(x))
    return t("part").select("p_partkey", F.filter(parts, lambda x: x != "").alias("parts"))


@query("h15_row_without_nulls", """SELECT o_orderkey, '{"key":' || o_orderkey || CASE WHEN o_orderkey % 2 = 0 THEN ',"status":"' || o_orderstatus || '"' ELSE '' END || '}' AS body FROM orders""")
def _(t):
    return t("orders").select("o_orderkey", ijson.present(key=F.col("o_orderkey"), status=F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus"))).alias("body"))


@query("j07_latest_child", f"WITH {_VERSIONS}, l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY version DESC, hash DESC) AS n FROM v WHERE conv_id % 3 <> 0) WHERE n = 1) SELECT c.conv_id, c.turn, l.version FROM conversations c LEFT JOIN l ON l.conv_id = c.conv_id AND l.turn = c.turn")
def _(t):
    last = versions(t).where("conv_id % 3 <> 0").groupBy("conv_id", "turn").agg(F.max("version").alias("version"))
    return t("conversations").select("conv_id", "turn").join(last, ["conv_id", "turn"], "left")




@query("s13_generic_passthrough", "SELECT conv_id::VARCHAR AS conv, count(*) AS messages FROM conversations WHERE conv_id % 3 <> 0 GROUP BY 1")
def _(t):
    """Files that carry the marker of the own format pass through; others do not."""
    m = F.struct("turn", "role", "text")
    body = F.struct(F.when(F.col("conv_id") % 3 != 0, "memory-conversation-import").otherwise("other").alias("format"), F.col("conv_id").cast("string").alias("id"), F.col("ms").alias("messages"))
    files = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(m)).alias("ms")).select(F.to_json(body).alias("value"))
    shape = "format string, id string, messages array<struct<turn:bigint,role:string,text:string>>"
    return files.select(F.from_json("value", shape).alias("f")).where("f.format = 'memory-conversation-import'").select(F.col("f.id").alias("conv"), LONG(F.size("f.messages")).alias("messages"))


