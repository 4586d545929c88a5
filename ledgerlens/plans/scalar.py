"""Queries of scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import scoring, text, times
from ..operators import substrings, vectors
from ..registry import query

D = lambda c: F.col(c).cast("double")
LONG = lambda c: c.cast("long")
STOPS = ", ".join(f"'{w}'" for w in text.STOP_WORDS)


@query("f14_language_hint", "SELECT doc_id, CASE WHEN regexp_matches(text, '[؀-ۿ]') THEN 'fa' WHEN regexp_matches(text, '[A-Za-z]') THEN 'en' ELSE 'und' END AS hint FROM documents")
def _(t):
    return t("documents").select("doc_id", text.language_hint(F.col("text")).alias("hint"))


@query("f18_slug", "SELECT p_partkey, regexp_replace(regexp_replace(lower(trim(p_name)), '\\s+', '_', 'g'), '[^a-z0-9_\\-]', '', 'g') AS slug FROM part")
def _(t):
    return t("part").select("p_partkey", text.slug(F.col("p_name")).alias("slug"))


@query("f19_canonical_key", "SELECT p_partkey, 'part:' || regexp_replace(regexp_replace(lower(trim(p_brand)), '\\s+', '_', 'g'), '[^a-z0-9_\\-]', '', 'g') || ':' || regexp_replace(regexp_replace(lower(trim(p_type)), '\\s+', '_', 'g'), '[^a-z0-9_\\-]', '', 'g') AS k FROM part")
def _(t):
    return t("part").select("p_partkey", text.canonical_key(F.lit("part"), F.col("p_brand"), F.col("p_type")).alias("k"))


@query("f21_fts_terms", "SELECT c_custkey, list_transform(list_filter(list_transform(string_split_regex(trim(c_name), '\\s+'), lambda w: replace(w, '\"', '')), lambda w: w <> ''), lambda w: '\"' || w || '\"') AS terms FROM customer")
def _(t):
    return t("customer").select("c_custkey", text.fts_terms(F.col("c_name")).alias("terms"))


@query("f22_meaningful_terms", f"SELECT item_id, list_filter(regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_؀-ۿ][\\p{{L}}\\p{{N}}_\\-؀-ۿ]+'), lambda w: lower(w) NOT IN ({STOPS})) AS terms FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", text.planner_terms(F.col("text")).alias("terms"))


@query("f23_entities", r"SELECT item_id, list_sort(list_distinct(list_filter(string_split_regex(text, '[^\p{L}\p{N}\p{M}_]+'), lambda w: regexp_matches(w, '^(?:[A-Z][a-z]{2,}|[A-Z]{2,})$')))) AS entities FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", text.entities(F.col("text")).alias("entities"))


@query("f24_technical_terms", "SELECT p_partkey, CAST(len(list_distinct(regexp_extract_all(p_brand || ' ' || upper(p_type), '\\b(?:[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)+|[A-Z0-9]{2,})\\b'))) AS BIGINT) AS n FROM part")
def _(t):
    return t("part").select("p_partkey", LONG(F.size(text.technical_terms(F.concat_ws(" ", "p_brand", F.upper("p_type"))))).alias("n"))


@query(
    "f25_sensitivity",
    r"""SELECT doc_id, CASE WHEN regexp_matches(text, '(?i)bearer\s+[A-Za-z0-9._\-]{8,}|\bsk-[A-Za-z0-9_\-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY|(password|secret|api[_ ]key)\s*[:=]') THEN 'secret' WHEN regexp_matches(text, '[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|\+?[0-9][0-9 ()\-]{8,}[0-9]|(?i)\b(medical|religion|political|health)\b') THEN 'sensitive' ELSE 'normal' END AS level FROM documents""",
)
def _(t):
    return t("documents").select("doc_id", text.sensitivity(F.col("text")).alias("level"))


_INJ = ", ".join(f"CASE WHEN regexp_matches(lower(text), '{p}') THEN '{k}' END" for k, p in text.INJECTION.items())


@query("f27_injection_flags", f"SELECT doc_id, CAST(len(list_filter([{_INJ}], lambda x: x IS NOT NULL)) AS BIGINT) AS flags FROM documents")
def _(t):
    return t("documents").select("doc_id", LONG(F.size(text.injection_flags(F.col("text")))).alias("flags"))


#: Texts that the instruction and acknowledgement queries mix into theirs, each after or instead of nothing of them.
_SAID = ["", *text.INSTRUCTION_LIKE, "IGNORE previous Instructions", "ignore  previous instructions", "always"]
_REPLIES = ["Ok, yes.", "نه! باشه", "Understood_agreed", "okay then", "", "...", "YES no Fine sure yeah yep", "خیر، متوجه شدم"]


def _said(column: str, key: str, some: list[str]):
    return F.concat_ws(" ", column, F.element_at(F.array(*map(F.lit, some)), (F.pmod(F.col(key), F.lit(len(some))) + 1).cast("int")))


def _said_sql(column: str, key: str, some: list[str]) -> str:
    return f"concat_ws(' ', {column}, [{', '.join(map(_quoted, some))}][{key} % {len(some)} + 1])"


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


@query("f28_instruction_like", f"SELECT doc_id, len(list_filter([{', '.join(map(_quoted, text.INSTRUCTION_LIKE))}], lambda p: contains(lower({_said_sql('text', 'doc_id', _SAID)}), p))) > 0 AS hit FROM documents")
def _(t):
    """All documents, each with one of the listed instructions, a near miss or nothing after it."""
    return t("documents").select("doc_id", text.instruction_like(_said("text", "doc_id", _SAID)).alias("hit"))


@query("f29_escaped_delimiters", "SELECT page_id, CAST(length(replace(replace(html, '<', '&lt;'), '>', '&gt;')) AS BIGINT) AS n, CAST(length(html) - length(replace(html, '<', '')) AS BIGINT) AS opens FROM pages")
def _(t):
    return t("pages").select("page_id", LONG(F.length(text.escaped_delimiters(F.col("html")))).alias("n"), LONG(F.regexp_count("html", F.lit("<"))).alias("opens"))


@query("f30_numbered_lines", "SELECT doc_id, CAST(len(regexp_extract_all(text, '(?m)^[ \\t]*[0-9]+[.):\\-]')) AS BIGINT) AS n FROM documents")
def _(t):
    return t("documents").select("doc_id", text.numbered_lines(F.col("text")).alias("n"))


_ACK = f"(len(w) > 0 AND len(list_filter(w, lambda x: NOT list_contains([{', '.join(map(_quoted, text.ACKNOWLEDGEMENTS))}], x))) = 0)"


@query(
    "f31_acknowledgement_only",
    f"""WITH m AS (SELECT conv_id, turn, part, CASE WHEN part = 0 THEN text ELSE [{', '.join(map(_quoted, _REPLIES))}][(conv_id + turn) % {len(_REPLIES)} + 1] END AS said FROM conversations, (VALUES (0), (1)) p(part))
    SELECT conv_id, turn, part, coalesce({_ACK}, false) AS only FROM (SELECT conv_id, turn, part, list_filter(string_split_regex(lower(said), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM m)""",
)
def _(t):
    """Every message (part 0) and a reply to it (part 1)."""
    reply = F.element_at(F.array(*map(F.lit, _REPLIES)), (F.pmod(F.col("conv_id") + F.col("turn"), F.lit(len(_REPLIES))) + 1).cast("int"))
    both = t("conversations").select("conv_id", "turn", F.posexplode(F.array("text", reply)).alias("part", "said"))
    return both.select("conv_id", "turn", "part", F.coalesce(text.acknowledgement_only(F.col("said")), F.lit(False)).alias("only"))


@query(
    "f33_query_relevance",
    r"""WITH q AS (SELECT item_id, list_distinct(list_transform(list_filter(regexp_extract_all(text, '[\p{L}\p{N}_؀-ۿ][\p{L}\p{N}_\-؀-ۿ]+'), lambda w: length(w) > 2), lambda w: lower(w))) AS terms FROM benchmark),
    d AS MATERIALIZED (SELECT doc_id, lower(text) AS low FROM documents)
    SELECT item_id, doc_id, len(list_filter(terms, lambda w: contains(low, w)))::BIGINT AS overlap, len(list_filter(terms, lambda w: contains(low, w))) / len(terms)::DOUBLE AS relevance FROM d, q
    WHERE len(list_filter(terms, lambda w: contains(low, w))) * 4 > len(terms)""",
)
def _(t):
    """Every item against every document; pairs that are left out have the least relevance."""
    return substrings.relevance(t("benchmark"), t("documents"), "item_id", "doc_id")


@query("f36_safe_file_name", "SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9._ \\-]', '_', 'g'), 180) AS name FROM pages")
def _(t):
    return t("pages").select("page_id", text.safe_file_name(F.col("url")).alias("name"))


@query("f37_token_estimate", "SELECT doc_id, CAST(greatest(1, (length(text) + 3) // 4) AS BIGINT) AS tokens FROM documents")
def _(t):
    return t("documents").select("doc_id", text.token_estimate(F.col("text")).alias("tokens"))


@query("f38_error_class", "SELECT event_id, CASE WHEN m LIKE '%timeout%' THEN 'timeout' WHEN m LIKE '%429%' THEN 'rate_limit' WHEN regexp_matches(m, '\\b5[0-9][0-9]\\b') THEN 'server' WHEN m LIKE '%config%' THEN 'configuration' WHEN m LIKE '%400%' THEN 'bad_request' ELSE 'unknown' END AS kind FROM (SELECT event_id, 'http ' || (event_id % 600) AS m FROM events)")
def _(t):
    return t("events").select("event_id", text.error_class(F.concat(F.lit("http "), F.col("event_id") % 600)).alias("kind"))


@query("p12_redaction", r"SELECT doc_id, CASE WHEN length(x) > 280 THEN rtrim(left(x, 279)) || '…' ELSE x END AS shown FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?i)bearer\s+[A-Za-z0-9._\-]+', '[redacted]', 'g'), '\bsk-[A-Za-z0-9_\-]{8,}', '[redacted]', 'g'), 'eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+', '[redacted]', 'g'), '(?i)(password|token|secret)\s*[:=]\s*\S+', '[redacted]', 'g'), '\s+', ' ', 'g')) AS x FROM documents)")
def _(t):
    return t("documents").select("doc_id", text.redacted(F.col("text")).alias("shown"))


@query("h01_sha256", "SELECT doc_id, sha256(text) AS digest FROM documents")
def _(t):
    return t("documents").select("doc_id", F.sha2("text", 256).alias("digest"))


@query("h07_identity", "SELECT c_custkey, sha256('{\"name\":\"' || c_name || '\",\"nation\":' || c_nationkey || '}') AS id FROM customer")
def _(t):
    return t("customer").select("c_custkey", scoring.identity(F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation")).alias("id"))


@query("h09_json_field", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def _(t):
    return t("events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))


@query("h11_visible_text", "SELECT conv_id, trim(string_agg(text, chr(10) ORDER BY turn)) AS visible FROM conversations WHERE role <> 'system' GROUP BY 1")
def _(t):
    parts = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("parts"))
    visible = F.filter("parts", lambda p: p["role"] != "system")
    return parts.where(F.size(visible) > 0).select("conv_id", F.trim(F.array_join(F.transform(visible, lambda p: p["text"]), "\n")).alias("visible"))


@query("h12_role_names", "SELECT conv_id, turn, CASE role WHEN 'user' THEN 'user' WHEN 'assistant' THEN 'assistant' WHEN 'system' THEN 'system' ELSE 'unknown' END AS role FROM conversations")
def _(t):
    return t("conversations").select("conv_id", "turn", text.role_of(F.col("role")).alias("role"))


@query("t01_parsed_time", "SELECT event_id, strftime(to_timestamp(CAST(floor(epoch(ts)) AS BIGINT)) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS at FROM events")
def _(t):
    return t("events").select("event_id", times.parsed_time(F.unix_timestamp("ts").cast("string")).alias("at"))


@query("t02_relative_dates", "SELECT event_id, [CAST(CAST(ts AS DATE) + 1 AS VARCHAR), '2024-02-03'] AS dates FROM events")
def _(t):
    return t("events").select("event_id", times.relative_dates(F.lit("due tomorrow or on 2024-02-03"), F.col("ts")).alias("dates"))


@query("t03_temporal_filter", "SELECT event_id, (event_id % 2 = 0) AS historical, CASE WHEN event_id % 3 = 0 THEN '2021-05' END AS since FROM events")
def _(t):
    q = F.concat_ws(" ", F.when(F.col("event_id") % 2 == 0, "what did I say before"), F.when(F.col("event_id") % 3 == 0, "in 2021-05"))
    return t("events").select("event_id", times.temporal_filter(q).alias("f")).select("event_id", "f.historical", "f.since")


@query("t04_temporal_score", "SELECT o_orderkey, CASE WHEN NOT (o_orderkey % 2 = 0) THEN CASE WHEN o_orderstatus = 'O' THEN 1.0::DOUBLE ELSE 0.35::DOUBLE END WHEN o_totalprice > 200000 THEN 1.0::DOUBLE WHEN o_orderstatus = 'O' THEN 0.8::DOUBLE ELSE 0.45::DOUBLE END AS score FROM orders")
def _(t):
    return t("orders").select("o_orderkey", scoring.temporal_score(F.col("o_orderstatus") == "O", F.col("o_orderkey") % 2 == 0, F.col("o_totalprice") > 200000).alias("score"))


@query("t06_hour_bucket", "SELECT date_trunc('hour', ts) AS hour, count(*) AS n FROM events GROUP BY 1")
def _(t):
    return t("events").groupBy(F.date_trunc("hour", "ts").alias("hour")).agg(F.count("*").alias("n"))


@query("t08_lease_until", "SELECT event_id, ts + to_seconds(CAST(event_id % 600 AS INT)) AS until FROM events")
def _(t):
    return t("events").select("event_id", times.lease_until(F.col("ts"), F.col("event_id") % 600).alias("until"))


@query("t09_rfc3339_check", "SELECT event_id, (event_id % 4 <> 0) AS ok FROM events")
def _(t):
    return t("events").select("event_id", times.valid_rfc3339(F.when(F.col("event_id") % 4 == 0, "2024-13-01T00:00:00Z").otherwise(F.date_format("ts", times.RFC3339))).alias("ok"))


@query("m01_cosine", "SELECT a.vec_id, b.vec_id AS other, round(list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6) AS cosine FROM (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 20 = 0) a JOIN (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings) b ON a.label = b.label AND a.vec_id <> b.vec_id")
def _(t):
    """A stated query set (ids divisible by 20) against all vectors of the label, by products of blocks; vectors without a direction meet the others one by one."""
    e = t("embeddings").select(F.col("label").alias("scope"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    good = F.coalesce(vectors.has_direction(F.col("vec")), F.lit(False))
    query = F.col("id") % 20 == 0
    sound = vectors.all_cosines(e.where(query & good).select("scope", F.col("id").alias("query"), "vec"), e.where(good), vectors.PAIRS)
    a, b = (x.select("scope", F.col("id").alias(name), F.col("vec").alias(v), good.alias(f"good_{v}")) for x, name, v in ((e.where(query), "query", "x"), (e, "other", "y")))
    odd = lambda p, q: p.join(q, "scope").where("query <> other").select("query", F.col("other").alias("id"), F.round(scoring.cosine(F.col("x"), F.col("y")), 6).alias("cosine"))
    made = sound.unionByName(odd(a.where("not good_x"), b)).unionByName(odd(a.where("good_x"), b.where("not good_y")))
    return made.select(F.col("query").alias("vec_id"), F.col("id").alias("other"), "cosine")


@query("m02_character_embedding", "SELECT item_id, list_transform(range(0, 16), lambda b: len(list_filter(string_split(lower(text), ''), lambda c: unicode(c) % 16 = b))::DOUBLE) AS v FROM benchmark")
def _(t):
    return t("benchmark").select("item_id", scoring.character_embedding(F.col("text")).alias("v"))


@query("m03_rank_fusion", "WITH g AS (SELECT user_id AS ver, 'semantic' AS gen, row_number() OVER (ORDER BY max(value) DESC, user_id) AS r FROM events WHERE event_type = 'click' GROUP BY 1 UNION ALL SELECT user_id, 'graph', row_number() OVER (ORDER BY count(*) DESC, user_id) FROM events GROUP BY 1), f AS (SELECT ver, round(sum(0.8::DOUBLE / (60 + r)), 9) AS score FROM g GROUP BY 1) SELECT ver, score FROM f ORDER BY score DESC, ver LIMIT 30")
def _(t):
    e = t("events")
    one = e.where("event_type = 'click'").groupBy(F.col("user_id").alias("ver")).agg(F.max("value").alias("s")).withColumn("gen", F.lit("semantic"))
    two = e.groupBy(F.col("user_id").alias("ver")).agg(F.count("*").cast("double").alias("s")).withColumn("gen", F.lit("graph"))
    ranked = one.unionByName(two).withColumn("r", F.row_number().over(Window.partitionBy("gen").orderBy(F.col("s").desc(), "ver")))
    fused = ranked.groupBy("ver").agg(F.round(F.sum(scoring.rrf_term(F.col("gen"), F.col("r"))), 9).alias("score"))
    return fused.orderBy(F.col("score").desc(), "ver").limit(30)


@query("m04_feature_score", "SELECT o_orderkey, round(o_totalprice / 1000000 + 0.2::DOUBLE * 0.5 + 0.16::DOUBLE * CASE WHEN o_orderstatus = 'O' THEN 1.0 WHEN o_orderstatus = 'F' THEN 0.85 ELSE 0.4 END::DOUBLE + 0.04::DOUBLE * 0.5, 6) AS score FROM orders")
def _(t):
    scope = scoring.scope_proximity(F.when(F.col("o_orderstatus") == "O", "session").when(F.col("o_orderstatus") == "F", "project").otherwise("user"))
    return t("orders").select("o_orderkey", scoring.feature_score(fused=F.col("o_totalprice") / 1000000, relevance=F.lit(0.5), scope=scope, recency=F.lit(0.5)).alias("score"))


@query("m09_confidence", "SELECT o_orderkey, round(greatest(0, least(1, 0.45 + 0.2 + CASE WHEN o_orderkey % 2 = 0 THEN 0.15 ELSE 0 END + CASE WHEN o_orderkey % 3 = 0 THEN 0.1 ELSE 0 END + CASE WHEN o_orderkey % 5 = 0 THEN 0.03 ELSE 0 END))::DOUBLE, 3) AS confidence FROM orders")
def _(t):
    k = F.col("o_orderkey")
    return t("orders").select("o_orderkey", scoring.confidence(F.lit(0.2), k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("confidence"))


@query("m12_evidence_score", "SELECT p_partkey, round(least(0.96::DOUBLE, 0.48::DOUBLE + 0.12::DOUBLE * (p_size % 4) + 0.24::DOUBLE * (p_size % 2)) + least(0.05::DOUBLE, 0.05::DOUBLE * (p_size / 50.0::DOUBLE)), 6) AS score FROM part")
def _(t):
    return t("part").select("p_partkey", F.round(scoring.evidence_score(F.col("p_size") % 4, F.col("p_size") % 2, F.col("p_size") / 50.0), 6).alias("score"))


@query("m13_attachment_budget", "SELECT p_partkey, CASE WHEN b < 200 THEN 0 ELSE b END AS budget FROM (SELECT p_partkey, least(CAST(floor(p_size * 100 * 0.25) AS BIGINT), 1800, 1000) AS b FROM part)")
def _(t):
    return t("part").select("p_partkey", scoring.attachment_budget(F.col("p_size") * 100, 0.25, [1800, 1000], 200).alias("budget"))


@query("m14_positional_score", "SELECT o_orderpriority, o_orderkey, round(greatest(0.1::DOUBLE, 1 - 0.04::DOUBLE * i), 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) - 1 AS i FROM orders) WHERE i < 12")
def _(t):
    w = Window.partitionBy("o_orderpriority").orderBy(F.col("o_totalprice").desc(), "o_orderkey")
    return t("orders").select("o_orderpriority", "o_orderkey", (F.row_number().over(w) - 1).alias("i")).where("i < 12").select("o_orderpriority", "o_orderkey", F.round(scoring.positional_score(F.col("i")), 6).alias("score"))


@query("m16_backoff", "SELECT event_id, CAST(least(900, 10 * pow(2, event_id % 9)) AS BIGINT) AS seconds FROM events")
def _(t):
    return t("events").select("event_id", LONG(scoring.backoff(F.col("event_id") % 9)).alias("seconds"))
