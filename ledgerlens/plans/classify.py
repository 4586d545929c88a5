"""Queries of message classification: gate, function, receiver and context, routes, candidates, intents, dispositions.

The texts are the conversations, each led in by one of the fixed sentences below, so that every rule is met.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import routing as R
from ..functions import unicode_text as U
from ..operators import coverage, overrides
from ..registry import query

#: Sentences that lead in the messages; the last ones stand for messages without a signal.
PROBES = [
    "hi", "Hello!", "ok", "thanks", "سلام", "hey there",
    "I prefer short answers.", "Remember this: never deploy on Friday.", "We decided to use the new pipeline.", "Please don't add any prompt wording.",
    "My name is Robin and I like tea.", "I mean the term as a definition.", "forget this please", "Please delete my data records.", "The api key is in the vault.",
    "The team must update the Jira board.", "You should define the meaning of the prompt.", "The workflow of the project is long.", "See https://example.org for the jira docs.",
    "Look at www.example.org now.", "Our slogan has a nice rhythm.", "I am frustrated with the style.", "Developers have to create tests.", "If it works, they ship it.",
    "تیم باید تست بنویسد", "ترجیح می‌دهم کوتاه باشد", "این پروژه بزرگ است", "معنی این واژه چیست؟", "نباید حذف شود", "Currently by hand, always.",
    "What did we decide before the update?", "tokenizer tests stay", "nothing of note", "plain words only",
]
N = len(PROBES)
KEYS = ["conv_id", "turn"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(values) -> str:
    return "(" + ", ".join(map(_q, values)) + ")"


def _case(*rules: tuple[str, str], last: str = "NULL") -> str:
    return "CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in rules) + f" ELSE {last} END"


def _has(lexicon: str) -> str:
    return f"regexp_matches(plain, {_q(U.phrase_pattern(R.LEXICONS[lexicon]))})"


def _any(column: str, needles) -> str:
    return "(" + " OR ".join(f"contains({column}, {_q(n)})" for n in needles) + ")"


def _map(column: str, table: dict) -> str:
    return _case(*((f"{column} = {_q(k)}", _q(v) if isinstance(v, str) else str(v)) for k, v in table.items()))


def messages(t) -> DataFrame:
    """conv_id, turn, role, raw, plain (normalised prose) and words: every message twice, as a probe alone (turns 0, 2, ...) and as that probe with the whole text (1, 3, ...)."""
    probe = F.element_at(F.array(*map(F.lit, PROBES)), (F.pmod(F.col("conv_id") * 7 + F.col("turn"), F.lit(N)) + 1).cast("int"))
    both = F.array(probe, F.concat(probe, F.lit(" "), F.coalesce("text", F.lit(""))))
    own = t("conversations").select("conv_id", "turn", "role", F.posexplode(both).alias("part", "raw")).select("conv_id", (F.col("turn") * 2 + F.col("part")).alias("turn"), "role", "raw")
    return own.withColumns({"plain": U.prose(F.col("raw")), "words": U.words(F.col("raw"))})


SQL = f"""WITH probes(i, s) AS (VALUES {", ".join(f"({i}, {_q(s)})" for i, s in enumerate(PROBES))}),
m0 AS (SELECT conv_id, turn * 2 + part AS turn, role, CASE WHEN part = 0 THEN s ELSE s || ' ' || coalesce(text, '') END AS raw FROM conversations JOIN probes ON i = (conv_id * 7 + turn) % {N}, (VALUES (0), (1)) p(part)),
m1 AS (SELECT *, trim(regexp_replace(lower(translate(replace(raw, chr(8204), ' '), 'يىك', 'ییک')), '\\s+', ' ', 'g')) AS plain, lower(trim(raw)) AS low FROM m0),
m AS (SELECT *, regexp_extract_all(plain, '[\\p{{L}}\\p{{N}}][\\p{{L}}\\p{{N}}\\p{{M}}]*') AS words FROM m1)"""
_IDLE = f"(low IN {_in(R.LOW_VALUE)} OR bare IN {_in(R.LOW_VALUE)} OR length(bare) <= 2)"
_FUNCTION = _case((f"len(words) = 1 AND words[1] IN {_in(R.GREETINGS)}", "'phatic'"), (_has("instruction"), "'conative'"), (_has("metalingual"), "'metalingual'"), (_has("emotive"), "'emotive'"), (_has("poetic"), "'poetic'"), last="'referential'")
_CONTEXT = _case(*((f"regexp_matches(raw, {_q(R.RESOURCE)})" if k == "resource" else _has(k), _q(k)) for k in R.CONTEXTS), last="'none'")
SQL_GATE = f"""{SQL},
g0 AS (SELECT *, trim(low, ' .!?؟') AS bare, {_any("low", R.STRONG)} AS strong, {_any("low", R.SENSITIVE)} AS sensitive, {_any("low", R.FORGET)} AS forget FROM m),
g1 AS (SELECT *, {_IDLE} AS idle, list_filter([{", ".join(f"CASE WHEN {c} THEN {_q(k)} END" for k, c in [("strong_memory_signal", "strong"), *((k, f"strong AND {_any('low', w)}") for k, w in R.STRONG_REASONS.items()), ("sensitive_mention", "sensitive"), ("assistant_claim_not_user_fact", "role = 'assistant' AND strong"), ("tool_observation", "role = 'tool'")])}], lambda x: x IS NOT NULL) AS said FROM g0),
g AS (SELECT *, {_case(("forget", "'manual_review'"), ("idle AND NOT strong", "'discard'"), ("len(said) = 0 AND NOT idle", "'retain_raw_only'"), ("sensitive", "'manual_review'"), ("list_contains(said, 'explicit_constraint') OR list_contains(said, 'project_decision')", "'analyze_high_confidence'"), last="'analyze'")} AS decision FROM g1)"""
SQL_ROUTES = f"""{SQL},
f0 AS (SELECT *, {_FUNCTION} AS func, {_CONTEXT} AS context, {_has("team")} AS team, {_has("ai")} AS ai, {_has("metalingual")} AS meta, {_any("lower(raw)", R.PROMPT)} AS prompt, regexp_matches(raw, {_q(R.FORGET_DIRECTIVE)}) AS forget FROM m),
f AS (SELECT *, CASE WHEN team THEN 'team' WHEN ai OR func = 'conative' THEN 'ai' ELSE 'unknown' END AS receiver FROM f0),
r0 AS (SELECT *, {_case(
    ("func = 'phatic'", "'ignore 0 low'"), ("forget", "'privacy_review 100 high'"), ("context = 'privacy'", "'privacy_review 95 high'"),
    ("func = 'conative' AND receiver = 'team'", "'workflow_policy 90 high,team_obligation 85 medium'"), ("func = 'conative' AND receiver = 'ai' AND meta AND prompt", "'prompt_instruction 90 high'"), ("func = 'conative'", "'task_constraint 75 high'"),
    ("func = 'referential' AND context = 'jira'", "'jira_configuration 80 high'"), ("func = 'referential' AND context = 'process'", "'process_fact 70 high'"), ("func = 'referential' AND context = 'resource'", "'resource_reference 60 medium'"),
    ("func = 'metalingual' AND context = 'metalingual' AND prompt", "'prompt_instruction 75 high'"), ("func = 'metalingual'", "'terminology_rule 75 high'"),
    ("func = 'emotive' AND context = 'emotive'", "'user_preference 65 medium'"), ("func = 'emotive'", "'emotional_stance 65 medium'"), ("func = 'poetic' OR context = 'poetic'", "'style_policy 55 medium'"), last="'manual_review 20 low'",
)} AS packed FROM f),
r1 AS (SELECT *, string_split(unnest(string_split(packed, ',')), ' ') AS p FROM r0),
r AS (SELECT *, p[1] AS route, CAST(p[2] AS INTEGER) AS priority, p[3] AS confidence FROM r1)"""  # fmt: skip


def gated(t) -> DataFrame:
    return messages(t).withColumn("gate", R.gate(F.col("raw"), F.col("role")))


def routed(t) -> DataFrame:
    """A row for each route of each message."""
    m = messages(t)
    plain, raw = F.col("plain"), F.col("raw")
    m = m.withColumn("function", R.function_of(plain, F.col("words"))).withColumns({"receiver": R.receiver_of(plain, F.col("function")), "context": R.context_of(plain, raw), "meta": U.has(plain, R.LEXICONS["metalingual"])})
    return m.withColumn("r", F.explode(R.routes_of(raw, F.col("function"), F.col("receiver"), F.col("context"), F.col("meta")))).select(*KEYS, "role", "raw", "plain", "function", "receiver", "context", "r.*")


@query("c01_gate_decision", f"{SQL_GATE} SELECT conv_id, turn, decision, CASE WHEN forget THEN ['forget_request'] WHEN idle AND NOT strong THEN ['low_value_phatic', 'greeting_only'] WHEN len(said) = 0 AND NOT idle THEN ['no_memory_signal'] ELSE CASE WHEN idle THEN list_concat(['low_value_phatic'], said) ELSE said END END AS reasons, decision IN ('manual_review', 'analyze_high_confidence') AS high_confidence FROM g")
def _(t):
    return gated(t).select(*KEYS, "gate.decision", "gate.reasons", "gate.high_confidence")


@query("c02_gate_scores", f"{SQL_GATE}, s AS (SELECT *, CASE WHEN forget THEN 'forget' ELSE decision END AS k FROM g) SELECT decision, count(*) AS n, " + ", ".join(f"round(sum({_map('k', {k: v[i] for k, v in R.GATE_SCORES.items()})}), 6) AS {name}" for i, name in enumerate(("salience", "persistence", "actionability", "sensitivity", "novelty"))) + " FROM s GROUP BY decision")
def _(t):
    names = ("salience", "persistence", "actionability", "sensitivity", "novelty")
    return gated(t).groupBy(F.col("gate.decision").alias("decision")).agg(F.count("*").alias("n"), *(F.round(F.sum(R.gate_score(F.col("gate"), i)), 6).alias(k) for i, k in enumerate(names)))


@query("c04_function", f"{SQL_ROUTES} SELECT conv_id, turn, func AS function FROM f")
def _(t):
    m = messages(t)
    return m.select(*KEYS, R.function_of(F.col("plain"), F.col("words")).alias("function"))


@query("c05_receiver_and_context", f"{SQL_ROUTES} SELECT conv_id, turn, receiver, context, nullif({_case(*((f'context = {_q(k)}', 'regexp_extract(plain, ' + _q(U.phrase_pattern(R.LEXICONS[k], group=True)) + ', 1)') for k in R.CONTEXTS if k != 'resource'))}, '') AS evidence FROM f")
def _(t):
    m = messages(t)
    f = R.function_of(F.col("plain"), F.col("words"))
    m = m.select(*KEYS, R.receiver_of(F.col("plain"), f).alias("receiver"), R.context_of(F.col("plain"), F.col("raw")).alias("context"), "plain")
    return m.select(*KEYS, "receiver", "context", R.evidence_of(F.col("plain"), F.col("context")).alias("evidence"))


@query("c06_semantic_routes", f"{SQL_ROUTES} SELECT conv_id, turn, route, priority, confidence FROM r")
def _(t):
    return routed(t).select(*KEYS, "route", "priority", "confidence")


_POLICY = f"""{SQL_ROUTES}, gates AS ({SQL_GATE} SELECT conv_id, turn, decision, decision IN ('manual_review', 'analyze_high_confidence') AS sure FROM g),
p AS (SELECT r.*, decision, sure, CASE WHEN route = 'ignore' THEN 'ignored' ELSE 'ready' END AS status, decision IN ('analyze', 'analyze_high_confidence') AND route <> 'ignore' AS candidate FROM r JOIN gates USING (conv_id, turn))"""


def with_policy(t) -> DataFrame:
    """Routes with what the gate allows them."""
    g = gated(t).select(*KEYS, "gate.decision", "gate.high_confidence")
    r = routed(t).join(g, KEYS).withColumn("status", F.when(F.col("route") == "ignore", "ignored").otherwise("ready"))
    return r.withColumn("policy", R.candidate_policy(F.col("decision"), F.col("route"), F.col("status"), F.col("high_confidence")))


@query("c07_candidate_policy", f"""{_POLICY} SELECT conv_id, turn, route, decision IN ('analyze', 'analyze_high_confidence', 'manual_review') AS analysis, candidate,
list_filter([CASE decision WHEN 'discard' THEN 'gate_discard' WHEN 'retain_raw_only' THEN 'gate_retain_raw_only' WHEN 'manual_review' THEN 'gate_manual_review_blocks_automatic_candidates' WHEN 'analyze_high_confidence' THEN 'gate_requires_high_confidence_pass' END, CASE WHEN route = 'ignore' THEN 'route_ignored' END], lambda x: x IS NOT NULL) AS reasons FROM p""")
def _(t):
    return with_policy(t).select(*KEYS, "route", "policy.*")


@query("c08_route_profiles", f"{SQL_ROUTES} SELECT route, {_map('route', {k: v[0] for k, v in R.PROFILES.items()})} AS kind, {_map('route', {k: v[1] for k, v in R.PROFILES.items()})} AS subject, {_map('route', {k: v[2] for k, v in R.PROFILES.items()})} AS predicate, {_map('route', {k: v[3] for k, v in R.PROFILES.items()})}::DOUBLE AS importance, count(*) AS n FROM r WHERE route <> 'ignore' GROUP BY ALL")
def _(t):
    route = F.col("route")
    own = [R.looked_up(route, {k: v[i] for k, v in R.PROFILES.items()}).alias(name) for i, name in enumerate(("kind", "subject", "predicate", "importance"))]
    return routed(t).where(route != "ignore").groupBy(route, *own).agg(F.count("*").alias("n"))


_KINDS = [*R.KIND_ROUTES, "heading", "table"]


@query("c09_kind_routes", f"WITH k AS (SELECT event_id, [{', '.join(map(_q, _KINDS))}][event_id % {len(_KINDS)} + 1] AS kind FROM events) SELECT kind, {_map('kind', R.KIND_ROUTES)} AS route, count(*) AS n FROM k GROUP BY ALL")
def _(t):
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("event_id") % len(_KINDS) + 1).cast("int"))
    return t("events").select(kind.alias("kind")).groupBy("kind", R.looked_up(F.col("kind"), R.KIND_ROUTES).alias("route")).agg(F.count("*").alias("n"))


_SPEAKER = "CASE WHEN (conv_id + turn) % 5 = 0 THEN 'tool' ELSE role END"
_IMPORTED = "(conv_id % 11 = 3)"
_MAPPED = f"""{_POLICY},
q0 AS (SELECT *, {_SPEAKER} AS speaker, {_IMPORTED} AS imported, CASE WHEN route IN ('manual_review', 'privacy_review') THEN 'needs_review' ELSE 'ready_for_consolidation' END AS mapped FROM p WHERE route <> 'ignore'),
q AS (SELECT *, CASE WHEN imported THEN 'imported_record' WHEN speaker = 'assistant' THEN 'assistant_claim' WHEN speaker = 'tool' THEN 'tool_observation' WHEN speaker = 'system' THEN 'system_instruction' ELSE 'user_explicit' END AS authority,
  NOT imported AND speaker = 'assistant' AND route NOT IN {_in(R.ASSISTANT_ROUTES)} AS rejected,
  NOT imported AND ((speaker = 'tool' AND route NOT IN {_in(R.TOOL_ROUTES)}) OR (speaker = 'system' AND route NOT IN {_in(R.SYSTEM_ROUTES)})) AS banned FROM q0),
s AS (SELECT *, CASE WHEN rejected THEN 'rejected' WHEN route IN {_in(R.REVIEW_ROUTES)} THEN 'needs_review' ELSE mapped END AS now, mapped = 'ready_for_consolidation' AND NOT rejected AND NOT banned AS memory FROM q)"""


def with_provenance(t) -> DataFrame:
    """Routed messages with the trust in their source. Some speakers are taken for tools and some conversations for imports."""
    p = with_policy(t).where("route <> 'ignore'").withColumns({"speaker": F.when((F.col("conv_id") + F.col("turn")) % 5 == 0, "tool").otherwise(F.col("role")), "imported": F.col("conv_id") % 11 == 3})
    mapped = F.when(F.col("route").isin(R.REVIEW_ROUTES), "needs_review").otherwise("ready_for_consolidation")
    return p.withColumn("source", R.provenance(F.col("speaker"), F.col("route"), mapped, F.col("imported")))


@query("c10_provenance", f"{_MAPPED} SELECT conv_id, turn, route, authority, now AS status, NOT banned AS candidate, memory, list_filter([CASE WHEN NOT imported AND speaker = 'assistant' AND NOT rejected THEN 'assistant_project_artifact' WHEN rejected THEN 'assistant_claim_not_user_authoritative' WHEN banned THEN speaker || '_route_not_provenance_compatible' END, CASE WHEN route IN {_in(R.REVIEW_ROUTES)} THEN 'route_requires_manual_review' END], lambda x: x IS NOT NULL) AS reasons FROM s")
def _(t):
    return with_provenance(t).select(*KEYS, "route", "source.*")


_DRAFT = f"""{_MAPPED},
d0 AS (SELECT *, {_any("low", ["password", "api key", "secret", "token"])} AS secret FROM s WHERE candidate AND NOT banned),
d AS (SELECT *, CASE WHEN secret THEN 'rejected' ELSE now END AS final, 0.45 + {_map("authority", R.AUTHORITY_DELTAS)} + CASE WHEN authority IN ('imported_record', 'assistant_claim') THEN 0 ELSE 0.15 END + 0.13 AS score FROM d0)"""


def drafts(t) -> DataFrame:
    """Candidates of the routes that may have one; a secret in the text rejects it."""
    p = with_provenance(t).where(F.col("policy.candidate") & F.col("source.candidate"))
    secret = R.contains_any(F.lower(F.trim(F.col("raw"))), ["password", "api key", "secret", "token"])
    explicit = ~F.col("source.authority").isin("imported_record", "assistant_claim")
    p = p.withColumns({"status": F.when(secret, "rejected").otherwise(F.col("source.status")), "kind": R.looked_up(F.col("route"), {k: v[0] for k, v in R.PROFILES.items()})})
    sure = R.candidate_confidence(F.col("source.authority"), explicit, F.col("status"))
    memory = F.col("source.memory") & (F.col("status") == "ready_for_consolidation")
    return p.select(*KEYS, "route", "kind", F.col("source.authority").alias("authority"), "status", sure.alias("confidence"), memory.alias("memory"), F.trim("raw").alias("evidence"))


@query("c11_candidate_drafts", f"{_DRAFT} SELECT conv_id, turn, route, {_map('route', {k: v[0] for k, v in R.PROFILES.items()})} AS kind, authority, final AS status, round(least(score, CASE final WHEN 'needs_review' THEN 0.65 WHEN 'rejected' THEN 0.35 ELSE 1 END), 3)::DOUBLE AS confidence, memory AND final = 'ready_for_consolidation' AS memory, trim(raw) AS evidence FROM d")
def _(t):
    return drafts(t)


@query("m10_candidate_confidence", f"{_DRAFT} SELECT authority, final AS status, round(avg(round(least(score, CASE final WHEN 'needs_review' THEN 0.65 WHEN 'rejected' THEN 0.35 ELSE 1 END), 3)), 6)::DOUBLE AS confidence, count(*) AS n FROM d GROUP BY ALL")
def _(t):
    return drafts(t).groupBy("authority", "status").agg(F.round(F.avg("confidence"), 6).alias("confidence"), F.count("*").alias("n"))


@query("m11_type_importance", f"{_DRAFT}, k AS (SELECT {_map('route', {k: v[0] for k, v in R.PROFILES.items()})} AS kind FROM d) SELECT kind, coalesce({_map('kind', R.TYPE_IMPORTANCE)}, 0.6)::DOUBLE AS importance, count(*) AS n FROM k GROUP BY ALL")
def _(t):
    return drafts(t).groupBy("kind", R.looked_up(F.col("kind"), R.TYPE_IMPORTANCE, 0.6).alias("importance")).agg(F.count("*").alias("n"))


@query("c12_polarity", f"{SQL} SELECT conv_id, turn, CASE WHEN len(words) = 0 THEN 'unknown' WHEN regexp_matches(plain, {_q(U.phrase_pattern(U.NEGATIONS + U.CONTRACTIONS))}) OR len(list_filter(words, lambda w: starts_with(w, {_q(U.NEGATION_PREFIX)}))) > 0 THEN 'negated' ELSE 'affirmed' END AS polarity FROM m")
def _(t):
    return messages(t).select(*KEYS, U.polarity_udf("raw")["polarity"].alias("polarity"))


@query("c13_hypothetical", f"{SQL} SELECT conv_id, turn, regexp_matches(plain, {_q(U.phrase_pattern(U.SUPPOSITIONS))}) AS hypothetical FROM m")
def _(t):
    return messages(t).select(*KEYS, U.has(F.col("plain"), U.SUPPOSITIONS).alias("hypothetical"))


@query("c14_context_hints", f"{SQL}, h AS (SELECT conv_id, turn, list_filter(words, lambda w: w IN {_in(U.DEICTICS)}) AS hints FROM m) SELECT conv_id, turn, hints, CASE WHEN len(hints) > 0 THEN {U.LONG_HISTORY} ELSE {U.HISTORY} END::BIGINT AS history FROM h")
def _(t):
    hints = F.filter("words", lambda w: w.isin(U.DEICTICS))
    return messages(t).select(*KEYS, hints.alias("hints"), F.when(F.size(hints) > 0, U.LONG_HISTORY).otherwise(U.HISTORY).cast("long").alias("history"))


#: Signs of speech acts, and the labels that signs give in their order.
ACTS = {"question": ["?", "؟"], "preference": ["prefer", "ترجیح"], "decision": ["decided", "تصمیم گرفتیم"], "command": ["do not", "don't", "نباید"], "definition": ["i mean", "منظورم از"]}
LABELS = {"prefer": "prefer", "decided": "decided", "do not": "do_not", "don't": "don't", "i mean": "i_mean", "ترجیح": "preference", "تصمیم گرفتیم": "decision"}
_ACTS = "list_filter([" + ", ".join(f"CASE WHEN {_any('low', w)} THEN {_q(k)} END" for k, w in ACTS.items()) + ", CASE WHEN low IN ('hi', 'hello', 'سلام') THEN 'greeting' END], lambda x: x IS NOT NULL)"


@query("c15_speech_acts", f"""{SQL}, a0 AS (SELECT *, {_ACTS} AS found FROM m), a AS (SELECT *, CASE WHEN len(found) = 0 AND low <> '' THEN ['assertion'] ELSE found END AS acts FROM a0)
SELECT conv_id, turn, acts, CASE WHEN list_contains(acts, 'greeting') THEN 0.1 ELSE 0.7 END::DOUBLE AS referential, greatest(CASE WHEN list_contains(acts, 'preference') THEN 0.6 ELSE 0 END, CASE WHEN contains(low, '!') THEN 0.5 ELSE 0 END)::DOUBLE AS emotive,
CASE WHEN list_contains(acts, 'command') THEN 0.8 ELSE 0 END::DOUBLE AS conative, CASE WHEN list_contains(acts, 'definition') THEN 0.9 ELSE 0 END::DOUBLE AS metalingual, {_case(*((f"contains(low, {_q(k)})", _q(v)) for k, v in LABELS.items()), last="'assertion'")} AS label FROM a""")
def _(t):
    low = F.lower(F.trim(F.col("raw")))
    acts = F.array_compact(F.array(*(F.when(R.contains_any(low, w), k) for k, w in ACTS.items()), F.when(low.isin("hi", "hello", "سلام"), "greeting")))
    m = messages(t).withColumns({"low": low, "acts": F.when((F.size(acts) == 0) & (low != ""), F.array(F.lit("assertion"))).otherwise(acts)})
    score = lambda act, x: F.when(F.array_contains("acts", act), float(x)).otherwise(0.0)
    label = F.coalesce(*(F.when(F.contains(F.col("low"), F.lit(k)), v) for k, v in LABELS.items()), F.lit("assertion"))
    emotive = F.greatest(score("preference", 0.6), F.when(F.contains(F.col("low"), F.lit("!")), 0.5).otherwise(0.0))
    return m.select(*KEYS, "acts", F.when(F.array_contains("acts", "greeting"), 0.1).otherwise(0.7).alias("referential"), emotive.alias("emotive"), score("command", 0.8).alias("conative"), score("definition", 0.9).alias("metalingual"), label.alias("label"))


#: Signs of query intents, and the memory types that intents ask for.
INTENTS = {"preference": ["prefer", "ترجیح"], "past_decision": ["decision", "decided", "تصمیم"], "constraint": ["constraint", "do not", "نباید"], "definition": ["mean", "definition", "منظور"], "temporal_question": ["previous", "before", "قبلا", "قبل"], "correction_or_update": ["changed", "update", "correction"]}
INTENT_TYPES = {"preference": "preference", "past_decision": "decision", "constraint": "constraint", "definition": "definition"}
ALL_TYPES = ["preference", "decision", "constraint", "definition", "fact"]


def intents(raw: Column) -> Column:
    low = F.lower(raw)
    return F.array_compact(F.array(F.lit("current_task"), *(F.when(R.contains_any(low, w), k) for k, w in INTENTS.items())))


def memory_types(found: Column) -> Column:
    own = F.array_compact(F.transform(found, lambda k: R.looked_up(k, INTENT_TYPES)))
    return F.when(F.size(own) == 0, F.array(*map(F.lit, ALL_TYPES))).otherwise(own)


SQL_INTENTS = "list_filter(['current_task', " + ", ".join(f"CASE WHEN {_any('lower(raw)', w)} THEN {_q(k)} END" for k, w in INTENTS.items()) + "], lambda x: x IS NOT NULL)"
_TYPES = "list_filter([" + ", ".join(f"CASE WHEN list_contains(intents, {_q(k)}) THEN {_q(v)} END" for k, v in INTENT_TYPES.items()) + "], lambda x: x IS NOT NULL)"


@query("c20_intents", f"{SQL}, i AS (SELECT conv_id, turn, {SQL_INTENTS} AS intents FROM m), k AS (SELECT *, {_TYPES} AS own FROM i) SELECT conv_id, turn, intents, CASE WHEN len(own) = 0 THEN [{', '.join(map(_q, ALL_TYPES))}] ELSE own END AS types FROM k")
def _(t):
    return messages(t).select(*KEYS, intents(F.col("raw")).alias("intents")).withColumn("types", memory_types(F.col("intents")))


@query("c16_structured_artifacts", r"""WITH d AS (SELECT doc_id, trim(text) AS body, len(regexp_extract_all(text, '(?m)^[ \t]*(?:[-*+•]|[0-9]+[.)])[ \t]')) AS listed, len(regexp_extract_all(text, '(?m)^[ \t]*[0-9]+[.):\-–]')) AS numbered, CASE WHEN doc_id % 2 = 0 THEN 'user' ELSE 'assistant' END AS role FROM documents)
SELECT doc_id, greatest(listed, numbered) AS items, CASE WHEN length(body) >= 200 AND greatest(listed, numbered) >= 3 THEN CASE role WHEN 'user' THEN 'user_authored_project_artifact' ELSE 'assistant_produced_project_artifact' END END AS artifact, CASE role WHEN 'user' THEN 0.9 ELSE 0.62 END::DOUBLE AS confidence FROM d""")
def _(t):
    """Substantial structured texts; the documents stand for messages of both roles in a scope across sessions."""
    text = F.col("text")
    listed = F.regexp_count(text, F.lit(r"(?m)^[ \t]*(?:[-*+•]|[0-9]+[.)])[ \t]"))
    numbered = F.regexp_count(text, F.lit(r"(?m)^[ \t]*[0-9]+[.):\-–]"))
    items = F.greatest(listed, numbered).cast("long")
    user = F.col("doc_id") % 2 == 0
    kind = F.when(user, "user_authored_project_artifact").otherwise("assistant_produced_project_artifact")
    return t("documents").select("doc_id", items.alias("items"), F.when((F.length(F.trim(text)) >= 200) & (items >= 3), kind).alias("artifact"), F.when(user, 0.9).otherwise(0.62).alias("confidence"))


_UNITS = """mm AS (SELECT conv_id * 1000 + turn AS message, text AS raw FROM conversations WHERE text IS NOT NULL),
u AS (SELECT message, i AS "at", CASE WHEN i = 4 AND message % 2 = 0 THEN 'u2' ELSE 'u' || i END AS id, 8 * i AS s, 8 * i + 10 AS e, length(raw) AS n FROM mm, range(0, 6) t(i)),
r AS (SELECT message, "at", s, e, CASE WHEN "at" = 4 AND message % 2 = 0 AND n >= 26 THEN 'duplicate_unit_id' WHEN e > n THEN 'span_out_of_range' WHEN ("at" % 2 = 1 AND NOT ("at" = 5 AND message % 2 = 0)) THEN 'units_overlap' END AS reason FROM u)"""


def units_of(t) -> DataFrame:
    """Six units of ten characters in every message, each overlapping the one before; in some messages one repeats an id."""
    m = t("conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message"), F.col("text").alias("raw"))
    u = m.select("message", "raw", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("at")).withColumns({"start": F.col("at") * 8, "end": F.col("at") * 8 + 10})
    id_ = F.when((F.col("at") == 4) & (F.col("message") % 2 == 0), "u2").otherwise(F.concat(F.lit("u"), "at"))
    return u.withColumns({"id": id_, "evidence": F.expr("substring(raw, start + 1, 10)")})


@query("c17_validated_units", f'WITH {_UNITS} SELECT message, "at", reason FROM r')
def _(t):
    return coverage.validated(units_of(t)).select("message", F.col("at"), "reason")


@query("c18_uncovered_text", f"""WITH {_UNITS}, w AS (SELECT message, unnest(string_split(raw, ' ')) AS word, generate_subscripts(string_split(raw, ' '), 1) AS place FROM mm),
p AS (SELECT message, place, sum(length(word) + 1) OVER (PARTITION BY message ORDER BY place) - length(word) - 1 AS s, sum(length(word) + 1) OVER (PARTITION BY message ORDER BY place) - 1 AS e FROM w),
f AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.message = p.message AND r.reason IS NULL AND r.s < p.e AND p.s < r.e)), g AS (SELECT *, place - row_number() OVER (PARTITION BY message ORDER BY place) AS run FROM f)
SELECT message, min(s) AS start, max(e) AS "end", count(*) AS tokens FROM g GROUP BY message, run""")
def _(t):
    """Runs of blank-separated words that no accepted unit touches."""
    u = units_of(t)
    taken = coverage.validated(u).where("reason is null").select("message", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    words = t("conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message"), F.posexplode(F.split("text", " ")).alias("place", "word"))
    so_far = F.sum(F.length("word") + 1).over(Window.partitionBy("message").orderBy("place"))
    tokens = words.select("message", F.col("place").cast("long").alias("place"), (so_far - F.length("word") - 1).alias("start"), (so_far - 1).alias("end"))
    return coverage.uncovered(tokens, taken)


@query("c19_dispositions", """WITH u AS (SELECT l_orderkey, l_linenumber, l_partkey % 23 = 0 AS missing, CASE WHEN l_suppkey % 13 = 0 THEN 'sensitive' ELSE 'normal' END AS ceiling, l_suppkey % 17 = 0 AS conflicting, l_partkey % 19 = 0 AS unresolved, ['durable', 'transient', 'context_only', 'unknown'][l_linenumber % 4 + 1] AS durability, ['statement', 'instruction', 'question'][l_partkey % 3 + 1] AS kind, ['asserted', 'hypothetical', 'unknown'][CASE WHEN l_quantity > 10 THEN 1 WHEN l_quantity > 5 THEN 2 ELSE 3 END] AS epistemic, l_returnflag <> 'R' AS supported FROM lineitem)
SELECT disposition, reason, count(*) AS n FROM (SELECT CASE WHEN missing OR conflicting OR ceiling <> 'normal' THEN 'needs_review' WHEN unresolved THEN 'unresolved_reference' WHEN durability = 'context_only' THEN 'context_only' WHEN kind = 'instruction' AND durability = 'transient' THEN 'transient_instruction' WHEN kind = 'question' OR epistemic = 'hypothetical' THEN 'context_only' WHEN durability = 'unknown' OR epistemic = 'unknown' THEN 'needs_review' WHEN NOT supported OR durability <> 'durable' THEN 'unsupported' ELSE 'durable_candidate' END AS disposition,
CASE WHEN missing THEN 'missing_persisted_authority' WHEN conflicting AND ceiling <> 'normal' THEN 'conflicting_persisted_authority,privacy_or_sensitivity_ceiling' WHEN conflicting THEN 'conflicting_persisted_authority' WHEN ceiling <> 'normal' THEN 'privacy_or_sensitivity_ceiling' WHEN unresolved THEN 'ambiguous_or_unresolved_reference' WHEN durability = 'context_only' THEN 'context_only' WHEN kind = 'instruction' AND durability = 'transient' THEN 'transient_instruction' WHEN kind = 'question' OR epistemic = 'hypothetical' THEN 'non_asserted_or_question' WHEN durability = 'unknown' OR epistemic = 'unknown' THEN 'unknown_durability_or_epistemic_status' WHEN NOT supported THEN 'route_mapping_unsupported' WHEN durability <> 'durable' THEN 'durability_not_candidate_eligible' ELSE 'durable_policy_eligible' END AS reason FROM u) GROUP BY ALL""")
def _(t):
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), i.cast("int"))
    q = F.col("l_quantity")
    units = t("lineitem").select(
        F.when(F.col("l_partkey") % 23 == 0, 0).otherwise(1).alias("authorities"), (F.col("l_suppkey") % 17 == 0).alias("conflicting"), F.when(F.col("l_suppkey") % 13 == 0, "sensitive").otherwise("normal").alias("ceiling"),
        (F.col("l_partkey") % 19 == 0).alias("unresolved"), at(["durable", "transient", "context_only", "unknown"], F.col("l_linenumber") % 4 + 1).alias("durability"), at(["statement", "instruction", "question"], F.col("l_partkey") % 3 + 1).alias("kind"),
        at(["asserted", "hypothetical", "unknown"], F.when(q > 10, 1).when(q > 5, 2).otherwise(3)).alias("epistemic"), (F.col("l_returnflag") != "R").alias("supported"),
    )
    return units.select(coverage.disposition().alias("d")).groupBy(F.col("d.disposition").alias("disposition"), F.col("d.reason").alias("reason")).agg(F.count("*").alias("n"))


@query("c21_semantic_outcome", "SELECT CASE WHEN o_orderpriority = '1-URGENT' THEN 'succeeded_with_failed_open_stage' WHEN o_orderstatus = 'F' THEN 'succeeded_with_abstention' WHEN o_totalprice > 200000 THEN 'succeeded_with_partial_semantics' ELSE 'succeeded_no_candidate' END AS outcome, CASE WHEN o_orderpriority = '1-URGENT' THEN 'failed_open' WHEN o_orderstatus = 'F' THEN 'abstained' ELSE 'succeeded' END AS status, count(*) AS n FROM orders GROUP BY ALL")
def _(t):
    fallback, abstained, warned = F.col("o_orderpriority") == "1-URGENT", F.col("o_orderstatus") == "F", F.col("o_totalprice") > 200000
    outcome = F.when(fallback, "succeeded_with_failed_open_stage").when(abstained, "succeeded_with_abstention").when(warned, "succeeded_with_partial_semantics").otherwise("succeeded_no_candidate")
    status = F.when(fallback, "failed_open").when(abstained, "abstained").otherwise("succeeded")
    return t("orders").groupBy(outcome.alias("outcome"), status.alias("status")).agg(F.count("*").alias("n"))


@query("c22_no_memory_reason", f"""{_DRAFT}, c AS (SELECT conv_id, count(*) FILTER (WHERE memory AND final = 'ready_for_consolidation') AS memories, count(*) FILTER (WHERE final = 'needs_review') AS review, count(*) FILTER (WHERE final = 'rejected') AS rejected FROM d GROUP BY conv_id)
SELECT conv_id, CASE WHEN coalesce(memories, 0) > 0 THEN NULL WHEN review > 0 THEN 'candidate_waiting_for_review' WHEN rejected > 0 THEN 'all_candidates_rejected' WHEN memories IS NULL THEN 'no_gate_and_route_eligible_candidates' ELSE 'consolidation_created_no_canonical_memory' END AS reason FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN c USING (conv_id)""")
def _(t):
    c = drafts(t).groupBy("conv_id").agg(F.count_if("memory").alias("memories"), F.count_if(F.col("status") == "needs_review").alias("review"), F.count_if(F.col("status") == "rejected").alias("rejected"))
    why = F.when(F.coalesce("memories", F.lit(0)) > 0, None).when(F.col("review") > 0, "candidate_waiting_for_review").when(F.col("rejected") > 0, "all_candidates_rejected").when(F.col("memories").isNull(), "no_gate_and_route_eligible_candidates").otherwise("consolidation_created_no_canonical_memory")
    return t("conversations").select("conv_id").distinct().join(c, "conv_id", "left").select("conv_id", why.alias("reason"))


_PLAN = f"""WITH {_UNITS}, a AS (SELECT *, (message + "at") AS k FROM r WHERE reason IS NULL),
d AS (SELECT message, 'u' || CASE WHEN "at" = 4 AND message % 2 = 0 THEN 2 ELSE "at" END AS unit_id, s AS start, e AS "end",
    CASE WHEN k % 9 = 0 OR k % 17 = 0 OR k % 13 = 0 THEN 'needs_review' WHEN k % 7 = 1 THEN 'unresolved_reference' WHEN k % 4 = 2 THEN 'context_only' WHEN message % 3 = 1 AND k % 4 = 1 THEN 'transient_instruction' WHEN message % 3 = 2 THEN 'context_only' WHEN k % 4 = 3 THEN 'needs_review' WHEN k % 5 = 0 THEN 'unsupported' WHEN k % 4 <> 0 THEN 'unsupported' ELSE 'durable_candidate' END AS disposition,
    CASE WHEN k % 9 = 0 THEN 'missing_persisted_authority' WHEN k % 17 = 0 AND k % 13 = 0 THEN 'conflicting_persisted_authority,privacy_or_sensitivity_ceiling' WHEN k % 17 = 0 THEN 'conflicting_persisted_authority' WHEN k % 13 = 0 THEN 'privacy_or_sensitivity_ceiling' WHEN k % 7 = 1 THEN 'ambiguous_or_unresolved_reference' WHEN k % 4 = 2 THEN 'context_only' WHEN message % 3 = 1 AND k % 4 = 1 THEN 'transient_instruction' WHEN message % 3 = 2 THEN 'non_asserted_or_question' WHEN k % 4 = 3 THEN 'unknown_durability_or_epistemic_status' WHEN k % 5 = 0 THEN 'route_mapping_unsupported' WHEN k % 4 <> 0 THEN 'durability_not_candidate_eligible' ELSE 'durable_policy_eligible' END AS reason FROM a),
w AS (SELECT message, unnest(string_split(raw, ' ')) AS word, generate_subscripts(string_split(raw, ' '), 1) AS place FROM mm),
p AS (SELECT message, place, sum(length(word) + 1) OVER (PARTITION BY message ORDER BY place) - length(word) - 1 AS s, sum(length(word) + 1) OVER (PARTITION BY message ORDER BY place) - 1 AS e FROM w),
f AS (SELECT * FROM p WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.message = p.message AND a.s < p.e AND p.s < a.e)), g AS (SELECT *, place - row_number() OVER (PARTITION BY message ORDER BY place) AS run FROM f),
i AS (SELECT message, unit_id, start, "end", disposition, reason FROM d UNION ALL SELECT message, NULL, min(s), max(e), 'unsupported', 'uncovered_material' FROM g GROUP BY message, run)"""


def planned(t):
    """Units and tokens of every message, with authorities, ceilings, durabilities and kinds of all sorts."""
    u, k = units_of(t), F.col("message") + F.col("at")
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    u = u.withColumns(
        {
            "authorities": F.when(k % 9 == 0, 0).otherwise(1), "conflicting": k % 17 == 0, "ceiling": F.when(k % 13 == 0, "sensitive").otherwise("normal"), "unresolved": k % 7 == 1, "supported": k % 5 != 0,
            "durability": at(["durable", "transient", "context_only", "unknown"], k % 4), "kind": at(["statement", "instruction", "question"], F.col("message") % 3), "epistemic": F.lit("asserted"),
        }
    )
    words = t("conversations").where("text is not null").select((F.col("conv_id") * 1000 + F.col("turn")).alias("message"), F.posexplode(F.split("text", " ")).alias("place", "word"))
    so_far = F.sum(F.length("word") + 1).over(Window.partitionBy("message").orderBy("place"))
    return u, words.select("message", F.col("place").cast("long").alias("place"), (so_far - F.length("word") - 1).alias("start"), (so_far - 1).alias("end"))


@query("c18_coverage_plan", _PLAN + """ SELECT message, unit_id, start, "end", disposition, reason, disposition = 'durable_candidate' AS proposal, CASE WHEN bool_or(disposition = 'needs_review') OVER (PARTITION BY message) THEN 'needs_review' ELSE 'complete' END AS status FROM i""")
def _(t):
    """The whole coverage plan of every message: one disposition for each accepted unit, and the text that none covers."""
    return coverage.plan(*planned(t)).drop("item_id")


def stand_in(texts: list[str], reasons: list[list[str]]) -> list[tuple[str, list[str]] | None]:
    """In place of a model: it fails for some texts, has nothing to say of others, and is sure of the rest."""
    out = []
    for text in texts:
        if len(text) % 11 == 0:
            raise ValueError("no answer")
        out.append(None if len(text) % 5 == 0 else ("analyze_high_confidence", ["model"]))
    return out


@query(
    "c03_gate_override",
    f"""{SQL_GATE}, x AS (SELECT conv_id, turn, length(raw) AS n, decision, CASE WHEN forget THEN ['forget_request'] WHEN idle AND NOT strong THEN ['low_value_phatic', 'greeting_only'] WHEN len(said) = 0 AND NOT idle THEN ['no_memory_signal'] ELSE CASE WHEN idle THEN list_concat(['low_value_phatic'], said) ELSE said END END AS reasons FROM g)
    SELECT conv_id, turn, CASE WHEN n % 11 = 0 OR n % 5 = 0 THEN decision ELSE 'analyze_high_confidence' END AS decision, CASE WHEN n % 11 = 0 THEN list_append(reasons, 'model_classifier_failed') WHEN n % 5 = 0 THEN reasons ELSE ['model'] END AS reasons, CASE WHEN n % 11 = 0 OR n % 5 = 0 THEN 'rules' ELSE 'model' END AS by, CASE WHEN n % 11 = 0 THEN 'ValueError: no answer' END AS error FROM x""",
)
def _(t):
    """The gate of every message after a classifier that may fail; where it does, the rules stand."""
    g = gated(t).select(*KEYS, F.col("raw").alias("text"), F.col("gate.decision").alias("decision"), F.col("gate.reasons").alias("reasons"))
    return overrides.overridden(g, stand_in).drop("text")
