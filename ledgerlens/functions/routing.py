"""What a message is for and where it goes: gate, communicative function, receiver, context, routes and candidates, as columns.

Lexicons are matched on whole tokens of normalised prose (``unicode_text.prose``); the gate's lists are substrings of the
lower-cased text, as their blanks show.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import unicode_text as U

#: Substrings and whole texts of the gate.
STRONG = [
    "remember this", "don't forget", "do not forget", "from now on", "prefer", "i prefer", "we decided", "we have decided", "do not ",
    "don't ", "never ", "always ", "my name is", "by ", "i mean", "از این به بعد", "یادت باشد", "یادت باشه", "من ترجیح می", "ترجیح می‌دهم",
    "تصمیم گرفتیم", "نباید", "همیشه", "هرگز", "فعلا", "فعلاً", "نام من", "منظورم از",
]
LOW_VALUE = ["hi", "hello", "thanks", "thank you", "ok", "okay", "test", "ping", "سلام", "مرسی", "ممنون", "باشه", "تست"]
SENSITIVE = ["religion", "political", "medical", "health", "password", "token", "secret", "api key", "مذهب", "سیاسی", "پزشکی", "رمز"]
FORGET = ["forget this", "forget that", "فراموش کن"]
#: Reasons that a strong text gets, with the substrings that give them.
STRONG_REASONS = {
    "explicit_preference": ["prefer", "ترجیح"],
    "explicit_constraint": ["do not", "don't", "never", "نباید", "هرگز"],
    "project_decision": ["decided", "تصمیم گرفتیم"],
    "definition_signal": ["i mean", "منظورم از"],
    "identity_signal": ["my name is", "نام من"],
    "temporary_state": ["currently", "فعلا", "فعلاً"],
}
#: Salience, persistence, actionability, sensitivity and novelty of each gate decision.
GATE_SCORES = {
    "forget": (0.8, 0.2, 0.8, 0.7, 0.5),
    "discard": (0.05, 0.0, 0.0, 0.0, 0.0),
    "retain_raw_only": (0.2, 0.1, 0.0, 0.0, 0.2),
    "manual_review": (0.75, 0.5, 0.4, 0.8, 0.5),
    "analyze_high_confidence": (0.9, 0.85, 0.9, 0.1, 0.7),
    "analyze": (0.75, 0.75, 0.45, 0.05, 0.6),
}
#: Lexicons of receivers, instructions and contexts.
GREETINGS = ["سلام", "درود", "hello", "hi", "hey", "thanks"]
LEXICONS = {
    "team": ["product team", "team", "teams", "developer", "developers", "squad", "squads", "تیم", "تیم‌ها", "توسعه‌دهنده", "توسعه‌دهندگان", "برنامه‌نویس", "برنامه‌نویسان", "اسکواد", "اسکوادها"],
    "ai": ["ai", "assistant", "model", "chatgpt", "you", "هوش مصنوعی", "دستیار", "مدل", "تو", "شما"],
    "instruction": ["must", "should", "have to", "do not", "don't", "add", "define", "create", "implement", "route", "use", "باید", "حتما", "وظیفه", "تعریف کن", "اضافه کن", "پیاده‌سازی کن", "استفاده کن", "نکن", "نکنید", "نکنیم"],
    "privacy": ["secret", "password", "token", "api key", "privacy", "رمز", "توکن", "کلید", "حریم خصوصی"],
    "jira": ["jira", "جیرا"],
    "process": ["process", "workflow", "project", "product", "pipeline", "system logic", "configuration", "فرایند", "فرآیند", "ورک‌فلو", "جریان کار", "پروژه", "محصول", "محصولات", "منطق سیستم", "کانفیگ"],
    "metalingual": ["term", "terminology", "wording", "definition", "translation", "meaning", "i mean", "mean", "means", "defined as", "prompt wording", "prompt", "اصطلاح", "واژه", "تعریف", "ترجمه", "معنی", "منظور", "عبارت", "متن پرامپت", "پرامپت"],
    "poetic": ["slogan", "style", "rhythm", "tone", "branding", "شعار", "سبک", "لحن", "برند"],
    "emotive": ["prefer", "want", "like", "dislike", "frustrated", "annoyed", "approve", "wish", "ترجیح", "می‌خواهم", "دوست دارم", "ناراحتم", "کلافه", "راضی", "نگران"],
}
#: Contexts in the order in which they are tried; resource is a pattern, and none comes last.
CONTEXTS = ["privacy", "jira", "process", "metalingual", "resource", "poetic", "emotive"]
RESOURCE = r"(?i)https?://|www\.|file:|مسیر فایل|لینک|منبع"
FORGET_DIRECTIVE = (
    r"(?i)^\s*(?:please\s+)?(?:forget|delete|erase|remove)\b|\b(?:please|can you|could you|would you|want you to|need you to)\s+(?:forget|delete|erase|remove)\b"
    r"|\b(?:delete|erase|remove)\b.{0,80}\b(?:memory|memories|data|records?)\b|فراموش کن|حذف کن|پاک کن|حافظه.{0,40}(?:حذف|پاک)"
)
PROMPT = ["prompt", "پرامپت"]
#: Candidate type, subject, predicate and importance of each route.
PROFILES = {
    "user_preference": ("preference", "user", "preference", 0.70),
    "style_policy": ("style", "user", "style_policy", 0.72),
    "terminology_rule": ("definition", "term", "meaning", 0.70),
    "task_constraint": ("constraint", "project", "constraint", 0.85),
    "workflow_policy": ("constraint", "project", "constraint", 0.85),
    "team_obligation": ("goal", "team", "obligation", 0.84),
    "prompt_instruction": ("instruction", "prompt", "instruction", 0.82),
    "jira_configuration": ("fact", "jira", "configuration", 0.68),
    "resource_reference": ("fact", "resource", "reference", 0.62),
    "project_context": ("fact", "project", "context", 0.62),
    "emotional_stance": ("feedback", "user", "emotional_stance", 0.55),
    "privacy_review": ("instruction", "privacy", "review_request", 0.90),
    "manual_review": ("fact", "message", "manual_review", 0.50),
    "process_fact": ("fact", "message", "states", 0.55),
}
#: The route of each kind of semantic unit.
KIND_ROUTES = {
    "Instruction": "prompt_instruction", "instruction": "prompt_instruction", "Need": "team_obligation", "LearningGoal": "team_obligation",
    "Preference": "user_preference", "Constraint": "task_constraint", "Feedback": "emotional_stance", "Decision": "project_context",
    "ProjectArtifact": "project_context", "ProjectState": "project_context", "FactClaim": "project_context", "Hypothesis": "project_context",
    "Correction": "project_context", "Retraction": "project_context", "statement": "project_context", "explanation": "project_context",
}
#: Routes that a source may feed, and those that a person has to look at.
TOOL_ROUTES = ["jira_configuration", "process_fact", "project_context", "resource_reference"]
SYSTEM_ROUTES = ["prompt_instruction", "style_policy", "task_constraint", "terminology_rule", "workflow_policy"]
ASSISTANT_ROUTES = ["project_context", "process_fact", "resource_reference"]
REVIEW_ROUTES = ["manual_review", "privacy_review"]
#: Confidence deltas of source authorities, and importance of candidate types.
AUTHORITY_DELTAS = {"user_explicit": 0.25, "tool_observation": 0.2, "system_instruction": 0.15, "imported_record": 0.1, "assistant_claim": -0.2}
TYPE_IMPORTANCE = {"constraint": 0.85, "goal": 0.84, "instruction": 0.82, "style": 0.72, "preference": 0.70, "definition": 0.70, "fact": 0.62, "feedback": 0.55}


def contains_any(text: Column, needles: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(n)) for n in needles))


def looked_up(key: Column, table: dict, default=None) -> Column:
    known = F.create_map(*(F.lit(x) for kv in table.items() for x in kv))
    found = F.try_element_at(known, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def gate(text: Column, role: Column) -> Column:
    """decision, reasons (in order) and whether a high-confidence pass is wanted."""
    low = F.lower(F.trim(text))
    bare = F.lower(F.regexp_replace(low, r"^[ .!?؟]+|[ .!?؟]+$", ""))
    strong, sensitive = contains_any(low, STRONG), contains_any(low, SENSITIVE)
    idle = low.isin(LOW_VALUE) | bare.isin(LOW_VALUE) | (F.length(bare) <= 2)
    said = [F.when(strong, "strong_memory_signal"), *(F.when(strong & contains_any(low, w), k) for k, w in STRONG_REASONS.items())]
    said += [F.when(sensitive, "sensitive_mention"), F.when((role == "assistant") & strong, "assistant_claim_not_user_fact"), F.when(role == "tool", "tool_observation")]
    found = F.array_compact(F.array(F.when(idle, "low_value_phatic"), *said))
    reasons = F.when(contains_any(low, FORGET), F.array(F.lit("forget_request"))).when(idle & ~strong, F.array(F.lit("low_value_phatic"), F.lit("greeting_only"))).when(F.size(found) == 0, F.array(F.lit("no_memory_signal"))).otherwise(found)
    hard = strong & (contains_any(low, STRONG_REASONS["explicit_constraint"]) | contains_any(low, STRONG_REASONS["project_decision"]))
    decision = F.when(contains_any(low, FORGET), "manual_review").when(idle & ~strong, "discard").when(F.size(found) == 0, "retain_raw_only").when(sensitive, "manual_review").when(hard, "analyze_high_confidence").otherwise("analyze")
    scores = F.when(contains_any(low, FORGET), "forget").otherwise(decision)
    return F.struct(decision.alias("decision"), reasons.alias("reasons"), decision.isin("manual_review", "analyze_high_confidence").alias("high_confidence"), scores.alias("scores"))


def gate_score(gate_: Column, i: int) -> Column:
    return looked_up(gate_["scores"], {k: v[i] for k, v in GATE_SCORES.items()})


def function_of(plain: Column, own: Column) -> Column:
    """The dominant communicative function of normalised prose. own: its words."""
    phatic = (F.size(own) == 1) & F.element_at(own, 1).isin(GREETINGS)
    return F.when(F.coalesce(phatic, F.lit(False)), "phatic").when(U.has(plain, LEXICONS["instruction"]), "conative").when(U.has(plain, LEXICONS["metalingual"]), "metalingual").when(U.has(plain, LEXICONS["emotive"]), "emotive").when(U.has(plain, LEXICONS["poetic"]), "poetic").otherwise("referential")


def receiver_of(plain: Column, function: Column) -> Column:
    return F.when(U.has(plain, LEXICONS["team"]), "team").when(U.has(plain, LEXICONS["ai"]) | (function == "conative"), "ai").otherwise("unknown")


def context_of(plain: Column, raw: Column) -> Column:
    cond = lambda k: raw.rlike(RESOURCE) if k == "resource" else U.has(plain, LEXICONS[k])
    return F.coalesce(*(F.when(cond(k), k) for k in CONTEXTS), F.lit("none"))


def evidence_of(plain: Column, kind: Column) -> Column:
    """The first phrase of the context's lexicon in the prose; null where a pattern or nothing decided."""
    found = F.coalesce(*(F.when(kind == k, F.regexp_extract(plain, U.phrase_pattern(LEXICONS[k], group=True), 1)) for k in CONTEXTS if k != "resource"))
    return F.when(found != "", found)


def routes_of(raw: Column, function: Column, receiver: Column, context: Column, metalingual: Column) -> Column:
    """The routes (route, priority, confidence) of a unit. metalingual: whether its prose has a metalingual phrase."""
    prompt = contains_any(F.lower(raw), PROMPT)
    one = lambda route, priority, sure: F.struct(F.lit(route).alias("route"), F.lit(priority).alias("priority"), F.lit(sure).alias("confidence"))
    arr = lambda *x: F.array(*(one(*r) for r in x))
    conative = (
        F.when(receiver == "team", arr(("workflow_policy", 90, "high"), ("team_obligation", 85, "medium")))
        .when((receiver == "ai") & metalingual & prompt, arr(("prompt_instruction", 90, "high")))
        .when(receiver == "ai", arr(("task_constraint", 75, "high")))
        .otherwise(arr(("task_constraint", 75, "medium")))
    )
    also = (function == "metalingual") | ((function == "conative") & metalingual)
    return (
        F.when(function == "phatic", arr(("ignore", 0, "low")))
        .when(raw.rlike(FORGET_DIRECTIVE), arr(("privacy_review", 100, "high")))
        .when(context == "privacy", arr(("privacy_review", 95, "high")))
        .when(function == "conative", conative)
        .when((function == "referential") & (context == "jira"), arr(("jira_configuration", 80, "high")))
        .when((function == "referential") & (context == "process"), arr(("process_fact", 70, "high")))
        .when((function == "referential") & (context == "resource"), arr(("resource_reference", 60, "medium")))
        .when(also & (context == "metalingual") & prompt, arr(("prompt_instruction", 75, "high")))
        .when(also, arr(("terminology_rule", 75, "high")))
        .when((function == "emotive") & (context == "emotive"), arr(("user_preference", 65, "medium")))
        .when(function == "emotive", arr(("emotional_stance", 65, "medium")))
        .when((function == "poetic") | (context == "poetic"), arr(("style_policy", 55, "medium")))
        .otherwise(arr(("manual_review", 20, "low")))
    )


def candidate_policy(decision: Column, route: Column, status: Column, high_confidence: Column) -> Column:
    """What gate and route allow: analysis, candidates, and the reasons against."""
    candidates = decision.isin("analyze", "analyze_high_confidence")
    ignored = F.coalesce((route == "ignore") | (status == "ignored"), F.lit(False))
    ready = F.coalesce(status == "ready", F.lit(False))
    first = (
        F.when(decision.isNull(), "missing_gate_decision").when(decision == "discard", "gate_discard").when(decision == "retain_raw_only", "gate_retain_raw_only")
        .when(decision == "manual_review", "gate_manual_review_blocks_automatic_candidates").when((decision == "analyze_high_confidence") | high_confidence, "gate_requires_high_confidence_pass")
    )
    second = F.when(ignored, "route_ignored").when(~ready, "route_not_ready")
    allowed = F.coalesce(candidates, F.lit(False)) & ready & ~ignored
    return F.struct(F.coalesce(decision.isin("analyze", "analyze_high_confidence", "manual_review"), F.lit(False)).alias("analysis"), allowed.alias("candidate"), F.array_compact(F.array(first, second)).alias("reasons"))


def provenance(role: Column, route: Column, status: Column, imported: Column) -> Column:
    """authority, status, whether a candidate and a memory may come of it, and reasons."""
    theirs = role == "assistant"
    authority = F.when(imported, "imported_record").when(theirs, "assistant_claim").when(role == "tool", "tool_observation").when(role == "system", "system_instruction").otherwise("user_explicit")
    rejected = ~imported & theirs & ~route.isin(ASSISTANT_ROUTES)
    banned = ~imported & (((role == "tool") & ~route.isin(TOOL_ROUTES)) | ((role == "system") & ~route.isin(SYSTEM_ROUTES)))
    review = route.isin(REVIEW_ROUTES)
    new = F.when(rejected, "rejected").when(review, "needs_review").otherwise(status)
    why = F.when(~imported & theirs & route.isin(ASSISTANT_ROUTES), "assistant_project_artifact").when(rejected, "assistant_claim_not_user_authoritative").when(banned, F.concat(role, F.lit("_route_not_provenance_compatible")))
    memory = (status == "ready_for_consolidation") & ~rejected & ~banned & ~review
    return F.struct(authority.alias("authority"), new.alias("status"), (~banned).alias("candidate"), memory.alias("memory"), F.array_compact(F.array(why, F.when(review, "route_requires_manual_review"))).alias("reasons"))


def candidate_confidence(authority: Column, explicit: Column, status: Column) -> Column:
    score = F.lit(0.45) + looked_up(authority, AUTHORITY_DELTAS, 0.0) + F.when(explicit, 0.15).otherwise(0.0) + 0.13
    capped = F.when(status == "needs_review", F.least(score, F.lit(0.65))).when(status == "rejected", F.least(score, F.lit(0.35))).otherwise(score)
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.round(capped, 3)))
