r"""Text functions as column expressions. Regular expressions stay in the part that Java and RE2 share where SQL checks them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Stop words of the query planner.
STOP_WORDS = ["the", "a", "an", "what", "which", "did", "do", "we", "i", "my", "is", "are", "was", "were", "to", "for", "از", "به", "در", "که", "چه"]
#: Flags of the injection scan and their patterns, on lower-cased text.
INJECTION = {
    "instruction_like": r"ignore previous instructions|دستورهای قبلی را نادیده بگیر",
    "scope_expansion_attempt": r"other projects|all memories|پروژه‌های دیگر",
    "tool_call_attempt": r"call the .*endpoint|delete endpoint|run tool",
    "exfiltration_attempt": r"exfiltrate|reveal .*api|فاش کن",
    "delimiter_attack": r"</memory_context_attachment>|close the memory delimiter",
    "role_confusion": r"you are now the system|نقش سیستم",
    "secret_request": r"api key|token|password|secret|sk-[a-z0-9_-]{12,}|api[_-]?key\s*[:=]\s*[^\s]+|token\s*[:=]\s*[^\s]+",
    "policy_override_attempt": r"override .*policy|ignore previous|نادیده بگیر",
}
#: Conversation roles by the names that exports use.
ROLES = {"human": "user", "user": "user", "ai": "assistant", "assistant": "assistant", "model": "assistant", "bot": "assistant", "system": "system", "tool": "tool", "function": "tool"}

#: What makes an attachment instruction-like, and words of which a mere acknowledgement consists.
INSTRUCTION_LIKE = ["ignore previous instructions", "act as system", "reveal hidden context", "call a tool", "change the system prompt", "</memory_context>"]
ACKNOWLEDGEMENTS = ["agreed", "confirmed", "fine", "no", "ok", "okay", "sure", "understood", "yeah", "yep", "yes", "آره", "باشه", "بله", "خوبه", "خیر", "شدم", "متوجه", "نه"]


def slug(text: Column) -> Column:
    """Lower case, blanks as underscores, only letters, digits, hyphens and Arabic script left."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(text)), r"\s+", "_"), r"[^a-z0-9_\-؀-ۿ]", "")


def canonical_key(kind: Column, subject: Column, predicate: Column) -> Column:
    return F.concat_ws(":", kind, slug(subject), slug(predicate))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def token_estimate(text: Column) -> Column:
    return F.greatest(F.lit(1), F.floor((F.length(text) + 3) / 4)).cast("long")


def language_hint(text: Column) -> Column:
    """Script, not language: Arabic script, else ASCII letters, else undetermined."""
    return F.when(text.rlike("[؀-ۿ]"), "fa").when(text.rlike("[A-Za-z]"), "en").otherwise("und")


def planner_terms(text: Column) -> Column:
    """Words of two or more characters (hyphens inside) that are no stop words, in order and with repeats."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_؀-ۿ][\p{L}\p{N}_\-؀-ۿ]+"), F.lit(0))
    return F.filter(found, lambda w: ~F.lower(w).isin(STOP_WORDS))


def query_terms(text: Column, limit: int = 8) -> Column:
    """Distinct lower-case words of three or more characters, in order of appearance, at most so many."""
    found = F.regexp_extract_all(text, F.lit(r"[\p{L}\p{N}_؀-ۿ][\p{L}\p{N}_\-؀-ۿ]+"), F.lit(0))
    return F.slice(F.array_distinct(F.transform(F.filter(found, lambda w: F.length(w) >= 3), F.lower)), 1, limit)


def html_escaped(text: Column) -> Column:
    pairs = [("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")]
    return reduce(lambda out, p: F.replace(out, F.lit(p[0]), F.lit(p[1])), pairs, text)


def has_key(text: Column, least: int = 8) -> Column:
    """Whether a secret key (prefix sk with hyphen or underscore) is in the text; its body counts without - and _."""
    bodies = F.regexp_extract_all(F.lower(text), F.lit(r"(?:^|[^\p{L}\p{N}])sk[-_]([\p{L}\p{N}_-]*)"), F.lit(1))
    return F.exists(bodies, lambda b: F.length(F.regexp_replace(b, "[-_]", "")) >= least)


def first_shared_term(memory: str, response: str) -> Column:
    """The first word of more than four characters of a text that the (lower-case) response contains."""
    words = F.filter(F.split(F.trim(memory), r"\s+"), lambda w: F.length(w) > 4)
    plain = F.transform(words, lambda w: F.lower(F.regexp_replace(w, r"^[ .,:;]+|[ .,:;]+$", "")))
    return F.try_element_at(F.filter(plain, lambda w: F.contains(F.col(response), w)), F.lit(1))


def entities(text: Column) -> Column:
    """Capitalised words of three or more letters and all-capital ones of two or more, sorted."""
    words = F.split(text, r"[^\p{L}\p{N}\p{M}_]+")
    return F.array_sort(F.array_distinct(F.filter(words, lambda w: w.rlike(r"^(?:[A-Z][a-z]{2,}|[A-Z]{2,})$"))))


def technical_terms(text: Column) -> Column:
    """Compounds with hyphen or underscore, and runs of capitals and digits."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\b(?:[A-Za-z0-9]+(?:[-_][A-Za-z0-9]+)+|[A-Z0-9]{2,})\b"), F.lit(0)))


def redacted(text: Column, limit: int = 280) -> Column:
    """Secrets as [redacted], blanks squeezed, cut with an ellipsis."""
    out = F.regexp_replace(text, r"(?i)bearer\s+[A-Za-z0-9._\-]+", "[redacted]")
    out = F.regexp_replace(out, r"\bsk-[A-Za-z0-9_\-]{8,}", "[redacted]")
    out = F.regexp_replace(out, r"eyJ[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+\.[A-Za-z0-9_\-]+", "[redacted]")
    out = squeeze(F.regexp_replace(out, r"(?i)(password|token|secret)\s*[:=]\s*\S+", "[redacted]"))
    return F.when(F.length(out) > limit, F.concat(F.rtrim(F.substring(out, 1, limit - 1)), F.lit("…"))).otherwise(out)


def sensitivity(text: Column) -> Column:
    """secret before sensitive before normal."""
    secret = text.rlike(r"(?i)bearer\s+[A-Za-z0-9._\-]{8,}|\bsk-[A-Za-z0-9_\-]{8,}|-----BEGIN [A-Z ]*PRIVATE KEY|(password|secret|api[_ ]key)\s*[:=]")
    sensitive = text.rlike(r"[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,}|\+?[0-9][0-9 ()\-]{8,}[0-9]|(?i)\b(medical|religion|political|health)\b")
    return F.when(secret, "secret").when(sensitive, "sensitive").otherwise("normal")


def injection_flags(text: Column) -> Column:
    return F.array_compact(F.array(*(F.when(F.lower(text).rlike(p), k) for k, p in INJECTION.items())))


def numbered_lines(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"(?m)^[ \t]*[0-9]+[.):\-]")).cast("long")


def only_words_of(text: Column, words: list[str]) -> Column:
    """Whether the text has words and all of them are listed."""
    own = F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")
    return (F.size(own) > 0) & (F.size(F.array_except(own, F.array(*map(F.lit, words)))) == 0)


def instruction_like(text: Column) -> Column:
    """Whether the text holds one of the listed instructions, in any case."""
    return reduce(lambda out, p: out | F.contains(F.lower(text), F.lit(p)), INSTRUCTION_LIKE, F.lit(False))


def acknowledgement_only(text: Column) -> Column:
    """Whether the text has runs of letters and digits and all of them are words of acknowledgement."""
    own = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return (F.size(own) > 0) & (F.size(F.array_except(own, F.array(*map(F.lit, ACKNOWLEDGEMENTS)))) == 0)


def relevance(terms: Column, text: Column) -> Column:
    """Share of the terms that the text contains, within 0.25 and 1; 0.5 without terms."""
    long_ = F.filter(terms, lambda w: F.length(w) > 2)
    hit = F.size(F.filter(long_, lambda w: F.contains(F.lower(text), w)))
    return F.when(F.size(long_) == 0, 0.5).otherwise(F.greatest(F.lit(0.25), F.least(F.lit(1.0), hit / F.size(long_))))


def safe_file_name(text: Column) -> Column:
    return F.substring(F.regexp_replace(text, r"[^A-Za-z0-9._ \-]", "_"), 1, 180)


def error_class(message: Column) -> Column:
    m = F.lower(message)
    return F.when(F.contains(m, F.lit("timeout")), "timeout").when(F.contains(m, F.lit("429")), "rate_limit").when(m.rlike(r"\b5[0-9][0-9]\b"), "server").when(F.contains(m, F.lit("config")), "configuration").when(F.contains(m, F.lit("400")), "bad_request").otherwise("unknown")


def role_of(name: Column) -> Column:
    known = F.create_map(*(F.lit(x) for kv in ROLES.items() for x in kv))
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(name))), F.lit("unknown"))


def escaped_delimiters(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def fts_terms(query: Column) -> Column:
    """Quoted terms of a full-text query; quotes inside terms go."""
    parts = F.filter(F.transform(F.split(F.trim(query), r"\s+"), lambda w: F.replace(w, F.lit('"'), F.lit(""))), lambda w: w != "")
    return F.transform(parts, lambda w: F.concat(F.lit('"'), w, F.lit('"')))
