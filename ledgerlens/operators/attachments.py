"""Attachment safety: which memories may be rendered into a context attachment, what was found in them, and what failed.

Items are rows (attachment, place, memory_key, text, scope, sensitive, source, trust_level); each is judged by itself, and
an attachment's report is one aggregation over its items, in order of place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import injection_flags

#: The delimiter that closes an attachment and what it becomes inside one, what is like a secret, and what must not be rendered.
CLOSING, ESCAPED_CLOSING = "</memory_context_attachment>", "&lt;/memory_context_attachment&gt;"
SECRET_LIKE = r"(?i)(sk-[a-z0-9_-]{12,}|api[_-]?key\s*[:=]\s*[^\s]+|token\s*[:=]\s*[^\s]+)"
NEVER_RENDERED = ["sk-", "api_key"]
TRUSTED, UNTRUSTED, IMPORTED = "trusted_directive", "untrusted_data", "import"


def judged(items: DataFrame, allowed_scope: str | None = None, allow_sensitive: bool = False) -> DataFrame:
    """items with outcome (rendered or why not), flags, trust (after the scan), escaped (delimiters) and shown (the text as rendered).

    Items of another scope and sensitive ones are left out before they are scanned, so they keep their trust. A null text
    is empty, a null scope is the allowed one, a null sensitive is false.
    """
    scope = F.lit(False) if allowed_scope is None else F.coalesce("scope", F.lit(allowed_scope)) != allowed_scope
    sensitive = F.coalesce("sensitive", F.lit(False)) & F.lit(not allow_sensitive)
    text = F.coalesce("text", F.lit(""))
    escaped = F.replace(text, F.lit(CLOSING), F.lit(ESCAPED_CLOSING))
    outcome = F.when(scope, "scope_excluded").when(sensitive, "sensitive_excluded").when(escaped.rlike(SECRET_LIKE), "secret_like_excluded").otherwise("rendered")
    out = items.withColumn("outcome", outcome)
    seen = ~F.col("outcome").isin("scope_excluded", "sensitive_excluded")
    out = out.withColumn("flags", F.when(seen, injection_flags(text)).otherwise(F.array().cast("array<string>")))
    doubtful = seen & (F.col("source").eqNullSafe(F.lit(IMPORTED)) | (F.size("flags") > 0))
    count = (F.length(text) - F.length(F.replace(text, F.lit(CLOSING)))) / len(CLOSING)
    return out.withColumns(
        {
            "trust": F.when(doubtful, UNTRUSTED).otherwise(F.col("trust_level")),
            "escaped": F.when(seen, count.cast("long")).otherwise(F.lit(0).cast("long")),
            "shown": F.when(F.col("outcome") == "rendered", escaped),
        }
    )


def _warnings() -> Column:
    """What an item adds to the report: its scope, or its flags and a secret, in this order."""
    key = F.coalesce("memory_key", F.lit(""))
    flags = F.transform("flags", lambda f: F.concat(key, F.lit(":"), f))
    secret = F.when(F.col("outcome") == "secret_like_excluded", F.array(F.concat(F.lit("secret_like_excluded:"), key))).otherwise(F.array().cast("array<string>"))
    return F.when(F.col("outcome") == "scope_excluded", F.array(F.concat(F.lit("scope_excluded:"), key))).otherwise(F.concat(flags, secret))


def safety_reports(items: DataFrame, allowed_scope: str | None = None, allow_sensitive: bool = False) -> DataFrame:
    """The report of each attachment: counts, warnings, rendered text, and the policies that failed.

    An attachment is one text in the end, so its items come together in one row; they are what a token budget let in.
    """
    seen = ~F.col("outcome").isin("scope_excluded", "sensitive_excluded")
    rows = judged(items, allowed_scope, allow_sensitive).withColumn("warnings", _warnings())
    foreign = (F.coalesce("memory_key", F.lit("")) != "") & ~F.col("scope").eqNullSafe(F.lit(allowed_scope))
    told = rows.groupBy("attachment").agg(
        F.count_if(seen & ~F.col("trust").eqNullSafe(F.lit(TRUSTED))).alias("untrusted_memory_count"),
        F.count_if(F.col("trust_level") == TRUSTED).alias("trusted_directive_count"),
        F.sum("escaped").alias("escaped_delimiter_count"),
        F.count_if(F.col("outcome") == "sensitive_excluded").alias("sensitive_item_excluded_count"),
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("place", "memory_key", "warnings"))), lambda x: x["warnings"])).alias("security_warnings"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("shown").isNotNull(), F.struct("place", "memory_key", "shown")))), lambda x: x["shown"]), "\n").alias("rendered_attachment"),
        F.coalesce(F.bool_or((F.col("trust") == TRUSTED) & (F.col("source") == IMPORTED)), F.lit(False)).alias("_imported"),
        F.collect_list(F.when(foreign, F.col("memory_key"))).alias("_foreign"),
    )
    text = F.col("rendered_attachment")
    failures = F.array_compact(
        F.array(
            F.when(F.col("_imported"), "imported_content_became_trusted_directive"),
            F.when(text.contains(CLOSING), "delimiter_escaping_failed"),
            F.when(text.contains(NEVER_RENDERED[0]) | F.lower(text).contains(NEVER_RENDERED[1]), "secret_like_text_rendered"),
            F.when(F.exists("_foreign", lambda k: F.contains(text, k)), "scope_expanded") if allowed_scope is not None else F.lit(None).cast("string"),
        )
    )
    out = told.withColumn("instruction_like_content_detected", F.exists("security_warnings", lambda w: F.contains(w, F.lit("instruction_like")))).withColumn("failures", failures)
    return out.withColumn("passed", F.size("failures") == 0).drop("_imported", "_foreign")
