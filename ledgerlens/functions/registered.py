"""The library's functions for SQL: bodies in SQL that the optimizer sees through, Arrow functions, and table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import sentence_units as S
from . import unicode_text as U

#: name, parameters, type and body of the functions whose body is SQL.
SQL_FUNCTIONS = [
    ("ledger_slug", "x STRING", "STRING", r"regexp_replace(regexp_replace(lower(trim(x)), r'\s+', '_'), r'[^a-z0-9_\-؀-ۿ]', '')"),
    ("ledger_key", "kind STRING, subject STRING, predicate STRING", "STRING", "concat_ws(':', kind, ledger_slug(subject), ledger_slug(predicate))"),
    ("ledger_tokens", "x STRING", "BIGINT", "CAST(greatest(1, floor((length(x) + 3) / 4)) AS BIGINT)"),
    ("ledger_language", "x STRING", "STRING", "CASE WHEN x RLIKE '[؀-ۿ]' THEN 'fa' WHEN x RLIKE '[A-Za-z]' THEN 'en' ELSE 'und' END"),
    ("ledger_rrf", "weight DOUBLE, place BIGINT", "DOUBLE", "weight / (60 + place)"),
    ("ledger_as_of", "since TIMESTAMP, until TIMESTAMP, at TIMESTAMP", "BOOLEAN", "since <= at AND (until IS NULL OR at < until)"),
]
ARROW_FUNCTIONS = {"ledger_normalize": U.normalize_udf, "ledger_label": U.label_udf, "ledger_words": U.words_udf, "ledger_polarity": U.polarity_udf}


ENDS = {"start": "INT", "end": "INT"}
#: name, Arrow function that gives a text's spans as an array of structs, and the columns after ``place`` of the functions that give a table.
TABLE_FUNCTIONS = [
    ("ledger_blocks", U.blocks_udf, {"kind": "STRING", **ENDS}),
    ("ledger_units", U.units_udf, {"kind": "STRING", **ENDS}),
    ("ledger_words_at", U.tokens_udf, {"word": "STRING", **ENDS}),
    ("ledger_sentences", U.sentences_udf, ENDS),
    ("ledger_sentence_units", S.sentence_units_udf, {**ENDS, "confidence": "STRING", "note": "STRING"}),
]


def table_functions() -> list[str]:
    return [name for name, _, _ in TABLE_FUNCTIONS]


def register(spark: SparkSession) -> list[str]:
    """Registers all functions for the session's SQL and returns their names. Null texts give null, or no rows."""
    for name, parameters, kind, body in SQL_FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    for name, f in ARROW_FUNCTIONS.items():
        spark.udf.register(name, f)
    for name, f, shape in TABLE_FUNCTIONS:
        spark.udf.register(f"{name}_of", f)
        columns = ", ".join(f"`{c}` {kind}" for c, kind in shape.items())
        values = ", ".join(f"s.`{'kind' if c == 'word' else c}`" for c in shape)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS TABLE (place INT, {columns}) RETURN SELECT i + 1, {values} FROM posexplode({name}_of(x)) AS t(i, s)")
    return [*(f[0] for f in SQL_FUNCTIONS), *ARROW_FUNCTIONS, *table_functions()]
