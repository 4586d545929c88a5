"""JSON as identity: canonical text, its hash, name-based UUIDs, and checks of what interchange JSON may hold."""

from __future__ import annotations

import json
import math
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The largest whole number that every JSON reader keeps.
SAFE = 2**53 - 1
TIMES = re.compile(r"(_at|_from|_until)$")
RFC3339 = re.compile(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$")


def canonical(**values: Column) -> Column:
    """JSON text with sorted keys, no blanks, and nulls written. Values are whole numbers, texts, booleans or arrays of them."""
    return F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))), {"ignoreNullFields": "false"})


def present(**values: Column) -> Column:
    """The same of the keys whose value is not null."""
    return F.to_json(F.struct(*(values[k].alias(k) for k in sorted(values))))


def digest(text: Column) -> Column:
    return F.sha2(text, 256)


def uuid5(namespace: str, name: Column) -> Column:
    """The name-based UUID (version 5) of a text in a namespace UUID."""
    hashed = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.element_at(F.array(*map(F.lit, "89ab")), (F.conv(F.substring(hashed, 17, 1), 16, 10).cast("int") % 4 + 1).cast("int"))
    return F.concat(F.substring(hashed, 1, 8), F.lit("-"), F.substring(hashed, 9, 4), F.lit("-5"), F.substring(hashed, 14, 3), F.lit("-"), variant, F.substring(hashed, 18, 3), F.lit("-"), F.substring(hashed, 21, 12))


def fault(text: str | None) -> str | None:
    """Why a text is no interchange JSON: malformed, duplicate_key, non_finite, unsafe_integer, lone_surrogate or bad_timestamp."""
    if text is None:
        return "malformed"
    found: list[str] = []

    def pairs(items: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in items}) < len(items):
            found.append("duplicate_key")
        return dict(items)

    def constant(_: str) -> None:
        found.append("non_finite")

    try:
        value = json.loads(text, object_pairs_hook=pairs, parse_constant=constant)
    except ValueError:
        return "malformed"
    stack: list[tuple[str | None, object]] = [(None, value)]
    while stack:
        key, v = stack.pop()
        if isinstance(v, str):
            if any("\ud800" <= c <= "\udfff" for c in v):
                found.append("lone_surrogate")
            if key and TIMES.search(key) and not RFC3339.match(v):
                found.append("bad_timestamp")
        elif isinstance(v, int) and not isinstance(v, bool) and abs(v) > SAFE:
            found.append("unsafe_integer")
        elif isinstance(v, float) and not math.isfinite(v):
            found.append("non_finite")
        elif isinstance(v, dict):
            if any(TIMES.search(k) and not isinstance(x, str) for k, x in v.items()):
                found.append("bad_timestamp")
            stack += list(v.items())
        elif isinstance(v, list):
            stack += [(None, x) for x in v]
    return found[0] if found else None


@F.pandas_udf(T.StringType())
def fault_udf(text: pd.Series) -> pd.Series:
    return text.map(fault)


def fragments(text: str | None) -> list[str]:
    """All strings in a JSON text, in order; none for a text that is no JSON."""
    try:
        value = json.loads(text or "")
    except ValueError:
        return []
    out, stack = [], [value]
    while stack:
        v = stack.pop()
        if isinstance(v, str):
            out.append(v)
        elif isinstance(v, dict | list):
            stack += list(v.values() if isinstance(v, dict) else v)[::-1]
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def fragments_udf(text: pd.Series) -> pd.Series:
    return text.map(fragments)
