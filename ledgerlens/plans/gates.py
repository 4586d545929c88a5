"""Rule-based gates, routes and dispositions as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_of(rules: list[tuple[str, Column]], otherwise: str) -> Column:
    """The first name whose condition holds."""
    head, *rest = rules
    return reduce(lambda c, r: c.when(r[1], r[0]), rest, F.when(head[1], head[0])).otherwise(otherwise)


def any_of(text: Column, phrases: list[str]) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(p)) for p in phrases))


def gate(text: Column, strong: list[str], low_value: list[str], sensitive: list[str]) -> Column:
    """discard for texts that are nothing but a low-value phrase, candidate for strong signals, review for sensitive terms.

    Phrases of ``strong`` and ``sensitive`` match as substrings of the lower-cased text, low-value ones as the whole text.
    """
    low = F.lower(text)
    return first_of([("discard", F.trim(low).isin(low_value)), ("candidate", any_of(low, strong)), ("review", any_of(low, sensitive))], "ignore")


def routes(units: DataFrame, rules: list[tuple[Column, list[tuple[str, int]]]], otherwise: list[tuple[str, int]]) -> DataFrame:
    """A row for each (route, priority) of the first rule that holds."""
    pack = lambda rs: F.array(*(F.struct(F.lit(r).alias("route"), F.lit(p).alias("priority")) for r, p in rs))
    head, *rest = rules
    chosen = reduce(lambda c, r: c.when(r[0], pack(r[1])), rest, F.when(head[0], pack(head[1]))).otherwise(pack(otherwise))
    return units.withColumn("_r", F.explode(chosen)).select(*units.columns, "_r.route", "_r.priority")
