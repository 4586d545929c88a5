"""Joins of the ledger: latest child, look-back, intervals, orphans, aliases and prefixes."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..checkpoints import checkpointed

#: The grid width of versions that are still open.
OPEN = 127
#: Requests from which on an alias is joined by itself.
OFTEN = 100_000


def latest(children: DataFrame, key: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first child of each key in the given order. A total order makes the choice reproducible."""
    w = Window.partitionBy(*key).orderBy(*order)
    return children.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn")


def latest_with_ties(children: DataFrame, key: Sequence[str], value: str) -> DataFrame:
    """All children that share their key's largest value."""
    w = Window.partitionBy(*key).orderBy(F.col(value).desc())
    return children.withColumn("_rk", F.rank().over(w)).where("_rk = 1").drop("_rk")


def look_back(rows: DataFrame, key: Sequence[str], order: Sequence[str], value: Column, n: int, name: str) -> DataFrame:
    """Adds the values of the n rows before each row of its key, oldest first (a frame, so no self-join)."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(-n, -1)
    return rows.withColumn(name, F.collect_list(value).over(w))


def contained(inner: DataFrame, outer: DataFrame, key: Sequence[str], how: str = "inner", width: int = 4096) -> DataFrame:
    """Spans [start, end) of inner that lie inside a span of outer with the same key.

    Columns: key, start, end on both sides; outer's span comes as outer_start, outer_end. An outer span stands in every
    stretch of ``width`` positions that it reaches into and an inner one in that of its start, so a key with very many
    spans is no single group of the join.
    """
    at = lambda c: F.floor(F.col(c) / width)
    o = outer.select(*(F.col(k).alias(f"_{k}") for k in key), F.col("start").alias("outer_start"), F.col("end").alias("outer_end"), F.explode(F.sequence(at("start"), F.greatest(at("start"), at("end")))).alias("_at"))
    on = reduce(lambda a, b: a & b, (F.col(k) == F.col(f"_{k}") for k in key)) & (F.col("_at") == at("start")) & (F.col("outer_start") <= F.col("start")) & (F.col("end") <= F.col("outer_end"))
    out = inner.join(o, on, how)
    return out if how in ("left_semi", "left_anti") else out.drop("_at", *(f"_{k}" for k in key))


def without_overlap(spans: DataFrame, taken: DataFrame, key: Sequence[str]) -> DataFrame:
    """Spans that no span of ``taken`` with the same key overlaps.

    A span is free if, of the taken ones that start before its end, none ends after its start: one running maximum over
    both sides in order of position, and no join of spans with spans.
    """
    mine = spans.select(F.struct(*spans.columns).alias("row"), *key, F.col("end").alias("_pos"), F.lit(0).alias("_kind"), F.lit(None).cast(taken.schema["end"].dataType).alias("_to"))
    theirs = taken.select(F.lit(None).cast(mine.schema["row"].dataType).alias("row"), *key, F.col("start").alias("_pos"), F.lit(1).alias("_kind"), F.col("end").alias("_to"))
    order = Window.partitionBy(*key).orderBy("_pos", "_kind").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = mine.unionByName(theirs).withColumn("_reach", F.max("_to").over(order))
    return swept.where("_kind = 0 and (_reach is null or _reach <= row.start)").select("row.*")


def orphans(children: DataFrame, parents: DataFrame, foreign: str, primary: str) -> DataFrame:
    """Children whose foreign key has no parent; a null key counts as an orphan."""
    return children.join(parents.select(F.col(primary).alias("_pk")), F.col(foreign) == F.col("_pk"), "left_anti")


def in_either(rows: DataFrame, first: tuple[str, DataFrame, str], second: tuple[str, DataFrame, str]) -> DataFrame:
    """Rows whose column is in one key set or in the other: two flags by joins with distinct keys, never a join on OR.

    Equal rows stay as many as they are.
    """
    out = rows
    for i, (c, keys, k) in enumerate((first, second)):
        known = keys.select(F.col(k).alias(f"_key{i}"), F.lit(True).alias(f"_in{i}")).distinct()
        out = out.join(known, F.col(c) == F.col(f"_key{i}"), "left")
    return out.where("_in0 or _in1").select(*rows.columns)


def resolve_aliases(requests: DataFrame, aliases: DataFrame) -> DataFrame:
    """request, target, status: the first alias type (by priority) with exactly one target decides.

    requests: request, alias_type, alias, priority. aliases: alias_type, alias, target. Status is ``resolved``,
    ``ambiguous`` (only types with several targets) or ``unknown``. Aliases that very many requests name are few; they meet
    their requests where these are, and no task gets all of them.
    """
    names = ["alias_type", "alias"]
    often = checkpointed(requests.groupBy(*names).agg(F.count("*").alias("n")).where(F.col("n") > OFTEN).select(*names))
    # a row for each alias, whatever its number of targets: only whether it is one counts
    known = aliases.groupBy(*names).agg(F.min("target").alias("lo"), F.max("target").alias("hi")).withColumn("target", F.explode(F.array_distinct(F.array("lo", "hi")))).select(*names, "target")
    few = F.broadcast(often.join(known, names, "left"))
    common = requests.join(few, names)
    rest = requests.join(F.broadcast(often), names, "left_anti").join(known, names, "left")
    hits = common.unionByName(rest).groupBy("request", "priority", "alias_type").agg(F.count_distinct("target").alias("n"), F.min("target").alias("target"))
    unique = F.when(F.col("n") == 1, F.struct("priority", "target"))
    best = hits.groupBy("request").agg(F.min(unique).alias("best"), F.max("n").alias("most"))
    status = F.when(F.col("best").isNotNull(), "resolved").when(F.col("most") > 1, "ambiguous").otherwise("unknown")
    return best.select("request", F.col("best.target").alias("target"), status.alias("status"))


def longest_rule_first(rows: DataFrame, name: str, rules: DataFrame) -> DataFrame:
    """The first rule (by ``rule_order``) whose prefix begins the name. rules must be a small fixed table; it is broadcast."""
    met = rows.join(F.broadcast(rules), F.col(name).startswith(F.col("prefix")), "left")
    return latest(met, rows.columns, [F.col("rule_order").asc_nulls_last()])


def as_of(probes: DataFrame, versions: DataFrame, key: str) -> DataFrame:
    """All pairs of a probe and a version of its key that was valid at ``valid_at`` as it was known at ``known_at``.

    probes: key, valid_at, known_at and more. versions: key, valid_from, valid_until, known_from, known_until (times; an
    end that is null is open) and more; no other name may be on both sides. A version holds for [from, until) on both
    axes; one whose end is not after its start holds never. Null keys and null times meet nothing.

    Versions are laid on a grid of their known interval's own width: cells as wide as the next power of two seconds, of
    which an interval touches two or three. A probe looks into one cell of each width that occurs. So a key with very
    many versions is spread over cells, and no probe meets those of another time.
    """
    seconds = lambda c: F.col(c).cast("timestamp").cast("double")
    width = F.when(F.col("known_until").isNull(), F.lit(OPEN)).otherwise(F.ceil(F.log2(F.greatest(seconds("known_until") - seconds("known_from"), F.lit(1.0)))).cast("int"))
    cell = lambda c, w: F.when(w == OPEN, F.lit(0).cast("long")).otherwise(F.floor(c / F.pow(F.lit(2.0), w)).cast("long"))
    held = versions.where("(valid_until is null or valid_until > valid_from) and (known_until is null or known_until > known_from) and known_from is not null").withColumn("_width", width)
    first, last = cell(seconds("known_from"), F.col("_width")), cell(F.coalesce(seconds("known_until"), F.lit(0.0)), F.col("_width"))
    laid = held.withColumn("_cell", F.explode(F.sequence(first, last)))
    widths = [r[0] for r in held.select("_width").distinct().collect()]  # a few dozen at most: powers of two
    if not widths:
        widths = [OPEN]
    asked = probes.withColumn("_width", F.explode(F.array(*map(F.lit, widths)))).withColumn("_cell", cell(seconds("known_at"), F.col("_width")))
    # either side is many times its table, which the planner would take it for and send it whole through the driver
    met = asked.hint("merge").join(laid, [key, "_width", "_cell"])
    inside = [(F.col(f"{a}_from") <= F.col(f"{a}_at")) & (F.col(f"{a}_until").isNull() | (F.col(f"{a}_at") < F.col(f"{a}_until"))) for a in ("valid", "known")]
    return met.where(inside[0] & inside[1]).drop("_width", "_cell")
