"""Set, dedup, delta and interval operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_max(first: DataFrame, second: DataFrame, key: Sequence[str], score: str = "score") -> DataFrame:
    """Two scored lists merged by key; the larger score stays and the first list wins ties."""
    both = first.withColumn("_src", F.lit(0)).unionByName(second.withColumn("_src", F.lit(1)))
    rest = [c for c in first.columns if c not in key]
    best = both.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(F.col(score), (-F.col("_src")).alias("o"))).alias("b"))
    return best.select(*key, *(F.col(f"b.{c}").alias(c) for c in rest))


def diverse(rows: DataFrame, group: Sequence[str], key: Column, exempt: Column, order: Sequence[Column], limit: int) -> DataFrame:
    """One row for each key inside a group, exempt rows aside, then the best ``limit`` in order."""
    once = rows.withColumn("_k", key).withColumn("_e", exempt)
    w = Window.partitionBy(*group, "_k", "_e").orderBy(*order)
    kept = once.withColumn("_rn", F.row_number().over(w)).where("_e or _rn = 1").drop("_rn", "_k", "_e")
    return kept.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= limit)


def drop_repeats_of_first(rows: DataFrame, key: str, text: str, order: Sequence[str]) -> DataFrame:
    """Drops a later row that has the text of its key's first row."""
    w = Window.partitionBy(key).orderBy(*order)
    firsts = rows.withColumn("_first", F.first(text).over(w)).withColumn("_rn", F.row_number().over(w))
    return firsts.where((F.col("_rn") == 1) | ~F.col(text).eqNullSafe(F.col("_first"))).drop("_first", "_rn")


def replays(captures: DataFrame, key: str, payload: str, order: Sequence[str]) -> DataFrame:
    """Adds outcome: ``new`` for a key's first capture, then ``replay`` for the same payload and ``conflict`` for another."""
    w = Window.partitionBy(key).orderBy(*order)
    first = F.first(payload).over(w)
    outcome = F.when(F.row_number().over(w) == 1, "new").when(F.col(payload).eqNullSafe(first), "replay").otherwise("conflict")
    return captures.withColumn("outcome", outcome)


def insert_new(target: DataFrame, rows: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows whose key the target lacks, one for each key."""
    return rows.dropDuplicates(list(key)).join(target.select(*key), list(key), "left_anti")


def upsert(target: DataFrame, rows: DataFrame, key: Sequence[str], order: Column) -> DataFrame:
    """The target with rows written over equal keys; among rows of one key the first in ``order`` wins."""
    both = target.withColumn("_new", F.lit(0)).unionByName(rows.withColumn("_new", F.lit(1)))
    w = Window.partitionBy(*key).orderBy(F.col("_new").desc(), order)
    return both.withColumn("_rn", F.row_number().over(w)).where("_rn = 1").drop("_rn", "_new")


def digest(rows: DataFrame, parts: int = 64) -> DataFrame:
    """rows, digest: an order-insensitive digest of a table.

    Row hashes are added modulo 2^61 - 1 in groups and as a whole, so any size is summed where it lies; equal multisets
    of rows give equal digests.
    """
    line = F.sha2(F.to_json(F.struct(*sorted(rows.columns)), {"ignoreNullFields": "false"}), 256)
    value = F.conv(F.substring(line, 1, 12), 16, 10).cast("decimal(38,0)")
    high = F.conv(F.substring(line, 13, 12), 16, 10).cast("decimal(38,0)")
    return rows.agg(F.count("*").alias("rows"), F.concat_ws("-", F.coalesce(F.sum(value), F.lit(0)).cast("string"), F.coalesce(F.sum(high), F.lit(0)).cast("string")).alias("digest"))


def merged_spans(spans: DataFrame, key: Sequence[str]) -> DataFrame:
    """Spans that touch or overlap, joined into one: an island begins where a span starts beyond all before it. Null ends come last."""
    w = Window.partitionBy(*key).orderBy(F.col("start").asc_nulls_last(), F.col("end").asc_nulls_last())
    past = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = spans.withColumn("_past", past).withColumn("_new", F.when(F.col("_past").isNull() | (F.col("start") > F.col("_past")), 1).otherwise(0)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*key, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def runs(rows: DataFrame, key: Sequence[str], order: Sequence[str], breaks: Column, name: str = "run") -> DataFrame:
    """Numbers the runs of neighbouring rows; ``breaks`` says where a row starts a new one (it may use F.lag over order)."""
    w = Window.partitionBy(*key).orderBy(*order)
    return rows.withColumn("_b", breaks).withColumn(name, F.sum(F.when(F.coalesce("_b", F.lit(True)), 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_b")
