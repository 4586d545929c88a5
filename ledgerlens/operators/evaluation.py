"""Retrieval metrics and governance checks over tables of ranked and expected keys."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..checkpoints import checkpointed
from .substrings import containing


def metrics(results: DataFrame, expected: DataFrame, cases: DataFrame, k: int) -> DataFrame:
    """case, recall, precision, mrr, ndcg at k.

    results: case, key, rank (from 1). expected: case, key. cases: all case ids, so that cases without results or
    expectations get their defined values: recall, mrr and ndcg are 1 if nothing is expected; precision without results
    is 1 if nothing is expected, else 0.
    """
    want = checkpointed(expected.select("case", "key").distinct())  # read twice
    n = want.groupBy("case").agg(F.count("*").alias("want"))
    hits = results.join(want.withColumn("hit", F.lit(1)), ["case", "key"], "left")
    top = F.col("rank") <= k
    got = hits.groupBy("case").agg(
        F.count_if(top).alias("shown"),
        F.count_if(top & F.col("hit").isNotNull()).alias("found"),
        F.min(F.when(F.col("hit").isNotNull(), F.col("rank"))).alias("first"),
        F.sum(F.when(top & F.col("hit").isNotNull(), 1 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)).alias("gain"),
    )
    row = cases.select("case").distinct().join(n, "case", "left").join(got, "case", "left").na.fill({"want": 0, "shown": 0, "found": 0, "gain": 0.0})
    ideal = F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.least(F.col("want"), F.lit(k))).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1.0))
    none = F.col("want") == 0
    return row.select(
        "case",
        F.round(F.when(none, 1.0).otherwise(F.col("found") / F.col("want")), 6).alias("recall"),
        F.round(F.when(F.col("shown") == 0, F.when(none, 1.0).otherwise(0.0)).otherwise(F.col("found") / F.col("shown")), 6).alias("precision"),
        F.round(F.when(none, 1.0).when(F.col("first").isNull(), 0.0).otherwise(1 / F.col("first")), 6).alias("mrr"),
        F.round(F.when(none, 1.0).otherwise(F.col("gain") / ideal), 6).alias("ndcg"),
    )


def erasure_closure(targets: DataFrame, links: list[tuple[str, DataFrame, str, str]]) -> DataFrame:
    """record_type, record_id, reached from targets (id) along a chain of (name, table, foreign key, primary key)."""
    level = targets.select(F.col("id").cast("string"))
    out = level.select(F.lit("target").alias("record_type"), F.col("id").alias("record_id"))
    for name, rows, foreign, primary in links:
        level = rows.join(level, F.col(foreign).cast("string") == F.col("id"), "left_semi").select(F.col(primary).cast("string").alias("id")).distinct()
        out = out.unionByName(level.select(F.lit(name).alias("record_type"), F.col("id").alias("record_id")))
    return out


def erased(rows: DataFrame, targets: DataFrame, key: str, text: list[str]) -> DataFrame:
    """rows with the text columns of target rows (id) overwritten by [erased]."""
    hit = rows.join(targets.select(F.col("id").alias("_id")).distinct().withColumn("_hit", F.lit(True)), F.col(key) == F.col("_id"), "left")
    return hit.select(*(F.when(F.col("_hit"), "[erased]").otherwise(F.col(c)).alias(c) if c in text else F.col(c) for c in rows.columns))


def residue(tables: list[tuple[str, DataFrame, str, str]], fragments: DataFrame, limit: int = 20) -> DataFrame:
    """table, key: up to ``limit`` rows per table that still contain an erased fragment. Any number of fragments is looked up by what they share with a table's words."""
    out = None
    for name, rows, key, text in tables:
        hit = containing(rows, key, text, fragments.select(F.col("fragment").alias("needle"))).select(key).distinct()
        part = hit.orderBy(key).limit(limit).select(F.lit(name).alias("table"), F.col(key).cast("string").alias("key"))
        out = part if out is None else out.unionByName(part)
    return out


def fragments_erased(rows: DataFrame, fragments: list[str], text: str) -> DataFrame:
    """Rows whose text holds one of the fragments (a request's short list), with every occurrence overwritten."""
    body = F.col(text)
    hit = reduce(lambda a, b: a | b, (F.contains(body, F.lit(f)) for f in fragments))
    return rows.where(hit).withColumn(text, reduce(lambda out, f: F.replace(out, F.lit(f), F.lit("[erased]")), fragments, body))


def schema_diff(expected: DataFrame, found: DataFrame) -> DataFrame:
    """name, difference of the columns of two tables: same, missing, extra, or the change of type."""
    want, have = dict(expected.dtypes), dict(found.dtypes)
    rows = [(c, "missing" if c not in have else "same" if have[c] == k else f"type {k} -> {have[c]}") for c, k in want.items()]
    rows += [(c, "extra") for c in have if c not in want]
    return expected.sparkSession.createDataFrame(rows, "name string, difference string")
