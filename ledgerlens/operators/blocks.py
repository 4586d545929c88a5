"""Versioned blocks of rendered facts: packing under limits, snapshots, staleness, rollback and drift."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def packed_sections(sections: DataFrame, budget: int) -> DataFrame:
    """run, i, kept of sections (run, i, size): skip what does not fit and go on; a run's first section always stays.

    A run is one rendered answer, so its sections are few; the fold carries the size used and the verdicts.
    """
    rows = sections.groupBy("run").agg(F.array_sort(F.collect_list(F.struct(F.col("i").cast("long").alias("i"), F.col("size").cast("long").alias("size")))).alias("ss"))
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<i:bigint,kept:boolean>>").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        kept = (F.size(acc["out"]) == 0) | (acc["used"] + s["size"] <= budget)
        return F.struct((acc["used"] + F.when(kept, s["size"]).otherwise(F.lit(0))).cast("long").alias("used"), F.concat(acc["out"], F.array(F.struct(s["i"].alias("i"), kept.alias("kept")))).alias("out"))

    return rows.select("run", F.explode(F.aggregate("ss", start, step, lambda a: a["out"])).alias("o")).select("run", "o.i", "o.kept")


def rendered(items: DataFrame, limit: int) -> DataFrame:
    """block, body, items, omitted of items (block, place, line): lines in order while the joined length stays in the limit.

    A line that does not fit is left out and later ones may still fit. A block is one page of a prompt: its eligible
    lines are gathered in one row, those longer than the limit are counted by a plain aggregate.
    """
    own = items.withColumn("size", F.length("line"))
    fits = own.where(F.col("size") <= limit)
    rows = fits.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("place", "line"))).alias("ls"))
    start = F.struct(F.lit("").alias("body"), F.lit(0).cast("long").alias("n"))

    def step(acc: Column, x: Column) -> Column:
        more = F.when(acc["n"] == 0, x["line"]).otherwise(F.concat(acc["body"], F.lit("\n"), x["line"]))
        ok = F.length(more) <= limit
        return F.struct(F.when(ok, more).otherwise(acc["body"]).alias("body"), (acc["n"] + F.when(ok, 1).otherwise(0)).cast("long").alias("n"))

    made = rows.select("block", F.aggregate("ls", start, step).alias("r")).select("block", "r.body", F.col("r.n").alias("items"))
    counts = own.groupBy("block").agg(F.count("*").alias("all"))
    return counts.join(made, "block", "left").select("block", F.coalesce("body", F.lit("")).alias("body"), F.coalesce("items", F.lit(0)).alias("items"), (F.col("all") - F.coalesce("items", F.lit(0))).alias("omitted"))


def snapshots(items: DataFrame) -> DataFrame:
    """block, snapshot: one hash of each block's sources (block, source, version), whatever their order."""
    each = F.sha2(F.concat_ws("\x1f", F.col("source").cast("string"), F.col("version").cast("string")), 256)
    return items.select("block", each.alias("h")).groupBy("block").agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), "\n"), 256).alias("snapshot"))


def stale(built: DataFrame, now: DataFrame) -> DataFrame:
    """Blocks whose snapshot is no longer that of their sources, gone or new ones too. Both: block, snapshot."""
    old, new = built.select("block", F.col("snapshot").alias("old")), now.select("block", F.col("snapshot").alias("new"))
    return old.join(new, "block", "full").where(~F.col("old").eqNullSafe(F.col("new"))).select("block", F.when(F.col("old").isNull(), "new").when(F.col("new").isNull(), "gone").otherwise("changed").alias("why"))


def rolled_back(versions: DataFrame, targets: DataFrame) -> DataFrame:
    """A new version of each target block (block, to) with the body of version ``to``. versions: block, version, body."""
    last = versions.groupBy("block").agg(F.max("version").alias("last"))
    picked = versions.select("block", F.col("version").alias("restored_from"), "body").join(targets.select("block", F.col("to").alias("restored_from")), ["block", "restored_from"])
    return picked.join(last, "block").select("block", (F.col("last") + 1).alias("version"), "body", "restored_from")


def unsupported(compacted: DataFrame, allowed: DataFrame) -> DataFrame:
    """Compacted items (item, versions) that name no source, or one that is not allowed (version)."""
    named = compacted.select("item", F.explode_outer("versions").alias("version"))
    bad = named.join(allowed.select("version").distinct().withColumn("known", F.lit(True)), "version", "left")
    return bad.groupBy("item").agg(F.count_if(F.col("known").isNull()).alias("unknown")).where("unknown > 0")
