"""Versioned facts: candidates folded into add, reinforce, contradict and supersede decisions per key.

The fold depends on the last accepted version (a contradiction does not advance it), so it is no plain lag. Candidates
are dealt and sorted by key and order and the fold streams over them batch by batch, holding one key's state and never its
rows, so a key may have any number of candidates.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema


def contradicts(a: Column, b: Column) -> Column:
    """Both polarities known and unlike."""
    known = F.coalesce((a != "unknown") & (b != "unknown"), F.lit(False))
    return known & (a != b)


def streamed(rows: DataFrame, order: list[str], start: Callable, step: Callable, shape: str) -> DataFrame:
    """step(state, row) -> (state, values) over the rows of each key in order; a row of values for each, after the key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state = None, None
        for b in batches:
            out = []
            for r in b.to_pylist():
                if now is None or r["key"] != now[0]:
                    now, state = (r["key"],), start(r)
                state, values = step(state, r)
                out.append({"key": r["key"]} | values)
            yield pa.RecordBatch.from_pylist(out, schema=to_arrow_schema(kind))

    kind = rows.sparkSession.createDataFrame([], f"key {rows.schema['key'].dataType.simpleString()}, {shape}").schema
    return rows.repartition("key").sortWithinPartitions("key", *order).mapInArrow(run, kind)


def _decide(state: tuple, r: dict) -> tuple[tuple, dict]:
    text, polarity, version = state
    unlike = polarity != r["polarity"] and None not in (polarity, r["polarity"]) and "unknown" not in (polarity, r["polarity"])
    if r["status"] == "rejected":
        op = "REJECT"
    elif r["status"] == "needs_review" or r["predicate"] == "forget_request":
        op = "MANUAL_REVIEW"
    elif version == 0:
        op = "ADD"
    elif text == r["text"]:
        op = "REINFORCE"
    else:
        op = "CONTRADICT" if unlike else "SUPERSEDE"
    if op in ("ADD", "SUPERSEDE"):
        state = r["text"], r["polarity"], version + 1
    return state, {"seq": r["seq"], "operation": op, "version": state[2]}


def consolidate(candidates: DataFrame) -> DataFrame:
    """key, seq, operation, version for each candidate (key, seq, status, predicate, text, polarity)."""
    rows = candidates.select("key", F.col("seq").cast("long"), "status", "predicate", "text", "polarity")
    return streamed(rows, ["seq", "status", "text"], lambda r: (None, None, 0), _decide, "seq long, operation string, version long")


def versions(decisions: DataFrame, candidates: DataFrame) -> DataFrame:
    """Versions with valid intervals: a superseded version ends where the next begins; evidence counts reinforcements."""
    made = decisions.where(F.col("operation").isin("ADD", "SUPERSEDE")).join(candidates.select("key", "seq", "text"), ["key", "seq"])
    w = Window.partitionBy("key").orderBy("version")
    proof = decisions.where(F.col("operation").isin("ADD", "SUPERSEDE", "REINFORCE")).groupBy("key", "version").agg(F.count("*").alias("evidence"))
    out = made.select("key", "version", "text", F.col("seq").alias("tx_from"), F.lead("seq").over(w).alias("tx_until"))
    return out.join(proof, ["key", "version"])


def _govern(state: tuple, r: dict) -> tuple[tuple, dict]:
    before, text, version, status = state
    op = r["operation"]
    if op in ("mark_incorrect", "mark_outdated"):
        status = "needs_review"
    elif op == "retract":
        status = "retracted"
    elif op == "undo":
        if version > 1:
            before, text, version = text, before, version + 1
    else:  # confirm, correct, restore, merge, split, change_scope, change_sensitivity, pin, unpin
        before, text, version, status = text, r["value"] if op == "correct" and r["value"] is not None else text, version + 1, "active"
    return (before, text, version, status), {"seq": r["seq"], "text": text, "version": version, "status": status}


def corrected(history: DataFrame, operations: DataFrame) -> DataFrame:
    """key, text, version, status after all governance operations (key, seq, operation, value) in order.

    confirm, correct and restore and the changes of place make a new version, which ``correct`` alone gives another text;
    marks put the fact under review and ``retract`` withdraws it; ``undo`` appends the text of the version before the
    last, so that undoing twice is a redo. Operations of keys without history are left out.
    """
    w = Window.partitionBy("key").orderBy(F.col("version").desc())
    two = history.withColumn("rn", F.row_number().over(w)).where("rn <= 2").groupBy("key").agg(F.max_by("text", "version").alias("current"), F.min_by("text", "version").alias("previous"), F.max("version").alias("latest"))
    value = F.col("value") if "value" in operations.columns else F.lit(None).cast("string")
    ops = operations.select("key", F.col("seq").cast("long"), "operation", value.alias("value")).join(two, "key")
    steps = streamed(ops, ["seq", "operation"], lambda r: (r["previous"], r["current"], r["latest"], "active"), _govern, "seq long, text string, version long, status string")
    last = steps.groupBy("key").agg(F.max_by(F.struct("text", "version", "status"), F.struct("version", "seq")).alias("s"), F.max_by("status", "seq").alias("status"))
    return two.join(last, "key", "left").select("key", F.coalesce("s.text", "current").alias("text"), F.coalesce("s.version", "latest").alias("version"), F.coalesce("status", F.lit("active")).alias("status"))
