"""Projection of many spans between raw and normalised texts, as one ordered pass over run-length pieces.

Pieces (key, at, to, raw_start, raw_end, whole) say which stretch of the normalised text, [at, to), stands for which of the
raw one. Ends of spans and pieces are put in one order by position and each end takes the piece beside it, so a text with
many spans and many pieces is sorted once and no span meets a piece that it does not need.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import unicode_text as U

PIECE = "struct<at:int,to:int,raw_start:int,raw_end:int,whole:boolean>"


def pieces_of(texts: DataFrame, key: str, text: str) -> DataFrame:
    """key, piece of every piece of every text."""
    own = texts.select(F.col(key).alias("key"), U.mapped_udf(text).alias("m"))
    to = lambda i: F.coalesce(F.get("m.pieces", i + 1)["at"], F.length("m.text"))
    piece = F.transform("m.pieces", lambda p, i: F.struct(p["at"].alias("at"), to(i).alias("to"), p["raw_start"].alias("raw_start"), p["raw_end"].alias("raw_end"), p["whole"].alias("whole")).cast(PIECE))
    return own.select("key", F.explode(piece).alias("piece"))


def _beside(spans: DataFrame, pieces: DataFrame, first: tuple[str, Column], last: tuple[str, Column]) -> DataFrame:
    """key, span, start, stop with ``first`` and ``last``: for either end the last piece at or before a position, or the first one at or after it.

    first, last: "before" or "after", and the piece's position in that order. Both ends and the pieces are dealt by key
    once; every order is one running value (backwards for "after", since a frame to the end is quadratic).
    """
    none = lambda c: F.lit(None).cast(spans.schema[c].dataType).alias(c)
    sides = [first] if first is last else [first, last]
    at = [F.col("start"), F.col("stop") - 1]
    own = lambda e: F.struct(F.lit(e).alias("end"), *(at[e].alias(f"pos{n}") if len(sides) == 1 or n == e else F.lit(None).cast("int").alias(f"pos{n}") for n in range(len(sides))))
    ends = spans.select("key", "span", "start", "stop", F.explode(F.array(own(0), own(1))).alias("e")).select("key", "span", "start", "stop", "e.*", F.lit(None).cast(PIECE).alias("piece"))
    marks = pieces.select("key", none("span"), none("start"), none("stop"), F.lit(None).cast("int").alias("end"), *(p.cast("int").alias(f"pos{n}") for n, (_, p) in enumerate(sides)), "piece")
    rows = ends.unionByName(marks)
    for n, (side, _) in enumerate(sides):
        by = [F.col(f"pos{n}"), F.col("piece").isNull(), F.col("piece.at")] if side == "before" else [F.col(f"pos{n}").desc(), F.col("piece").isNull(), F.col("piece.at").desc()]
        rows = rows.withColumn(f"found{n}", F.last("piece", ignorenulls=True).over(Window.partitionBy("key").orderBy(*by).rowsBetween(Window.unboundedPreceding, 0)))
    found = [F.first(F.when(F.col("end") == e, F.col(f"found{e if len(sides) > 1 else 0}")), ignorenulls=True).alias(name) for e, name in enumerate(("first", "last"))]
    return rows.where("end is not null").groupBy("key", "span").agg(F.first("start").alias("start"), F.first("stop").alias("stop"), *found)


def to_raw(spans: DataFrame, pieces: DataFrame) -> DataFrame:
    """spans (key, span, start, stop of the normalised text; key and span tell rows apart) with raw_start, raw_stop."""
    at = ("before", F.col("piece.at"))
    both = _beside(spans, pieces, at, at)
    low = F.when(F.col("first.whole"), F.col("first.raw_start")).otherwise(F.col("first.raw_start") + F.col("start") - F.col("first.at"))
    high = F.when(F.col("last.whole"), F.col("last.raw_end")).otherwise(F.col("last.raw_start") + F.col("stop") - F.col("last.at"))
    return both.select("key", "span", "start", "stop", low.alias("raw_start"), high.alias("raw_stop"))


def to_normalized(spans: DataFrame, pieces: DataFrame) -> DataFrame:
    """spans (key, span, start, stop of the raw text) with plain_start, plain_stop; both null if nothing of the span is left."""
    both = _beside(spans, pieces, ("after", F.col("piece.raw_end") - 1), ("before", F.col("piece.raw_start")))
    left = F.col("first").isNotNull() & F.col("last").isNotNull() & (F.col("first.at") <= F.col("last.at"))
    low = F.when(F.col("first.whole"), F.col("first.at")).otherwise(F.col("first.at") + F.greatest(F.lit(0), F.col("start") - F.col("first.raw_start")))
    high = F.when(F.col("last.whole"), F.col("last.to")).otherwise(F.least(F.col("last.to"), F.col("last.at") + F.col("stop") - F.col("last.raw_start")))
    return both.select("key", "span", "start", "stop", F.when(left, low).alias("plain_start"), F.when(left, high).alias("plain_stop"))
