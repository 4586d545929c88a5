"""From raw documents to packed training sequences: quality, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and returns the columns of documents (the
last one returns pieces). Stages are written as Parquet and reread, so a lost executor costs one stage's tasks at most.
SQL cannot express the stages (models, hashes, edit distances and a linear program), so tests compare them with
brute-force versions.

Every stage decides row by row: rows that repeat a doc_id, or have none, are documents of their own, and each is kept or
dropped for what its own text says. Columns beyond doc_id and text are handed through, whatever they are called and hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlens.llm.decontaminate import leaking
from ledgerlens.llm.linedup import dedup_lines
from ledgerlens.llm.packing import pack
from ledgerlens.llm.resample import resample
from ledgerlens.llm.store import dropped, saved, table
from ledgerlens.llm.superminhash import near_duplicates

ORACLE_SQL = None


def _wrapped(docs: DataFrame) -> DataFrame:
    """doc_id, text and all columns of docs as one, so that no column of docs meets one of an operator's."""
    return docs.select("doc_id", "text", F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"))


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the sampling keeps. Empty and null texts weigh as much as the corpus does on average; equal rows stay or go together."""
    return resample(_wrapped(docs), table(spark, sf_dir, "labels"), carry=["whole"]).where("kept").select("whole.*")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages go; so do documents of which nothing is left. Null and empty texts stay as they are."""
    out = dedup_lines(docs)
    found = F.col(f"{out.columns[-1]}.removed_lines")
    left = out.where((found == 0) | (F.trim(F.col("text").cast("string")) != ""))
    columns = [F.when(found > 0, F.length("text").cast("long")).otherwise(F.col(c)).alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return left.select(*columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group stays, that of the smallest doc_id (of rows that repeat it, the first). Texts without words stay."""
    rows = saved(docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole"), F.monotonically_increasing_id().alias("row")), "near-rows")
    keep = near_duplicates(rows.select("whole.doc_id", "whole.text", "row"), key="row").where("first").select("row")
    return rows.join(keep, "row", "left_semi").select("whole.*")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold a benchmark item go. Null and empty texts hold none."""
    return leaking(_wrapped(docs), table(spark, sf_dir, "benchmark")).where("size(leaks) = 0 or leaks is null").select("whole.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents that are left."""
    return pack(docs)


STAGES = [("quality classifier", quality), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("packing", packing)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        before, docs = docs, saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        dropped(before)
    return docs
