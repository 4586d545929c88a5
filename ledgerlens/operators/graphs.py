"""Graph tables: nodes and edges that are merged or rebuilt without repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame


def rebuilt(rows: DataFrame) -> DataFrame:
    """The rows of a rebuilt node or edge table: what is there now, each once, and nothing of before."""
    return rows.dropDuplicates()


def merged(target: DataFrame, rows: DataFrame, keys: list[str]) -> DataFrame:
    """target with rows merged in by key: new keys are added, known ones stay as they are, so a replay changes nothing."""
    fresh = rows.dropDuplicates(keys).join(target.select(*keys), keys, "left_anti")
    return target.unionByName(fresh)
