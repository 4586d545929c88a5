"""Portable packages: tables as JSON lines with a manifest of counts and digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sets import digest


def write_package(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes each table as JSON lines with sorted keys, and the manifest (table, rows, digest, schema)."""
    manifest = None
    for name, df in tables.items():
        ordered = df.select(*sorted(df.columns))
        ordered.write.mode("overwrite").option("ignoreNullFields", "false").json(f"{folder}/{name}")
        row = digest(df.sparkSession.read.schema(ordered.schema).json(f"{folder}/{name}")).select(F.lit(name).alias("table"), "rows", "digest", F.lit(ordered.schema.json()).alias("schema"))
        manifest = row if manifest is None else manifest.unionByName(row)
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return manifest


def verify_package(spark: SparkSession, folder: str) -> DataFrame:
    """table, status: ok, checksum_mismatch or missing. The manifest has one row for each table."""
    from pyspark.sql.types import StructType

    out = None
    for r in spark.read.schema("table string, rows long, digest string, schema string").json(f"{folder}/manifest").collect():
        import json

        expected = F.lit(r["digest"])
        try:
            found = digest(spark.read.schema(StructType.fromJson(json.loads(r["schema"]))).json(f"{folder}/{r['table']}"))
            row = found.select(F.lit(r["table"]).alias("table"), F.when((F.col("digest") == expected) & (F.col("rows") == r["rows"]), "ok").otherwise("checksum_mismatch").alias("status"))
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            row = spark.createDataFrame([(r["table"], "missing")], "table string, status string")
        out = row if out is None else out.unionByName(row)
    return out


def read_table(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(f"{folder}/{name}")
