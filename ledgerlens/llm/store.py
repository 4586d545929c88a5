"""Where jobs keep intermediate tables, so that a lost executor costs a re-read and not a re-run."""

from __future__ import annotations

import gc
import tempfile
import time
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder. Only a local master may fall back to a temporary folder."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.ledgerlens.shared.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    made = "file://" + tempfile.mkdtemp(prefix="ledgerlens-")
    spark.conf.set("spark.ledgerlens.shared.dir", made)
    return made


def saved(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: cuts its lineage and fixes its rows."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_path = path
    return out


def bucketed(df: DataFrame, label: str, key: str) -> DataFrame:
    """saved(), dealt by ``key`` into as many buckets as a shuffle has partitions: later joins on it don't move df's rows."""
    spark = df.sparkSession
    name = f"ledgerlens_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{label}-{name}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.repartition(n, key).write.option("compression", "zstd").option("path", path).bucketBy(n, key).saveAsTable(name, format="parquet")
    out = spark.table(name)
    out._saved_path = path
    return out


def dropped(*frames: DataFrame) -> None:
    """Deletes tables made by saved() that nothing will read again."""
    for df in frames:
        if path := getattr(df, "_saved_path", None):
            jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def released(spark: SparkSession) -> None:
    """Has the driver collect its garbage: the shuffle files of jobs that are over go from the executors' disks.

    What one collection frees may be what holds others, and the files are removed in the background, so it takes two.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(1)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
