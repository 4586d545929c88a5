"""Verification of portable packages from their files: checksums in parallel, missing payloads by anti joins, JSON by line.

Files are rows (package, path, content) as the binaryFile source reads a folder, or as ``members`` takes them out of ZIP
archives. No file is compared with another on one machine, and a package may have any number of files.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ijson

#: Names within a package, and what a line of the checksums is: a digest, two blanks and a path.
MANIFEST, CHECKSUMS, LINES = "manifest.ijson", "checksums.sha256", ".ijsonl"
ENTRY = r"^([0-9a-f]{64})  (.+)$"
UNSAFE = r"^([A-Za-z]:|/|\\)|(^|[/\\])\.\.([/\\]|$)"


def read_folders(spark: SparkSession, path: str) -> DataFrame:
    """Files of the packages in a folder, one folder for each. The binary source lists no empty files, so an empty payload counts as missing; archives have them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    below = F.substring_index("path", path.rstrip("/").rpartition(":")[2].lstrip("/") + "/", -1)
    return files.select(F.substring_index(below, "/", 1).alias("package"), F.regexp_replace(below, "^[^/]*/", "").alias("path"), "content")


def members(archives: DataFrame) -> DataFrame:
    """Files of packages as ZIP archives (package, content); the folder that holds all of an archive is left away."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for package, content in zip(b.column(0), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    names = [i for i in z.infolist() if not i.is_dir()]
                    tops = {i.filename.split("/", 1)[0] for i in names if "/" in i.filename}
                    top = f"{tops.pop()}/" if len(tops) == 1 and all("/" in i.filename for i in names) else ""
                    for i in names:
                        yield pa.RecordBatch.from_arrays([pa.array([package.as_py()], pa.string()), pa.array([i.filename.removeprefix(top)], pa.string()), pa.array([z.read(i)], pa.binary())], names=["package", "path", "content"])

    return archives.select(F.col("package").cast("string"), "content").mapInArrow(run, "package string, path string, content binary")


def issues(files: DataFrame, format_name: str) -> DataFrame:
    """package, issue_code, path, line, detail: all that is wrong with the packages.

    A package without a manifest has that issue alone. A file that the checksums do not name is no issue; a name twice
    counts for each of its lines.
    """
    own = files.select("package", "path", "content").withColumn("is_manifest", F.col("path") == MANIFEST)
    packages = own.groupBy("package").agg(F.bool_or("is_manifest").alias("manifest"), F.bool_or(F.col("path") == CHECKSUMS).alias("sums"))
    none, nil = F.lit(None).cast("string"), F.lit(None).cast("long")
    row = lambda df, code, path=none, line=nil, detail=none: df.select("package", F.lit(code).alias("issue_code"), path.alias("path"), line.alias("line"), detail.alias("detail"))
    text = F.decode("content", "UTF-8")

    bare = row(packages.where("not manifest"), "missing_manifest", F.lit(MANIFEST))
    whole = own.join(packages.where("manifest").select("package"), "package", "left_semi")
    manifest = whole.where("is_manifest").select("package", ijson.fault_udf(text).alias("fault"), F.get_json_object(text, "$.format").alias("format"))
    found = [
        bare,
        row(manifest.where("fault is not null"), "invalid_manifest", F.lit(MANIFEST), detail=F.col("fault")),
        row(manifest.where(F.col("fault").isNull() & ~F.col("format").eqNullSafe(F.lit(format_name))), "unsupported_format", F.lit(MANIFEST), detail=F.col("format")),
        row(packages.where("manifest and not sums"), "missing_checksums", F.lit(CHECKSUMS)),
        row(whole.where(F.col("path").rlike(UNSAFE)), "unsafe_path", F.col("path")),
    ]
    lines = whole.where(F.col("path") == CHECKSUMS).select("package", F.posexplode(F.split(text, "\r?\n")).alias("line", "entry")).where(F.trim("entry") != "").withColumn("line", (F.col("line") + 1).cast("long"))
    found.append(row(lines.where(~F.col("entry").rlike(ENTRY)), "malformed_checksum", F.lit(CHECKSUMS), F.col("line")))
    expected = lines.where(F.col("entry").rlike(ENTRY)).select("package", F.regexp_extract("entry", ENTRY, 2).alias("path"), F.regexp_extract("entry", ENTRY, 1).alias("wanted"))
    # digests are made where the files are read; contents do not travel
    actual = whole.select("package", "path", F.sha2("content", 256).alias("digest"))
    compared = expected.join(actual, ["package", "path"], "left")
    found.append(row(compared.where("digest is null"), "missing_payload", F.col("path")))
    found.append(row(compared.where("digest <> wanted"), "checksum_mismatch", F.col("path")))
    json_lines = whole.where(F.col("path").endswith(LINES)).select("package", "path", F.posexplode(F.split(text, "\r?\n")).alias("line", "value")).where(F.trim("value") != "")
    judged = json_lines.select("package", "path", (F.col("line") + 1).cast("long").alias("line"), ijson.fault_udf("value").alias("fault")).where("fault is not null")
    found.append(row(judged, "invalid_ijson", F.col("path"), F.col("line"), F.col("fault")))
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out


def verify(files: DataFrame, format_name: str) -> DataFrame:
    """package, valid, issues (their number) of every package."""
    counted = issues(files, format_name).groupBy("package").agg(F.count("*").alias("issues"))
    rows = files.select("package").distinct().join(counted, "package", "left").withColumn("issues", F.coalesce("issues", F.lit(0)).cast("long"))
    return rows.select("package", (F.col("issues") == 0).alias("valid"), "issues")
