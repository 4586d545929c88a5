"""An inverted index in segments: changes are appended, tombstones hide what they replace, and merging folds it all.

A segment is a folder of postings (part, term, key, length, tf), of the documents it brought (key, digest), and of
tombstones (key): a tombstone of segment n hides everything of its key in segments before n. Postings lie in folders by a
hash of their term, so that a search reads the parts of its own terms only. A change costs its own documents and not the
index. The list of live segments is the manifest; it is written last, so a run that is lost leaves the index as it was.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import retrieval

#: Folders of postings by term in a segment, and how many ways each is dealt so that a common term is no single task.
PARTS, WAYS = 64, 8


def part_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


class SegmentedIndex:
    """The index in a folder that all machines share. One writer at a time; readers see the last manifest.

    Documents have a unique, not null ``key`` and a text; a text without words (or a null one) is a document without
    postings. ``deleted`` in changes removes a document; deleting what is not there does nothing.
    """

    def __init__(self, spark: SparkSession, folder: str, key: str) -> None:
        self.spark, self.folder, self.key = spark, folder.rstrip("/"), key

    def segments(self) -> list[int]:
        """Numbers of the live segments, from the last manifest."""
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/manifest-*/_SUCCESS")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        if not found:
            return []
        last = max(int(f.getPath().getParent().getName().rpartition("-")[2]) for f in found)
        return sorted(r.segment for r in self.spark.read.parquet(f"{self.folder}/manifest-{last:06d}").collect())

    def _next(self) -> int:
        jvm = self.spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/*-*")
        found = at.getFileSystem(self.spark._jsc.hadoopConfiguration()).globStatus(at)
        return 1 + max((int(f.getPath().getName().rpartition("-")[2]) for f in found or ()), default=0)

    def _publish(self, number: int, live: list[int]) -> None:
        self.spark.createDataFrame([(n,) for n in live], "segment int").coalesce(1).write.parquet(f"{self.folder}/manifest-{number:06d}")

    def _write(self, number: int, postings: DataFrame, documents: DataFrame, tombstones: DataFrame) -> None:
        at = f"{self.folder}/segment-{number:06d}"
        dealt = postings.withColumn("part", part_of(F.col("term"))).repartition("part", F.pmod(F.xxhash64(self.key), F.lit(WAYS)))
        dealt.sortWithinPartitions("part", "term").write.option("compression", "zstd").partitionBy("part").parquet(f"{at}/postings")
        documents.write.parquet(f"{at}/documents")
        tombstones.write.parquet(f"{at}/tombstones")

    def append(self, changes: DataFrame) -> int:
        """Adds a segment of changes (key, text, deleted; each key once): new documents, new texts and deletions."""
        number = self._next()
        kept = changes.where(~F.coalesce("deleted", F.lit(False)))
        documents = kept.select(self.key, F.sha2("text", 256).alias("digest"))
        self._write(number, retrieval.postings(kept, self.key, "text"), documents, changes.select(self.key))
        self._publish(number, [*self.segments(), number])
        return number

    def rebuild(self, docs: DataFrame) -> int:
        """One segment of all documents instead of what there was."""
        number = self._next()
        documents = docs.select(self.key, F.sha2("text", 256).alias("digest"))
        self._write(number, retrieval.postings(docs, self.key, "text"), documents, docs.select(self.key).limit(0))
        self._publish(number, [number])
        return number

    def merge(self, least: int = 2) -> int | None:
        """Folds all live segments into one if there are as many as ``least``; what tombstones hide is gone from it."""
        live = self.segments()
        if len(live) < least:
            return None
        number = self._next()
        documents = self.documents()
        self._write(number, self.postings(), documents, documents.select(self.key).limit(0))
        self._publish(number, [number])
        return number

    def _read(self, what: str) -> DataFrame:
        live = self.segments()
        if not live:
            raise ValueError("the index has no segment yet")
        at = f"{self.folder}/segment-"
        shape = self.spark.read.parquet(f"{at}{live[0]:06d}/documents").schema if what == "documents" else self.spark.read.parquet(f"{at}{live[0]:06d}/tombstones").schema
        if what == "postings":  # a segment of deletions has no folder of a part that would tell
            shape = T.StructType([T.StructField("term", T.StringType()), *shape.fields, T.StructField("length", T.IntegerType()), T.StructField("tf", T.LongType()), T.StructField("part", T.IntegerType())])
        one = lambda n: self.spark.read.schema(shape).parquet(f"{at}{n:06d}/{what}").withColumn("segment", F.lit(n))
        return reduce(DataFrame.unionByName, map(one, live))

    def _live(self, rows: DataFrame) -> DataFrame:
        """Rows that no later segment's tombstone hides."""
        buried = self._read("tombstones").groupBy(self.key).agg(F.max("segment").alias("buried"))
        return rows.join(buried, self.key, "left").where("buried is null or segment >= buried").drop("segment", "buried")

    def documents(self) -> DataFrame:
        """key, digest of the indexed documents."""
        return self._live(self._read("documents"))

    def postings(self, terms: DataFrame | None = None) -> DataFrame:
        """term, key, length, tf. terms: the terms (column term) that are asked for; only their parts are read."""
        rows = self._read("postings")
        if terms is not None:
            asked = terms.select("term").distinct().withColumn("part", part_of(F.col("term")))
            rows = rows.join(asked, ["part", "term"], "left_semi")
        return self._live(rows).select("term", self.key, "length", "tf")

    def consistency(self, docs: DataFrame) -> DataFrame:
        """One row: authoritative and indexed documents, missing, stale and surplus ones, and whether all agree."""
        own = docs.select(self.key, F.sha2("text", 256).alias("digest"), F.lit(True).alias("in_docs"))
        mine = self.documents().select(self.key, F.col("digest").alias("indexed_digest"), F.lit(True).alias("in_index"))
        both = own.join(mine, self.key, "full")
        sums = both.agg(
            F.count_if(F.col("in_docs")).alias("authoritative"),
            F.count_if(F.col("in_index")).alias("indexed"),
            F.count_if(F.col("in_index").isNull()).alias("missing"),
            F.count_if(F.col("in_docs").isNull()).alias("surplus"),
            F.count_if(F.col("in_docs") & F.col("in_index") & ~F.col("digest").eqNullSafe(F.col("indexed_digest"))).alias("stale"),
        )
        return sums.withColumn("consistent", F.expr("missing + surplus + stale = 0"))
