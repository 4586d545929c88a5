"""Conversation exports as DataFrames: format probe, tree, linear, history and activity adapters, generator, archives.

Adapters give one row for each message: conv, title, node, parent, role, text, created, active.
"""

from __future__ import annotations

import hashlib
import io
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import role_of

TREE = "array<struct<id:string,title:string,current_node:string,mapping:map<string,struct<id:string,parent:string,message:struct<author:struct<role:string>,content:struct<content_type:string,parts:array<string>>,create_time:double>>>>>"
LINEAR = "array<struct<uuid:string,name:string,chat_messages:array<struct<uuid:string,sender:string,text:string,created_at:string>>>>"
HISTORY = "array<struct<id:string,title:string,chat:struct<history:struct<currentId:string,messages:map<string,struct<id:string,role:string,content:string,parentId:string,timestamp:double>>>>>>"
ACTIVITY = "array<struct<time:string,title:string>>"
GENERIC = "struct<format:string,conversations:array<struct<id:string,title:string,messages:array<struct<id:string,parent:string,role:string,text:string>>>>>"
#: How sure a format is once its shape is found.
CONFIDENCE = {"tree": 0.98, "history": 0.95, "generic": 0.99, "linear": 0.82, "activity": 0.7, "manual": 0.3}
#: Limits of an archive.
MAX_COMPRESSED, MAX_EXPANDED, MAX_RATIO, MAX_FILES = 50 << 20, 250 << 20, 100, 10_000


def probe(payloads: DataFrame) -> DataFrame:
    """path, format, confidence: the surest format whose shape the JSON text (value) has."""
    v = F.col("value")
    shapes = {
        "tree": F.from_json(v, TREE)[0]["mapping"].isNotNull(),
        "history": F.from_json(v, HISTORY)[0]["chat"]["history"]["messages"].isNotNull(),
        "linear": F.from_json(v, LINEAR)[0]["chat_messages"].isNotNull(),
        "activity": F.from_json(v, ACTIVITY)[0]["time"].isNotNull(),
        "generic": F.from_json(v, GENERIC)["format"] == "conversation-import",
    }
    found = F.array_compact(F.array(*(F.when(F.coalesce(ok, F.lit(False)), F.struct(F.lit(CONFIDENCE[k]).alias("confidence"), F.lit(k).alias("format"))) for k, ok in shapes.items()), F.struct(F.lit(CONFIDENCE["manual"]).alias("confidence"), F.lit("manual").alias("format"))))
    best = F.array_max(found)
    return payloads.select("path", best["format"].alias("format"), best["confidence"].alias("confidence"))


def read_tree(payloads: DataFrame) -> DataFrame:
    c = payloads.select(F.explode(F.from_json("value", TREE)).alias("c")).select("c.*")
    m = c.select(F.col("id").alias("conv"), "title", "current_node", F.explode("mapping").alias("node", "n"))
    text = F.array_join(F.col("n.message.content.parts"), "\n")
    return m.select("conv", "title", "node", F.col("n.parent").alias("parent"), role_of(F.col("n.message.author.role")).alias("role"), text.alias("text"), F.timestamp_seconds(F.floor("n.message.create_time")).alias("created"), (F.col("node") == F.col("current_node")).alias("active"))


def read_history(payloads: DataFrame) -> DataFrame:
    c = payloads.select(F.explode(F.from_json("value", HISTORY)).alias("c")).select("c.*")
    m = c.select(F.col("id").alias("conv"), "title", F.col("chat.history.currentId").alias("leaf"), F.explode("chat.history.messages").alias("node", "n"))
    return m.select("conv", "title", "node", F.col("n.parentId").alias("parent"), role_of(F.col("n.role")).alias("role"), F.col("n.content").alias("text"), F.timestamp_seconds(F.floor("n.timestamp")).alias("created"), (F.col("node") == F.col("leaf")).alias("active"))


def read_linear(payloads: DataFrame) -> DataFrame:
    c = payloads.select(F.explode(F.from_json("value", LINEAR)).alias("c")).select("c.*")
    m = c.select(F.col("uuid").alias("conv"), F.col("name").alias("title"), F.posexplode("chat_messages").alias("i", "n"))
    w = Window.partitionBy("conv").orderBy("i")
    return m.select("conv", "title", F.col("n.uuid").alias("node"), F.lag("n.uuid").over(w).alias("parent"), role_of(F.col("n.sender")).alias("role"), F.col("n.text").alias("text"), F.try_to_timestamp("n.created_at").alias("created"), F.lead("i").over(w).isNull().alias("active"))


def read_generic(payloads: DataFrame) -> DataFrame:
    """Files of the own format; without its marker there is nothing to read."""
    g = payloads.select(F.from_json("value", GENERIC).alias("g")).where("g.format = 'conversation-import'").select(F.explode("g.conversations").alias("c"))
    m = g.select(F.col("c.id").alias("conv"), F.col("c.title").alias("title"), F.explode("c.messages").alias("n"))
    return m.select("conv", "title", F.col("n.id").alias("node"), F.col("n.parent").alias("parent"), role_of(F.col("n.role")).alias("role"), F.col("n.text").alias("text"), F.lit(None).cast("timestamp").alias("created"), F.lit(False).alias("active"))


def read_activity(payloads: DataFrame) -> DataFrame:
    a = payloads.select("path", F.posexplode(F.from_json("value", ACTIVITY)).alias("i", "a"))
    return a.select(F.col("path").alias("conv"), F.lit(None).cast("string").alias("title"), F.col("i").cast("string").alias("node"), F.lit(None).cast("string").alias("parent"), F.lit("user").alias("role"), F.col("a.title").alias("text"), F.try_to_timestamp("a.time").alias("created"), F.lit(False).alias("active"))


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []

    def handle_data(self, data: str) -> None:
        if data.strip():
            self.parts.append(data.strip())


@F.pandas_udf(T.StringType())
def html_text(html: pd.Series) -> pd.Series:
    """Text nodes of HTML, stripped and joined by line breaks."""

    def one(h: str | None) -> str | None:
        if h is None:
            return None
        p = _Text()
        p.feed(h)
        p.close()
        return "\n".join(p.parts)

    return html.map(one)


def archive_verdict(members: DataFrame) -> DataFrame:
    """archive, ok, reason from member metadata (archive, name, packed, size, mode): any doubt refuses the archive."""
    bad_name = F.col("name").rlike(r"^([A-Za-z]:|/|\\)|(^|[/\\])\.\.([/\\]|$)")
    kind = F.shiftright(F.col("mode"), 12)
    g = members.groupBy("archive").agg(F.sum("packed").alias("packed"), F.sum("size").alias("size"), F.count("*").alias("files"), F.bool_or(bad_name).alias("bad_name"), F.bool_or(~kind.isin(0, 4, 8)).alias("special"), F.count_if(F.lower("name").rlike(r"\.(zip|tar|gz|rar|7z)$")).alias("nested"))
    reason = F.when(F.col("packed") > MAX_COMPRESSED, "too_large").when(F.col("size") > MAX_EXPANDED, "expands_too_far").when(F.col("size") > MAX_RATIO * F.greatest(F.col("packed"), F.lit(1)), "ratio").when(F.col("files") > MAX_FILES, "too_many_files").when(F.col("bad_name"), "unsafe_path").when(F.col("special"), "special_file").when(F.col("nested") > 1, "nested")
    return g.select("archive", reason.isNull().alias("ok"), reason.alias("reason"))


def generated(seeds: DataFrame, messages: int, branches: int = 1, duplicate_every: int = 0, malformed_every: int = 0) -> DataFrame:
    """Synthetic conversations, one for each id of seeds: conv, copy, node, parent, role, text.

    Messages are a chain; branches beyond the first hang on its second message. Ids that duplicate_every divides come
    twice (copy 1), those that malformed_every divides have no messages: one row whose node is null.
    """
    every = lambda n: (F.col("id") % n == 0) if n > 0 else F.lit(False)
    c = seeds.select("id", F.explode(F.when(every(duplicate_every), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"), every(malformed_every).alias("malformed"))
    chain = [(f"message-{i}", f"message-{i - 1}" if i else None, "user" if i % 2 == 0 else "assistant") for i in range(max(2, messages))]
    hung = [(f"branch-{i}", "message-1", "assistant") for i in range(1, branches)]
    nodes = F.array(*(F.struct(*(F.lit(x).cast("string").alias(n) for n, x in zip(("node", "parent", "role"), row, strict=True))) for row in [*chain, *hung]))
    none = F.array(F.struct(*(F.lit(None).cast("string").alias(n) for n in ("node", "parent", "role"))))
    m = c.select(F.concat(F.lit("conv-"), F.lpad(F.col("id").cast("string"), 8, "0")).alias("conv"), "copy", F.explode(F.when(F.col("malformed"), none).otherwise(nodes)).alias("m"))
    return m.select("conv", "copy", "m.*", F.concat_ws(" ", F.lit("synthetic"), "conv", "m.node").alias("text"))


def json_records(lines: DataFrame, schema: str) -> DataFrame:
    """The records of JSON text (column value) with the given DDL schema; what does not parse is left out, and so are blank lines."""
    own = F.from_json("value", f"{schema}, _corrupt string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    rest = [c for c in lines.columns if c != "value"]
    return lines.where(F.trim("value") != "").select(*rest, own.alias("r")).where("r is not null and r._corrupt is null").select(*rest, "r.*").drop("_corrupt")


def read_json_files(spark: SparkSession, path: str, schema: str, whole: bool = False) -> DataFrame:
    """JSON lines, or with ``whole`` one JSON value in each file; malformed records or files are skipped."""
    text = spark.read.text(path, wholetext=whole)
    return json_records(text, schema)


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """Manual transcripts (.md, .txt): one row a file, with little confidence and no messages until someone reconstructs them."""
    return transcripts(spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text")))


def transcripts(files: DataFrame) -> DataFrame:
    title = F.trim(F.regexp_replace(F.substring_index("text", "\n", 1), r"^#+\s*", ""))
    return files.select("path", title.alias("title"), F.lit(0.2).alias("confidence"), F.lit(0).alias("messages"), "text")


MEMBER = T.StructType([T.StructField("archive", T.StringType()), T.StructField("place", T.IntegerType()), T.StructField("name", T.StringType()), T.StructField("staged", T.StringType()), T.StructField("size", T.LongType()), T.StructField("sha256", T.StringType()), T.StructField("role", T.StringType())])
#: What a member is by the ending of its name.
MEMBER_ROLES = {".json": "conversations", ".jsonl": "conversations", ".html": "activity", ".htm": "activity", ".md": "transcript", ".txt": "transcript"}


def staged(archives: DataFrame) -> DataFrame:
    """The members of ZIP archives (path, content, as the binaryFile source reads them) under neutral names, with size, digest and role.

    A member is read in pieces, so its size does not matter; run ``archive_verdict`` on the metadata first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                with zipfile.ZipFile(io.BytesIO(content.as_py())) as z:
                    for i, m in enumerate(x for x in z.infolist() if not x.is_dir()):
                        digest, size = hashlib.sha256(), 0
                        with z.open(m) as f:
                            while piece := f.read(1 << 20):
                                digest.update(piece)
                                size += len(piece)
                        role = next((r for end, r in MEMBER_ROLES.items() if m.filename.lower().endswith(end)), "attachment")
                        rows.append((path, i, m.filename, f"artifact-{i:06d}", size, digest.hexdigest(), role))
            columns = list(zip(*rows, strict=True)) or [[]] * len(MEMBER)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int32() if f.name == "place" else pa.int64() if f.name == "size" else pa.string()) for c, f in zip(columns, MEMBER, strict=True)], names=MEMBER.names)

    return archives.select("path", "content").mapInArrow(run, MEMBER)
