"""Fill-in-middle transformation by overlapping chunks, with DataFrame functions only.

A text is cut into chunks of CHUNK code points that overlap the next by one, so that every chunk counts its token ends by
looking at adjacent characters alone: a token ends where a character that is no space stands before a space, and at the
text's end. Prefix sums over the chunks of a text give its number of tokens and send each of the two cut ranks to the one
chunk that holds it; only these chunks are taken apart again, for the cut's position.

A text of one chunk is its own prefix sum and stays where it was read. The chunks of longer texts are dealt over the
cluster by size, so that a text of any length is counted in parallel; their counts come back keyed by doc_id and a digest
of the text, and only longer texts move for that.

Edge cases: a null or empty text has no tokens and is plain; a null doc_id hashes as the empty string; rows that repeat a
doc_id and a text get the same result, once for each row; a text that holds a sentinel is plain. Other columns are not
read, so they may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import table

#: Code points of a chunk, and chunks of a block; blocks keep the cutting of very long texts from starting at their first character each time.
CHUNK, BLOCK = 16384, 256
#: Fixed values of the contract.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED, FIM_RATE, SPM_RATE = 42, 50, 80
SPACE = r"[\x20\x09-\x0D]"
END = rf"[^\x20\x09-\x0D](?={SPACE})"
BETWEEN = rf"(?<=[^\x20\x09-\x0D])(?={SPACE})"


def _overlapping(text: Column, own: Column, size: int) -> Column:
    """Pieces of ``size`` code points and the next one, of the first ``own`` code points of a text that is not empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((own - 1) / size).cast("int")), lambda i: text.substr(i * size + 1, F.lit(size + 1)))


def ends(piece: Column, chunk: int) -> Column:
    """Token ends among a chunk's own code points. A chunk without the next one's first code point is the last, where the text ends."""
    return F.regexp_count(piece, F.lit(END)).cast("long") + F.when(F.length(piece) <= chunk, 1).otherwise(0)


def offset(piece: Column, rank: Column) -> Column:
    """Code points of a chunk up to its ``rank``-th token end."""
    return F.length(F.array_join(F.slice(F.split(piece, BETWEEN), F.lit(1), rank.cast("int")), ""))


def draws(doc_id: Column, seed: int) -> list[Column]:
    """The first four 32-bit groups of the sha256 of ``seed:doc_id``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    return [F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def _ranks(n: Column, doc_id: Column, seed: int) -> tuple[Column, Column]:
    a, b = (h % (n + 1) for h in draws(doc_id, seed)[:2])
    return F.least(a, b), F.greatest(a, b)


def counted(long: DataFrame, chunk: int, seed: int) -> DataFrame:
    """same, n, route1, route2 of each text with more than one chunk; a route is a chunk and a rank in it, null for rank 0."""
    size = chunk * BLOCK
    blocks = long.select("doc_id", "same", F.posexplode(_overlapping(F.col("text"), F.length("text"), size)).alias("block", "part"))
    chunks = blocks.select("doc_id", "same", "block", F.posexplode(_overlapping(F.col("part"), F.least(F.length("part"), F.lit(size)), chunk)).alias("i", "piece"))
    dealt = chunks.select("doc_id", "same", (F.col("block") * BLOCK + F.col("i")).alias("chunk"), "piece").hint("rebalance")
    # rows that repeat a text under one doc_id say the same of each chunk
    each = dealt.select("doc_id", "same", "chunk", ends(F.col("piece"), chunk).alias("held")).groupBy("doc_id", "same", "chunk").agg(F.max("held").alias("held"))
    own = Window.partitionBy("doc_id", "same")
    sums = each.withColumn("upto", F.sum("held").over(own.orderBy("chunk"))).withColumn("n", F.sum("held").over(own))
    routes = []
    for j, rank in enumerate(_ranks(F.col("n"), F.col("doc_id"), seed), 1):
        before = F.col("upto") - F.col("held")
        held = (before < rank) & (rank <= F.col("upto"))
        routes.append(F.max(F.when(held, F.struct("chunk", (rank - before).alias("rank")))).alias(f"route{j}"))
    return sums.groupBy("doc_id", "same").agg(F.max("n").alias("n"), *routes).drop("doc_id")


def transform(docs: DataFrame, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """doc_id, n (tokens), form (plain, psm or spm), prefix_chars, middle_chars and output of every row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", text.alias("text"))
    first, second = _ranks(F.col("n"), F.col("doc_id"), seed)
    route = lambda rank: F.when(rank > 0, F.struct(F.lit(0).alias("chunk"), rank.alias("rank")))
    # one chunk: what it counts is the sum, and it holds both cuts
    short = rows.where(F.length("text") <= chunk).withColumn("n", F.when(F.col("text") == "", F.lit(0).cast("long")).otherwise(ends(F.col("text"), chunk)))
    short = short.select("doc_id", "text", "n", route(first).alias("route1"), route(second).alias("route2"))
    same = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.md5("text"))
    long = rows.where(F.length("text") > chunk).withColumn("same", same)
    sent = long.join(counted(long, chunk, seed), "same").select("doc_id", "text", "n", "route1", "route2")
    return _formed(short.unionByName(sent), chunk, seed)


def _formed(routed: DataFrame, chunk: int, seed: int) -> DataFrame:
    text = F.col("text")
    _, _, rate, order = draws(F.col("doc_id"), seed)
    held = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = F.when((text == "") | held | (rate % 100 >= FIM_RATE), "plain").when(order % 100 < SPM_RATE, "spm").otherwise("psm")

    def cut(name: str) -> Column:
        at, rank = F.col(f"{name}.chunk"), F.col(f"{name}.rank")
        return F.when(F.col("form") == "plain", None).when(rank.isNull(), F.lit(0)).otherwise(at * chunk + offset(text.substr(at * chunk + 1, F.lit(chunk + 1)), rank)).cast("long")

    cuts = routed.withColumn("form", form).withColumns({"a": cut("route1"), "b": cut("route2")})
    part = lambda start, length: text.substr((start + 1).cast("int"), length.cast("int"))
    a, b = F.col("a"), F.col("b")
    parts = cuts.withColumns({"prefix": part(F.lit(0), a), "middle": part(a, b - a), "suffix": part(b, F.length("text") - b)})
    psm = F.concat(F.lit(PREFIX), "prefix", F.lit(SUFFIX), "suffix", F.lit(MIDDLE), "middle")
    spm = F.concat(F.lit(SUFFIX), "suffix", F.lit(PREFIX), "prefix", F.lit(MIDDLE), "middle")
    output = F.when(F.col("form") == "plain", text).when(F.col("form") == "psm", psm).otherwise(spm)
    return parts.select("doc_id", "n", "form", a.alias("prefix_chars"), (b - a).alias("middle_chars"), output.alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of. Texts with sentinels are plain, so those of an output are its own."""
    p = F.split(output, "|".join((PREFIX, SUFFIX, MIDDLE)), -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(p[1], p[3], p[2])).otherwise(F.concat(p[2], p[3], p[1]))


def op13_chunked_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = transform(table(spark, sf_dir, "documents"))
    digests = F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)


SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS s FROM documents),
h AS (SELECT doc_id, text, regexp_extract_all(text, '[ \x09-\x0D]*[^ \x09-\x0D]+|[ \x09-\x0D]+') AS tokens,
        ('0x' || s[1:8])::BIGINT AS h1, ('0x' || s[9:16])::BIGINT AS h2, ('0x' || s[17:24])::BIGINT AS h3, ('0x' || s[25:32])::BIGINT AS h4 FROM d),
k AS (SELECT *, len(tokens)::BIGINT AS n, least(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS a, greatest(h1 % (len(tokens) + 1), h2 % (len(tokens) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT doc_id, text, n, form, coalesce(array_to_string(tokens[1:a], ''), '') AS p, coalesce(array_to_string(tokens[a + 1:b], ''), '') AS m, coalesce(array_to_string(tokens[b + 1:], ''), '') AS s FROM k)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p)::BIGINT END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m)::BIGINT END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM p"""
