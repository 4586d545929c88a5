r"""Chat formatting from event logs, with DataFrame functions only.

``reconstruct`` folds a log of events (conv_id, seq, turn, kind, role, text) into final messages. In the order of seq:
``message`` sets role and text of a turn; ``delta`` appends text to it; ``edit`` replaces its text and discards the later
turns that were written before the edit; ``regenerate`` empties it for new deltas; ``delete`` removes it.
``render`` writes the turns as ``<|turn|>role\ntext<|end|>\n`` and gives the spans under the loss mask (assistant texts).
Control strings inside roles and texts get a backslash after their first character and backslashes are doubled, which
``unescape`` undoes exactly. ``read_back`` parses the formatted string and the spans alone.

A conversation becomes one string, so it must fit in a row; everything before that is per event.

Edge cases: null text is empty, null role is the empty role; events of equal (conv_id, turn, seq) are folded in the
order of role and text; repeated plain messages are messages of their own; events without conv_id form one
conversation under null; deltas without a message start one with their own role; an empty log gives no rows. Other
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import table

TURN, END = "<|turn|>", "<|end|>\n"
#: A line break inside a role; escaped text has no single backslash there.
BREAK = "[\\n]"
#: Control strings of chat templates. Each is escaped where its first character is followed by the rest.
CONTROLS = ["<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]


def escape(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for c in CONTROLS:
        out = F.replace(out, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}"))
    return out


def unescape(text: Column) -> Column:
    out = text
    for c in reversed(CONTROLS):
        out = F.replace(out, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c))
    return F.replace(out, F.lit("\\\\"), F.lit("\\"))


def reconstruct(events: DataFrame) -> DataFrame:
    """conv_id, turn, place, role, text of the final messages; place separates plain messages of one turn."""
    kind = F.col("kind")
    e = events.select("conv_id", "turn", "seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), "place")
    message = Window.partitionBy("conv_id", "turn", "place")
    e = e.withColumn("reset", F.max(F.when(kind != "delta", F.col("seq"))).over(message)).where(F.col("reset").isNull() | (F.col("seq") >= F.col("reset")))
    folded = e.groupBy("conv_id", "turn", "place").agg(
        F.array_sort(F.collect_list(F.struct("seq", F.when(kind == "delta", 1).otherwise(0).alias("late"), "role", "text"))).alias("parts"),
        F.min_by("kind", F.struct("seq", F.when(kind == "delta", 1).otherwise(0))).alias("first_kind"),
        F.max("seq").alias("written"),
        F.max(F.when(kind == "edit", F.col("seq"))).alias("edited"),
    )
    earlier = Window.partitionBy("conv_id").orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    roles = events.where("role is not null and role <> ''").groupBy("conv_id", "turn", "place").agg(F.max_by("role", "seq").alias("named"))
    text = F.array_join(F.transform("parts", lambda p: p["text"]), "")
    out = folded.withColumn("cut", F.max("edited").over(earlier)).where("first_kind <> 'delete' and (cut is null or written > cut)")
    keys = [F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")) for c in ("conv_id", "turn", "place")]
    return out.alias("l").join(roles.alias("r"), keys[0] & keys[1] & keys[2], "left").select("l.conv_id", "l.turn", "l.place", F.coalesce("r.named", F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """conv_id, formatted, and loss: the (start, length) spans of assistant texts in the formatted string, by code points."""
    body = escape(F.col("text"))
    head = F.concat(F.lit(TURN), F.replace(escape(F.col("role")), F.lit("\n"), F.lit(BREAK)), F.lit("\n"))
    parts = messages.select("conv_id", "turn", "place", "role", head.alias("head"), body.alias("body")).withColumn("piece", F.concat("head", "body", F.lit(END)))
    before = Window.partitionBy("conv_id").orderBy("turn", "place").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("int").alias("start"), F.length("body").alias("length")))
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "place", "piece", span.alias("span")))).alias("turns"))
    return whole.select("conv_id", F.array_join(F.transform("turns", lambda t: t["piece"]), "").alias("formatted"), F.filter(F.transform("turns", lambda t: t["span"]), lambda s: s.isNotNull()).alias("loss"))


def read_back(rendered: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text: parsed from formatted and loss."""
    segments = F.slice(F.split("formatted", r"<\|turn\|>"), 2, F.length("formatted") + 1)
    line = lambda s: F.instr(s, "\n")
    one = lambda s: F.struct(unescape(F.replace(F.substring(s, F.lit(1), line(s) - 1), F.lit(BREAK), F.lit("\n"))).alias("role"), unescape(F.substring(s, line(s) + 1, F.length(s) - line(s) - len(END))).alias("text"))
    loss = F.array_join(F.transform("loss", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["length"]))), "")
    return rendered.select("conv_id", "formatted", F.transform(segments, one).alias("turns"), loss.alias("loss_text"))


def as_events(conversations: DataFrame) -> DataFrame:
    """A table of turns as a log of plain messages."""
    order = Window.partitionBy("conv_id", "turn").orderBy(F.coalesce("role", F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit("")))
    return conversations.select("conv_id", "turn", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text", F.row_number().over(order).alias("place"))


def as_stream(conversations: DataFrame, chunk: int = 2048) -> DataFrame:
    """A table of turns as the log that a chat leaves: an assistant turn is opened empty, streams a first piece of its text,
    is regenerated, and streams all of it in pieces of ``chunk`` characters; other turns are plain messages."""
    e = as_events(conversations)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    event = lambda k, kind, said: F.struct(F.lit(k).cast("long").alias("k"), F.lit(kind).alias("kind"), said.alias("text"))
    pieces = F.transform(F.sequence(F.lit(0), F.floor(F.length(text) / chunk).cast("int")), lambda i: F.struct((i + 3).cast("long").alias("k"), F.lit("delta").alias("kind"), F.substring(text, i * chunk + 1, F.lit(chunk)).alias("text")))
    streamed = F.concat(F.array(event(0, "message", F.lit("")), event(1, "delta", F.substring(text, 1, chunk)), event(2, "regenerate", F.lit(""))), pieces)
    log = F.when(F.col("role") == "assistant", streamed).otherwise(F.array(event(0, "message", text)))
    return e.select("conv_id", "turn", "role", "place", F.explode(log).alias("e")).select("conv_id", "turn", (F.coalesce("turn", F.lit(0)) * 2**24 + F.col("e.k")).alias("seq"), "e.kind", F.when(F.col("e.kind") == "message", F.col("role")).alias("role"), "e.text", "place")


def digests(back: DataFrame) -> DataFrame:
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(text, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2(F.col("loss_text"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op9_event_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], "conv_id long, turn long, role string, text string")
    return digests(read_back(render(reconstruct(as_stream(rows.unionByName(extra))))))


def _sql() -> str:
    escaped = "replace({0}, '\\', '\\\\')"
    for c in CONTROLS:
        escaped = f"replace({escaped}, '{c}', '{c[0]}\\{c[1:]}')"
    body, role = escaped.format("text"), "replace(" + escaped.format("role") + ", chr(10), '[\\n]')"
    return f"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN) + 1 + len(END)} + length({role}) + length({body})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id"""


SQL = _sql()
