"""Line dedup by content-defined chunks of lines.

Boundaries: a rolling hash over the last ``window`` line hashes gives every line a value, and a line is a cut line where
its value is the least of some stretch of ``span`` words; a text's ends, its first and last line with words, are cut
lines as well. So every stretch of ``span`` words has a cut line in it, cut
lines depend on nothing but the lines near them, and a passage that moves to another place keeps its inner cuts. A chunk
is a shortest run of whole lines that starts at a cut line, or ends with one, and holds ``min_words`` words. Rolling
hashes (differences of prefix sums of hashed lines) name the chunks; the first occurrence by (doc_id, row, line) stays,
and later ones go once their bytes equal the first one's. A passage of min_words + span words (50 by default) and a
line more is found wherever it is; of shorter ones, those are lost whose only cut lines lie inside (see the README for
measured shares by length).
A line that holds min_words words by itself is a chunk too, as a passage may stand in one line.

A removed line always has an equal line at an earlier place, so one copy of every line text stays.

Edge cases: null texts stay null; texts without a long enough run are untouched; rows without doc_id take part as
themselves but are never a first occurrence; rows that repeat a doc_id are documents of their own (the first row stays);
documents that lose all their lines keep an empty text; an empty table gives an empty table. Extra columns are carried
unchanged whatever they are called; the result column is ``line_dedup``, or that with as many ``_`` as make it new.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .hashing import U, mix, salt
from .store import bucketed, dropped, saved, table

MIN_WORDS, WINDOW, SPAN = 40, 2, 10
#: Odd base of the rolling hash and its inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 2**64)


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & 0xFFFFFFFFFFFFFFFF, U)
    out[:1] = U(1)
    return np.multiply.accumulate(out)


def cut_lines(values: np.ndarray, words: np.ndarray, span: int) -> np.ndarray:
    """Numbers of the lines with the least value (the first of equal ones) of some shortest stretch of span words, and of both ends.

    Blank lines count for nothing.
    """
    full = np.flatnonzero(words)
    values, ends = values[full], np.concatenate([[0], np.cumsum(words[full])])
    stop = np.searchsorted(ends, ends[:-1] + span)
    start = np.flatnonzero(stop <= len(full))
    best = start.copy()
    for ahead in range(1, int((stop[start] - start).max(initial=1))):
        other = np.minimum(start + ahead, len(full) - 1)
        best = np.where((start + ahead < stop[start]) & (values[other] < values[best]), other, best)
    return full[np.unique(np.concatenate([best, [0, len(full) - 1]]))] if len(full) else full


def chunks(lines: list[bytes], min_words: int = MIN_WORDS, window: int = WINDOW, span: int = SPAN) -> list[tuple[int, int, int]]:
    """(first line, number of lines, hash) of every chunk, each run once."""
    n = len(lines)
    hashes = mix(np.fromiter(map(xxhash.xxh3_64_intdigest, lines), U, n))
    words = np.array([len(x.split()) for x in lines], np.int64)
    ends = np.concatenate([[0], np.cumsum(words)])
    if ends[-1] < min_words:
        return []
    up, down = powers(BASE, n + 1), powers(BASE_INVERSE, n + 1)
    sums = np.concatenate([np.zeros(1, U), np.cumsum(hashes * up[:n], dtype=U)])
    roll = lambda a, b: mix((sums[b] - sums[a]) * down[a] + (b - a).astype(U) * salt(7))  # noqa: E731  of lines a..b-1
    at = np.arange(n)
    head = cut_lines(roll(np.maximum(at - window + 1, 0), at + 1), words, span)
    tail = np.searchsorted(ends, ends[head] + min_words)
    ok = tail <= n
    back = head + 1
    start = np.searchsorted(ends, ends[back] - min_words, side="right") - 1
    fit = ends[back] >= min_words
    runs = np.unique(np.stack([np.concatenate([head[ok], start[fit]]), np.concatenate([tail[ok], back[fit]])], axis=1), axis=0)
    if not len(runs):
        return []
    a, b = runs[:, 0], runs[:, 1]
    return list(zip(a.tolist(), (b - a).tolist(), roll(a, b).view(np.int64).tolist(), strict=True))


def _lines(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n") if text is not None else []


def _spotted(min_words: int, window: int, span: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, docs, starts, sizes, names = [], [], [], [], []
            for i, doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                for start, size, name in chunks(_lines(text.as_py()), min_words, window, span):
                    rows.append(i)
                    docs.append(doc)
                    starts.append(start)
                    sizes.append(size)
                    names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(docs, pa.int64()), pa.array(starts, pa.int32()), pa.array(sizes, pa.int32()), pa.array(names, pa.int64())], names=["row", "doc", "start", "size", "name"])

    return run


def _quoted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the chunks of each text."""
    for b in batches:
        rows, spans, texts = [], [], []
        for i, text, own in zip(b.column(0).to_pylist(), b.column(1), b.column(2).to_pylist(), strict=True):
            lines = _lines(text.as_py())
            for s in own:
                rows.append(i)
                spans.append(s)
                texts.append(b"\n".join(lines[s["start"] : s["start"] + s["size"]]))
        column = lambda c, kind: pa.array([s[c] for s in spans], kind)
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), column("start", pa.int32()), column("size", pa.int32()), column("name", pa.int64()), column("first_doc", pa.int64()), column("is_first", pa.bool_()), pa.array(texts, pa.binary())], names=["row", "start", "size", "name", "first_doc", "is_first", "bytes"])


def dedup_lines(docs: DataFrame, min_words: int = MIN_WORDS, window: int = WINDOW, span: int = SPAN) -> DataFrame:
    """docs with later copies of repeated passages cut from ``text``, and a last struct column ``line_dedup``.

    line_dedup has n_lines, removed_lines and spans: the removed (start, size) runs in lines of the old text, with the
    row's doc_id where the first copy is. Needs columns doc_id and text; other columns pass through.
    """
    result = "line_dedup"
    while result in docs.columns:
        result += "_"
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("whole")
    numbered = bucketed(docs.select(F.monotonically_increasing_id().alias("row"), whole), "numbered", "row")
    text = F.col("whole.text").cast("string").alias("text")
    spotted = saved(numbered.select("row", F.col("whole.doc_id").cast("long").alias("doc"), text).mapInArrow(_spotted(min_words, window, span), "row long, doc long, start int, size int, name long"), "chunks")
    # the first copy: by doc_id, then row (for repeated ids), then line; rows without id come last
    place = F.struct(F.col("doc").isNull().alias("none"), "doc", "row", "start")
    firsts = spotted.groupBy("name").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1").select("name", "first")
    again = spotted.join(firsts, "name").select("row", F.struct("start", "size", "name", F.col("first.doc").alias("first_doc"), ((F.col("row") == F.col("first.row")) & (F.col("start") == F.col("first.start"))).alias("is_first")).alias("span"))
    wanted = again.groupBy("row").agg(F.collect_list("span").alias("spans"))
    quoted = saved(numbered.select("row", text).join(wanted, "row").mapInArrow(_quoted, "row long, start int, size int, name long, first_doc long, is_first boolean, bytes binary"), "quoted")
    originals = quoted.where("is_first").select(F.col("name").alias("of"), F.col("bytes").alias("original"))
    same = quoted.where("not is_first").join(originals, (F.col("name") == F.col("of")) & (F.col("bytes") == F.col("original")))
    cuts = same.groupBy("row").agg(F.array_sort(F.collect_set(F.struct("start", "size", "first_doc"))).alias("cuts"))

    joined = numbered.join(cuts, "row", "left").select("whole", "cuts", F.split(text, "\n", -1).alias("lines"))
    gone = lambda i: F.exists("cuts", lambda s: (i >= s["start"]) & (i < s["start"] + s["size"]))
    out = joined.withColumn("left", F.when(F.col("cuts").isNull(), F.col("lines")).otherwise(F.filter("lines", lambda x, i: ~gone(i))))
    new = F.when(F.col("cuts").isNull(), F.col("whole.text")).otherwise(F.array_join("left", "\n"))
    found = F.struct(F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"), F.coalesce(F.size("lines") - F.size("left"), F.lit(0)).alias("removed_lines"), F.coalesce("cuts", F.array().cast("array<struct<start:int,size:int,first_doc:bigint>>")).alias("spans"))
    dropped(spotted)
    return out.select(*(new.alias(c) if c == "text" else F.col(f"whole.`{c}`") for c in docs.columns), found.alias(result))


def op10_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", F.col("line_dedup.n_lines").cast("long").alias("n_lines"), F.col("line_dedup.removed_lines").cast("long").alias("removed_lines"), F.array_sort(F.array_distinct(F.transform("line_dedup.spans", lambda s: s["first_doc"]))).alias("first_docs"), F.col("line_dedup.spans").alias("spans"), "text")
