"""Spelling variants by forward and reversed sorted dictionaries.

One edit of a word leaves one of its halves intact. Words are laid out in a forward dictionary, by the first half, and in a
reversed one, by the last half; words that are near share a block of one of them. A block with more than BLOCK words is
subdivided: what is still open between its fixed beginning and its fixed end is halved again, and one of these halves is
intact in turn. Blocks are dealt over tasks, sorted and scanned one by one, and what a block holds is verified.

A block is (size, lo, hi): it is for pairs whose shorter word has ``size`` code points, whose words agree in the first lo
and the last size - hi, and whose first difference lies in [lo, hi) (or at the end, for hi = size). These ranges are a
partition of all positions, so every pair is found in one block and none is counted twice.

Block sizes are counted before any row is dealt, with sums in each task first, so a beginning that a third of all words
share never meets in one task: it is subdivided beforehand. At hi - lo = 1 a block is no longer divided. Its words differ
in one or two code points, so the alphabet's square bounds it, whatever the corpus.

Edge cases: null and empty texts hold no words; a null doc_id hashes as the empty string; rows that repeat a doc_id count
once each; a word without near words has n_near 0 and is its own root; ties are resolved by code-point order; no documents
give no words. Only doc_id and text are read.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .store import dropped, saved, table

#: Fixed values of the contract.
RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
EVERY, LEAST_SIZE, LEAST_COUNT, RATIO = 199, 6, 5, 5
#: Words of a block beyond which it is subdivided; words up to which all pairs of a block are looked at.
BLOCK, FEW = 2000, 16
#: Open code points beyond which a block of more than FEW words is subdivided rather than laid out by its one-code-point gaps.
OPEN = 24


def words(docs: DataFrame, least_size: int = LEAST_SIZE, least_count: int = LEAST_COUNT) -> DataFrame:
    """word and n (occurrences) of all words of docs. About one run in EVERY loses the code point that its hash names."""
    run = F.col("run")
    h = F.crc32(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), run))
    runs = docs.select("doc_id", F.explode(F.regexp_extract_all(F.translate(F.col("text").cast("string"), UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run")).withColumn("h", h)
    at = (F.col("h") % F.length(run)).cast("int")
    cut = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.length(run)))
    each = runs.select(F.when(F.col("h") % EVERY == 0, cut).otherwise(run).alias("word"))
    return each.where(F.length("word") >= least_size).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def halves(rows: DataFrame) -> DataFrame:
    """Every row of a block (word, n, size, lo, hi) in the two blocks that the block is divided into."""
    lo, hi = F.col("lo"), F.col("hi")
    mid = lo + F.floor((hi - lo) / 2).cast("int")
    two = F.array(F.struct(mid.alias("lo"), hi.alias("hi")), F.struct(lo.alias("lo"), mid.alias("hi")))
    return _keyed(rows.select("word", "n", "size", F.explode(two).alias("part")).select("word", "n", "size", "part.lo", "part.hi"))


def _keyed(rows: DataFrame) -> DataFrame:
    """The beginning and the end that the words of a block share, as its key."""
    end = F.col("size") - F.col("hi")
    word = F.col("word")
    return rows.withColumn("key", F.concat(word.substr(F.lit(1), F.col("lo")), F.lit(" "), word.substr(F.length("word") - end + 1, end)))


def blocks(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """Rows (word, n, size, lo, hi, key) of blocks that need no further division. A word is the shorter one of its size and the longer one of one less."""
    sizes = F.array(F.length("word"), F.length("word") - 1)
    whole = vocabulary.select("word", "n", F.explode(sizes).alias("size")).where("size > 0").withColumns({"lo": F.lit(0), "hi": F.col("size")})
    rows, done, used = saved(halves(whole), "spelling-blocks"), None, []
    names = ["size", "lo", "hi", "key"]
    while True:
        span, held = F.col("hi") - F.col("lo"), F.col("held")
        large = rows.groupBy(*names).agg(F.count("*").alias("held")).where((span > 1) & ((held > block) | ((held > FEW) & (span > OPEN))))
        large = saved(large.select(*names), "spelling-large")
        used += [rows, large]
        if large.isEmpty():
            done = rows if done is None else done.unionByName(rows)
            return done, used
        small = rows.join(large, names, "left_anti").select(*rows.columns)
        done = small if done is None else done.unionByName(small)
        rows = saved(halves(rows.join(large, names, "left_semi")), "spelling-blocks")


def first_difference(a: str, b: str) -> int:
    """The first position at which a and b, the longer one, differ by one edit; -1 if they don't."""
    p = 0
    while p < len(a) and a[p] == b[p]:
        p += 1
    if len(a) == len(b):
        return p if p < len(a) and a[p + 1 :] == b[p + 1 :] else -1
    return p if a[p:] == b[p + 1 :] else -1


def near_pairs(size: int, lo: int, hi: int, found: list[str]) -> Iterator[tuple[int, int]]:
    """Pairs of places in ``found``, the words of a block, that differ by one edit that is this block's to report."""
    short = [i for i, w in enumerate(found) if len(w) == size]
    if len(found) <= FEW:
        pairs = ((i, j) for x, i in enumerate(short) for j in [*short[x + 1 :], *(k for k, w in enumerate(found) if len(w) > size)])
    else:
        pairs = _same_gap(size, lo, hi, found, short)
    for i, j in pairs:
        p = first_difference(found[i], found[j])
        if p >= lo and (p < hi or hi == size):
            yield i, j


def _same_gap(size: int, lo: int, hi: int, found: list[str], short: list[int]) -> Iterator[tuple[int, int]]:
    """Pairs that are equal but for one code point of the open part, each once."""
    for p in range(lo, hi):
        held = defaultdict(list)
        for i in short:
            held[found[i][lo:p], found[i][p + 1 : hi]].append(i)
        for same in held.values():
            yield from ((i, j) for x, i in enumerate(same) for j in same[x + 1 :])
    whole = {found[i][lo:hi]: i for i in short}
    for j, w in enumerate(found):
        if len(w) > size:
            part = w[lo : hi + 1]
            yield from ((whole[x], j) for x in {part[:p] + part[p + 1 :] for p in range(len(part))} if x in whole)


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Scans sorted blocks; for each word of a block with near words in it: how many, and the best of them."""
    block, found, counts, out = None, [], [], []

    def close() -> None:
        near = [0] * len(found)
        best: list[tuple] = [()] * len(found)
        for i, j in near_pairs(*block[:3], found) if len(found) > 1 else ():
            for x, y in ((i, j), (j, i)):
                near[x] += 1
                mine = (-counts[y], found[y])
                if not best[x] or mine < best[x]:
                    best[x] = mine
        out.extend((w, k, -b[0], b[1]) for w, k, b in zip(found, near, best, strict=True) if k)

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array([r[c] for r in out], t) for c, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.string()))], ["word", "n_near", "best_n", "best"])
        out.clear()
        return made

    for batch in batches:
        for word, n, *here in zip(*(batch.column(c).to_pylist() for c in ("word", "n", "size", "lo", "hi", "key")), strict=True):
            if here != block:
                if found:
                    close()
                block, found, counts = here, [], []
            found.append(word)
            counts.append(n)
        if out:
            yield flush()
    if found:
        close()
    if out:
        yield flush()


def best_first(n: str, word: str) -> Column:
    """What is least for the largest n and, of equal ones, for the first word in code-point order."""
    return F.struct((-F.col(n)).alias("less"), F.col(word).alias("near"))


def neighbours(vocabulary: DataFrame, block: int = BLOCK) -> DataFrame:
    """word, n_near and best (-n and word of the best near word) of every word that has near words."""
    rows, used = blocks(vocabulary, block)
    n = int(vocabulary.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    names = ["size", "lo", "hi", "key"]
    scanned = rows.repartition(n, *names).sortWithinPartitions(*names).mapInArrow(_scan, "word string, n_near long, best_n long, best string")
    found = saved(scanned.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(best_first("best_n", "best")).alias("best")), "spelling-near")
    dropped(*used)
    return found


def roots(forms: DataFrame) -> DataFrame:
    """word and root of every word that has a form. Forms grow in n, so following them ends; each round doubles the steps that are followed."""
    at = saved(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        ahead = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        new = saved(at.join(ahead, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-roots")
        dropped(at)
        if new.where("moved").isEmpty():
            return new.select("word", "root")
        at = new


def variants(vocabulary: DataFrame, ratio: int = RATIO, block: int = BLOCK) -> DataFrame:
    """word, form, root, n, n_near and form_n of every word of a vocabulary (word, n)."""
    near = neighbours(vocabulary, block)
    form = F.when(-F.col("best.less") >= F.col("n") * ratio, F.struct(F.col("best.near").alias("form"), (-F.col("best.less")).alias("form_n")))
    formed = saved(vocabulary.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), form.alias("f")).select("word", "n", "n_near", "f.form", "f.form_n"), "spelling-forms")
    dropped(near)
    last = roots(formed.where("form is not null"))
    return formed.join(last, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op12_half_dictionaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(saved(words(table(spark, sf_dir, "documents")), "spelling-words"))
