"""Phrases of many lexicons in whole texts: one pass of a token automaton, or a join by first token beyond its size bound.

A phrase is a run of tokens with nothing but blanks and _-'’ between them, outside fenced code, in normalised text; a hit
is the raw span behind it. Both ways give all hits; ``leftmost_longest`` then keeps those of a lexicon that do not overlap.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import unicode_text as U

#: Tokens of all phrases up to which they become one automaton (each takes about 300 bytes in a worker).
MOST_TOKENS = 1_000_000
#: What may be between the tokens of a phrase.
BETWEEN = set(" \t\n_-'’")
#: The same in a raw Latin text, where all blanks are still there.
JOINT = re.compile(r"[\t\n\x0B\f\r \u00A0_\-']*")


class TokenAutomaton:
    """Aho-Corasick over tokens: for every place of a text, all phrases that end there."""

    def __init__(self, phrases: Iterable[tuple[int, list[str]]]) -> None:
        """phrases: numbers and their tokens, at least one each."""
        self.next: list[dict[str, int]] = [{}]
        self.ends: list[list[tuple[int, int]]] = [[]]
        for number, words in phrases:
            at = 0
            for w in words:
                if w not in self.next[at]:
                    self.next[at][w] = len(self.next)
                    self.next.append({})
                    self.ends.append([])
                at = self.next[at][w]
            self.ends[at].append((number, len(words)))
        self.back = [0] * len(self.next)
        # the nearest shorter suffix that ends a phrase, 0 if there is none
        self.shorter = [0] * len(self.next)
        level = list(self.next[0].values())
        while level:
            below = []
            for at in level:
                for w, to in self.next[at].items():
                    self.back[to] = self.step(self.back[at], w)
                    hit = self.back[to]
                    self.shorter[to] = hit if self.ends[hit] else self.shorter[hit]
                    below.append(to)
            level = below

    def step(self, at: int, word: str) -> int:
        while at and word not in self.next[at]:
            at = self.back[at]
        return self.next[at].get(word, 0)

    def hits(self, words: list[str], joined: list[bool]) -> Iterator[tuple[int, int, int]]:
        """(number, first, last) of all phrases in the words. joined: whether a word may follow the one before in a phrase."""
        at, root = 0, self.next[0]
        for i, w in enumerate(words):
            at = self.step(at, w) if at and joined[i] else root.get(w, 0)
            end = at
            while end:
                for number, size in self.ends[end]:
                    yield number, i - size + 1, i
                end = self.shorter[end]


def laid_out(raw: str | None) -> tuple[list[str], list[bool], list[tuple[int, int]]]:
    """The prose tokens of a text, whether each may follow the one before in a phrase, and their raw spans."""
    raw = raw or ""
    if U.latin(raw):  # tokens stand where they stand in the raw text
        found = [(m[0], *m.span()) for m in U.LATIN_WORD.finditer(raw.lower())]
        ends = [0, *(b for _, _, b in found)]
        joined = [i > 0 and JOINT.fullmatch(raw, ends[i], found[i][1]) is not None for i in range(len(found))]
        return [w for w, _, _ in found], joined, [(a, b) for _, a, b in found]
    text, pieces = U.mapped(raw)
    own = U.prose_tokens(raw)
    joined = [i > 0 and set(text[own[i - 1][2] : own[i][1]]) <= BETWEEN for i in range(len(own))]
    starts = [p[0] for p in pieces]
    return [w for w, _, _ in own], joined, [U.raw_span(pieces, a, b, starts) for _, a, b in own]


def phrase_tokens(phrase: str | None) -> list[str]:
    return [w for w, _, _ in U.tokens(U.normalize(phrase or ""))]


@F.pandas_udf(T.ArrayType(T.StringType()))
def phrase_tokens_udf(phrases):
    return phrases.map(phrase_tokens)


#: Tokens of a text with what a phrase needs to know about each.
TOKENS = T.ArrayType(T.StructType([T.StructField("word", T.StringType()), T.StructField("joined", T.BooleanType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]))


@F.pandas_udf(TOKENS)
def laid_out_udf(raw):
    return raw.map(lambda x: [{"word": w, "joined": j, "start": a, "end": b} for w, j, (a, b) in zip(*laid_out(x), strict=True)])


def numbered(lexicons: DataFrame) -> DataFrame:
    """lexicon, phrase, words of every distinct phrase that has tokens."""
    made = lexicons.select("lexicon", "phrase").distinct().withColumn("words", phrase_tokens_udf("phrase"))
    return made.where(F.size("words") > 0)


def all_hits(texts: DataFrame, key: str, text: str, lexicons: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """key, lexicon, phrase, start, end of every hit, overlapping ones too.

    lexicons: lexicon, phrase. Up to ``most`` tokens they are collected once and broadcast as one automaton, so one pass
    over the texts answers all lexicons; beyond that they are joined, and no machine holds them whole. Null texts and
    phrases without tokens have no hits; rows that repeat a text have hits of their own.
    """
    phrases = numbered(lexicons)
    size = phrases.agg(F.sum(F.size("words"))).first()[0] or 0
    return _scanned(texts, key, text, phrases) if size <= most else _joined(texts, key, text, phrases)


def _scanned(texts: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    known = [(r.lexicon, r.phrase, r.words) for r in phrases.collect()]
    sent = texts.sparkSession.sparkContext.broadcast((TokenAutomaton((i, w) for i, (_, _, w) in enumerate(known)), [k[:2] for k in known]))
    key_type = texts.schema[key].dataType
    fields = [T.StructField(key, key_type), *(T.StructField(c, T.StringType()) for c in ("lexicon", "phrase")), *(T.StructField(c, T.IntegerType()) for c in ("start", "end"))]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, names = sent.value
        for batch in batches:
            at, found = [], []
            for i, raw in enumerate(batch.column(1).to_pylist()):
                words, joined, spans = laid_out(raw)
                for number, first, last in automaton.hits(words, joined):
                    at.append(i)
                    found.append((*names[number], spans[first][0], spans[last][1]))
            columns = [batch.column(0).take(pa.array(at, pa.int64()))]
            columns += [pa.array([f[c] for f in found], kind) for c, kind in enumerate((pa.string(), pa.string(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, [f.name for f in fields])

    return texts.select(key, F.col(text).cast("string")).mapInArrow(scan, T.StructType(fields))


def _joined(texts: DataFrame, key: str, text: str, phrases: DataFrame) -> DataFrame:
    """Every token meets the phrases that it begins; those that go on as the text does are hits. A text's tokens travel once for each token that begins a phrase."""
    firsts = phrases.withColumn("word", F.col("words")[0])
    own = texts.select(F.col(key).alias("k"), laid_out_udf(F.col(text).cast("string")).alias("own"))
    longest = phrases.agg(F.max(F.size("words"))).first()[0]
    # what a phrase can cover from a token on
    at = own.select("k", "own", F.explode(F.sequence(F.lit(1), F.size("own"))).alias("i")).where("size(own) > 0")
    ahead = at.select("k", F.col("own")[F.col("i") - 1]["word"].alias("word"), F.slice("own", F.col("i"), F.lit(longest)).alias("ahead"))
    ahead = ahead.join(firsts.select("word").distinct(), "word", "left_semi")
    met = ahead.join(firsts, "word").where(F.size("words") <= F.size("ahead"))
    run = F.slice("ahead", F.lit(1), F.size("words"))
    same = (F.transform(run, lambda x: x["word"]) == F.col("words")) & F.forall(F.slice(run, F.lit(2), F.greatest(F.size("words") - 1, F.lit(0))), lambda x: x["joined"])
    return met.where(same).select(F.col("k").alias(key), "lexicon", "phrase", F.col("ahead")[0]["start"].alias("start"), F.element_at(run, -1)["end"].alias("end"))


def leftmost_longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of sorted hits those that start where the last one kept of their text and lexicon has ended, or after it."""
    last, end = None, 0
    for batch in batches:
        kept = []
        for i, (*here, start, to) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, "lexicon", "start", "end")), strict=True)):
            if here != last or start >= end:
                last, end = here, to
                kept.append(i)
        yield batch.take(pa.array(kept, pa.int64()))


def resolved(hits: DataFrame, key: str) -> DataFrame:
    """The hits of each text and lexicon that do not overlap: leftmost first, then longest, then the first phrase by name. Rows are streamed in order; none but the last is held."""
    order = [key, "lexicon", "start", F.col("end").desc(), "phrase"]
    return hits.repartition(key, "lexicon").sortWithinPartitions(*order).mapInArrow(leftmost_longest, hits.schema)


def find(texts: DataFrame, key: str, text: str, lexicons: DataFrame, most: int = MOST_TOKENS) -> DataFrame:
    """key (unique), lexicon, phrase, start, end of the leftmost, then longest hits of each lexicon that do not overlap."""
    return resolved(all_hits(texts, key, text, lexicons, most), key)
