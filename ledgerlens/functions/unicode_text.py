"""Unicode text functions that have no built-in: normalisation with exact spans, blocks, tokens, phrases, sentences, units.

All spans are [start, end) in code points, as Spark's substring counts them. Normalisation works on whole stretches of
text: character clusters that can compose go through NFC by one regular expression, one translation table folds all code
points, and blanks are closed up at the end. Where spans are asked for they are run-length pieces, not a pair for each
character. Texts of Latin letters without fences need none of this: ``normalized`` sends them through built-in
functions only. The pandas UDFs below apply the helpers to Arrow batches.
"""

from __future__ import annotations

import re
import unicodedata
from array import array
from bisect import bisect_right
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Letters that are unified, and marks that end or close sentences.
LETTERS = {"ي": "ی", "ى": "ی", "ك": "ک"}
TERMINATORS = ".!?؟۔‼⁇⁈⁉。！？"
CLOSERS = "\"'”»’)]}"
ABBREVIATIONS = {"e.g", "i.e", "etc", "vs", "mr", "mrs", "ms", "dr", "prof", "fig", "no", "al", "inc", "ltd"}
BULLETS = "-*+•—–"
#: Words and phrases of negation, contractions as their two tokens, the bound prefix, and words of supposition.
NEGATIONS = [
    "not", "never", "cannot", "do not", "does not", "did not", "will not", "would not", "should not", "must not", "is not", "are not",
    "was not", "were not", "has not", "have not", "had not", "dont", "doesnt", "didnt", "wont", "cant", "isnt", "arent", "wasnt",
    "werent", "hasnt", "havent", "hadnt", "shouldnt", "wouldnt", "mustnt", "couldnt", "نباید", "هرگز", "نکن", "نکنید", "نکنیم",
    "نیست", "نیستند", "ندارد", "ندارم", "نداریم", "ندارید", "نخواهم", "نخواهد", "نکرده", "نشده", "نمی",
]
CONTRACTIONS = ["don t", "doesn t", "didn t", "won t", "can t", "isn t", "aren t", "wasn t", "weren t", "hasn t", "haven t", "hadn t", "shouldn t", "wouldn t", "mustn t", "couldn t"]
NEGATION_PREFIX = "نمی"
SUPPOSITIONS = ["if", "suppose", "hypothetically", "assuming", "اگر", "فرض کنیم", "فرض کنید", "احتمالا"]
#: Words that point to something said before, and how many earlier units are sent without and with one.
DEICTICS = ["این", "آن", "همان", "همین", "چنین", "اینها", "آنها", "ایشان", "اش", "شان", "شون", "this", "that", "these", "those", "it", "them", "they", "such", "previous", "earlier", "above", "prior", "same", "قبلی", "پیشین", "بالا"]
HISTORY, LONG_HISTORY = 2, 6
#: What divides sentences, what ends one, and what a line of its own begins with.
DIVIDER = re.compile(r"\n[ \t]*\n|\n(?=[ \t]*(?:[" + re.escape(BULLETS) + r"]|\d+[.)])[ \t])")
TERMINATOR = re.compile("[" + re.escape(TERMINATORS) + "]+[" + re.escape(CLOSERS) + "]*")
HEADING, LIST_ITEM = re.compile(r"#{1,6}\s"), re.compile(r"(?:[" + re.escape(BULLETS) + r"]|\d+[.)])\s")
FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})([^\n]*)$")
#: Code points of Arabic blocks, whose non-spacing marks are dropped.
ARABIC = [(0x0600, 0x06FF), (0x0750, 0x077F), (0x08A0, 0x08FF), (0xFE70, 0xFEFF)]
TATWEEL, ZWNJ, ZWJ = "ـ", "‌", "‍"
#: What may compose: a character and the marks of a combining class after it.
COMPOSABLE = regex.compile(r"[^\x00-\x7f]\P{ccc=0}*|[\x00-\x7f]\P{ccc=0}+")
#: Printable ASCII that nothing composes with, or one cluster.
STRETCH = regex.compile(r"(?:[!-~](?!\P{ccc=0}))+|[\x00-\x7f]\P{ccc=0}*|[^\x00-\x7f]\P{ccc=0}*")
WORD = regex.compile(r"[\p{L}\p{N}](?:[\p{L}\p{N}]|\P{ccc=0})*")
#: Blanks, printable ASCII and precomposed Latin letters, without İ, whose lower case is two characters.
LATIN = r"^[\t\n\x0B\f\r\x20-\x7E\u00A0-\u00AC\u00AE-\u012F\u0131-\u024F]*$"
LATIN_TEXT, LATIN_BLANKS, LATIN_WORD = re.compile(LATIN[1:-1]), re.compile(r"[\t\n\x0B\f\r \u00A0]+"), re.compile(r"[^\W_]+")
#: Whether a code point belongs to a token, up to the last lower case of LATIN (U+2C66).
LATIN_LETTER = np.array([LATIN_WORD.match(chr(i)) is not None for i in range(0x3000)], np.int8)


class _Folding(dict):
    """What each code point becomes: None if it is dropped, a blank if it divides words."""

    def __missing__(self, code: int) -> str | None:
        c = chr(code)
        kind = unicodedata.category(c)
        if c.isspace() or c == ZWNJ:
            new: str | None = " "
        elif c in (TATWEEL, ZWJ) or kind in ("Cc", "Cf") or (kind == "Mn" and any(a <= code <= b for a, b in ARABIC)):
            new = None
        elif "٠" <= c <= "٩" or "۰" <= c <= "۹":
            new = str(unicodedata.digit(c))
        else:
            new = LETTERS.get(c, c.lower())
        self[code] = new
        return new


FOLDING = _Folding()


def composed(text: str) -> str:
    """NFC of every cluster by itself."""
    return text if text.isascii() else COMPOSABLE.sub(lambda m: unicodedata.normalize("NFC", m[0]), text)


def blocks(raw: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) runs of prose and fenced code; an unclosed fence runs to the end."""
    out: list[tuple[str, int, int]] = []
    at = prose = 0
    fence: tuple[str, int, int] | None = None
    if "```" not in raw and "~~~" not in raw:
        return [("prose", 0, len(raw))] if raw else []
    for line in raw.splitlines(keepends=True):
        m = FENCE.match(line.rstrip("\r\n"))
        if fence is None:
            if m and not (m[1][0] == "`" and "`" in m[2]):
                if at > prose:
                    out.append(("prose", prose, at))
                fence = m[1][0], len(m[1]), at
        elif m and m[1][0] == fence[0] and len(m[1]) >= fence[1] and not m[2].strip():
            out.append(("code", fence[2], at + len(line)))
            fence, prose = None, at + len(line)
        at += len(line)
    if fence is not None:
        out.append(("code", fence[2], at))
    elif at > prose:
        out.append(("prose", prose, at))
    return out


def latin(raw: str) -> bool:
    """Whether lower case and single blanks are all that normalisation does: Latin letters and no fence."""
    return "```" not in raw and "~~~" not in raw and LATIN_TEXT.fullmatch(raw) is not None


def parts(raw: str) -> list[tuple[str, str]]:
    """(kind, normalised text) of the blocks: prose folded with single blanks, code as it is, no blank at either end."""
    if latin(raw):
        text = " ".join(raw.split()).lower()  # the blanks of Latin texts are those of split()
        return [("prose", text)] if text else []
    out: list[tuple[str, str]] = []
    for kind, a, b in blocks(raw):
        text = raw[a:b] if kind == "code" else re.sub(" +", " ", composed(raw[a:b]).translate(FOLDING))
        if kind == "prose" and not out:
            text = text.lstrip(" ")
        if text:
            out.append((kind, text))
    if out and out[-1][0] == "prose":
        out[-1] = "prose", out[-1][1].rstrip(" ")
    return out


def normalize(raw: str) -> str:
    """The normalised text; fenced code is kept as it is."""
    return "".join(text for _, text in parts(raw))


def mapped(raw: str) -> tuple[str, list[tuple[int, int, int, bool]]]:
    """The normalised text and its pieces (at, raw_start, raw_end, whole), in order.

    A piece reaches to the next one's ``at``. In a piece that is not whole each character stands for one raw character;
    all characters of a whole piece stand for its whole raw range.
    """
    if latin(raw):
        return _mapped_latin(raw)
    text, size = [], 0
    pieces: list[tuple[int, int, int, bool]] = []
    blank: tuple[int, int] | None = None

    def add(new: str, start: int, end: int, whole: bool) -> None:
        nonlocal blank, size
        for lo, hi, string, own in ((*(blank or (0, 0)), " ", True), (start, end, new, whole)):
            if string == " " and own and lo == hi:
                continue
            if not own and pieces and not pieces[-1][3] and pieces[-1][2] == lo:
                pieces[-1] = (*pieces[-1][:2], hi, False)
            else:
                pieces.append((size, lo, hi, own))
            text.append(string)
            size += len(string)
        blank = None

    for kind, a, b in blocks(raw):
        if kind == "code":
            add(raw[a:b], a, b, False)
            continue
        for m in STRETCH.finditer(raw, a, b):
            start, end = m.span()
            for new in re.split("( )", composed(m[0]).translate(FOLDING)):
                if new == " ":
                    if size:
                        blank = (blank[0] if blank else start, end)
                elif new:
                    add(new, start, end, len(new) != end - start or end - start > 1 and not m[0].isascii())
    return "".join(text), pieces


def _mapped_latin(raw: str) -> tuple[str, list[tuple[int, int, int, bool]]]:
    text, size, last = [], 0, 0
    pieces: list[tuple[int, int, int, bool]] = []
    for m in LATIN_BLANKS.finditer(raw):
        if m.start() > last:
            pieces.append((size, last, m.start(), False))
            text.append(raw[last : m.start()])
            size += m.start() - last
        last = m.end()
        if size and last < len(raw):
            pieces.append((size, *m.span(), True))
            text.append(" ")
            size += 1
    if last < len(raw):
        pieces.append((size, last, len(raw), False))
        text.append(raw[last:])
    return "".join(text).lower(), pieces


def raw_span(pieces: list[tuple[int, int, int, bool]], start: int, end: int, starts: list[int] | None = None) -> tuple[int, int]:
    """The raw range behind the normalised range [start, end). starts: where the pieces start, for many ranges of one text."""
    starts = [p[0] for p in pieces] if starts is None else starts
    at, low, _, whole = pieces[bisect_right(starts, start) - 1]
    last_at, last_low, last_high, last_whole = pieces[bisect_right(starts, end - 1) - 1]
    return (low if whole else low + start - at), (last_high if last_whole else last_low + end - last_at)


def normalized_span(pieces: list[tuple[int, int, int, bool]], size: int, start: int, end: int) -> tuple[int, int] | None:
    """The smallest normalised range that covers the raw range [start, end); None if nothing of it is left. size: of the text."""
    ends = [p[0] for p in pieces[1:]] + [size]
    hit = [(at, to, low, high, whole) for (at, low, high, whole), to in zip(pieces, ends, strict=True) if low < end and start < high]
    if not hit:
        return None
    at, _, low, _, whole = hit[0]
    last_at, last_to, last_low, _, last_whole = hit[-1]
    return (at if whole else at + max(0, start - low)), (last_to if last_whole else min(last_to, last_at + end - last_low))


def tokens(text: str) -> list[tuple[str, int, int]]:
    """Maximal runs of letters and digits; combining marks stay inside a run."""
    return [(m[0], *m.span()) for m in WORD.finditer(text)]


def prose_tokens(raw: str) -> list[tuple[str, int, int]]:
    """Tokens of the normalised text that are not in fenced code."""
    out, at = [], 0
    if latin(raw):
        return [(m[0], m.start(), m.end()) for _, text in parts(raw) for m in LATIN_WORD.finditer(text)]
    for kind, text in parts(raw):
        if kind == "prose":
            out += [(w, a + at, b + at) for w, a, b in tokens(text)]
        at += len(text)
    return out


def identifiers(text: str) -> list[tuple[str, int, int]]:
    """Maximal runs of tokens that are joined by one of _-. each."""
    one = WORD.pattern
    return [(m[0], *m.span()) for m in regex.finditer(rf"{one}(?:[_\-.]{one})+", text)]


def find_phrases(text: str, phrases: list[str], own: list[tuple[str, int, int]] | None = None) -> list[tuple[str, int, int]]:
    """Leftmost, then longest, non-overlapping phrases as token runs with only blanks or _-'’ between. own: the text's tokens."""
    own = tokens(text) if own is None else own
    wanted: dict[str, list[list[str]]] = {}
    for p in phrases:
        if words := [w for w, _, _ in tokens(p)]:
            wanted.setdefault(words[0], []).append(words)
    out, i = [], 0
    while i < len(own):
        best = 0
        for words in wanted.get(own[i][0], ()):
            run = own[i : i + len(words)]
            if [w for w, _, _ in run] == words and all(set(text[a[2] : b[1]]) <= set(" \t\n_-'’") for a, b in zip(run, run[1:], strict=False)):
                best = max(best, len(words))
        if best:
            out.append((text[own[i][1] : own[i + best - 1][2]], own[i][1], own[i + best - 1][2]))
        i += best or 1
    return out


def sentences(text: str) -> list[tuple[int, int]]:
    """Sentence spans: a terminator (with closing quotes) before a blank or the end, blank lines and list items divide."""
    cuts = [m.start() for m in DIVIDER.finditer(text)]
    for m in TERMINATOR.finditer(text):
        mark, at, end = m[0], m.start(), m.end()
        if end < len(text) and mark[0] in ".!?" and not text[end].isspace():
            continue
        if mark == ".":
            before = text[max(0, at - 16) : at].split()
            word = before[-1].lower().lstrip("([\"'") if before else ""
            if word in ABBREVIATIONS or (word.isdigit() and text.rfind("\n", 0, at) + 1 == at - len(word)) or (len(word) == 1 and word.isalpha()):
                continue
        cuts.append(end)
    out, start = [], 0
    for cut in [*sorted(cuts), len(text)]:
        a, b = start, cut
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b))
        start = max(start, cut)
    return out


def units(raw: str) -> list[tuple[str, int, int]]:
    """Typed line units: code, heading, list_item, quote, and the sentences of paragraphs."""
    out: list[tuple[str, int, int]] = []
    for kind, start, end in blocks(raw):
        if kind == "code":
            out.append(("code", start, end))
            continue
        at, para = start, None

        def flush(upto: int, para: int | None) -> None:
            if para is not None:
                out.extend(("sentence", para + a, para + b) for a, b in sentences(raw[para:upto]))

        for line in raw[start:end].splitlines(keepends=True):
            body = line.strip()
            offset = at + len(line) - len(line.lstrip())
            form = "heading" if HEADING.match(body) else "quote" if body.startswith(">") else "list_item" if LIST_ITEM.match(body) else None
            if form or not body:
                flush(at, para)
                para = None
                if form:
                    out.append((form, offset, offset + len(body)))
            elif para is None:
                para = at
            at += len(line)
        flush(end, para)
    return out


def label(text: str) -> str:
    return " ".join(unicodedata.normalize("NFKC", text).casefold().split())


def find_token(text: str, needle: str) -> tuple[str, int, int] | None:
    """The first token that equals the needle, which must be one token itself."""
    want = tokens(normalize(needle))
    if len(want) != 1:
        raise ValueError(f"not one token: {needle!r}")
    return next((t for t in tokens(text) if t[0] == want[0][0]), None)


def polarity(raw: str) -> tuple[str, int | None, int | None]:
    """negated with the raw span of the first negation, affirmed, or unknown for a text without tokens outside code."""
    own = prose_tokens(raw)
    if not own:
        return "unknown", None, None
    text, pieces = mapped(raw)
    hits = find_phrases(text, [normalize(p) for p in NEGATIONS + CONTRACTIONS], own)
    hits = hits or [t for t in own if t[0].startswith(NEGATION_PREFIX) and t[0] != NEGATION_PREFIX]
    return ("negated", *raw_span(pieces, *hits[0][1:])) if hits else ("affirmed", None, None)


def has_phrase(raw: str, phrases: list[str]) -> bool:
    own = prose_tokens(raw)
    return bool(own and find_phrases(normalize(raw), [normalize(p) for p in phrases], own))


def hypothetical(raw: str) -> bool:
    """Whether the text is a supposition."""
    return has_phrase(raw, SUPPOSITIONS)


#: Types are objects and not DDL text, since executors import this module without a session.
ENDS = [T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())]
PIECES = T.ArrayType(T.StructType([*(T.StructField(c, T.IntegerType()) for c in ("at", "raw_start", "raw_end")), T.StructField("whole", T.BooleanType())]))
MAPPED = T.StructType([T.StructField("text", T.StringType()), T.StructField("pieces", PIECES)])
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), *ENDS]))
POLARITY = T.StructType([T.StructField("polarity", T.StringType()), *ENDS])


@F.pandas_udf(T.StringType())
def normalize_udf(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else normalize(x))


def _lists(sizes: Iterable[int], columns: list[pa.Array], names: list[str]) -> pa.ListArray:
    """Lists of structs from flat columns and the lists' sizes."""
    offsets = array("i", [0])
    for n in sizes:
        offsets.append(offsets[-1] + n)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays(columns, names))


@F.arrow_udf(MAPPED)
def mapped_udf(raw: pa.Array) -> pa.Array:
    texts, sizes, flat = [], array("i"), [array("i"), array("i"), array("i"), array("b")]
    for x in raw:
        text, pieces = mapped(x.as_py() or "")
        texts.append(text)
        sizes.append(len(pieces))
        for column, values in zip(flat, zip(*pieces, strict=True), strict=False):
            column.extend(values)
    columns = [*(pa.array(c, pa.int32()) for c in flat[:3]), pa.array(flat[3], pa.int8()).cast(pa.bool_())]
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), _lists(sizes, columns, ["at", "raw_start", "raw_end", "whole"])], ["text", "pieces"])


def _spans_udf(find: Callable[[str], list[tuple]]):
    """An Arrow function of the spans that ``find`` gives; they are flat arrays and never an object each."""

    def run(raw: pa.Array) -> pa.Array:
        kinds, sizes, starts, ends = [], array("i"), array("i"), array("i")
        for x in raw:
            found = find(x.as_py() or "")
            sizes.append(len(found))
            kinds.extend(s[0] if len(s) == 3 else "sentence" for s in found)
            starts.extend(s[-2] for s in found)
            ends.extend(s[-1] for s in found)
        return _lists(sizes, [pa.array(kinds, pa.string()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["kind", "start", "end"])

    run.__annotations__ = {"raw": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, SPANS)


blocks_udf, sentences_udf, units_udf = map(_spans_udf, (blocks, sentences, units))


def _latin_ends(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of a normalised Latin text."""
    inside = np.zeros(len(text) + 2, np.int8)
    inside[1:-1] = LATIN_LETTER[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    turns = np.flatnonzero(np.diff(inside)).astype(np.int32)
    return turns[::2], turns[1::2]


@F.arrow_udf(SPANS)
def tokens_udf(raw: pa.Array) -> pa.Array:
    """``prose_tokens``; those of Latin texts are never an object each."""
    words, sizes, starts, ends = [], array("i"), [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    for x in raw:
        text = x.as_py() or ""
        if latin(text):
            plain = normalize(text)
            found, (start, end) = LATIN_WORD.findall(plain), _latin_ends(plain)
        else:
            found, start, end = map(list, zip(*own, strict=True)) if (own := prose_tokens(text)) else ([], [], [])
        words.extend(found)
        sizes.append(len(found))
        starts.append(np.asarray(start, np.int32))
        ends.append(np.asarray(end, np.int32))
    return _lists(sizes, [pa.array(words, pa.string()), pa.array(np.concatenate(starts)), pa.array(np.concatenate(ends))], ["kind", "start", "end"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def words_udf(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else [w for w, _, _ in prose_tokens(x)])


@F.pandas_udf(T.StringType())
def prose_udf(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: None if x is None else " | ".join(t for k, t in parts(x) if k == "prose"))


@F.pandas_udf(T.StringType())
def label_udf(text: pd.Series) -> pd.Series:
    return text.map(lambda x: None if x is None else label(x))


@F.pandas_udf(POLARITY)
def polarity_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([polarity(x or "") for x in text], columns=["polarity", "start", "end"]).astype({"start": "Int32", "end": "Int32"})


def is_latin(raw: Column) -> Column:
    """Whether built-in functions can normalise the text: Latin letters and no fence."""
    return raw.rlike(LATIN) & ~raw.contains("```") & ~raw.contains("~~~")


def normalized(raw: Column) -> Column:
    """``normalize`` as a column: built-in functions for Latin texts without fences, the UDF for the others alone."""
    latin = F.coalesce(is_latin(raw), F.lit(True))
    return F.when(latin, F.lower(F.trim(F.regexp_replace(raw, r"[\t\n\x0B\f\r \u00A0]+", " ")))).otherwise(normalize_udf(F.when(~latin, raw)))


def words(raw: Column) -> Column:
    """``prose_tokens`` without places as a column, dealt in the same way."""
    latin = F.coalesce(is_latin(raw), F.lit(True))
    return F.when(latin, F.regexp_extract_all(F.lower(raw), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}\p{M}]*"), F.lit(0))).otherwise(words_udf(F.when(~latin, raw)))


def prose(raw: Column) -> Column:
    """The normalised prose of a text, with a bar where fenced code was, dealt in the same way."""
    latin = F.coalesce(is_latin(raw), F.lit(True))
    return F.when(latin, normalized(raw)).otherwise(prose_udf(F.when(~latin, raw)))


def phrase_pattern(phrases: list[str], group: bool = False) -> str:
    """A regular expression for normalised text that finds the phrases as whole tokens with blanks or _-'’ between, longest first."""
    runs = {tuple(w for w, _, _ in tokens(normalize(p))) for p in phrases}
    some = "|".join("[\\s_\\-'’]+".join(r) for r in sorted(runs, key=lambda r: (-len(" ".join(r)), r)))
    return rf"(?:^|[^\p{{L}}\p{{N}}\p{{M}}])({'' if group else '?:'}{some})(?:$|[^\p{{L}}\p{{N}}\p{{M}}])"


def has(plain: Column, phrases: list[str]) -> Column:
    """Whether normalised text holds one of the phrases."""
    return F.coalesce(plain.rlike(phrase_pattern(phrases)), F.lit(False))
