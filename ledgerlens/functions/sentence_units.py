"""Sentence units of messages by lines: fences, list items, headings and quotes first, then sentences within what is left.

Each line gets a letter for its kind, and one regular expression over these letters groups the lines: it is the automaton
of the grammar. Groups that may be divided are cut at sentence ends outside quotes. Spans are [start, end) in code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The lines that begin or are something of their own, tried in this order.
LINES = [
    ("B", r"\s*$"),
    ("F", r"\s*```"),
    ("I", r"\s*(?:[-*+•]|[0-9۰-۹٠-٩]+[.)]|[A-Za-z][.)])\s+"),
    ("H", r"\s{0,3}#{1,6}\s+\S"),
    ("H", r"\s*(?:[A-Z][A-Za-z0-9 _/-]{1,60}|[؀-ۿ0-9 _/-]{2,60})\s*[:：]\s*$"),
    ("Q", r"\s*(?:>|[\"'“”«])"),
    ("P", ""),
]
#: Characters that end sentences, words whose point does not, what may follow an end, quotes by what closes them.
ENDS = ".!?؟۔؛"
ABBREVIATIONS = {"mr", "mrs", "ms", "dr", "prof", "sr", "jr", "e.g", "i.e", "etc", "vs", "fig", "no"}
AFTER_END = "\"'”»"
QUOTES = {"“": "”", "«": "»", '"': '"'}
URL = re.compile(r"https?://|www\.")
#: Characters around a point in which a URL makes it no end, and the longest heading that takes the next line.
AROUND, LONGEST_HEADING = 16, 120
#: Groups of lines: a fence to the next one, an item or a paragraph with the plain lines after it, a short heading (h) with
#: the line after it, any other heading, lines of quotes. With each: confidence, note, and whether sentences divide it.
GROUPS = re.compile(r"(?P<fence>F[^F]*F?)|(?P<item>IP*)|(?P<joined>h[PHh])|(?P<heading>[Hh])|(?P<quote>Q+)|(?P<paragraph>P+)|B+")
SAYS = {
    "fence": ("low", "technical code block", False),
    "item": ("high", "list item treated as sentence unit", True),
    "joined": ("medium", "heading joined with following sentence", True),
    "heading": ("medium", "standalone heading", False),
    "quote": ("medium", "quoted example preserved", False),
    "paragraph": (None, None, True),
}
KINDS = [(kind, re.compile(pattern)) for kind, pattern in LINES]
MARKS = re.compile("[" + re.escape(ENDS + "".join(QUOTES) + "".join(QUOTES.values())) + "]")


def line_kind(line: str) -> str:
    kind = next(k for k, pattern in KINDS if pattern.match(line))
    return "h" if kind == "H" and len(line.strip()) <= LONGEST_HEADING else kind


def is_end(text: str, at: int) -> bool:
    """Whether the sentence mark at a place outside quotes ends a sentence."""
    after = text[at + 1 : at + 2]
    if text[at] == ".":
        line = text[text.rfind("\n", 0, at) + 1 : at].lstrip()
        number = at > 0 and text[at - 1].isdigit() and after != ""
        if number and (after.isdigit() or re.fullmatch("[0-9۰-۹٠-٩]+", line)):
            return False
        word = text[max(0, at - AROUND) : at + 1].split()[-1].lower().rstrip(".")
        if word in ABBREVIATIONS or URL.search(text, max(0, at - AROUND), at + AROUND):
            return False
    return after == "" or after.isspace() or after in AFTER_END


def sentence_cuts(text: str) -> Iterator[int]:
    """Ends of the sentences of a group, with the quotes that close them. Marks inside quotes divide nothing."""
    open_quotes: list[str] = []
    for m in MARKS.finditer(text):
        c = m[0]
        if open_quotes and c == open_quotes[-1] and c not in "“«":
            open_quotes.pop()
        elif c in QUOTES:
            open_quotes.append(QUOTES[c])
        elif c in ENDS and not open_quotes and is_end(text, m.start()):
            end = m.end()
            while text[end : end + 1] and text[end] in AFTER_END:
                end += 1
            yield end


def sentence_units(raw: str | None) -> list[tuple[int, int, str, str | None]]:
    """(start, end, confidence, note) of every unit. A group that is not divided is one unit with its line ends."""
    lines = (raw or "").splitlines(keepends=True)
    at = [0]
    for line in lines:
        at.append(at[-1] + len(line))
    out: list[tuple[int, int, str, str | None]] = []
    for m in GROUPS.finditer("".join(map(line_kind, lines))):
        if not m.lastgroup:
            continue
        start, end = at[m.start()], at[m.end()]
        text = raw[start:end]
        confidence, note, divided = SAYS[m.lastgroup]
        confidence = confidence or ("high" if any(c in text for c in ENDS) else "medium" if "\n" in text.strip() else "low")
        cuts = [0, *sentence_cuts(text), len(text)] if divided else [0, len(text)]
        spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if text[a:b].strip()]
        spans = spans if len(spans) > 1 else [(0, len(text))]
        out += [(start + a, start + b, confidence, note) for a, b in spans]
    return out


UNITS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("confidence", T.StringType()), T.StructField("note", T.StringType())]))


@F.pandas_udf(UNITS)
def sentence_units_udf(raw: pd.Series) -> pd.Series:
    return raw.map(lambda x: [dict(zip(("start", "end", "confidence", "note"), u, strict=True)) for u in sentence_units(x)])


def script(text: Column) -> Column:
    """Which of Arabic script and Latin letters a text holds."""
    arabic, latin = text.rlike("[؀-ۿ]"), text.rlike("[A-Za-z]")
    return F.when(arabic & latin, "mixed").when(arabic, "fa").when(latin, "en").otherwise("unknown")
