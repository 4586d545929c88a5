import random
import re

import pytest

from ledgerlens.functions import sentence_units as S

NOTE = {"code": "technical code block", "item": "list item treated as sentence unit", "joined": "heading joined with following sentence", "heading": "standalone heading", "quote": "quoted example preserved", None: None}


def units(raw):
    return [(raw[a:b], c, n) for a, b, c, n in S.sentence_units(raw)]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("One. Two? Three", [("One.", "high", None), (" Two?", "high", None), (" Three", "high", None)]),
        ("no mark", [("no mark", "low", None)]),
        ("two\nlines", [("two\nlines", "medium", None)]),
        ("See Dr. Who at 3.14 e.g. here. Done.", [("See Dr. Who at 3.14 e.g. here.", "high", None), (" Done.", "high", None)]),
        ("Go to www.a.com. Then stop. Now leave it be. End", [("Go to www.a.com. Then stop.", "high", None), (" Now leave it be.", "high", None), (" End", "high", None)]),
        ('He said "Stop. Now." and left. Ok', [('He said "Stop. Now." and left.', "high", None), (" Ok", "high", None)]),
        ("«الف. ب؟» رفت؟ آمد۔ پایان", [("«الف. ب؟» رفت؟ آمد۔ پایان", "medium", "quoted example preserved")]),
        ("او «الف. ب؟» رفت؟ آمد۔ پایان", [("او «الف. ب؟» رفت؟", "high", None), (" آمد۔", "high", None), (" پایان", "high", None)]),
        ("“a “b.” c.” d. e", [("“a “b.” c.” d. e", "medium", "quoted example preserved")]),
        ("x “a “b. ” c. ” d. e", [("x “a “b. ” c. ” d.", "high", None), (" e", "high", None)]),
        ("- first. More.\n  goes on\n- second\n\nplain", [("- first.", "high", NOTE["item"]), (" More.", "high", NOTE["item"]), ("\n  goes on\n", "high", NOTE["item"]), ("- second\n", "high", NOTE["item"]), ("plain", "low", None)]),
        ("1. one 2. two\n", [("1. one 2.", "high", NOTE["item"]), (" two\n", "high", NOTE["item"])]),
        ("۱) یک\nب", [("۱) یک\nب", "high", NOTE["item"])]),
        ("# Head\nBody here. More.\n", [("# Head\nBody here.", "medium", NOTE["joined"]), (" More.", "medium", NOTE["joined"])]),
        ("# Head\n\nBody", [("# Head\n", "medium", NOTE["heading"]), ("Body", "low", None)]),
        ("# Head\n- item", [("# Head\n", "medium", NOTE["heading"]), ("- item", "high", NOTE["item"])]),
        ("# " + "x" * 118 + "\nBody", [("# " + "x" * 118 + "\nBody", "medium", NOTE["joined"])]),
        ("# " + "x" * 119 + "\nBody", [("# " + "x" * 119 + "\n", "medium", NOTE["heading"]), ("Body", "low", None)]),
        ("Label:\n# Head\nBody", [("Label:\n# Head\n", "medium", NOTE["joined"]), ("Body", "low", None)]),
        ("> a. b\n> c\nd", [("> a. b\n> c\n", "medium", NOTE["quote"]), ("d", "low", None)]),
        ("p\n```py\n# x. y\n```\nq", [("p\n", "low", None), ("```py\n# x. y\n```\n", "low", NOTE["code"]), ("q", "low", None)]),
        ("```\nopen. to the end", [("```\nopen. to the end", "low", NOTE["code"])]),
        ("", []),
        (" \n\t\n", []),
        (None, []),
        ('Hi." Then. End."', [('Hi."', "high", None), (' Then. End."', "high", None)]),
    ],
)
def test_rules(raw, want):
    assert [(raw[a:b], c, n) for a, b, c, n in S.sentence_units(raw)] == want


def by_characters(text):
    """Cuts of a group, one character after the other."""
    quotes, cuts = [], []
    for i, c in enumerate(text):
        if c in "“«":
            quotes.append({"“": "”", "«": "»"}[c])
        elif quotes and c == quotes[-1]:
            quotes.pop()
        elif c == '"':
            quotes.append('"')
        if quotes or c not in ".!?؟۔؛":
            continue
        nxt = text[i + 1 : i + 2]
        if c == "." and nxt and text[i - 1 : i].isdigit() and i and (nxt.isdigit() or re.search(r"(?:^|\n)\s*[0-9۰-۹٠-٩]+\.$", text[: i + 1])):
            continue
        if c == "." and (text[max(0, i - 16) : i + 1].split()[-1].lower().rstrip(".") in S.ABBREVIATIONS or re.search(r"https?://|www\.", text[max(0, i - 16) : i + 16])):
            continue
        if nxt and not nxt.isspace() and nxt not in "\"'”»":
            continue
        end = i + 1
        while end < len(text) and text[end] in "\"'”»":
            end += 1
        cuts.append(end)
    return cuts


def test_cuts_match_a_scan_by_characters():
    rng = random.Random(1)
    bits = ["a", "b ", ". ", ".", "! ", "؟", "۔ ", '"', '" ', "“", "”", "«", "»", "'", "1", "2.", "3. ", "\n", " dr.", " e.g. ", "http://x.y ", "www.", "\n 4. ", "؛ "]
    for _ in range(4000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(1, 25)))
        assert list(S.sentence_cuts(text)) == by_characters(text), text


def test_units_cover_all_text_in_order():
    rng = random.Random(2)
    bits = ["a line. ", "\n", "\n\n", "- x\n", "# h\n", "> q\n", "```\n", "Label:\n", '"', "b! ", "1. y\n", " ", "\x0b"]
    for _ in range(2000):
        raw = "".join(rng.choice(bits) for _ in range(rng.randrange(0, 20)))
        end = 0
        for a, b, *_ in S.sentence_units(raw):
            assert a >= end and raw[end:a].strip() == "" and raw[a:b].strip()
            end = b
        assert raw[end:].strip() == ""


def test_query(spark):
    from ledgerlens import catalog
    from tests.oracle import DATA

    got = catalog.queries()["f16_sentence_units"](spark, DATA).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    want = [(k, i, a, b, c, n) for k, text in docs.items() for i, (a, b, c, n) in enumerate(S.sentence_units(text), 1)]
    assert sorted((r.doc_id, r.place, r.start, r.end, r.confidence, r.note) for r in got if r.note is None) == sorted(w for w in want if w[5] is None)
    assert len(got) == len(want) and len({r.unit_id for r in got}) == len(got)
    assert all(r.sentence == docs[r.doc_id][r.start : r.end] for r in got)
