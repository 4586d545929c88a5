import hashlib
import random
from fractions import Fraction

import pytest

from ledgerlens.llm import chat, licenses


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


LOG = [
    # conv, seq, turn, kind, role, text
    (1, 0, 0, "message", "user", "hi"),
    (1, 1, 1, "message", "assistant", ""),
    (1, 2, 1, "delta", None, "He"),
    (1, 3, 1, "delta", None, "llo"),
    (1, 4, 1, "regenerate", None, None),
    (1, 5, 1, "delta", None, "Good "),
    (1, 6, 1, "delta", None, "day"),
    (1, 7, 2, "message", "user", "old question"),
    (1, 8, 3, "message", "assistant", "old answer"),
    (1, 9, 2, "edit", None, "new question"),
    (1, 10, 3, "message", "assistant", "new answer"),
    (2, 0, 0, "message", "user", "a"),
    (2, 1, 1, "message", "assistant", "b"),
    (2, 2, 0, "edit", None, "c"),
    (3, 0, 0, "message", "user", "gone"),
    (3, 1, 0, "delete", None, None),
    (3, 2, 1, "message", None, None),
]


def test_folding(spark):
    events = spark.createDataFrame([(*r, 1) for r in LOG], "conv_id long, seq long, turn long, kind string, role string, text string, place int").repartition(5)
    got = [(r.conv_id, r.turn, r.role, r.text) for r in chat.reconstruct(events).orderBy("conv_id", "turn").collect()]
    assert got == [
        (1, 0, "user", "hi"),
        (1, 1, "assistant", "Good day"),
        (1, 2, "user", "new question"),
        (1, 3, "assistant", "new answer"),
        (2, 0, "user", "c"),
        (3, 1, "", ""),
    ]


def test_round_trip_of_control_strings(spark):
    rng = random.Random(8)
    bits = [*chat.CONTROLS, "\\", "<", "[", "|", "\n", "x", "é😀", "/", "SYS>>", "<|turn|>", "<|end|>\n", "<\\|", "[\\INST]"]
    want, rows = {}, []
    for c in range(60):
        turns = [(rng.choice(["user", "assistant", "tool<|x\n", "a\\nb"]), "".join(rng.choice(bits) for _ in range(rng.randrange(0, 12)))) for _ in range(rng.randrange(1, 7))]
        want[c] = turns
        rows += [(c, t, role, text, "extra") for t, (role, text) in enumerate(turns)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, place string").repartition(3)
    out = chat.render(chat.reconstruct(chat.as_events(df)))
    got = {r.conv_id: r for r in chat.read_back(out).collect()}
    for c, turns in want.items():
        assert [(t.role, t.text) for t in got[c].turns] == turns
        assert got[c].loss_text == "".join(x for role, x in turns if role == "assistant")
        assert got[c].formatted.count("<|turn|>") == len(turns)
    streamed = chat.render(chat.reconstruct(chat.as_stream(df, chunk=3)))
    assert sorted(map(tuple, streamed.select("conv_id", "formatted").collect())) == sorted(map(tuple, out.select("conv_id", "formatted").collect()))
    assert {r.kind for r in chat.as_stream(df, chunk=3).select("kind").distinct().collect()} == {"message", "delta", "regenerate"}
    assert "Python" not in plan_of(streamed) and "Arrow" not in plan_of(streamed)


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string"
    odd = spark.createDataFrame([(1, None, "assistant", "x" * 5000), (1, 0, "assistant", None), (1, 0, "assistant", None), (None, 0, None, "y")], schema)
    back = {r.conv_id: [t.text for t in r.turns] for r in chat.read_back(chat.render(chat.reconstruct(chat.as_stream(odd)))).collect()}
    assert back == {1: ["x" * 5000, "", ""], None: ["y"]}
    assert chat.digests(chat.read_back(chat.render(chat.reconstruct(chat.as_events(spark.createDataFrame([], schema)))))).count() == 0
    rows = [(None, 0, "user", "x"), (1, 0, "user", None), (1, 0, "user", None), (1, 1, None, "y" * 200000)]
    got = {r.conv_id: r for r in chat.digests(chat.read_back(chat.render(chat.reconstruct(chat.as_events(spark.createDataFrame(rows, schema)))))).collect()}
    assert got[1].n_turns == 3 and got[None].n_turns == 1 and got[1].loss_chars == 0
    assert got[1].turns_sha256 == hashlib.sha256(("user\n\n" * 2 + "\n" + "y" * 200000 + "\n").encode()).hexdigest()


def dice(a, b):
    return 2 * len(a & b) / (len(a) + len(b))


def grams(text):
    import re

    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return set(zip(w, w[1:], strict=False))


def test_license_scan_matches_brute_force(spark):
    rng = random.Random(3)
    notices = [(n, t) for n, ts in licenses.TEMPLATES.items() for t in ts]
    docs = []
    for i in range(120):
        lines = [" ".join(rng.choice(["of", "the", "software", "license", "zebra"]) for _ in range(rng.randrange(0, 20))) for _ in range(3)]
        w = rng.choice(notices)[1].split()
        if rng.random() < 0.5 and len(w) > 4:
            w[rng.randrange(len(w))] = "changed"
        lines.insert(rng.randrange(4), " ".join(w).upper() if i % 2 else " ".join(w))
        docs.append((i, rng.choice(["\n", "\n\n"]).join(lines)))
    want = {}
    for i, text in docs:
        for u in {*text.split("\n"), *text.split("\n\n"), text}:
            for name, t in notices:
                if len(u) >= 3 and grams(u) and dice(grams(u), grams(t)) >= 0.8:
                    want[i, name] = max(want.get((i, name), 0), round(dice(grams(u), grams(t)), 6))
    df = spark.createDataFrame([(i, t, 9) for i, t in docs], "doc_id long, text string, n int")
    out = licenses.scan(df)
    assert {(r.doc_id, r.license): r.dice for r in out.collect()} == pytest.approx(want)
    assert "Python" not in plan_of(out) and "Arrow" not in plan_of(out)


def test_license_edges(spark):
    schema = "doc_id long, text string"
    assert licenses.scan(spark.createDataFrame([], schema)).count() == 0
    rows = [(1, None), (2, ""), (3, "word"), (None, "All rights reserved."), (4, "All rights reserved"), (4, "All rights reserved"), (5, "z " * 200000)]
    assert sorted((r.doc_id or 0, r.license, r.hits) for r in licenses.scan(spark.createDataFrame(rows, schema)).collect()) == [(0, "proprietary", 1), (4, "proprietary", 2)]


def test_license_of_repeated_notices(spark):
    mit = licenses.TEMPLATES["mit"][2]
    rows = [(1, " ".join([mit] * 4)), (2, "All rights reserved. " * 67), (3, "All rights reserved. " * 5000), (4, " ".join(f"w{i}" for i in range(5000)))]
    got = {(r.doc_id, r.license): r.dice for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == pytest.approx({(1, "mit"): round(dice(grams(rows[0][1]), grams(mit)), 6), (2, "proprietary"): 0.8, (3, "proprietary"): 0.8})


def test_license_sizes_at_their_edges(spark):
    """Two bigrams match three (Dice 0.8); equal lines of a text count once, equal rows once each."""
    rows = [(1, "all rights reserved now"), (2, "All rights reserved.\nAll rights reserved."), (3, "all rights reserved now then"), (4, "all rights reserved now"), (4, "all rights reserved now")]
    got = {r.doc_id: (r.license, r.dice, r.hits) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("proprietary", 0.8, 1), 2: ("proprietary", 1.0, 2), 4: ("proprietary", 0.8, 2)}
    assert licenses.sizes(2, Fraction("0.8")) == (2, 3) and licenses.sizes(10, Fraction("0.8")) == (7, 15)


def test_every_match_holds_an_anchor():
    """Of each template any bigrams that suffice for a match are kept, as far from the anchors as can be."""
    least = Fraction("0.8")
    words = set(licenses.anchors(least))
    for text in (t for ts in licenses.TEMPLATES.values() for t in ts):
        own = licenses.plain_bigrams(text)
        free = [g for g in own if not set(g) & words]
        n = max(len(free), licenses.sizes(len(own), least)[0])
        assert Fraction(2 * len(free), n + len(own)) < least, text[:40]


def test_license_query_equals_its_sql(spark, tmp_path):
    import duckdb

    mit = licenses.TEMPLATES["mit"]
    texts = ["All rights reserved. " * 20, "All rights reserved. " * 100, "Licensed under the MIT License. " * 20, "Licensed under the MIT License. " * 60, mit[-1], mit[-1] + "\n\n" + mit[0], "x " + mit[2] + "\ny", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute("SELECT doc_id, license, dice, hits FROM (" + licenses.SQL + ")").fetchall())
    assert sorted(tuple(r) for r in licenses.op5_license_dice(spark, str(tmp_path)).select("doc_id", "license", "dice", "hits").collect()) == want
    assert {r[0] for r in want} == {0, 1, 2, 3, 4, 5, 6}
