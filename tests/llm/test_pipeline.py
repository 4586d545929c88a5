import random

import corpus_pipeline as cp
from ledgerlens.llm.packing import encoder


def planted(seed=11):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    para = lambda n: " ".join(word() for _ in range(n))
    vocab = [word() for _ in range(300)]
    clean = lambda: "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randrange(5, 40))) for _ in range(rng.randrange(2, 6)))
    docs, junk, leaked, copies = {}, set(), set(), {}
    item = " ".join(rng.choice(vocab) for _ in range(30))
    passage = "\n".join([para(30), para(35)])
    for i in range(260):
        docs[i] = clean()
    for i in range(200, 230):
        docs[i] = " | ".join(x + "%%%" for x in docs[i].split())
        junk.add(i)
    for i in range(0, 40, 8):
        docs[i] += "\n" + item.replace(" ", "  ", 3)
        leaked.add(i)
    for i in (50, 60, 70):
        docs[i] = docs[i] + "\n" + passage + "\n" + clean()
    base = [rng.choice(vocab) for _ in range(45)]
    for i in (100, 101, 102):
        w = list(base)
        w[i - 100] = word()
        docs[i], copies[i] = " ".join(w), 100
    docs[110] = docs[5]
    return docs, junk, leaked, copies, item, passage


def test_stages_find_what_was_planted(spark, tmp_path):
    docs, junk, leaked, copies, item, passage = planted()
    d = f"file://{tmp_path}"
    spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs.items()], "doc_id long, text string, lang string, source string, n_chars long").repartition(4).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([(i, int(i not in junk), 0) for i in docs if i % 2 == 0 or i > 215], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    now = spark.read.parquet(f"{d}/documents.parquet")
    columns, seen = now.columns, []
    for name, stage in cp.STAGES:
        now = stage(spark, now, d)
        if name != "packing":
            assert now.columns == columns
            seen.append({r.doc_id: r for r in now.collect()})
    good, lines, near, free = seen
    assert not set(good) & junk and len(good) >= 0.97 * (len(docs) - len(junk))
    assert passage in lines[50].text and passage not in lines[60].text and passage not in lines[70].text
    assert lines[60].n_chars == len(lines[60].text)
    assert 110 not in lines or lines[110].text == docs[110]  # too short for a passage, or gone as a whole
    assert 100 in near and not {101, 102} & set(near) and 110 not in near
    assert not set(free) & leaked and set(near) - set(free) <= leaked
    pieces = now.collect()
    encode = encoder()
    for i, r in free.items():
        assert sum(p.length for p in pieces if p.doc_id == i) == len(encode(r.text)) + 1
    assert {p.doc_id for p in pieces} == set(free)


def test_stages_decide_row_by_row_and_carry_any_column(spark, tmp_path):
    """Rows without id, rows that repeat an id with another text, empty texts, and columns that operators use inside."""
    d = f"file://{tmp_path}"
    rng = random.Random(4)
    say = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, item = say(80), say(70), say(60), say(20)
    rows = [(1, a), (1, b), (1, a + " more"), (None, c), (None, c), (None, say(40) + " " + item), (None, say(30)), (7, None), (8, ""), (9, item)]
    names = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, leaks int, row string, line_dedup int, first int, `odd name` string, whole int"
    docs = spark.createDataFrame([(i, t, "en", None, len(t or ""), False, 1, "r", 2, 3, f"n{n}", 4) for n, (i, t) in enumerate(rows)], names)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    docs.write.parquet(f"{d}/documents.parquet")
    now, seen = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, stage in cp.STAGES[:-1]:
        now = stage(spark, now, d)
        assert now.columns == docs.columns, name
        now.write.parquet(f"{d}/{name}")
        now = spark.read.parquet(f"{d}/{name}")
        seen.append(sorted((r.doc_id or 0, r.text) if r.text is not None else (r.doc_id, "null") for r in now.collect()))
    good, lines, near, free = seen
    assert len(good) == 10  # no labels: as many stay as there are
    assert lines.count((0, c)) == 1 and len(lines) == 9  # the second c is an exact copy and is empty afterwards
    assert ((1, a) in near) + ((1, a + " more") in near) == 1 and (1, b) in near
    assert len(near) == 8 and {x for x in near if x not in free} == {x for x in near if item in x[1]}
    assert sorted((p.doc_id or 0) for p in cp.packing(spark, now, d).collect()) == [0, 0, 1, 1, 7, 8]


def test_run_is_the_stages(spark, tmp_path):
    d = f"file://{tmp_path}"
    spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (None, "x y z", "en", "s", 5)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    assert sorted((p.doc_id or 0) for p in cp.run(spark, d).collect()) == [0, 1, 2]
