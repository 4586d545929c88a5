import random

import numpy as np
import xxhash

from ledgerlens.llm.hashing import mix, salt
from ledgerlens.llm.linedup import BASE, MIN_WORDS, SPAN, WINDOW, chunks, cut_lines, dedup_lines, op10_line_chunks


def words(rng, n):
    return " ".join("".join(rng.choice("abcdefghij") for _ in range(4)) for _ in range(n))


def plain_cuts(lines, span):
    """Cut lines in plain integers: the least rolling value of each shortest stretch of non-blank lines."""
    mask = 2**64 - 1
    fin = lambda x: int(mix(np.array([x & mask], np.uint64))[0])
    h = [fin(xxhash.xxh3_64_intdigest(x.encode())) for x in lines]
    n = [len(x.split()) for x in lines]
    value = []
    for i in range(len(lines)):
        first = max(0, i - WINDOW + 1)
        rolled = sum(h[j] * pow(BASE, j - first, 2**64) for j in range(first, i + 1))
        value.append(fin(rolled + (i + 1 - first) * int(salt(7))))
    full = [i for i, k in enumerate(n) if k]
    out = {*full[:1], *full[-1:]}
    for a in range(len(full)):
        for b in range(a + 1, len(full) + 1):
            if sum(n[i] for i in full[a:b]) >= span:
                out.add(min(full[a:b], key=lambda i: (value[i], i)))
                break
    return out


def brute(texts, min_words):
    """Walks all documents in order; a shortest run of lines from or to a cut line that was seen before goes."""
    seen, out, removed = {}, {}, {}
    places = []
    for d in sorted(texts):
        lines = texts[d].split("\n")
        n = [len(x.split()) for x in lines]
        runs, cuts = set(), plain_cuts(lines, SPAN)
        for i in sorted(cuts):
            for j in range(i + 1, len(lines) + 1):
                if sum(n[i:j]) >= min_words:
                    runs.add((i, j))
                    break
        for j in (c + 1 for c in sorted(cuts)):
            for i in range(j - 1, -1, -1):
                if sum(n[i:j]) >= min_words:
                    runs.add((i, j))
                    break
        places += [(d, i, j, tuple(lines[i:j])) for i, j in runs]
    for d, i, j, key in sorted(places):
        if key in seen:
            removed.setdefault(d, set()).update(range(i, j))
        else:
            seen[key] = (d, i)
    for d, t in texts.items():
        out[d] = "\n".join(x for k, x in enumerate(t.split("\n")) if k not in removed.get(d, ()))
    return out


def test_matches_brute_force(spark):
    rng = random.Random(9)
    passages = [[words(rng, rng.choice([3, 10, 27, 30, 60])) for _ in range(rng.choice([1, 2, 3, 5]))] for _ in range(8)]
    texts = {}
    for i in range(80):
        lines = [words(rng, rng.choice([0, 2, 8, 20, 70])) for _ in range(rng.randrange(1, 9))]
        for _ in range(rng.choice([0, 1, 1, 2])):
            k = rng.randrange(len(lines) + 1)
            lines[k:k] = rng.choice(passages)
        texts[i] = "\n".join(lines)
    texts[80] = texts[3]
    texts[81] = "\n".join(["same line of five words"] * 40)
    df = spark.createDataFrame([(i, t, 5) for i, t in texts.items()], "doc_id long, text string, row int").repartition(5)
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    want = brute(texts, MIN_WORDS)
    assert {i: r.text for i, r in got.items()} == want
    assert got[80].text == "" and got[3].row == 5
    assert all(r.line_dedup.removed_lines == len(texts[i].split("\n")) - (len(want[i].split("\n")) if r.line_dedup.removed_lines < r.line_dedup.n_lines else 0) for i, r in got.items())


def test_nulls_repeats_and_empty_tables(spark):
    passage = "w " * 60
    rows = [(1, passage), (1, passage), (None, passage), (2, None), (3, ""), (4, "short\nlines")]
    got = sorted(((r.doc_id or 9, r.text) for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(1, ""), (1, passage), (9, ""), (2, None), (3, ""), (4, "short\nlines")], key=str)
    assert dedup_lines(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_chunks_do_not_depend_on_what_stands_before():
    rng = random.Random(1)
    p = [words(rng, 30).encode() for _ in range(4)]
    one = {h for _, _, h in chunks([b"x y z", *p])}
    two = {h for _, _, h in chunks([words(rng, 12).encode() for _ in range(9)] + p)}
    assert len(one & two) >= 3


def test_cuts_are_chosen_by_hash_and_never_far_apart():
    rng = random.Random(2)
    lines = [words(rng, rng.choice([0, 1, 2, 3, 4])).encode() for _ in range(4000)]
    n = np.array([len(x.split()) for x in lines])
    values = mix(np.arange(4000, dtype=np.uint64))
    cut = cut_lines(values, n, 10)
    assert 0.15 < len(cut) / (n > 0).sum() < 0.5
    between = [n[a + 1 : b].sum() for a, b in zip(cut, cut[1:])]
    assert max(between) < 10 + 4
    assert set(cut_lines(values[7:], n[7:], 10) + 7) <= set(cut.tolist()) | set(range(7, 20))


def recall_by_length(seed=6, each=60):
    """Share of planted passages whose second copy is cut, by words a line and words over 50."""
    rng = random.Random(seed)
    out = {}
    for line in (4, 8, 15, 30):
        for more in (0, 10, 25, 60):
            found = 0
            for _ in range(each):
                p, total = [], 0
                while total < 50 + more:
                    p.append(words(rng, max(1, min(line, 50 + more - total))).encode())
                    total += len(p[-1].split())
                around = lambda: [words(rng, rng.randrange(1, 2 * line)).encode() for _ in range(8)]
                keys = []
                for _ in range(2):
                    a, b = around(), around()
                    keys.append({h: set(range(s - len(a), s + k - len(a))) for s, k, h in chunks([*a, *p, *b])})
                common = set().union(*(keys[0][h] for h in keys[0].keys() & keys[1].keys()))
                found += len(common & set(range(len(p)))) >= 0.7 * len(p)
            out[line, more] = found / each
    return out


def test_recall_of_planted_passages_by_length():
    got = recall_by_length()
    assert all(v == 1.0 for v in got.values()), got


def test_clashing_columns_are_carried(spark):
    passage = "w " * 60
    rows = [(1, passage, 1, 2, 3, 4, 5, 6), (2, passage, 1, 2, 3, 4, 5, 6)]
    names = "doc_id long, text string, cuts int, line_dedup int, __lines int, row int, whole int, lines int"
    got = dedup_lines(spark.createDataFrame(rows, names)).orderBy("doc_id").collect()
    assert [tuple(r)[2:8] for r in got] == [(1, 2, 3, 4, 5, 6)] * 2
    assert [r.line_dedup_.removed_lines for r in got] == [0, 1] and [r.text for r in got] == [passage, ""]


def test_query_has_a_row_for_every_document(spark):
    rows = op10_line_chunks(spark, "/root/testdata/sf0.001").collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert {r.doc_id: r.text for r in rows} == brute({i: t or "" for i, t in texts.items()}, MIN_WORDS)
    assert all(r.n_lines == len((texts[r.doc_id] or "").split("\n")) for r in rows)
