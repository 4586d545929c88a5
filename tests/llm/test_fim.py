import hashlib
import random
import re

import pytest

from ledgerlens.llm import fim
from tests.oracle import DATA, connect, spark_rows, sql_rows

TOKEN = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, n long, form long"


def plain(doc_id, text):
    text = text or ""
    tokens = TOKEN.findall(text)
    s = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[i : i + 8], 16) for i in (0, 8, 16, 24)]
    a, b = sorted(x % (len(tokens) + 1) for x in h[:2])
    p, m, z = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= 50:
        return doc_id, len(tokens), "plain", None, None, text
    if h[3] % 100 < 80:
        return doc_id, len(tokens), "spm", len(p), len(m), f"<S>{z}<P>{p}<M>{m}"
    return doc_id, len(tokens), "psm", len(p), len(m), f"<P>{p}<S>{z}<M>{m}"


def texts(seed, n):
    rng = random.Random(seed)
    bits = ["a", "bc", " ", "  ", "\n", "\t", "é", "😀", "\u00a0", "\x0b", "<", "<S", "P>", "x" * 9, "<M"]
    out = ["".join(rng.choice(bits) for _ in range(rng.choice([0, 1, 2, 3, 7, 40, 300]))) for _ in range(n)]
    return [*out, None, "", " ", "  \n", "a", " a", "a ", "x<M>y", "w " * 3000, "y" * 5000, "\n" * 700]


@pytest.mark.parametrize("chunk", [1, 2, 7, 64, 16384])
def test_cuts_match_tokens_at_any_chunk_size(spark, monkeypatch, chunk):
    monkeypatch.setattr(fim, "BLOCK", 3)
    few = texts(chunk, 150 if chunk > 2 else 40)
    rows = [(i, t, -1, -2) for i, t in enumerate(few) if chunk > 2 or len(t or "") < 400]
    rows += [(None, "a b c", 0, 0), (None, None, 0, 0), rows[3], rows[3], (10**15, "a " * 40, 0, 0), (10**15, "b " * 40, 0, 0)]
    out = fim.transform(spark.createDataFrame(rows, SCHEMA).repartition(3), chunk=chunk)
    got = [tuple(r) for r in out.collect()]
    assert sorted(got, key=repr) == sorted((plain(i, t) for i, t, *_ in rows), key=repr)
    back = out.select("output", fim.restored(out.output, out.form).alias("text"), "doc_id").collect()
    assert sorted((r.doc_id or -1, r.text) for r in back) == sorted((i or -1, t or "") for i, t, *_ in rows)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_no_texts(spark):
    assert fim.transform(spark.createDataFrame([], SCHEMA)).count() == 0


def test_plan_has_no_python_and_moves_long_texts_only(spark):
    plan = fim.op13_chunked_fim(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    short = plan.index("Union"), plan.index("Join")
    assert short[0] < short[1]


def test_query_equals_sql(spark):
    assert spark_rows(fim.op13_chunked_fim(spark, DATA)) == sql_rows(connect(), fim.SQL)
