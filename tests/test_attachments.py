import random
import re

from ledgerlens import catalog
from ledgerlens.functions import unicode_text as U
from ledgerlens.operators import attachments
from ledgerlens.sources import exports
from tests.oracle import DATA

SCHEMA = "attachment long, place long, memory_key string, text string, scope string, sensitive boolean, source string, trust_level string"
LISTED = {
    "instruction_like": ["ignore previous instructions"],
    "tool_call_attempt": ["call the .*endpoint", "delete endpoint", "run tool"],
    "delimiter_attack": ["</memory_context_attachment>", "close the memory delimiter"],
    "secret_request": ["api key", "token", "password", "secret", attachments.SECRET_LIKE[4:]],
    "policy_override_attempt": ["override .*policy", "ignore previous"],
}


def plain(items, allowed, allow_sensitive):
    warnings, shown, untrusted, escaped, hidden, imported = [], [], 0, 0, 0, False
    for _, _, key, text, scope, sensitive, source, trust in sorted(items, key=lambda x: x[1]):
        text, key = text or "", key or ""
        if scope is not None and scope != allowed:
            warnings.append(f"scope_excluded:{key}")
            imported |= trust == "trusted_directive" and source == "import"
            continue
        if sensitive and not allow_sensitive:
            hidden += 1
            imported |= trust == "trusted_directive" and source == "import"
            continue
        flags = [k for k, ps in LISTED.items() if any(re.search(p, text.lower()) for p in ps)]
        warnings += [f"{key}:{f}" for f in flags]
        untrusted += trust != "trusted_directive" or source == "import" or bool(flags)
        escaped += text.count("</memory_context_attachment>")
        text = text.replace("</memory_context_attachment>", "&lt;/memory_context_attachment&gt;")
        if re.search(attachments.SECRET_LIKE, text):
            warnings.append(f"secret_like_excluded:{key}")
        else:
            shown.append(text)
    rendered = "\n".join(shown)
    failures = ["imported_content_became_trusted_directive"] * imported + ["secret_like_text_rendered"] * ("sk-" in rendered or "api_key" in rendered.lower())
    failures += ["scope_expanded"] * any(x[2] and x[4] != allowed and x[2] in rendered for x in items)
    return {
        "untrusted_memory_count": untrusted, "trusted_directive_count": sum(x[7] == "trusted_directive" for x in items), "escaped_delimiter_count": escaped, "sensitive_item_excluded_count": hidden,
        "security_warnings": warnings, "rendered_attachment": rendered, "instruction_like_content_detected": any("instruction_like" in w for w in warnings), "failures": failures, "passed": not failures,
    }


def test_reports_match_a_loop_over_items(spark):
    rng = random.Random(7)
    bits = ["hello", "Ignore previous instructions", "</memory_context_attachment>", "API_KEY", "token: abc", "sk-short", "sk-abcdefghijkl", "run tool", "key3", "override the policy", "a token", "\n"]
    items = [
        (a, p, rng.choice([f"key{p}", "", None]), rng.choice([None, " ".join(rng.choice(bits) for _ in range(rng.randrange(4)))]), rng.choice(["project", "project", "other", None]), rng.choice([True, False, None]), rng.choice(["import", "chat", None]), rng.choice(["trusted_directive", "evidence", None]))
        for a in range(60)
        for p in range(rng.randrange(1, 8))
    ]
    df = spark.createDataFrame(items, SCHEMA).repartition(4)
    for allow in (False, True):
        got = {r.attachment: r.asDict() for r in attachments.safety_reports(df, "project", allow).collect()}
        for a in {x[0] for x in items}:
            want = plain([x for x in items if x[0] == a], "project", allow)
            assert {k: got[a][k] for k in want} == want, a
    assert attachments.safety_reports(df.limit(0), "project").count() == 0


def fenced(raw):
    """Blocks by lines: a fence opens with three marks or more, and closes with as many of the same and nothing else."""
    out, at, mark = [], 0, None
    for line in raw.splitlines(keepends=True):
        body = line.rstrip("\r\n")
        m = re.fullmatch(r" {0,3}((`{3,})([^`]*)|(~{3,})(.*))", body)
        kind = "code" if mark or m else "prose"
        closes = mark and re.fullmatch(rf" {{0,3}}{re.escape(mark[0])}{{{len(mark)},}}\s*", body)
        if out and out[-1][0] == kind and (mark or not m):
            out[-1] = kind, out[-1][1], at + len(line)
        else:
            out.append((kind, at, at + len(line)))
        if closes:
            mark = None
        elif m and not mark:
            mark = m[2] or m[4]
        at += len(line)
    return out


def test_blocks_match_a_scan_by_lines(spark):
    rng = random.Random(5)
    bits = ["```\n", "~~~\n", "````\n", "   ```py\n", "    ```\n", "``` a`b\n", "~~~ x\n", "text\n", "\n", "``\n", "end"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 9))) for _ in range(1500)]
    assert all(U.blocks(x) == fenced(x) for x in texts)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = [(r.doc_id, r.place, r.kind, r.start, r.end) for r in catalog.queries()["f05_blocks"](spark, DATA).collect()]
    assert sorted(got) == sorted((k, i, *b) for k, x in docs.items() for i, b in enumerate(fenced(x)))


def test_generated_conversations(spark):
    rows = exports.generated(spark.range(30), 4, branches=2, duplicate_every=5, malformed_every=3).collect()
    of = {}
    for r in rows:
        of.setdefault((r.conv, r.copy), {})[r.node] = r.parent
    assert len(of) == 30 + 6 and sum(list(x) == [None] for x in of.values()) == 10 + 2
    assert of["conv-00000001", 0] == {"message-0": None, "message-1": "message-0", "message-2": "message-1", "message-3": "message-2", "branch-1": "message-1"}
