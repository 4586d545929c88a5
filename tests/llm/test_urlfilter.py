import random
import re

from ledgerlens.llm import urlfilter
from tests.oracle import DATA, connect, spark_rows, sql_rows

RULES = "verdict string, host string, path string, host_note string"
PAGES = "page_id long, url string, host string, path string, verdict string"


def plain(url, rules, default="allow"):
    m = re.search(r"://([^/?#]*)([^?#]*)", url or "")
    host, path = (re.sub("[A-Z]", lambda x: x[0].lower(), m[1]), m[2]) if m else ("", "")
    best = None
    for verdict, rh, rp, _ in rules:
        if not rh or rp is None:
            continue
        rh = rh.lower()
        if (host == rh or host.endswith("." + rh)) and path.startswith(rp):
            best = max(best or (), (len(rh) + len(rp), len(rh), rh + rp, verdict))
    return host, path, best and best[2], best[3] if best else default


def urls(rng, n):
    labels = ["net", "com", "example", "a", "b", "a-b", "Example", "ne", "nett", "", "xn--é", "a" * 300]
    paths = ["", "/", "/en/", "/en", "/en/x", "/de/", "/EN/", "//", "/en/x?q=://net/", "#/en/", "?/en/"]
    made = [f"{rng.choice(['http', 'HTTPS', ''])}://{'.'.join(rng.choice(labels) for _ in range(rng.randrange(0, 5)))}{rng.choice(paths)}" for _ in range(n)]
    return [*made, None, "", "net/", "://", "http://net", "http://net/", "http://user@net:80/x", "http://a.net./", "x://y://net/", "http://NET/" + "z" * 50000]


def rules(rng, n):
    hosts = ["net", "com", "example.net", "a.example.net", "b.a.example.net", "example.com", "a-b.net", "NET", "a.com", "", None, "b.example.com"]
    return [(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(["/", "", "/en/", "/en/x", "/de/", None]), "x") for _ in range(n)]


def test_sweep_matches_brute_force(spark):
    rng = random.Random(5)
    for known in (rules(rng, 3), rules(rng, 12), rules(rng, 40)):
        rows = [(i, u, "clash", "clash", "clash") for i, u in enumerate(urls(rng, 400))]
        rows += [rows[7], rows[7], (None, "http://b.net/en/", "", "", "")] + [(10**6 + i, "http://hot.example.net/en/x", "", "", "") for i in range(300)]
        got = urlfilter.judge(spark.createDataFrame(rows, PAGES).repartition(6), spark.createDataFrame(known, RULES))
        assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr((r[0], *plain(r[1], known))) for r in rows)


def test_ranges_begin_inside_intervals(spark):
    """Many hosts under few rules: the ranges after the first get rules that were opened before them."""
    rows = [(i, f"http://h{i:05d}.s{i % 7}.example.net/en/", "", "", "") for i in range(3000)]
    known = [("block", "net", "/", ""), ("allow", "s3.example.net", "/en/", ""), ("block", "h00010.s3.example.net", "/en/", "")]
    got = urlfilter.judge(spark.createDataFrame(rows, PAGES), spark.createDataFrame(known, RULES)).collect()
    assert sorted((r.page_id, r.rule, r.verdict) for r in got) == sorted((r[0], *plain(r[1], known)[2:]) for r in rows)


def test_nothing(spark):
    none = spark.createDataFrame([], PAGES)
    some = spark.createDataFrame([(1, "http://a.net/", "", "", "")], PAGES)
    assert urlfilter.judge(none, spark.createDataFrame([("block", "net", "/", "")], RULES)).count() == 0
    assert [tuple(r) for r in urlfilter.judge(some, spark.createDataFrame([], RULES), default="block").collect()] == [(1, "a.net", "/", None, "block")]


def test_plan_has_no_python(spark):
    plan = urlfilter.op11_url_sweep(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cross" not in plan


def test_query_equals_sql(spark):
    assert spark_rows(urlfilter.op11_url_sweep(spark, DATA)) == sql_rows(connect(), urlfilter.SQL)
