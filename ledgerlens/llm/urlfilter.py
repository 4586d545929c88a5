"""URL filters by a sort-merge range join of hosts and rules, with DataFrame functions only.

A rule is a host and a path prefix. A host's key is its labels in reverse, each with a point after it, so that a host and
all its subdomains are the keys of one interval: ``example.net`` is ``[net.example., net.example/)`` ("/" comes next after
"."). Two such intervals are nested or apart.

Pages are first reduced to distinct hosts, so a host of any number of pages is one row of the sweep. Hosts are dealt by
ranges of keys. A rule goes to the ranges that its interval meets; a range that begins inside an interval gets the rule as
one that was opened before. Each range is swept in key order: a running sum of openings and closings is the height of the
stack of active rules, and the last opening at each height is what lies there. The rules of the stack then go to the pages
of the host (where Spark splits a host that has many), and of those whose path fits, the longest wins.

Ranges are at most as many as a shuffle has partitions, so their table of bounds is broadcast; its size does not depend on
the data. The path rules of one rule host travel as one array.

Edge cases: a null url, or one without ``://``, has an empty host and path; no rule fits an empty host; a rule with a null
or empty host or a null path fits nothing; of rules with equal host and path "block" wins; equal rows give equal rows;
equally long rules (``a.b`` + ``/x`` and ``b`` + ``/x/y``) are told apart by the longer host. Other columns of pages
are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import saved, table

#: The rules of the query as (verdict, host, path), and the verdict of a url that no rule fits.
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
DEFAULT = "allow"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PARTS = r"://([^/?#]*)([^?#]*)"
#: What happens at equal keys, in this order.
CLOSE, OPEN, HOST = 0, 1, 2


def host_of(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, PARTS, 1), F.lit("")), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PARTS, 2), F.lit(""))


def key_of(host: Column) -> Column:
    """``blog.example.net`` as ``net.example.blog.``"""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def intervals(rules: DataFrame) -> DataFrame:
    """host, lo, hi (the first key beyond) and paths (path, verdict) of every rule host."""
    host = F.translate(F.col("host"), UPPER, LOWER)
    known = rules.select(host.alias("host"), "path", "verdict").where((F.col("host") != "") & F.col("path").isNotNull())
    one = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" comes after "allow"
    paths = F.collect_list(F.struct("path", "verdict")).alias("paths")
    return one.groupBy("host").agg(paths).withColumn("lo", key_of(F.col("host"))).withColumn("hi", F.concat(F.expr("left(lo, length(lo) - 1)"), F.lit("/")))


def active(hosts: DataFrame, rules: DataFrame) -> DataFrame:
    """host and stack (host, paths; the outermost first) of every host inside some rule's interval."""
    spark = hosts.sparkSession
    known = intervals(rules)
    deepest = known.agg(F.max(F.size(F.split("host", r"\.", -1)))).first()[0] or 0
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = hosts.where("host != ''").select("host", key_of(F.col("host")).alias("key")).distinct()
    dealt = saved(keys.repartitionByRange(n, "key").withColumn("part", F.spark_partition_id()), "url-hosts")
    bounds = dealt.groupBy("part").agg(F.min("key").alias("least"), F.max("key").alias("most"))
    met = known.join(F.broadcast(bounds), (F.col("lo") <= F.col("most")) & (F.col("hi") > F.col("least")))
    rule = F.struct("host", "paths")
    turns = F.array(F.struct(F.col("lo").alias("key"), F.lit(OPEN).alias("kind"), rule.alias("rule")), F.struct(F.col("hi").alias("key"), F.lit(CLOSE).alias("kind"), rule.alias("rule")))
    edges = met.select("part", F.explode(turns).alias("t")).select("part", "t.key", "t.kind", "t.rule", F.lit(None).cast("string").alias("host"))
    events = edges.unionByName(dealt.select("part", "key", F.lit(HOST).alias("kind"), "host"), allowMissingColumns=True)
    order = Window.partitionBy("part").orderBy("key", "kind")
    step = F.when(F.col("kind") == OPEN, 1).when(F.col("kind") == CLOSE, -1).otherwise(0)
    height = events.withColumn("height", F.sum(step).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    at = [F.last(F.when((F.col("kind") == OPEN) & (F.col("height") == d), F.col("rule")), ignorenulls=True).over(upto).alias(f"at{d}") for d in range(1, deepest + 1)]
    swept = height.select("host", "kind", "height", *at).where((F.col("kind") == HOST) & (F.col("height") > 0))
    stack = F.slice(F.array(*(f"at{d}" for d in range(1, deepest + 1))), F.lit(1), F.col("height").cast("int")) if deepest else F.array().cast("array<struct<host:string,paths:array<struct<path:string,verdict:string>>>>")
    return swept.select("host", stack.alias("stack"))


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT) -> DataFrame:
    """page_id, host, path, rule (host and path, or null) and verdict of every row of pages (page_id, url)."""
    url = F.col("url").cast("string")
    urls = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    found = urls.join(active(urls.select("host"), rules), "host", "left")
    fits = F.flatten(
        F.transform(
            "stack",
            lambda level: F.transform(
                F.filter(level["paths"], lambda p: F.startswith(F.col("path"), p["path"])),
                lambda p: F.struct((F.length(level["host"]) + F.length(p["path"])).alias("size"), F.length(level["host"]).alias("own"), F.concat(level["host"], p["path"]).alias("rule"), p["verdict"].alias("verdict")),
            ),
        )
    )
    best = found.withColumn("best", F.array_max(fits))
    return best.select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))


def op11_url_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages"), spark.createDataFrame(RULES, "verdict string, host string, path string"))


SQL = r"""
WITH u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path, (SELECT max_by(rhost || rpath, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT max_by(verdict, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM u"""
