"""URL filters: a trie over reversed host labels and path segments; the longest fitting rule decides.

A rule is (verdict, host, path). It fits its host and every subdomain of it, if the url's path starts with
the rule's. Of the fitting rules that with the most host labels wins, then that with the longest path, then
`allow` before `block`; with none, the default verdict holds.

Up to `broadcast_rules` rules the trie is broadcast (at most about 1 KB a rule). More are never broadcast:
each url is expanded to the trie nodes on its way, which are as many as it has labels times segments, and
these meet the rules in a shuffle join.

Defined cases: a null url or one without `://` has an empty host and path and gets the default verdict; no
rules at all give the default; repeated rules count once; further columns of the input stay as they are.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

BROADCAST_RULES = 50_000


def parts(df: DataFrame, url: str = "url") -> DataFrame:
    """Adds host (A-Z lower-cased) and path; both empty for a null url or one without `://`."""
    rest = F.when(F.instr(F.col(url), "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return df.withColumns({"host": F.coalesce(common.ascii_lower(host), F.lit("")), "path": F.coalesce(path, F.lit(""))})


def build_trie(rules: list[tuple[str, str, str]]) -> dict:
    """Nested dicts: host labels from the right; under the key None the whole path segments, and under "" the
    rules whose path ends inside or at the end of the next segment, longest first."""
    trie: dict = {}
    for verdict, host, path in sorted(set(rules)):
        node = trie
        for label in reversed(host.split(".")) if host else ():
            node = node.setdefault(label, {})
        node = node.setdefault(None, {})
        *whole, last = path.split("/")
        for segment in whole:
            node = node.setdefault(segment, {})
        node.setdefault("/", []).append((last, verdict, f"{host}{path}"))
    stack = [trie]
    while stack:
        node = stack.pop()
        for key, child in node.items():
            if isinstance(child, list):
                child.sort(key=lambda r: (-len(r[0]), r[1]))
            else:
                stack.append(child)
    return trie


def longest(trie: dict, host: str, path: str) -> tuple[str | None, str | None]:
    """(rule, verdict) of the longest fitting rule."""
    nodes, node = [trie], trie
    for label in reversed(host.split(".")) if host else ():
        node = node.get(label)
        if node is None:
            break
        nodes.append(node)
    segments = path.split("/")
    for node in reversed(nodes):
        at, best = node.get(None), None
        for depth, segment in enumerate(segments):
            if at is None:
                break
            for last, verdict, rule in at.get("/", ()):
                if segment.startswith(last) or last == "":
                    best = (rule, verdict)
                    break
            at = at.get(segment) if depth + 1 < len(segments) else None
        if best:
            return best
    return None, None


def judge(df: DataFrame, rules: list[tuple[str, str, str]] | DataFrame, default: str = "allow", url: str = "url", broadcast_rules: int = BROADCAST_RULES) -> DataFrame:
    """Adds host, path, rule and verdict to df. rules: (verdict, host, path) tuples, or a DataFrame of them."""
    spark = df.sparkSession
    if not isinstance(rules, DataFrame):
        if len(rules) > broadcast_rules:
            rules = spark.createDataFrame(rules, "verdict string, host string, path string")
    elif rules.limit(broadcast_rules + 1).count() <= broadcast_rules:
        rules = [tuple(r) for r in rules.select("verdict", "host", "path").collect()]
    df = parts(df, url)
    return _by_join(df, rules, default) if isinstance(rules, DataFrame) else _by_trie(df, rules, default)


def _by_trie(df: DataFrame, rules: list[tuple[str, str, str]], default: str) -> DataFrame:
    trie = df.sparkSession.sparkContext.broadcast(build_trie(rules))

    @F.pandas_udf("rule string, verdict string")
    def walk(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        tree = trie.value
        return pd.DataFrame([longest(tree, h, p) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"])

    found = df.withColumn("_found", walk("host", "path"))
    return found.withColumns({"rule": F.col("_found.rule"), "verdict": F.coalesce(F.col("_found.verdict"), F.lit(default))}).drop("_found")


def _by_join(df: DataFrame, rules: DataFrame, default: str) -> DataFrame:
    """The same for any number of rules: a rule sits at the node (host, whole segments of its path)."""
    rules = rules.select("verdict", "host", "path").distinct()
    node = F.regexp_extract("path", r"^(.*/)?", 1)
    rules = rules.select(F.col("host").alias("_host"), node.alias("_node"), F.struct(F.when(F.col("host") == "", 0).otherwise(F.size(F.split("host", r"\."))).alias("labels"), F.length("path").alias("chars"), (F.col("verdict") == "allow").alias("allow"), F.concat("host", "path").alias("rule"), "verdict", "path").alias("_r"))
    urls = df.select("host", "path").distinct()
    labels = F.split("host", r"\.")
    segments = F.split("path", "/")
    hosts = urls.withColumn("_host", F.explode(F.transform(F.sequence(F.lit(1), F.size(labels) + 1), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    nodes = hosts.withColumn("_node", F.explode(F.transform(F.sequence(F.lit(0), F.size(segments) - 1), lambda i: F.when(i > 0, F.concat(F.array_join(F.slice(segments, F.lit(1), i), "/"), F.lit("/"))).otherwise(""))))
    best = nodes.join(rules, ["_host", "_node"]).where("startswith(path, _r.path)").groupBy("host", "path").agg(F.max("_r").alias("_r"))
    out = df.join(best, ["host", "path"], "left")
    return out.select(*df.columns, F.col("_r.rule").alias("rule"), F.coalesce("_r.verdict", F.lit(default)).alias("verdict"))


#: The rules of the query below.
RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op4_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(common.table(spark, sf_dir, "pages").select("page_id", "url"), RULES).select("page_id", "host", "path", "rule", "verdict")


SQL = """
WITH cut AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (VALUES
  ('block', 'com', '/en/'), ('allow', 'example.com', '/en/7'), ('allow', 'net', '/de/'),
  ('block', 'example.net', '/de/8'), ('block', 'org', '/es/')
), hits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS r
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id AND h.r = 1
"""
