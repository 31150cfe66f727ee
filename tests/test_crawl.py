"""Crawl rules: the whole target, hosts' own rules, files that are missing."""

from pyspark.sql import functions as F

from worldstate.operators import crawl


def test_rules(spark):
    rules = [("a", "/en/", False), ("a", "/en/open", True), ("a", "/*?a=", False), ("a", "/x$", False), ("a", "/same", False), ("a", "/same", True), ("a", "", False), ("b", "/", False), ("c", "/", False), ("d", "/", True), ("e", "/", True), ("a", "/p.f", False)]
    urls = {
        "http://a/en/": False, "http://a/en": True, "http://a/en/open/1": True, "http://a/q?a=1": False, "http://a/q?b=1": True, "http://a/x": False, "http://a/xy": True, "http://a/x?y": True, "http://a/same/1": True, "http://a": True,
        "http://a#/en/": True, "http://a/pdf": True, "http://a/p.f": False, "http://b/": False, "http://b?q": False, "http://c/any": True, "http://d/any": False, "http://e/any": False, "http://f/any": True, "nothing": True, None: True,
    }
    asked = spark.createDataFrame([*enumerate(urls)], "page_id long, url string").select("page_id", F.regexp_extract("url", "//([^/?#]*)", 1).alias("host"), crawl.target_of(F.col("url")).alias("target"))
    fetched = spark.createDataFrame([("a", 200), ("a", 200), ("c", 404), ("d", 503), ("e", None)], "host string, status int")
    table = spark.createDataFrame(rules + rules[:2], "host string, rule string, allow boolean").repartition(9)
    got = {r.page_id: r.allowed for r in crawl.allowed(asked.repartition(7), table, fetched).collect()}
    assert got == dict(enumerate(urls.values()))
    assert crawl.allowed(asked.limit(0), table, fetched).count() == 0
