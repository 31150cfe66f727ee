"""Which pages their hosts' crawl rules let be read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import pages


def target_of(url: Column) -> Column:
    """What a request asks a host for: path and query, without fragment; / where there is no path."""
    rest = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^#]*)", 1)
    return F.when(F.startswith(rest, F.lit("/")), rest).otherwise(F.concat(F.lit("/"), rest))


def allowed(asked: DataFrame, rules: DataFrame, fetched: DataFrame, id_col: str = "page_id") -> DataFrame:
    """id and allowed for each id of asked (id, host, target); rules: host, rule, allow; fetched: host, status of its rules' file.

    The longest rule that fits the target's beginning decides, of equally long ones that which allows; no rule, no ban. A file that isn't there (4xx)
    allows all, one that can't be had (5xx, or a null status) nothing. A host that fetched doesn't know is judged by its rules, an empty
    or null host has none. An empty rule bans nothing. Hot hosts are split by Spark's skew join: a page meets its host's rules only.
    """
    patterns = rules.where("rule <> ''").select("host", "rule", "allow").distinct().withColumn("pattern", pages.rule_pattern(F.col("rule")))
    states = fetched.groupBy("host").agg(F.max_by("status", F.col("status").isNotNull()).alias("status")).withColumn("known", F.lit(True))
    met = asked.select(id_col, "host", "target").join(patterns, "host", "left").join(states, "host", "left")
    fits = met.withColumn("fits", F.coalesce(F.regexp_like("target", F.col("pattern")), F.lit(False)))
    best = F.max_by("allow", F.when(F.col("fits"), F.struct(F.length("rule"), "allow")))
    found = fits.groupBy(id_col).agg(F.coalesce(F.when(F.max("fits"), best), F.lit(True)).alias("by_rule"), F.max("known").alias("known"), F.max("status").alias("status"))
    verdict = F.when(F.col("known") & F.col("status").between(400, 499), True).when(F.col("known") & (F.col("status").isNull() | (F.col("status") >= 500)), False).otherwise(F.col("by_rule"))
    return found.select(id_col, verdict.alias("allowed"))
