"""Registrable domains by a table of public suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rules of a file in the public suffix list's format: one a line up to the first white space; // begins a comment."""
    return spark.read.text(path).select(F.regexp_extract("value", r"^\s*(\S*)", 1).alias("rule")).where("rule <> '' and not startswith(rule, '//')")


def registrable(df: DataFrame, rules: DataFrame, host: str = "host") -> DataFrame:
    """df with registrable_domain: the host's public suffix and one label more; hosts that have no suffix, or are one, stay as they are.

    rules: a column rule, as in `com`, `co.uk`, `*.ck` (each label below ck is a suffix, too) and `!www.ck` (but this isn't). Of
    the rules that fit a host an exception counts first, then the longest. Rules are a table, however long: each different host
    asks for its endings, one for every label, in an equi-join. Nulls stay null; hosts are taken as lower-case, without a last dot.
    """
    known = rules.select(F.lower(F.trim("rule")).alias("_rule")).where("_rule <> ''").distinct()
    exception, wild = F.startswith("_rule", F.lit("!")), F.startswith("_rule", F.lit("*."))
    known = known.select(F.regexp_replace("_rule", r"^(!|\*\.)", "").alias("_end"), exception.alias("_exception"), F.when(exception, -1).when(wild, 1).otherwise(0).alias("_more"))
    hosts = df.select(F.col(host).alias("_host")).where("_host is not null").distinct()
    labels = hosts.withColumn("_labels", F.split(F.regexp_replace(F.lower("_host"), r"\.$", ""), r"\."))
    ends = text.bound(F.col("_labels"), lambda x: F.transform(F.sequence(F.lit(1), F.size(x)), lambda k: F.array_join(F.slice(x, F.size(x) - k + 1, k), ".")))
    fits = labels.select("_host", F.size("_labels").alias("_n"), F.posexplode(ends).alias("_at", "_end")).join(known, "_end").withColumn("_k", F.col("_at") + 1 + F.col("_more")).where("_k <= _n")
    best = fits.groupBy("_host").agg(F.max(F.struct("_exception", "_k"))["_k"].alias("_k"))
    found = best.join(labels, "_host").where(F.size("_labels") > F.col("_k")).select("_host", F.array_join(F.slice("_labels", F.size("_labels") - F.col("_k"), F.col("_k") + 1), ".").alias("registrable_domain"))
    return df.join(found, F.col(host) == F.col("_host"), "left").select(*df.columns, F.coalesce("registrable_domain", host).alias("registrable_domain"))
