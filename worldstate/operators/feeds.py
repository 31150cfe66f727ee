"""Feeds: newest rows of a key, related rows, previous rows, neighbours in a graph, merges of rows into a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def newest(df: DataFrame, key: list[str], order: list[Column], n: int) -> DataFrame:
    """The first n rows of each key in order, with their place."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*key).orderBy(*order)).cast("long")).where(F.col("place") <= n)


def related(df: DataFrame, key: list[str], id_col: str, at: str, days: int | None, n: int, among: Column | None = None) -> DataFrame:
    """id, other, place: the n newest others of a row's key, none older than `days` before it (None: however old); at is in days.

    among: which rows can be others. A null key part equals a null; ties go to the larger id. Of a key only its n + 1 newest can be
    anyone's answer, so those alone meet its rows: one top-k, one join, no pairs.
    """
    others = df if among is None else df.where(among)
    top = newest(others.where(F.col(id_col).isNotNull() & F.col(at).isNotNull()), key, [F.desc(at), F.desc(id_col)], n + 1)
    top = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("place", F.col(id_col).alias("id"), F.col(at).alias("at")))).alias("_top")).select(*(F.col(k).alias(f"_{k}") for k in key), "_top")
    own = df.select(*key, F.col(id_col).alias("_id"), F.col(at).alias("_at"))
    same = F.lit(True)
    for k in key:
        same &= F.col(k).eqNullSafe(F.col(f"_{k}"))
    fits = F.filter("_top", lambda x: (x["id"] != F.col("_id")) & (F.lit(True) if days is None else x["at"] >= F.col("_at") - days))
    met = own.join(top, same).select(F.col("_id").alias("id"), F.posexplode(F.slice(fits, 1, n)).alias("_k", "x"))
    return met.select("id", F.col("x.id").alias("other"), (F.col("_k") + 1).cast("long").alias("place"))


def previous(df: DataFrame, key: list[str], order: list[str], value: str, accepted: Column) -> DataFrame:
    """df with previous: the value of the key's last accepted row strictly before."""
    before = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn("previous", F.last(F.when(accepted, F.col(value)), True).over(before))


def one_hop(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, neighbour, direction of each node's edges (a, b), in both directions; nodes: node."""
    out = edges.join(nodes.withColumnRenamed("node", "a"), "a").select(F.col("a").alias("node"), F.col("b").alias("neighbour"), F.lit("out").alias("direction"))
    into = edges.join(nodes.withColumnRenamed("node", "b"), "b").select(F.col("b").alias("node"), F.col("a").alias("neighbour"), F.lit("in").alias("direction"))
    return out.unionByName(into)


def upsert(table: DataFrame, rows: DataFrame, key: list[str], sets: list[str], keep_if_empty: list[str]) -> DataFrame:
    """table with rows merged in by key: arrays in `sets` become sorted unions, `keep_if_empty` keep an old text where the new one is empty, all else is overwritten.

    rows has one row a key.
    """
    rest = [c for c in table.columns if c not in key]
    new = rows.select(*key, *(F.col(c).alias(f"_{c}") for c in rest), F.lit(True).alias("_new"))
    met = table.withColumn("_old", F.lit(True)).join(new, key, "full")
    value = {}
    for c in rest:
        old, fresh = F.col(c), F.col(f"_{c}")
        if c in sets:
            value[c] = F.array_sort(F.array_union(F.coalesce(old, F.array().cast("array<string>")), F.coalesce(fresh, F.array().cast("array<string>"))))
        elif c in keep_if_empty:
            value[c] = F.when(F.col("_new") & (F.coalesce(fresh, F.lit("")) != ""), fresh).otherwise(old)
        else:
            value[c] = F.when(F.col("_new"), fresh).otherwise(old)
    return met.select(*key, *(v.alias(c) for c, v in value.items()))


def insert_absent(table: DataFrame, rows: DataFrame, key: list[str]) -> DataFrame:
    """table and those rows whose key is not there, one of each key; both have the same columns."""
    from .matching import keep_first

    fresh = keep_first(rows, key, [c for c in rows.columns if c not in key] or key)
    return table.unionByName(fresh.join(table.select(*key), key, "left_anti").select(*table.columns))


def touch(table: DataFrame, rows: DataFrame, key: list[str], at: str) -> DataFrame:
    """Rows by key with the first and last time they were seen; table: key, first_seen, last_seen; rows: key, at."""
    seen = table.unionByName(rows.select(*key, F.col(at).alias("first_seen"), F.col(at).alias("last_seen")))
    return seen.groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))
