"""Dated versions of facts: current, first and last change, trail, as-of."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def changes(obs: DataFrame, fact: list[str], at: str, tie: str, key: str) -> DataFrame:
    """Adds is_change: the value differs from the fact's former one; false for the first."""
    before = F.lag(key).over(Window.partitionBy(*fact).orderBy(at, tie))
    return obs.withColumn("is_change", F.coalesce(F.col(key) != before, F.lit(False)))


def summary(obs: DataFrame, fact: list[str], at: str, tie: str, key: str) -> DataFrame:
    """Per fact: current value, first_seen, last_changed (null if it never did), n_versions, n_changes."""
    return (
        changes(obs, fact, at, tie, key)
        .groupBy(*fact)
        .agg(
            F.max_by(key, F.struct(at, tie)).alias("current"),
            F.min(at).alias("first_seen"),
            F.max(F.when(F.col("is_change"), F.col(at))).alias("last_changed"),
            F.count("*").alias("n_versions"),
            F.count_if("is_change").alias("n_changes"),
        )
    )


def trail(obs: DataFrame, fact: list[str], at: str, tie: str, key: str) -> DataFrame:
    """The first version of each run of equal values, numbered within its fact; as rows, so that no fact has to fit in one."""
    order = Window.partitionBy(*fact).orderBy(at, tie)
    marked = changes(obs, fact, at, tie, key).withColumn("first", F.row_number().over(order) == 1)
    return marked.where("first or is_change").withColumn("step", F.row_number().over(order)).select(*fact, "step", F.col(key).alias("value"), F.col(at).alias("since"))


def as_of(obs: DataFrame, fact: list[str], at: str, tie: str, key: str, when: Column) -> DataFrame:
    """The value current at a time: partial aggregation, no window."""
    return obs.where(F.col(at) <= when).groupBy(*fact).agg(F.max_by(key, F.struct(at, tie)).alias("value"), F.max(at).alias("since"))


def last_n(obs: DataFrame, fact: list[str], at: str, tie: str, n: int) -> DataFrame:
    newest = Window.partitionBy(*fact).orderBy(F.desc(at), F.desc(tie))
    return obs.withColumn("nth", F.row_number().over(newest)).where(F.col("nth") <= n)


def latest(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row of each key that comes last in order, by partial aggregation."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))


def first_per_month(df: DataFrame, key: list[str], at: str, tie: str) -> DataFrame:
    month = F.date_trunc("month", at).cast("date").alias("month")
    return df.groupBy(*key, month).agg(F.min(F.struct(at, tie)).alias("r")).select(*key, "month", F.col(f"r.{at}").alias(at), F.col(f"r.{tie}").alias(tie))
