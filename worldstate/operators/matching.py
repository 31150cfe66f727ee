"""Joins in time: as-of, nearest with tolerance, interval; anti joins against history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def as_of_join(left: DataFrame, right: DataFrame, key: list[str], at: str, values: list[str]) -> DataFrame:
    """For each row of left, right's latest row of the key with right.at <= left.at.

    Both sides go through one shuffle and one sort of their union; nothing is joined by range.
    """
    mine = left.select(*left.columns, *(F.lit(None).cast(right.schema[v].dataType).alias(f"_{v}") for v in values), F.lit(None).cast(right.schema[at].dataType).alias("_at"), F.lit(1).alias("_side"))
    other = right.select(*(F.col(c) if c in [*key, at] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), *(F.col(v).alias(f"_{v}") for v in values), F.col(at).alias("_at"), F.lit(0).alias("_side"))
    order = Window.partitionBy(*key).orderBy(at, "_side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = mine.unionByName(other).withColumns({f"matched_{v}": F.last(f"_{v}", True).over(order) for v in values} | {"matched_at": F.last("_at", True).over(order)})
    return both.where("_side = 1").select(*left.columns, *(f"matched_{v}" for v in values), "matched_at")


def nearest_join(left: DataFrame, right: DataFrame, key: list[str], at: str, tolerance_us: int) -> DataFrame:
    """matched_at: right's nearest time of the key within the tolerance, the earlier of two; at is in microseconds."""
    mine = left.withColumns({"_at": F.lit(None).cast("long"), "_side": F.lit(1)})
    other = right.select(*(F.col(c) if c in [*key, at] else F.lit(None).cast(left.schema[c].dataType).alias(c) for c in left.columns), F.col(at).alias("_at"), F.lit(0).alias("_side"))
    order = Window.partitionBy(*key).orderBy(at, "_side")
    both = mine.unionByName(other)
    both = both.withColumns({"_before": F.last("_at", True).over(order.rowsBetween(Window.unboundedPreceding, 0)), "_after": F.first("_at", True).over(order.rowsBetween(0, Window.unboundedFollowing))})
    back, ahead = F.col(at) - F.col("_before"), F.col("_after") - F.col(at)
    best = F.when(back.isNotNull() & (ahead.isNull() | (back <= ahead)), F.col("_before")).otherwise(F.col("_after"))
    out = both.where("_side = 1").withColumn("matched_at", best)
    return out.withColumn("matched_at", F.when(F.abs(F.col("matched_at") - F.col(at)) <= tolerance_us, F.col("matched_at"))).select(*left.columns, "matched_at")


def interval_join(left: DataFrame, right: DataFrame, key: list[str], left_at: str, right_at: str, before: int, after: int) -> DataFrame:
    """Pairs of a key with right.at in [left.at - before, left.at + after].

    Times are cut into cells as wide as the interval; each right row falls into one cell and each left row asks
    two, so a busy key is spread over its cells.
    """
    width = before + after
    asking = left.withColumn("_cell", F.explode(F.array_distinct(F.array(F.floor((F.col(left_at) - before) / width), F.floor((F.col(left_at) + after) / width)))))
    placed = right.withColumn("_cell", F.floor(F.col(right_at) / width))
    return asking.join(placed, [*key, "_cell"]).where((F.col(right_at) >= F.col(left_at) - before) & (F.col(right_at) <= F.col(left_at) + after)).drop("_cell")


def unseen(df: DataFrame, history: DataFrame, key: list[str]) -> DataFrame:
    """Rows whose key is not in the history."""
    return df.join(history.select(*key).distinct(), key, "left_anti")


def keep_first(df: DataFrame, key: list[str], order: list[str | Column]) -> DataFrame:
    """Dedup that keeps the first row of each key in order, by partial aggregation."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("r")).select(*key, *(F.col(f"r.{c}").alias(c) for c in rest))
