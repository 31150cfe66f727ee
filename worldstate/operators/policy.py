"""Policies: areas and learned rules folded into thresholds, feedback turned into rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import levels

#: The scales, and the threshold that an area's importance starts with.
MATERIALITY = ["none", "low", "medium", "high", "critical"]
IMPORTANCE = ["low", "medium", "high", "critical"]
BASE_THRESHOLD = {"critical": "low", "high": "medium", "medium": "medium", "low": "high"}
#: Fixed value: signals of one kind before a threshold rises.
SIGNALS_NEEDED = 2


def base_threshold(importance: Column) -> Column:
    pairs = [F.lit(x) for pair in BASE_THRESHOLD.items() for x in pair]
    return F.element_at(F.create_map(*pairs), importance)


def effective_areas(areas: DataFrame, rules: DataFrame) -> DataFrame:
    """area, effective_importance, threshold: the last active rule of an area decides its importance.

    areas: area, importance; rules: kind, area, importance, created, active.
    """
    last = rules.where("active and kind = 'area_importance'").groupBy("area").agg(F.max_by("importance", "created").alias("_set"))
    own = levels.coerce(F.col("importance"), "medium", IMPORTANCE)
    out = areas.join(last, "area", "left").withColumn("effective_importance", levels.coerce(F.col("_set"), own, IMPORTANCE))
    return out.select("area", "effective_importance", base_threshold(F.col("effective_importance")).alias("threshold"))


def type_thresholds(rules: DataFrame) -> DataFrame:
    """area, event_type ('*': any), raised: the last active threshold rule of each."""
    found = rules.where("active and kind = 'materiality_threshold'").withColumns({"area": F.coalesce("area", F.lit("*")), "event_type": F.coalesce("event_type", F.lit("*"))})
    last = found.groupBy("area", "event_type").agg(F.max_by("threshold", "created").alias("raised"))
    return last.withColumn("raised", levels.coerce(F.col("raised"), F.lit("medium"), MATERIALITY))


def with_threshold(items: DataFrame, areas: DataFrame, thresholds: DataFrame) -> DataFrame:
    """items (area, event_type, materiality) with threshold and material: rules of the area's type or of the area only raise."""
    exact = thresholds.withColumnRenamed("raised", "_exact")
    any_ = thresholds.where("event_type = '*'").select("area", F.col("raised").alias("_any"))
    met = items.join(areas, "area", "left").join(exact, ["area", "event_type"], "left").join(any_, "area", "left")
    rank = lambda c: levels.rank(F.col(c), MATERIALITY)
    most = F.greatest(levels.rank(F.coalesce("threshold", F.lit("medium")), MATERIALITY), rank("_exact"), rank("_any"))
    met = met.withColumn("threshold", F.element_at(F.array(*map(F.lit, MATERIALITY)), most + 1))
    material = F.coalesce(F.col("materiality") != "none", F.lit(False)) & (rank("materiality") >= most)
    return met.withColumn("material", material).drop("_exact", "_any")


def feedback_rule(reason: Column, prior: Column, threshold: Column, importance: Column, independent: Column, primary: Column) -> Column:
    """The rule that a piece of feedback asks for, as kind:effect; null for none. independent, primary: numbers of publishers."""
    stepped, lowered = levels.step(threshold, 1, MATERIALITY), levels.step(importance, -1, IMPORTANCE)
    return (
        F.when((reason == "too_minor") & (prior + 1 >= SIGNALS_NEEDED) & (stepped != threshold), F.concat(F.lit("materiality_threshold:"), stepped))
        .when((reason == "not_our_area") & (lowered != importance), F.concat(F.lit("area_importance:"), lowered))
        .when((reason == "always_urgent") & (importance != "critical"), F.lit("area_importance:critical"))
        .when((reason == "inaccurate") & (primary == 0) & (independent == 1), F.lit("publisher_trust:distrusted"))
        .when(reason == "wrong_entity", F.lit("entity_exclusion:example"))
    )


def prior_signals(feedback: DataFrame, key: list[str], at: str, days: int = 60) -> DataFrame:
    """feedback with prior: equal signals of the key in the days before, itself excluded; at is in days."""
    from pyspark.sql.window import Window

    span = Window.partitionBy(*key).orderBy(at).rangeBetween(-days, 0)
    return feedback.withColumn("prior", F.count("*").over(span) - 1)


def merged_rules(proposals: DataFrame) -> DataFrame:
    """One rule of each kind and scope: the latest effect, and how much evidence it has. proposals: kind, scope, effect, created."""
    return proposals.groupBy("kind", "scope").agg(F.max_by("effect", "created").alias("effect"), F.count("*").alias("evidence_count"))
