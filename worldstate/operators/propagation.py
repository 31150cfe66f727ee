"""Statuses of claims carried on to their events and the events' reports, with notices of those that have come into conflict."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def refreshed(assessed: DataFrame, reports: DataFrame) -> DataFrame:
    """Assessments in order with what each made of its event's report: old_status, and whether it became conflicting by it.

    assessed: claim_id, event_id, at, status, summary; every assessment of a claim is its event's new status. reports: report_id, event_id,
    evidence_status, is_historical, teams (array), one at most an event. Equal times are in order of claim_id, then status.
    The status before an event's first assessment is its report's. Assessments of events without a report have a null report_id.
    """
    order = Window.partitionBy("event_id").orderBy("at", "claim_id", "status")
    ranked = assessed.withColumns({"_before": F.lag("status").over(order), "step": F.row_number().over(order)})
    met = ranked.join(reports.select("event_id", "report_id", "evidence_status", "is_historical", "teams"), "event_id", "left")
    old = F.when(F.col("step") == 1, F.col("evidence_status")).otherwise(F.col("_before"))
    turned = F.col("report_id").isNotNull() & (F.col("status") == "conflicting") & ~old.eqNullSafe(F.lit("conflicting"))
    return met.select("event_id", "step", "claim_id", "at", "status", "summary", "report_id", "is_historical", "teams", old.alias("old_status"), F.coalesce(turned, F.lit(False)).alias("turned"))


def statuses(steps: DataFrame, *by: str) -> DataFrame:
    """The last status and summary of each claim, event or report, as `by` says."""
    last = F.max_by(F.struct("status", "summary"), F.col("step"))
    return steps.where(" and ".join(f"{c} is not null" for c in by)).groupBy(*by).agg(last.alias("_last")).select(*by, "_last.status", "_last.summary")


def notices(steps: DataFrame) -> DataFrame:
    """One row for each team of a report that is no history, each time that it has come into conflict: upgrades and repeats are silent."""
    told = steps.where(F.col("turned") & ~F.coalesce("is_historical", F.lit(False)))
    return told.select("report_id", "step", "at", F.explode(F.array_distinct("teams")).alias("team_id")).where("team_id is not null")
