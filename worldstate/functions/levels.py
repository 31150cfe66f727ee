"""Ordered levels: rank, comparison, clamped steps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEVERITY = ["none", "low", "medium", "high", "critical"]


def rank(level: Column, levels: list[str] = SEVERITY) -> Column:
    """Place from 0; an unknown or null level counts as the lowest."""
    names = F.array(*map(F.lit, levels))
    return F.greatest(F.coalesce(F.array_position(names, level), F.lit(0)) - 1, F.lit(0)).cast("int")


def at_least(level: Column, least: Column, levels: list[str] = SEVERITY) -> Column:
    return rank(level, levels) >= rank(least, levels)


def step(level: Column, by: int, levels: list[str] = SEVERITY) -> Column:
    """The level `by` places on, clamped to the scale."""
    place = F.least(F.greatest(rank(level, levels) + by, F.lit(0)), F.lit(len(levels) - 1))
    return F.element_at(F.array(*map(F.lit, levels)), place + 1)


def coerce(level: Column, default: str, levels: list[str] = SEVERITY) -> Column:
    clean = F.lower(F.trim(level))
    return F.when(clean.isin(levels), clean).otherwise(default)


def clamp_severity(severity: Column, evidence: Column, importance: Column) -> Column:
    """Severity that evidence and the area's importance allow; an unknown one counts as medium."""
    severity = coerce(severity, "medium")
    most = F.when((evidence == "unverified") | (importance == "low"), rank(F.lit("medium"))).when(evidence == "single_source", rank(F.lit("high"))).otherwise(rank(F.lit("critical")))
    return F.element_at(F.array(*map(F.lit, SEVERITY)), F.least(rank(severity), most) + 1)


def clamp_notes(severity: Column, evidence: Column, importance: Column) -> Column:
    """Why a severity was lowered, in order."""
    own, medium = coerce(severity, "medium"), SEVERITY.index("medium")
    first = (evidence == "unverified") & (rank(own) > medium)
    second = (evidence == "single_source") & (own == "critical")
    left = F.when(first, medium).when(second, SEVERITY.index("high")).otherwise(rank(own))
    notes = [(first, "unverified: medium at most"), (second, "single source: high at most"), ((importance == "low") & (left > medium), "area of low importance: medium at most")]
    return F.array_compact(F.array(*(F.when(c, F.lit(n)) for c, n in notes)))
