"""Every query of the engine by name, with the SQL that gives the same rows where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import changed, entities, extracted, fetched, rules
from .oracles import ORACLES
from .queries import QUERIES


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | entities.QUERIES | rules.QUERIES | fetched.QUERIES | extracted.QUERIES | changed.QUERIES


def oracle_sql() -> dict[str, str]:
    return ORACLES | entities.ORACLES | rules.ORACLES | fetched.ORACLES | extracted.ORACLES | changed.ORACLES
