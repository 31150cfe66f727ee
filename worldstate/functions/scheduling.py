"""Check intervals, retries, quality gates and change ratios as expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LEAST_WORDS, LEAST_SHARE, REJECT_SPREAD = 30, 0.35, 0.25


def next_interval(base: Column, current: Column, outcome: Column, failures: Column, is_page: Column) -> Column:
    """Minutes to the next check: back to the base after a change, longer while nothing changes or checks fail."""
    base = F.greatest(base, F.lit(5))
    calm = F.least(F.floor(F.greatest(current, base) * 1.5), base * 4, F.lit(10080))
    failing = F.least(base * F.pow(F.lit(2.0), F.least(failures, F.lit(5))), F.lit(2880))
    return F.when(~is_page | outcome.isin("changed", "baseline"), base).when(outcome.isin("unchanged", "not_modified"), calm).otherwise(failing).cast("long")


def retry_delay(attempt: Column) -> Column:
    """Seconds before an attempt is repeated."""
    return F.least(F.lit(30) * F.pow(F.lit(2.0), attempt - 1), F.lit(1800)).cast("long")


def gate(status: Column, challenged: Column, words: Column, reference: Column) -> Column:
    """Whether a capture can stand for its page."""
    return (
        F.when(status.isin(401, 403, 429, 503) | challenged, "blocked")
        .when((status >= 400) | (words < LEAST_WORDS) | (words < reference * LEAST_SHARE), "degenerate")
        .otherwise("ok")
    )


def adopt(words: Column, reference: Column, last_rejected: Column) -> Column:
    """A capture is accepted if it is not far shorter than the accepted one, or agrees with the one rejected last."""
    agrees = F.abs(words - last_rejected) <= F.greatest(words, last_rejected) * REJECT_SPREAD
    return reference.isNull() | (words >= reference * LEAST_SHARE) | F.coalesce(agrees, F.lit(False))


def changed_ratio(added: Column, removed: Column, old: Column, new: Column) -> Column:
    return (added + removed) / F.greatest(F.lit(1), old + new)
