"""Checks of live pages, folded in order into outcomes: what changed, what can't be trusted, and when to look again.

A source's state is the last accepted snapshot (its words, content and id), the words of the version rejected last, the failures
in a row and the current interval: a handful of numbers, whatever its history. The same step runs over a table (sources are
dealt to tasks, each in order) and over a stream (transformWithState, event time). The stream holds a source's checks back until
the watermark has passed them, so rows that come late or shuffled within the delay give what the table gives.

Outcomes: not_modified, error, blocked, degenerate (an error page, too little text, or far less than the accepted snapshot
and unlike the version rejected last), unchanged, baseline (the first accepted snapshot, which can never alert), changed.

Defined cases: checks are ordered by (at, id), ties by all else; a null source is one source; a check without a time comes first in a table and is left
out of a stream; unknown words of a good page count as 0; no checks, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..functions.scheduling import LEAST_SHARE, REJECT_SPREAD
from .in_order import Fold

#: Columns of a check. status: of HTTP; error: what failed; blocked: by rules of the host; quality: by the absolute gate; noise: the
#: difference to the accepted snapshot is no more than volatile; base: minutes between checks of the source.
CHECK = {"source": "string", "id": "long", "at": "long", "status": "int", "error": "string", "blocked": "boolean", "quality": "string", "words": "long", "content": "string", "noise": "boolean", "base": "long"}
OUT = {"source": "string", "id": "long", "at": "long", "outcome": "string", "before_id": "long", "failures": "long", "interval": "long", "next_at": "long"}
#: words, content and id of the accepted snapshot, words of the one rejected last, failures in a row, interval in minutes.
NEW = (None, None, None, None, 0, None)
MINUTE = 60_000_000
FAILED = ("error", "blocked", "degenerate")


def interval(base: int, current: int | None, outcome: str, failures: int) -> int:
    """scheduling.next_interval of a page, for one check."""
    base = max(5, base)
    if outcome in ("changed", "baseline"):
        return base
    if outcome in ("unchanged", "not_modified"):
        return min(max(current or 0, base) * 3 // 2, base * 4, 10080)
    return min(base * 2 ** min(failures, 5), 2880)


def judged(state: tuple, check: dict) -> tuple[str, tuple]:
    """The outcome of a check, and the state but for failures and interval."""
    words, content, own, rejected, failures, minutes = state
    if check["status"] == 304:
        return "not_modified", state
    if check["blocked"] or check["error"] is not None:
        return "blocked" if check["blocked"] else "error", state
    if check["quality"] != "ok":
        return "degenerate" if check["quality"] == "degenerate" else "blocked", state
    n = check["words"] or 0
    near = bool(rejected) and abs(n - rejected) <= REJECT_SPREAD * max(n, rejected)
    if words and n < LEAST_SHARE * words and not near:
        return "degenerate", (words, content, own, n, failures, minutes)
    if own is not None and check["content"] == content:
        return "unchanged", (words, content, own, None, failures, minutes)
    outcome = "baseline" if own is None else "unchanged" if check["noise"] else "changed"
    return outcome, (n, check["content"], check["id"], None, failures, minutes)


def step(state: tuple | None, check: dict) -> tuple[tuple, tuple]:
    """One check: the state after it, and its row."""
    state = NEW if state is None else state
    outcome, after = judged(state, check)
    failures = state[4] + 1 if outcome in FAILED else 0
    minutes = interval(check["base"] or 0, state[5], outcome, failures)
    next_at = None if check["at"] is None else check["at"] + minutes * MINUTE
    return (*after[:4], failures, minutes), (check["source"], check["id"], check["at"], outcome, state[2], failures, minutes, next_at)


PAGES = Fold(step, ["source"], CHECK, OUT)


def outcomes(checks: DataFrame) -> DataFrame:
    """OUT for a table with the columns of CHECK; a source is folded in one task, in order, its state alone in memory."""
    return PAGES.over_table(checks)


def outcomes_stream(checks: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same for a stream of checks; those more than `delay` behind the latest are left out. Needs in_order.STATE_STORE."""
    return PAGES.over_stream(checks, delay)
