"""Captures of a page in order: which of them can stand for it."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from ..functions import scheduling

Reference = tuple[int | None, int | None, int | None]


def step(state: Reference, words: int | None, content: int | None) -> tuple[Reference, str]:
    """One capture against (words and content of the accepted one, words of the one rejected last)."""
    reference, before, rejected = state
    if before is not None and content == before:
        return state, "same"
    if words is None:
        return state, "unknown"
    near = rejected is not None and abs(words - rejected) <= max(words, rejected) * scheduling.REJECT_SPREAD
    if reference is None or words >= reference * scheduling.LEAST_SHARE or near:
        return (words, content, None), "accepted"
    return (reference, before, words), "rejected"


def adopted(captures: DataFrame) -> DataFrame:
    """captures (source, at, id, words, content, all long) with verdict, folded in order of (at, id) with a state of three numbers a source."""
    dealt = captures.select("source", "at", "id", "words", "content").repartition("source").sortWithinPartitions("source", "at", "id")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = object(), (None, None, None)
        for batch in batches:
            verdicts = []
            for source, words, content in zip(*(batch.column(c).to_pylist() for c in ("source", "words", "content")), strict=True):
                if source != last:
                    last, state = source, (None, None, None)
                state, verdict = step(state, words, content)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(verdicts, pa.string())], names=[*batch.schema.names, "verdict"])

    return dealt.mapInArrow(fold, "source long, at long, id long, words long, content long, verdict string")
