"""The first JSON object in a text that has other things around it."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

_FENCED = re.compile(r"```(?:json)?\s*(.*?)```", re.DOTALL | re.IGNORECASE)


def _values(s: str) -> Iterator[object]:
    """What the text holds in the order in which it counts: all of it, fenced parts, then whatever begins at a brace."""
    whole, decoder = s.strip(), json.JSONDecoder()
    places = [(whole, 0, True), *((m.group(1).strip(), 0, True) for m in _FENCED.finditer(whole)), *((whole, m.start(), False) for m in re.finditer("{", whole))]
    for part, at, to_end in places:
        try:
            value, end = decoder.raw_decode(part, at)
        except (ValueError, RecursionError):
            continue
        if not to_end or end == len(part):
            yield value
            if part is whole and to_end:
                return


def first_object(s: str | None) -> dict | None:
    """The first object of a text, or None; a text that is another JSON value as a whole has none."""
    return next((x for x in _values(s or "") if isinstance(x, dict)), None)


@F.pandas_udf(StringType())
def object_text(s: pd.Series) -> pd.Series:
    """The first object as compact JSON, keys in order of appearance; null where there is none."""
    found = (first_object(x) for x in s)
    return pd.Series([None if x is None else json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in found], dtype=object)
