"""Items that tell of one event, found in order of time: by a structured key, else by a near-equal title.

An item joins the earliest open event with its key, else the latest of the RECENT newest ones with a similar title, else it opens an event. Open
is an event for as long as items can reach it: its first item lies up to two windows back. An event is known by its
first item, and later items only corroborate it, so what an item joins doesn't depend on who joined before.

Items are dealt by (tenant, type, entity): keys begin with type and entity, and titles are compared within them. A task holds the
events of two windows of one entity and type, whatever its history. The same fold runs over streams (in_order).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import token_set
from ..streaming.in_order import Fold
from . import evidence

#: Microseconds of a window, least likeness of titles in per cent, newest events whose titles are compared.
WINDOW, ALIKE, RECENT = 21 * 86_400_000_000, 82, 40
ITEM = {"tenant": "string", "event_type": "string", "entity": "string", "id": "long", "at": "long", "key": "string", "title": "string"}
PLACED = {"id": "long", "event_id": "long", "leg": "string", "nth": "long"}


def similar(a: str | None, b: str | None) -> bool:
    return a is not None and b is not None and token_set(a.lower(), b.lower()) >= ALIKE


def place(state: list | None, item: dict) -> tuple[list, tuple]:
    """state: open events as [id, at, key, title, items], by time."""
    at = item["at"] or 0
    events = [e for e in state or [] if e[1] >= at - 2 * WINDOW]
    hit = next((e for e in events if item["key"] is not None and e[2] == item["key"]), None)
    leg = "key"
    if hit is None:
        leg = "title"
        hit = next((e for e in events[: -RECENT - 1 : -1] if similar(e[3], item["title"])), None)
    if hit is None:
        leg, hit = "new", [item["id"], at, item["key"], item["title"], 0]
        events.append(hit)
    hit[4] += 1
    return events, (item["id"], hit[0], leg, hit[4])


CLUSTERS = Fold(place, ["tenant", "event_type", "entity"], ITEM, PLACED)


def clustered(items: DataFrame) -> DataFrame:
    """PLACED for items with the columns of ITEM: the event of each item (by its first item's id), how it was found, and the how-manieth it is.

    Nulls: a null key or title matches nothing; a null tenant, type or entity is one of its own; no items, no rows.
    """
    return CLUSTERS.over_table(items)


def clustered_stream(items: DataFrame, delay: str = "1 hour") -> DataFrame:
    """The same for a stream; items more than `delay` behind the latest are left out."""
    return CLUSTERS.over_stream(items, delay)


def corroborated(items: DataFrame, distrusted: DataFrame | None = None) -> DataFrame:
    """Evidence of each event from all its items: items have the columns of ITEM and of evidence.assess but claim_id."""
    placed = clustered(items).select("id", "event_id")
    counts = placed.groupBy("event_id").agg(F.count("*").alias("n_items"))
    return evidence.assess(items.join(placed, "id"), "event_id", distrusted).join(counts, "event_id")
