"""Sequence diff of two versions of a page, line by line: hunks with context, noise told by reason, rendering, quotes.

Versions are arrays of lines. Lines are aligned by keys without volatile parts, so that a new date in a note of updates
is no hunk; hunks carry the lines as they are. A hunk that can't matter is noise, with its reason:

    volatile    both sides are alike once dates, times, ages and ids are masked (a re-wrapped note of updates)
    formatting  both sides are alike but for white space, case and marks that no digit or % stands beside
    whitespace  no line has a character other than white space
    rule        every line that isn't blank matches some learned pattern, whatever its case; patterns that don't compile count for nothing

A null version is one without lines. All but the alignment, learned patterns and the check of quotes are built-in expressions.
"""

from __future__ import annotations

import difflib
import re
from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from ..functions import domain, text
from ..functions.quotes import held, normal

LINES = ArrayType(StringType())
#: A stretch that differs: its begin and size in the old and the new version, and begin and end of the new version's context.
PLACES = ["i", "n_before", "k", "n_after", "low", "high"]
STEPS = ArrayType(StructType([StructField("kind", StringType()), *(StructField(c, IntegerType()) for c in PLACES)]))
#: Lines of context on either side; characters of a rendered diff and of a side in a note.
CONTEXT, RENDERED, SHOWN = 2, 6000, 120
#: Kinds of hunks by difflib's names, and the notes on noise.
KINDS = {"replace": "changed", "insert": "added", "delete": "removed"}
NOTES = {"volatile": "volatile-only change (dates/times/ids)", "formatting": "formatting-only change (whitespace/punctuation/case)", "whitespace": "whitespace-only change", "rule": "matched suppression rule"}


class Keyed(NamedTuple):
    """A version's lines, and their keys."""

    lines: Column
    keys: Column


def keyed(lines: Column) -> Keyed:
    """Lines with keys without volatile parts; dates outside notes of updates stay, and so does case."""
    key = lambda x: text.bound(text.squeeze(x), lambda s: text.mask_volatile(s, None))
    return Keyed(lines, F.transform(lines, key))


def masked_lines(s: Column) -> Keyed:
    """The squeezed lines of a text that aren't empty, with keys."""
    return keyed(F.filter(F.transform(F.split(s, "\n"), text.squeeze), lambda x: x != ""))


def _lists(lists: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Where each row's list begins and ends among all values, and the values; a null list is an empty one."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    return np.concatenate([[0], np.cumsum(sizes)]).astype("int64"), lists.flatten()


@F.arrow_udf(STEPS)
def _steps(old: pa.Array, new: pa.Array, context: pa.Array) -> pa.Array:
    """Where two lists of keys differ, and how far the new one's context reaches. A batch's keys are numbers here: rows see no strings."""
    (begins, left), (starts, right) = _lists(old), _lists(new)
    numbers = pa.concat_arrays([left, right]).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
    ends, kinds, places = [0], [], []
    for row in range(len(old)):
        a = numbers[begins[row] : begins[row + 1]].tolist()
        b = numbers[len(left) + starts[row] : len(left) + starts[row + 1]].tolist()
        n = context[row].as_py()
        steps = [s for s in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes() if s[0] != "equal"]
        # stretches that differ are never neighbours: what lies between two of them is alike and bounds the context of both
        lows, highs = [0, *(s[4] for s in steps)], [*(s[3] for s in steps[1:]), len(b)]
        for (kind, i, j, k, m), low, high in zip(steps, lows, highs):
            kinds.append(KINDS[kind])
            places.append((i, j - i, k, m - k, max(low, k - n), min(high, m + n)))
        ends.append(len(kinds))
    columns = np.array(places, dtype="int32").reshape(-1, len(PLACES)).T
    fields = pa.StructArray.from_arrays([pa.array(kinds, pa.string()), *(pa.array(c) for c in columns)], ["kind", *PLACES])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), fields)


#: Spark would otherwise align twice: once more in a filter that it infers where hunks are exploded.
_steps = _steps.asNondeterministic()


def hunks(old: Keyed, new: Keyed, context: int = CONTEXT) -> Column:
    """Stretches that differ by key, with the lines as they are and lines of the new version around them, up to the next hunk.

    Only keys go to Python, and places come back, so that a worker holds an Arrow batch (of bounded bytes) and one row's numbers.
    """
    none = F.array().cast(LINES)
    before, after = F.coalesce(old.lines, none), F.coalesce(new.lines, none)
    steps = _steps(F.coalesce(old.keys, none), F.coalesce(new.keys, none), F.lit(context))
    cut = lambda of, at, n: F.slice(of, at + 1, n)

    def hunk(s: Column) -> Column:
        end = s["k"] + s["n_after"]
        sides = cut(before, s["i"], s["n_before"]).alias("before"), cut(after, s["k"], s["n_after"]).alias("after")
        return F.struct(s["kind"].alias("kind"), *sides, cut(after, s["low"], s["k"] - s["low"]).alias("context_before"), cut(after, end, s["high"] - end).alias("context_after"))

    return F.transform(steps, hunk)


def counts(found: Column) -> dict[str, Column]:
    """n_added and n_removed lines of a diff."""
    total = lambda side: F.aggregate(F.transform(found, lambda h: F.size(h[side])), F.lit(0), lambda a, x: a + x).cast("long")
    return {"n_added": total("after"), "n_removed": total("before")}


def changed_ratio(found: Column, n_old: Column, n_new: Column) -> Column:
    """Share of both versions' lines that a hunk holds; over a half, the page has been rebuilt."""
    n = counts(found)
    return (n["n_added"] + n["n_removed"]) / F.greatest(n_old + n_new, F.lit(1))


@F.arrow_udf(LINES)
def _rules(lines: pa.Array, patterns: pa.Array) -> pa.Array:
    """For each hunk's lines the first pattern that matches one of them, if every line matches some pattern."""
    out, compiled = [], {}
    for found, known in ((x.as_py(), y.as_py()) for x, y in zip(lines, patterns, strict=True)):
        asked = [x for x in known or [] if x is not None]
        for x in asked:
            if x not in compiled:
                try:
                    compiled[x] = re.compile(x, re.IGNORECASE)
                except re.error:
                    compiled[x] = None
        usable = [compiled[x] for x in asked if compiled[x]]
        row = []
        for hunk in found or []:
            shown = [x for x in hunk if x and x.strip()]
            all_match = bool(shown) and all(any(p.search(x) for p in usable) for x in shown)
            row.append(next(p.pattern for p in usable if any(p.search(x) for x in shown)) if all_match else None)
        out.append(row)
    return pa.array(out, pa.list_(pa.string()))


def _alike(h: Column) -> Column:
    """volatile or formatting, if both sides say the same."""
    flat = lambda side: text.squeeze(F.array_join(h[side], " "))
    mask = lambda s: text.mask_volatile(s, None)

    def reason(x: Column) -> Column:
        masked = F.struct(mask(x["b"]).alias("b"), mask(x["a"]).alias("a"))
        same = lambda m: domain.formatting_key(m["b"]) == domain.formatting_key(m["a"])
        return text.bound(masked, lambda m: F.when((x["b"] != x["a"]) & (m["b"] == m["a"]), "volatile").when((m["b"] == m["a"]) | same(m), "formatting"))

    both = (F.size(h["before"]) > 0) & (F.size(h["after"]) > 0)
    return F.when(both, text.bound(F.struct(flat("before").alias("b"), flat("after").alias("a")), reason))


def _quoted(s: Column) -> Column:
    """A text between quotes: single ones, or double ones where it has a single one and no double one."""
    plain = F.regexp_replace(F.regexp_replace(s, r"\\", r"\\\\"), "\n", r"\\n")
    double = F.contains(s, F.lit("'")) & ~F.contains(s, F.lit('"'))
    return F.when(double, F.concat(F.lit('"'), plain, F.lit('"'))).otherwise(F.concat(F.lit("'"), F.regexp_replace(plain, "'", r"\\'"), F.lit("'")))


def _shown(h: Column) -> Column:
    side = lambda c: _quoted(text.truncate(F.array_join(h[c], " / "), SHOWN))
    one = F.when(h["kind"] == "added", F.concat(F.lit("+ "), side("after"))).when(h["kind"] == "removed", F.concat(F.lit("- "), side("before")))
    return one.otherwise(F.concat(side("before"), F.lit(" -> "), side("after")))


def judged(found: Column, patterns: Column | Sequence[str] = ()) -> Column:
    """Every hunk in order as (hunk, reason, rule, note); reason and note are null for what is no noise, rule for all but rules.

    patterns: learned patterns, given or as an array column (a table of rules, joined by owner).
    """
    given = patterns if isinstance(patterns, Column) else F.array(*map(F.lit, patterns)).cast("array<string>")
    rules = _rules(F.transform(found, lambda h: F.concat(h["before"], h["after"])), given)
    blank = lambda h: ~F.exists(F.concat(h["before"], h["after"]), lambda x: text.squeeze(x) != "")

    def reason(h: Column, rule: Column) -> Column:
        return F.coalesce(_alike(h), F.when(blank(h), "whitespace"), F.when(rule.isNotNull(), "rule"))

    def note(h: Column, why: Column, rule: Column) -> Column:
        kind = F.element_at(F.create_map(*(F.lit(x) for pair in NOTES.items() for x in pair)), why)
        return F.when(why.isNotNull(), F.concat(kind, F.when(why == "rule", F.concat(F.lit(" "), _quoted(rule))).otherwise(""), F.lit(": "), _shown(h)))

    def one(h: Column, rule: Column) -> Column:
        return text.bound(reason(h, rule), lambda why: F.struct(h.alias("hunk"), why.alias("reason"), F.when(why == "rule", rule).alias("rule"), note(h, why, rule).alias("note")))

    return F.zip_with(found, rules, one)


def kept(judgements: Column) -> Column:
    """The hunks that are no noise."""
    return F.transform(F.filter(judgements, lambda x: x["reason"].isNull()), lambda x: x["hunk"])


def notes(judgements: Column) -> Column:
    """Why hunks were left out, in order."""
    return F.transform(F.filter(judgements, lambda x: x["reason"].isNotNull()), lambda x: x["note"])


def without_noise(found: Column, patterns: Column | Sequence[str] = ()) -> Column:
    """The hunks that no reason takes away."""
    return kept(judged(found, patterns))


def _fitting(parts: Column, between: str, fits) -> Column:
    """(text, n, open): the first n parts joined; the first that doesn't fit ends it. fits(length with it, number from 1)."""
    start = F.struct(F.lit("").alias("text"), F.lit(0).alias("n"), F.lit(True).alias("open"))

    def step(s: Column, part: Column) -> Column:
        longer = F.when(s["n"] == 0, part).otherwise(F.concat(s["text"], F.lit(between), part))
        going = s["open"] & fits(F.length(s["text"]) + F.when(s["n"] == 0, 0).otherwise(len(between)) + F.length(part), s["n"] + 1)
        return F.struct(F.when(going, longer).otherwise(s["text"]).alias("text"), F.when(going, s["n"] + 1).otherwise(s["n"]).alias("n"), going.alias("open"))

    return F.aggregate(parts, start, step)


def rendered(found: Column, most: int = RENDERED) -> Column:
    """A diff as text of at most so many characters: whole hunks while they fit, then how many were left out.

    A first hunk that is too long alone is cut at a line's end. (Fixed values: the format, and room of 40 and 60 characters for notes.)
    """
    lead = lambda mark, lines: F.transform(lines, lambda x: F.concat(F.lit(mark), x))

    def block(h: Column, i: Column) -> Column:
        head = F.array(F.concat(F.lit("@@ "), (i + 1).cast("string"), F.lit(" "), h["kind"]))
        return F.array_join(F.concat(head, lead("  ", h["context_before"]), lead("- ", h["before"]), lead("+ ", h["after"]), lead("  ", h["context_after"])), "\n")

    def cut(first: Column) -> Column:
        room = most - 60
        lines = F.split(first, "\n")
        whole = _fitting(lines, "\n", lambda length, _: length <= room)
        return text.bound(whole, lambda s: F.concat(F.when(s["n"] == 0, text.truncate(F.get(lines, F.lit(0)), max(1, room))).otherwise(s["text"]), F.lit("\n  … (hunk truncated)")))

    def whole(blocks: Column) -> Column:
        n = F.size(blocks)
        fitting = _fitting(blocks, "\n\n", lambda length, number: length + F.when(number < n, 40).otherwise(0) <= most)
        return text.bound(fitting, lambda s: noted(F.when(s["n"] == 0, cut(F.get(blocks, F.lit(0)))).otherwise(s["text"]), n - F.greatest(s["n"], F.lit(1))))

    def noted(shown: Column, left: Column) -> Column:
        note = F.concat(F.lit("\n\n… "), left.cast("string"), F.lit(" more hunk"), F.when(left == 1, "").otherwise("s"), F.lit(" omitted"))
        return text.truncate(F.when(left > 0, F.concat(shown, note)).otherwise(shown), most)

    return F.when(F.size(found) == 0, "(no changes)").when(found.isNotNull(), text.bound(F.transform(found, block), whole))


@F.arrow_udf(StringType())
def _first_holding(lines: pa.Array, bodies: pa.Array) -> pa.Array:
    out = []
    for found, body in ((x.as_py(), y.as_py()) for x, y in zip(lines, bodies, strict=True)):
        form = normal(body or "")
        asked = (x.strip() for x in found or [] if x)
        out.append(next((x for x in asked if len(x) >= 3 and held(normal(x), form)[0]), None))
    return pa.array(out, pa.string())


def quote(found: Column, body: Column) -> Column:
    """A quote for a change: the first line of three characters or more, of the new lines and then those around them, hunk by hunk, that holds in the new text."""
    return _first_holding(F.flatten(F.transform(found, lambda h: F.concat(h["after"], h["context_after"], h["context_before"]))), body)
