"""Dates as search providers and pages write them, as microseconds since 1970 in UTC; one expression, no session's zone.

Read are ISO 8601, RFC 2822 ("Sun, 21 Sep 2026 10:15:00 GMT"), written dates in either order ("Sep 21, 2026", "21st of September 2026",
"Dec 30"), numbers with the month first unless it can't be one ("09/21/2026"), and ages ("3 hours ago", "yesterday"). What
has no zone is UTC. What lies over a day ahead is a misreading: without a year it meant last year, else it is null.
Null, empty and other texts are null.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text

#: Seconds of the units in which ages are told; a month has 30 days, a year 365.
UNITS = {
    1: "s sec secs second seconds", 60: "m min mins minute minutes", 3600: "h hr hrs hour hours", 86400: "d day days", 604800: "w wk wks week weeks",
    2592000: "mo mos month months", 31536000: "y yr yrs year years",
}
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
DAY = 86_400_000_000
_NAMES = "jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?"
_WEEKDAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs?)?|fri|sat(?:ur)?|sun)(?:day)?\.?,?\s+)?"
_CLOCK = r"(?:[t\s,]\s*(?:at\s+)?(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,6})\d*)?)?\s*([ap]m)?\s*(z|utc|gmt|[+-]\d{2}:?\d{2})?)?"
#: Each form: the expression, and the groups of year, month (a number or a name), day; the clock's five groups and its zone follow.
FORMS = [
    (rf"^(\d{{4}})-(\d{{1,2}})-(\d{{1,2}}){_CLOCK}$", 1, 2, 3),
    (rf"^(\d{{4}})/(\d{{1,2}})/(\d{{1,2}}){_CLOCK}$", 1, 2, 3),
    (rf"^{_WEEKDAY}({_NAMES})\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?(?:,?\s+(\d{{4}}))?{_CLOCK}$", 3, 1, 2),
    (rf"^{_WEEKDAY}(\d{{1,2}})(?:st|nd|rd|th)?[\s-]+(?:of\s+)?({_NAMES})\.?(?:,?[\s-]+(\d{{4}}))?{_CLOCK}$", 3, 2, 1),
    (rf"^(\d{{1,2}})[/.-](\d{{1,2}})[/.-](\d{{4}}){_CLOCK}$", 3, 1, 2),
]
_AGE = r"^(\d{1,9}|an?|one)\s*([a-z]+)\s+ago$"


def _micros(year: Column, x: Column) -> Column:
    """Microseconds of the moment that x tells, in a year; null where there is no such day or time."""
    date = F.call_function("try_to_date", F.format_string("%04d-%02d-%02d", year, x["month"], x["day"]), F.lit("yyyy-MM-dd"))
    return F.when(x["month"].between(1, 12) & x["day"].between(1, 31), F.unix_date(date).cast("long") * DAY + x["clock"])


def _clock(hour: Column, minute: Column, second: Column, fraction: Column, half: Column, zone: Column) -> Column:
    """Microseconds into the day in UTC; null where there is no such time."""
    number = lambda c: F.when(c == "", 0).otherwise(c.cast("int"))
    h = number(hour)
    h = F.when((half != "") & ~h.between(1, 12), F.lit(99)).when(half == "pm", h % 12 + 12).when(half == "am", h % 12).otherwise(h)
    digits = F.regexp_replace(zone, "[^0-9]", "")
    minutes = F.left(digits, F.lit(2)).cast("long") * 60 + F.right(digits, F.lit(2)).cast("long")
    offset = F.when(digits == "", F.lit(0)).otherwise(F.when(F.startswith(zone, F.lit("-")), -minutes).otherwise(minutes))
    seconds = h.cast("long") * 3600 + (number(minute).cast("long") - offset) * 60 + number(second)
    micros = F.when(fraction == "", F.lit(0)).otherwise(F.rpad(fraction, 6, "0").cast("long"))
    return F.when((h < 24) & (number(minute) < 60) & (number(second) < 60), seconds * 1_000_000 + micros)


def _parts(low: Column) -> Column:
    """Year (null where it is left out), month, day and clock of the first form that fits."""
    fits = []
    for pattern, *places in FORMS:
        groups = [F.regexp_extract(low, pattern, k).alias(name) for k, name in zip(places, "ymd", strict=True)]
        groups += [F.regexp_extract(low, pattern, k).alias(f"c{k - 4}") for k in range(4, 10)]
        swaps = F.lit("[/.-](\\d{1,2})[/.-](\\d{4})" in pattern).alias("swaps")
        fits.append(F.when(low.rlike(pattern), F.struct(*groups, swaps)))

    def told(x: Column) -> Column:
        named = F.array_position(F.array(*map(F.lit, MONTHS)), F.left(x["m"], F.lit(3))).cast("int")
        month, day = F.when(x["m"].rlike("^[0-9]+$"), x["m"].cast("int")).otherwise(named), x["d"].cast("int")
        # the month comes first unless only the other can be one
        turned = x["swaps"] & (month > 12)
        year = F.when(x["y"] != "", x["y"].cast("int"))
        return F.struct(year.alias("year"), F.when(turned, day).otherwise(month).alias("month"), F.when(turned, month).otherwise(day).alias("day"), _clock(*(x[f"c{k}"] for k in range(6))).alias("clock"))

    return text.bound(F.coalesce(*fits), lambda x: F.when(x.isNotNull(), told(x)))


def published(s: Column, now: Column) -> Column:
    """Microseconds since 1970 of a date as it is written; now: the same of the present."""
    this_year = F.year(F.date_from_unix_date(F.floor(now / DAY).cast("int")))

    def read(low: Column) -> Column:
        unit, count = F.regexp_extract(low, _AGE, 2), F.regexp_extract(low, _AGE, 1)
        seconds = F.coalesce(*(F.when(unit.isin(names.split()), F.lit(n)) for n, names in UNITS.items()))
        age = F.when(count.rlike("^[0-9]+$"), count.cast("long")).otherwise(F.lit(1)) * seconds * 1_000_000
        return F.when(low.isin("today", "just now"), now).when(low == "yesterday", now - DAY).when(low.rlike(_AGE), now - age).otherwise(text.bound(_parts(low), lambda x: dated(x)))

    def dated(x: Column) -> Column:
        at, before = _micros(F.coalesce(x["year"], this_year), x), _micros(this_year - 1, x)
        return F.when(at <= now + DAY, at).when(x["year"].isNull() & (before <= now + DAY), before)

    return text.bound(F.lower(F.trim(F.regexp_replace(s, r"(?U)\s+", " "))), read)


def loose(s: Column) -> Column:
    """The same for the metadata of pages: ages and years left out are no dates there, and the future is none to mind."""
    far = F.lit(253_402_300_799_000_000)
    return F.when(F.trim(s).rlike(r"\b\d{4}\b"), published(s, far))
