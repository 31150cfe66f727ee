"""String functions that are built-in expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a search leaves out.
STOPWORDS = """
a about above after again against all also am an and any are as at be been before being below between both but by
can could did do does doing done during each few for from further had has have having he her here hers him his how
i if in into is it its itself just let me more most my no nor not now of off on once only or other our ours out over
own same she should so some such than that the their theirs them then there these they this those through to too
under until up very was we were what when where which while who whom why will with would you your yours
anything something everything tell show give list find know see look looking please us any much many recent
recently lately latest new news currently current today yesterday week weeks month months year years ago since
ever still yet happened happen happening changed change changes thing things
""".split()
#: Words that turn a statement round.
NEGATIONS = "not no never none nor neither without cannot".split()


def bound(value: Column, body) -> Column:
    """body(value), with value computed once a row however often body names it, in loops over elements too."""
    return F.element_at(F.transform(F.array(value), body), 1)


def squeeze(s: Column) -> Column:
    """White space collapsed to one blank, none at the ends."""
    return F.trim(F.regexp_replace(s, r"(?U)\s+", " "))


def truncate(s: Column, n: int, marker: str = "…") -> Column:
    """At most n characters, the marker included."""
    return F.when(F.length(s) <= n, s).otherwise(F.concat(F.rtrim(F.left(s, F.lit(max(0, n - len(marker))))), F.lit(marker)))


def name_key(s: Column) -> Column:
    return F.left(F.lower(squeeze(s)), F.lit(300))


def numbers(s: Column) -> Column:
    """Distinct numbers in order of appearance, without thousands separators; other commas and points stay."""
    found = F.regexp_extract_all(s, F.lit(r"\d+(?:[.,]\d+)*"), F.lit(0))
    grouped = r"^\d{1,3}(?:,\d{2,3})+(?:\.\d+)?$"
    return F.array_distinct(F.transform(found, lambda x: F.when(F.regexp_like(x, F.lit(grouped)), F.regexp_replace(x, ",", "")).otherwise(x)))


def negations(s: Column) -> Column:
    """The multiset of negating words, sorted."""
    words = F.regexp_extract_all(F.lower(F.regexp_replace(s, "n['’]t\\b", " not")), F.lit(r"(?U)\w+"), F.lit(0))
    return F.array_sort(F.filter(words, lambda w: w.isin(NEGATIONS)))


#: The parts of dates.
MONTH = r"(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sep(?:t(?:ember)?)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)\b\.?"
WEEKDAY = r"(?:(?:mon(?:day)?|tue(?:s(?:day)?)?|wed(?:nesday)?|thu(?:r(?:s(?:day)?)?)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)\b\.?,?\s+)?"
DAY = r"\d{1,2}(?:st|nd|rd|th)?"
#: What changes on every visit, in the order in which it is masked, so that none sees half a date.
MASKS = [
    (r"(?iU)(?:©|\(c\)|&copy;|\bcopyright\b)(?:\s*©)?\s*\d{4}(?:\s*[-–—]\s*(?:\d{4}|present))?", "<COPYRIGHT>"),
    (r"(?U)\b\d{4}-\d{2}-\d{2}(?:[T ]\d{2}:\d{2}(?::\d{2}(?:[.,]\d+)?)?(?:\s?(?:Z|[+-]\d{2}:?\d{2})\b)?)?", "<DATE>"),
    (rf"(?iU)\b{WEEKDAY}{MONTH}\s+{DAY}\b(?:,?\s+\d{{4}}\b)?", "<DATE>"),
    (rf"(?iU)\b{WEEKDAY}{DAY}\s+(?:of\s+)?{MONTH}(?:,?\s+\d{{4}}\b)?", "<DATE>"),
    (r"(?U)\b\d{1,2}[/-]\d{1,2}[/-](?:\d{4}|\d{2})\b", "<DATE>"),
    (r"(?U)\b\d{1,2}\.\d{1,2}\.\d{4}\b", "<DATE>"),
    (r"(?U)\b\d{4}/\d{1,2}/\d{1,2}\b", "<DATE>"),
    (r"(?U)\b(?:[01]?\d|2[0-3]):[0-5]\d:[0-5]\d(?:[.,]\d+)?\b", "<TIME>"),
    (r"(?iU)\b(?:[01]?\d|2[0-3]):[0-5]\d\s?[ap]\.?m\b\.?", "<TIME>"),
    (r"(?U)\b(?:[01]\d|2[0-3]):[0-5]\d\b", "<TIME>"),  # 1:10 is a ratio
    (r"(?iU)\b(?:1[0-2]|0?[1-9])\s?[ap]\.?m\b\.?", "<TIME>"),
    (r"(?iU)\b(?:\d+|an?|one|two|three|few|several)\s*(?:s|secs?|seconds?|m|mins?|minutes?|h|hrs?|hours?|d|days?|w|wks?|weeks?|mos?|months?|y|yrs?|years?)\s+ago\b", "<RELTIME>"),
    (r"(?iU)\b(?:just now|moments? ago|a moment ago|yesterday)\b", "<RELTIME>"),
    (r"""(?iU)(?<=[?&])(v|ver|version|rev|cb|cachebust|cache_bust|nocache|_|t|ts|timestamp)=[^&#\s"'<>]*""", "$1=<CB>"),
]
#: A token of 16 characters or more that is a UUID, hex, or changes four times between digits and letters.
LETTER, NO_DIGIT, NO_LETTER = r"[\w&&[^\d_]]", r"[\w+/=\-&&[^\d]]*+", r"[\d_+/=-]*+"
TO_DIGIT, TO_LETTER = NO_DIGIT + r"\d", NO_LETTER + LETTER
ID = (
    r"(?U)(?<![\w+/=-])(?=(?:[0-9a-fA-F]{16,}+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})(?![\w+/=-])"
    rf"|{TO_DIGIT}{TO_LETTER}{TO_DIGIT}{TO_LETTER}{TO_DIGIT}|{TO_LETTER}{TO_DIGIT}{TO_LETTER}{TO_DIGIT}{TO_LETTER})"
    r"[A-Za-z0-9][\w+/=-]{15,}+(?<=[\w=])"
)
#: Fixed value: lines with these words have dates that only say when the page was made.
DATE_NOISE = r"(?iU)\b(?:updated|update|modified|published|posted|as\s+(?:of|on)|last|generated|reviewed|retrieved|accessed|printed|refreshed|today)\b|©|\bcopyright\b"


def dates_are_noise(s: Column) -> Column:
    """Whether a line's dates say when the page was made, or are all it holds; elsewhere they are deadlines and the like."""
    bare = s
    for pattern, marker in MASKS:
        if marker == "<DATE>":
            bare = F.regexp_replace(bare, pattern, "")
    word = F.lit(r"(?U)[\w&&[^_]]")
    alone = F.regexp_like(s, word) & ~F.regexp_like(bare, word)
    return F.regexp_like(s, F.lit(DATE_NOISE)) | alone


#: What a line must have for any mask to fit: a digit, a word of age, a parameter, or a long run of hex letters.
MASKABLE = r"(?iU)\d|\bago\b|\bnow\b|\byesterday\b|[?&]|[0-9a-f]{16}"


def mask_volatile(s: Column, dates: bool | None = True) -> Column:
    """Parts of a line that change on every visit become markers: dates, times, ages, copyright years, cache-busters and long ids.

    Dates are masked in all lines, in none, or for None in those where they are noise. Ages are marked <RELTIME>. Lines that
    no mask can fit are told by one look.
    """

    def masked(x: Column, with_dates: bool) -> Column:
        for pattern, marker in MASKS:
            if with_dates or marker != "<DATE>":
                x = F.regexp_replace(x, pattern, marker)
        return F.regexp_replace(x, ID, "<ID>")

    found = F.when(~F.regexp_like(s, F.lit(MASKABLE)), s)
    if dates is not None:
        return found.otherwise(masked(s, dates))
    return found.when(dates_are_noise(s), masked(s, True)).otherwise(masked(s, False))


def content_hash(lines: Column) -> Column:
    """SHA-256 over masked, squeezed lines joined by line ends."""
    return F.sha2(F.array_join(F.transform(F.transform(lines, squeeze), lambda x: mask_volatile(x, None)), "\n"), 256)


#: Words; typography that is alike in quotes, and characters without width.
WORDS = r"[\p{L}\p{M}\p{N}_]+"
ALIKE = ("\u2018\u2019\u201a\u201b\u2032`\u201c\u201d\u201e\u201f\u2033\u00ab\u00bb\u2010\u2011\u2012\u2013\u2014\u2015\u2212", "''''''" + '"' * 7 + "-" * 7)
NO_WIDTH = "\u200b\u200c\u200d\u2060\ufeff\u00ad"


def for_match(s: Column) -> Column:
    """The form in which quotes are looked up: typography, white space and case made alike (NFKC is not applied)."""
    plain = F.translate(F.translate(s, NO_WIDTH, ""), *ALIKE)
    return F.trim(F.regexp_replace(F.lower(plain), r"[\t-\r\x{85}\p{Z}]+", " "))


def mark_words(s: Column) -> Column:
    """Words between marks, so that what is contained doesn't begin or end inside a word."""
    return F.regexp_replace(s, f"({WORDS})", "\u0001$1\u0002")


def runs(words: Column, n: int) -> Column:
    """All runs of n words, joined by blanks; none where there are fewer words."""
    found = lambda: F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, found()).otherwise(F.array().cast("array<string>"))


def search_terms(query: Column, most: int = 12) -> Column:
    """Distinct words of a query in order, of two characters or more, without stop words."""
    words = F.regexp_extract_all(F.lower(query), F.lit(r"(?U)[\p{L}\p{N}][\w.'+&-]*"), F.lit(0))
    clean = F.transform(words, lambda w: F.regexp_replace(F.regexp_replace(w, r"[.'+&-]+$", ""), "'s$", ""))
    return F.slice(F.array_distinct(F.filter(clean, lambda w: (F.length(w) >= 2) & ~w.isin(STOPWORDS))), 1, most)
