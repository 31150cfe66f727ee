"""Expressions on pages as they are fetched: challenges, markdown, archive addresses, paragraphs, crawl rules."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: What a bot challenge's title begins with, what its source holds, and what only tiny pages of that kind hold.
CHALLENGE_TITLES = [
    "just a moment", "attention required! | cloudflare", "access denied", "request rejected", "pardon our interruption", "are you a robot",
    "robot or human", "security check", "ddos-guard", "verify you are human", "please verify you are a human",
]
STRONG = [
    "cf-browser-verification", "cf-chl", "cf_chl", "enable javascript and cookies to continue", "request unsuccessful. incapsula",
    "_incapsula_resource", "incapsula incident id", "checking your browser before accessing", "attention required! | cloudflare", "just a moment...",
]
WEAK = ["captcha", "access denied", "challenge-platform", "datadome", "perimeterx"]
SMALL, TINY, HEAD = 250, 80, 200_000
#: markdown's images, links, emphasis, headings and table rules, in the order in which they go.
MARKDOWN = [
    (r"!\[[^\]]*\]\([^)]*\)", " "),
    (r"\[([^\]]*)\]\([^)]*\)", "$1"),
    (r"(\*\*|__|`)", ""),
    (r"(?m)^\s{0,3}#{1,6}\s*|(?<=\s)#{2,6}\s+", ""),
    (r"(?m)^\s*\|?\s*:?-{2,}:?\s*(\|\s*:?-{2,}:?\s*)*\|?\s*$", ""),
]
ARCHIVE = "https://web.archive.org/web/"
BLANK = r"[ \t\r\n\f]"


def challenge(raw: Column, title: Column, words: Column) -> Column:
    """The marker that makes a small page a bot challenge, or null: titles first, then strong markers, then weak ones on tiny pages."""
    name, head = F.lower(F.trim(F.coalesce(title, F.lit("")))), F.lower(F.left(F.coalesce(raw, F.lit("")), F.lit(HEAD)))
    titles = F.coalesce(*(F.when(F.startswith(name, F.lit(m)), m) for m in CHALLENGE_TITLES))
    strong, weak = (F.coalesce(*(F.when(F.contains(head, F.lit(m)), m) for m in markers)) for markers in (STRONG, WEAK))
    return F.when(words < SMALL, F.coalesce(titles, strong, F.when(words < TINY, weak)))


def without_markdown(s: Column) -> Column:
    """Text without markup, white space collapsed in each line, empty lines dropped."""
    for pattern, by in MARKDOWN:
        s = F.regexp_replace(s, pattern, by)
    lines = F.transform(F.split(s, r"\r\n|[\n\r\x0B\f]"), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    return F.array_join(F.filter(lines, lambda x: x != ""), "\n")


def paragraphs(s: Column, longest: int = 1500) -> Column:
    """Stretches between blank lines; those over `longest` characters are split at line ends. Trimmed, none empty."""
    trim = lambda x: F.regexp_replace(x, f"^{BLANK}+|{BLANK}+$", "")
    whole = F.transform(F.split(s, rf"\n[ \t\r\f]*\n{BLANK}*"), trim)
    parts = F.flatten(F.transform(whole, lambda x: F.when(F.length(x) > longest, F.split(x, "\n")).otherwise(F.array(x))))
    return F.filter(F.transform(parts, trim), lambda x: x != "")


def archive_url(url: Column, stamp: Column, raw: bool = False) -> Column:
    """Where an archive shows the capture of that time (yyyyMMddHHmmss), or gives its bytes as they were."""
    return F.concat(F.lit(ARCHIVE), stamp, F.lit("id_/" if raw else "/"), url)


def recency(days: Column) -> Column:
    """The bucket that providers search for an age in days."""
    return F.when(days <= 1, "day").when(days <= 7, "week").when(days <= 31, "month").otherwise("year")


def rule_pattern(rule: Column) -> Column:
    """A crawl rule as a regular expression: * stands for anything, $ at its end for the path's end."""
    plain = F.regexp_replace(rule, r"([.+?^${}()|\[\]\\])", r"\\$1")
    return F.concat(F.lit("^"), F.regexp_replace(F.regexp_replace(plain, r"\*", ".*"), r"\\\$$", r"\$"))
