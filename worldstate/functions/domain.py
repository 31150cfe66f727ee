"""Rules on names, values, sources and requests, as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text, urls

#: Units that have a standard name.
UNITS = {"percent": "%", "pct": "%", "per cent": "%", "%": "%", "inr": "INR", "rs": "INR", "rs.": "INR", "₹": "INR", "rupees": "INR", "usd": "USD", "$": "USD", "us$": "USD", "eur": "EUR", "€": "EUR", "gbp": "GBP", "£": "GBP"}
#: Legal forms and general words that a company's name may go without.
SUFFIXES = "inc ltd limited pvt private llc llp corp corporation co plc gmbh sa ag bv nv the company group holdings technologies technology software solutions services systems labs ventures global international india".split()
#: Registries, whose pages are primary for whatever they say, and community sites.
REGISTRIES = "rbi.org.in sebi.gov.in npci.org.in mca.gov.in irdai.gov.in pfrda.org.in bseindia.com nseindia.com cdsco.gov.in ipindia.gov.in meity.gov.in pib.gov.in egazette.gov.in sec.gov fda.gov clinicaltrials.gov uspto.gov ftc.gov federalregister.gov europa.eu fca.org.uk mas.gov.sg".split()
COMMUNITY = "reddit.com x.com twitter.com facebook.com instagram.com linkedin.com quora.com medium.com youtube.com threads.net t.me ycombinator.com msn.com yahoo.com flipboard.com newsbreak.com dailyhunt.in inshorts.com google.com bing.com".split()
#: Path segments below which articles lie, and how a request in free text begins.
ARTICLES = "blog blogs learn guides resources stories articles".split()
REQUESTS = "what tell how give brief analy show who research monitor please".split()
#: Letters with marks and the same without, of Latin-1 and Latin Extended-A, made by rule.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"


def slug(value: Column, max_len: int = 60, strip_suffixes: bool = False) -> Column:
    """Lower-case words of ASCII letters and digits joined by hyphens; marks go, other letters vanish."""
    words = F.regexp_extract_all(F.regexp_replace(F.lower(F.translate(F.coalesce(value, F.lit("")), MARKED, PLAIN)), r"[^\x00-\x7f]", ""), F.lit("[a-z0-9]+"), F.lit(0))
    if strip_suffixes:
        kept = F.filter(words, lambda w: ~w.isin(SUFFIXES))
        words = F.when(F.size(kept) > 0, kept).otherwise(words)
    return F.regexp_replace(F.left(F.array_join(words, "-"), F.lit(max_len)), "^-+|-+$", "")


def cluster_key(kind: Column, entity: Column, counterparty: Column, product: Column, person: Column, amount: Column, topic: Column, month: Column) -> Column:
    """What an event is about, by its kind; month: its yyyy-MM."""
    name, other = slug(entity, strip_suffixes=True), slug(counterparty, strip_suffixes=True)
    name = F.when(name == "", "unknown").otherwise(name)
    filled = lambda c: F.coalesce(c, F.lit("")) != ""
    first = lambda *cols: F.coalesce(*(F.when(filled(c), c) for c in cols), F.lit(""))
    key = lambda *parts: F.concat_ws(":", *parts)
    money, general = slug(amount), slug(first(product, topic), 40)
    return (
        F.when(kind.isin("partnership", "acquisition") & (other != ""), key(kind, name, other))
        .when(kind == "funding", key(F.lit("funding"), name, F.when(money != "", money).otherwise(F.coalesce(month, F.lit("na")))))
        .when((kind == "leadership") & filled(person), key(kind, name, slug(person)))
        .when((kind == "product_launch") & filled(product), key(F.lit("launch"), name, slug(product, strip_suffixes=True)))
        .when(kind == "regulatory", key(kind, name, slug(first(topic, product), 50)))
        .when(kind == "pricing", key(kind, name, F.when(general == "", "general").otherwise(general)))
        .otherwise(key(kind, name, slug(first(topic, product, counterparty), 50)))
    )


def norm_unit(unit: Column) -> Column:
    u = F.lower(F.trim(F.coalesce(unit, F.lit(""))))
    known = F.create_map(*(F.lit(x) for pair in UNITS.items() for x in pair))
    return F.coalesce(F.try_element_at(known, u), F.when(F.length(u) <= 4, F.upper(u)).otherwise(u))


def decimal_text(number: Column) -> Column:
    """A number rounded to four places, with one place at least and no zeros behind it."""
    fixed = F.regexp_replace(F.round(number, 4).cast("decimal(38,4)").cast("string"), "0+$", "")
    return F.when(F.endswith(fixed, F.lit(".")), F.concat(fixed, F.lit("0"))).otherwise(fixed)


def value_key(display: Column, number: Column, unit: Column, conditions: Column) -> Column:
    """32 hex digits that are equal for equal values, however they are shown; numbers below 1e16 as usual decimals."""
    numeric = F.concat(F.lit("n:"), decimal_text(number), F.lit("|u:"), norm_unit(unit), F.lit("|c:"), text.for_match(F.coalesce(conditions, F.lit(""))))
    return F.left(F.sha2(F.when(number.isNotNull(), numeric).otherwise(F.concat(F.lit("t:"), text.for_match(F.coalesce(display, F.lit(""))))), 256), F.lit(32))


def source_class(url: Column, publisher: Column, entity_domains: list[str], regulator_domains: list[str], distrusted: list[str]) -> Column:
    """primary, community or independent."""
    return (
        F.when(F.startswith(url, F.lit("sandbox://")), "primary")
        .when(publisher.isin(distrusted) if distrusted else F.lit(False), "community")
        .when(urls.domain_matches(url, [*entity_domains, *regulator_domains, *REGISTRIES]), "primary")
        .when(urls.domain_matches(url, COMMUNITY), "community")
        .otherwise("independent")
    )


def is_article(url: Column) -> Column:
    path = F.concat(F.lower(F.regexp_extract(url, r"(?i)^[a-z]+://[^/]+(/[^?#]*)?", 1)), F.lit("/"))
    return F.regexp_like(path, F.lit(rf"/(?:{'|'.join(ARTICLES)})/+[^/]"))


def looks_like_request(s: Column) -> Column:
    t = F.lower(text.squeeze(s))
    return (F.size(F.split(t, " ")) > 5) | F.contains(t, F.lit("?")) | F.regexp_like(t, F.lit(f"^(?:{'|'.join(REQUESTS)})"))


def expanded(s: Column) -> Column:
    """Amounts in lakh and crore as plain numbers; each is met by its place, so that built-ins can multiply it."""
    pattern = r"(?i)(\d+(?:\.\d+)?)\s*(lakhs?|lacs?|crores?|cr)\b"
    found = F.regexp_extract_all(s, F.lit(pattern), F.lit(0))
    between = F.split(F.regexp_replace(s, pattern, "\u0001"), "\u0001")

    def amount(x: Column) -> Column:
        factor = F.when(F.regexp_like(x, F.lit(r"(?i)\dcr|\scr")), F.lit(10_000_000)).otherwise(F.lit(100_000))
        return F.round(F.regexp_extract(x, r"^\d+(?:\.\d+)?", 0).cast("double") * factor).cast("long").cast("string")

    return F.concat(F.get(between, F.lit(0)), F.array_join(F.transform(found, lambda x, i: F.concat(amount(x), F.get(between, i + 1))), ""))


def numbers_supported(claim: Column, quote: Column) -> Column:
    """Every number of a claim is in its quote, as written or as a plain number."""
    shown = F.array_union(text.numbers(quote), text.numbers(expanded(quote)))
    return F.size(F.array_except(text.numbers(expanded(claim)), shown)) == 0


def formatting_key(s: Column) -> Column:
    """What is left of a line if only its make-up is taken away: letters, digits, currency, %, and marks next to a digit or %."""
    return F.lower(F.regexp_replace(F.regexp_replace(s, r"(?<![\d%])[^\p{L}\p{N}\p{Sc}%\s](?![\d%])", ""), r"(?U)\s+", ""))


def snippet(s: Column, limit: int = 300) -> Column:
    """The first characters on a word's end, where one is near."""
    flat = text.squeeze(F.coalesce(s, F.lit("")))
    cut = F.left(flat, F.lit(limit))
    word = F.regexp_extract(cut, r"^(.*) [^ ]*$", 1)
    cut = F.when(F.length(word) > limit * 0.6, word).otherwise(cut)
    return F.when(F.length(flat) <= limit, flat).otherwise(F.concat(F.regexp_replace(cut, "[ ,;:]+$", ""), F.lit("…")))


def clip(s: Column, n: int) -> Column:
    flat = text.squeeze(F.coalesce(s, F.lit("")))
    return F.when(F.length(flat) <= n, flat).otherwise(F.concat(F.left(flat, F.lit(n - 1)), F.lit("…")))


def or_query(query: Column, most: int = 12) -> Column:
    """Quoted phrases first, then single terms, joined by or; null if there is nothing to look for."""
    quoted = F.regexp_extract_all(query, F.lit('"([^"]{2,80})"'), F.lit(1))
    phrases = F.filter(F.transform(quoted, lambda p: F.array_join(text.search_terms(p), " ")), lambda p: p != "")
    terms = F.array_except(text.search_terms(F.regexp_replace(query, '"([^"]{2,80})"', " ")), phrases)
    parts = F.slice(F.concat(F.transform(phrases, lambda p: F.concat(F.lit('"'), p, F.lit('"'))), terms), 1, most)
    return F.when(F.size(parts) > 0, F.array_join(parts, " or "))


def valid_email(s: Column) -> Column:
    return F.regexp_like(F.trim(s), F.lit(r"^[^@\s]+@[^@\s]+\.[^@\s]+$"))


def clean_domains(domains: Column) -> Column:
    """Without www., each once, in order."""
    clean = F.transform(domains, lambda d: F.regexp_replace(F.lower(F.trim(d)), r"^www\.", ""))
    return F.array_distinct(F.filter(clean, lambda d: d != ""))


def original_url(archived: Column) -> Column:
    """The captured URL of an archive's URL /web/{time}/{url}."""
    return F.regexp_extract(archived, r"^[a-z]+://[^/]*/web/[^/]*/(.*)$", 1)


def is_immediate(severity: Column, importance: Column) -> Column:
    return severity.isin("critical", "high") & (importance != "low")


def percent(part: Column, whole: Column) -> Column:
    """A share for display; under one in a hundred is no zero."""
    share = part * 100.0 / whole
    return F.when(F.coalesce(whole, F.lit(0)) == 0, "–").when((share > 0) & (share < 1), "<1%").otherwise(F.concat(F.round(share).cast("long").cast("string"), F.lit("%")))
