"""URL functions that are built-in expressions throughout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Query parameters that only track a visit; besides, all that begin with utm_.
TRACKING = "gclid fbclid mc_cid mc_eid ref_src igshid msclkid dclid gbraid wbraid yclid twclid _hsenc _hsmi mkt_tok".split()


#: A documented subset of the public suffixes of two labels or more, as a pattern: second levels of country domains by their
#: usual names, and sites below which anyone can register.
SUFFIXES = r"(?:co|com|org|net|gov|ac|edu|ne|or|go|gob|gouv|mil|sch|nic|ltd|plc|me|firm|gen|ind|res)\.[a-z]{2}|github\.io|gitlab\.io|blogspot\.com|herokuapp\.com|netlify\.app|vercel\.app|pages\.dev|web\.app|appspot\.com|wordpress\.com"


def host_of(url: Column) -> Column:
    """Lower-case host without port, user and final dot; the scheme may be absent."""
    rest = F.regexp_replace(F.trim(url), r"^[a-zA-Z][a-zA-Z0-9+.-]*://|^//", "")
    authority = F.regexp_extract(rest, r"^(?:[^/?#@]*@)?(\[[^\]/?#]*\]|[^/?#:]*)", 1)
    authority = F.regexp_replace(authority, r"^\[|\]$", "")
    return F.regexp_replace(F.lower(authority), r"\.$", "")


def path_of(url: Column) -> Column:
    """Path without its last slash."""
    rest = F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", "")
    return F.regexp_replace(F.regexp_extract(rest, r"^([^?#]*)", 1), r"/$", "")


def registrable_domain(url: Column) -> Column:
    """The last two labels of a host, three below one of SUFFIXES; numbers and single labels stay."""
    host = host_of(url)
    deep = F.regexp_extract(host, rf"([^.]+\.(?:{SUFFIXES}))$", 1)
    flat = F.regexp_extract(host, r"([^.]+\.[^.]+)$", 1)
    return F.when(host.rlike(r"^[0-9.]+$|:"), host).when(deep != "", deep).when(flat != "", flat).otherwise(host)


def domain_matches(url: Column, domains: list[str]) -> Column:
    """The host is one of the domains or lies below one."""
    host = host_of(url)
    wanted = F.array(*(F.lit(d.lower().removeprefix("www.")) for d in domains))
    return F.exists(wanted, lambda d: (host == d) | F.endswith(host, F.concat(F.lit("."), d)))


def canonical(url: Column) -> Column:
    """Of a trimmed url: lower-case scheme and host, no default port, fragment or tracking parameters, parameters sorted by name, / for an empty path."""
    url = F.trim(url)
    scheme = F.lower(F.regexp_extract(url, r"^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    authority = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    port = F.when(scheme == "https", ":443").otherwise(":80")
    authority = F.when(F.endswith(authority, port), F.regexp_replace(authority, r":(?:80|443)$", "")).otherwise(authority)
    path = F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    name = lambda p: F.substring_index(p, "=", 1)
    plain = lambda p: F.lower(F.coalesce(F.try_url_decode(name(p)), name(p)))
    kept = F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.startswith(plain(p), F.lit("utm_")) & ~plain(p).isin(TRACKING))
    # a stable sort by name: the place breaks ties
    keyed = F.array_sort(F.transform(kept, lambda p, i: F.struct(name(p).alias("n"), i.alias("i"), p.alias("p"))))
    args = F.array_join(F.transform(keyed, lambda x: x["p"]), "&")
    whole = F.concat(scheme, F.lit("://"), authority, F.when(path == "", "/").otherwise(path), F.when(args == "", "").otherwise(F.concat(F.lit("?"), args)))
    return F.when(scheme == "", url).otherwise(whole)
