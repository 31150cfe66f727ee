"""HTML extraction by equivalence classes of tokens over the pages of a host.

A page is a sequence of tokens: its tags with their path and class attribute, and its text blocks with their path. A
token's occurrence vector has its count on each distinct page of the host; the first of a page's equal tags is a token of
its own too, as it may have another role than the rest. Tokens with one vector form an equivalence
class. A class is valid if it is on three pages or more and holds tags and texts; it need not be on every page. On each
page that holds it, its tokens must come in the class's order, and those of its texts that nest below a tag of its own are
template. What the template doesn't hold are slots, and these are extracted:
all blocks of slots whose path has no boilerplate role (menu, header, footer, sidebar, notice, advert, form,
script, style, reader comments); see _flagged() for what a role reaches. Where a page has an article or main element, its slots are those inside. A page
that the template would empty by over half of such text is a near copy of others, so its texts are content.

Vectors are compared by a sum of hashes over pages, added up by (host, token) with partial aggregation: no
group of pages is ever gathered, however hot the host, and no html moves. The template is broadcast up to
TEMPLATE_ROWS tokens; beyond, each page's tokens meet it in a shuffle join.

Defined cases: null or empty html gives an empty text and no characters; broken markup (unclosed, crossed or
unquoted) is read as browsers do, roughly; null or hostless urls form one host; pages without a token are on no class; repeated rows count as one page
of a template and are all extracted; an empty table gives no rows; further columns stay, unless named as the results.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape
from itertools import pairwise

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Pages that must hold a class; template tokens that are broadcast at most.
LEAST_PAGES, TEMPLATE_ROWS = 3, 200_000
#: Fixed value: what turns a tag's token into that of its first occurrence on a page.
FIRST = 0x5851F42D4C957F2D

#: Elements whose content is no text of the page, boilerplate elements, and elements that stay within a line.
RAW = "script style noscript template iframe svg select textarea title object math canvas audio video".split()
BOILERPLATE = set("nav header footer aside form menu dialog button label fieldset head".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = set("navigation banner contentinfo complementary search form alert dialog menu menubar toolbar".split())
#: Words of a class or id that mark boilerplate.
MARKS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|sponsor(?:ed|s)?|promos?|banners?|cookies?|consent|gdpr|notices?|popups?|modals?|newsletter|subscribe|side-?bar|menus?|nav|navbar|navigation|breadcrumbs?|footers?|masthead|site-?header|page-?header|top-?bar|comments?|disqus|replies|respond|related|share|sharing|social|widgets?|toolbar|pagination|pager)(?:$|[\s_-])",
    re.I,
)
TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(?P<raw>{'|'.join(RAW)})\b[^>]*>.*?(?:</(?P=raw)\s*>|\Z)|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?/][^>]*>", re.S | re.I)
ATTRIBUTE = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|aria-label)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
#: End tags that may be left out, as a new one of the kind ends the former.
ENDS_ITSELF = set("p li dt dd option tr td th".split())


#: What flags an element's text: nothing, its element or role, a word of its class or id, or that it is not shown.
CLEAN, ELEMENT, MARK, HIDDEN = range(4)


def _flag(tag: str, rest: str, inside: bool) -> int:
    found = {k.lower(): v.strip("\"'") for k, v in ATTRIBUTE.findall(rest)} if rest else {}
    if "hidden" in found or found.get("aria-hidden") == "true":
        return HIDDEN
    if tag in BOILERPLATE and not (inside and tag == "header") or found.get("role", "").lower() in ROLES:
        return ELEMENT
    if tag == "article" and re.search(r"\bcomment", found.get("class", ""), re.I):
        return ELEMENT
    return MARK if tag not in ("html", "body", "main", "article") and any(MARKS.search(found.get(k, "")) for k in ("class", "id")) else CLEAN


def _class(rest: str) -> str:
    return next((v.strip("\"'") for k, v in ATTRIBUTE.findall(rest) if k.lower() == "class"), "") if rest else ""


def tokens(html: str) -> list[tuple[str, str | None, bool, bool, str]]:
    """(path, text or None for a tag, boilerplate, inside an article or main element, a tag's class attribute) of each token in order."""
    out: list[tuple[int, str, str | None, str]] = []  # node, path, text, class attribute
    nodes: list[list] = [[0, "", "", CLEAN, False, False]]  # parent, tag, path, flag, inside, closed by its end tag
    stack = [0]
    parts: list[str] = []

    def end_block() -> None:
        if parts and (text := " ".join(unescape("".join(parts)).split())):
            end_head()
            out.append((stack[-1], nodes[stack[-1]][2], text, ""))
        parts.clear()

    def end_head() -> None:
        """Anything but metadata ends an open head, whose end tag may be left out."""
        for k in range(1, len(stack)):
            if nodes[stack[k]][1] == "head":
                del stack[k:]
                break

    at = 0
    for m in TOKEN.finditer(html):
        if m.start() > at:
            parts.append(html[at : m.start()])
        at = m.end()
        tag = (m["tag"] or "").lower()
        if not tag:
            continue
        if tag in INLINE:
            continue
        end_block()
        if m["close"]:
            for k in range(len(stack) - 1, 0, -1):
                if nodes[stack[k]][1] == tag:
                    nodes[stack[k]][5] = True
                    del stack[k:]
                    break
            continue
        if tag in EMPTY:
            continue
        end_head()
        if tag in ENDS_ITSELF and nodes[stack[-1]][1] == tag:
            stack.pop()
        above = nodes[stack[-1]]
        nodes.append([stack[-1], tag, f"{above[2]}/{tag}", _flag(tag, m["rest"], above[4]), above[4] or tag in ("article", "main"), False])
        stack.append(len(nodes) - 1)
        out.append((stack[-1], nodes[-1][2], None, _class(m["rest"])))
    parts.append(html[at:])
    end_block()
    bad = _flagged(nodes, out)
    return [(path, text, bad[node], nodes[node][4], name) for node, path, text, name in out]


def _flagged(nodes: list[list], out: list[tuple[int, str, str | None, str]]) -> list[bool]:
    """Which nodes are boilerplate, by their own flag or one above.

    An article or main element starts anew, unless it is flagged itself or not shown. A class or id, a form and an
    element without its end tag flag nothing if an article or main element, or most of the page's text, is below.
    """
    n = len(nodes)
    if not any(x[3] for x in nodes):
        return [False] * n
    holds = [x[1] in ("article", "main") for x in nodes]
    size = [0] * n
    for node, _, text, _ in out:
        size[node] += len(text or "")
    # text that an element surely flags is no part of the page's text; node numbers grow downwards
    sure = [x[3] == HIDDEN or x[3] == ELEMENT and x[5] and x[1] != "form" for x in nodes]
    for k in range(n - 1, 0, -1):
        up = nodes[k][0]
        holds[up] = holds[up] or holds[k]
        size[up] += 0 if sure[k] else size[k]
    bad, unseen = [False] * n, [False] * n
    for k in range(1, n):
        up, tag, _, flag, _, _ = nodes[k]
        own_article = tag in ("article", "main")
        if flag and not sure[k] and not own_article and (holds[k] or 2 * size[k] > size[0]):
            flag = CLEAN
        unseen[k] = unseen[up] or flag == HIDDEN
        bad[k] = unseen[k] or flag != CLEAN or bad[up] and not own_article
    return bad


def token_id(path: str, text: str | None, name: str = "") -> int:
    return int.from_bytes(blake2b(f"{path}\0{name if text is None else text}".encode(), digest_size=8, salt=b"tag" if text is None else b"text").digest(), "big", signed=True)


Template = dict[int, tuple[int, int]]


def template_texts(found: list[tuple[str, str | None, bool, bool, str]], template: Template) -> set[int]:
    """Which of a page's tokens are texts of a class that is in order and nests them below a tag of its own."""
    known = []
    places: dict[int, dict[int, None]] = {}
    tags: dict[int, set[str]] = {}
    for path, text, _, _, name in found:
        token = token_id(path, text, name)
        known.append(template.get(token))
        for own in (known[-1], template.get(token ^ FIRST)) if text is None else known[-1:]:
            if own:
                places.setdefault(own[0], {}).setdefault(own[1])
                if text is None:
                    tags.setdefault(own[0], set()).add(path)
    ordered = {c for c, seen in places.items() if all(a < b for a, b in pairwise(seen))}
    out = set()
    for i, ((path, text, *_), own) in enumerate(zip(found, known, strict=True)):
        if own and text is not None and own[0] in ordered and (above := tags.get(own[0])):
            ends = [k for k, x in enumerate(path) if x == "/"][1:] + [len(path)]
            if any(path[:k] in above for k in ends):
                out.add(i)
    return out


def main_text(html: str | None, template: Template | None = None) -> str:
    """The blocks of the slots that hold the article, joined by line ends."""
    every = tokens(html or "")
    fixed = template_texts(every, template) if template else set()
    found = [(text, inside, i in fixed) for i, (_, text, bad, inside, _) in enumerate(every) if text is not None and not bad]
    inside = [x for x in found if x[1]] or found
    slots = [x for x in inside if not x[2]]
    if 2 * sum(len(x[0]) for x in slots) < sum(len(x[0]) for x in inside):
        slots = inside
    return "\n".join(x[0] for x in slots)


def template(pages: DataFrame) -> DataFrame:
    """(host, class, token, place) of the classes of each host that hold tags and texts; pages: host, html."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for host, html in zip(batch["host"], batch["html"], strict=True):
                page = int.from_bytes(blake2b(html.encode(), digest_size=8).digest(), "big", signed=True)
                seen: dict[int, list] = {}
                for at, (path, text, _, _, name) in enumerate(tokens(html)):
                    seen.setdefault(token_id(path, text, name), [host, text is None, at, 0])[3] += 1
                rows += [(host, token, is_tag, page, at, n) for token, (host, is_tag, at, n) in seen.items()]
                rows += [(host, token ^ FIRST, True, page, at, 1) for token, (host, is_tag, at, n) in seen.items() if is_tag]
            yield pd.DataFrame(rows, columns=["host", "token", "is_tag", "page", "at", "n"])

    hashed = pages.select(F.xxhash64("host").alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    counted = hashed.mapInPandas(count, "host long, token long, is_tag boolean, page long, at int, n int").distinct()
    part = F.xxhash64("page", "n").cast("decimal(38,0)")
    # tokens of a class are on the same pages, so all of them have their place on the same one of these
    vectors = counted.groupBy("host", "token", "is_tag").agg(F.count("*").alias("pages"), F.min(F.struct("page", "at")).alias("first"), F.sum(part).alias("class"))
    vectors = common.stored(vectors.where(F.col("pages") >= LEAST_PAGES), "vectors")
    valid = vectors.groupBy("host", "class").agg(F.bool_or("is_tag").alias("tags"), F.bool_and("is_tag").alias("only")).where("tags and not only")
    return vectors.join(valid, ["host", "class"], "left_semi").select("host", "class", "token", F.col("first.at").alias("place"))


def extract(df: DataFrame, url: str = "url", html: str = "html", template_rows: int = TEMPLATE_ROWS) -> DataFrame:
    """df with text, the main text of each page, and n_chars, its code points."""
    spark = df.sparkSession
    host = F.coalesce(common.ascii_lower(F.regexp_extract(F.col(url), r"://([^/?#]*)", 1)), F.lit(""))
    pages = df.drop("text", "n_chars").withColumns({"_host": F.xxhash64(host), "_html": F.coalesce(F.col(html), F.lit(""))})
    found = common.stored(template(pages.select(host.alias("host"), F.col("_html").alias("html"))), "template")
    if found.limit(template_rows + 1).count() <= template_rows:
        tables: dict[int, Template] = {}
        for h, t, c, at in found.select("host", "token", F.xxhash64("class"), "place").collect():
            tables.setdefault(h, {})[t] = (c, at)
        shared = spark.sparkContext.broadcast(tables)

        @F.pandas_udf("string")
        def text_of(hosts: pd.Series, whole: pd.Series) -> pd.Series:
            known = shared.value
            return pd.Series([main_text(x, known.get(h)) for h, x in zip(hosts, whole, strict=True)])

        out = pages.withColumn("text", text_of("_host", "_html"))
    else:

        @F.pandas_udf("string")
        def text_with(own: pd.Series, whole: pd.Series) -> pd.Series:
            return pd.Series([main_text(x, None if t is None else {r["token"]: (r["class"], r["place"]) for r in t}) for t, x in zip(own, whole, strict=True)])

        # a host's template is as large as its pages' frames; hosts are many, each of them small
        by_host = found.groupBy("host").agg(F.collect_set(F.struct("token", F.xxhash64("class").alias("class"), "place")).alias("_own")).withColumnRenamed("host", "_host")
        out = pages.join(by_host, "_host", "left").withColumn("text", text_with("_own", "_html")).drop("_own")
    return out.drop("_host", "_html").withColumn("n_chars", F.length("text").cast("long"))


def op7_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
