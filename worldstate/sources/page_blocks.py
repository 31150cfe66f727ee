"""A fetched page as ordered text blocks: what a reader sees, without navigation, banners, forms and footers.

Elements are judged in document order over a flat tree (html_tree), a dropped one with all below it. Blocks have a kind:
heading, paragraph, list_item, table_row (cells joined by " | ") or other (loose text). Hero copy in a header stays, a restaurant's
menu stays, and a wrapper that holds most of the page stays whatever it is called.

Spark cuts the pages into Arrow batches; a row's work sees one page. Defined cases: null and empty pages, and what is no
HTML, have no blocks and null metadata; a page is never an error.
"""

from __future__ import annotations

import re
import unicodedata
from datetime import UTC, datetime
from urllib.parse import urljoin

import pyarrow as pa
from dateutil import parser as dates
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from .html_tree import CLOSE, OPEN, TEXT, Tree, read

#: Elements and roles that never hold content.
DROPPED = frozenset(
    """script style noscript svg iframe template head link meta base input select textarea button option optgroup datalist
    nav footer aside dialog object embed canvas audio video source track map picture""".split()
)
ROLES = frozenset("navigation menu menubar contentinfo dialog alertdialog search".split())
#: Classes and ids of consent banners, of what is never content, and of menus; labels of what is none.
CONSENT = re.compile(r"cookie|consent|gdpr|onetrust|cookiebot|didomi|usercentrics|trustarc|truste-|osano|termly|iubenda")
NO_CONTENT = re.compile(
    r".*breadcrumb.*|.*newsletter.*|skip([-_].*)?|skiplink|(site|page|global|main|layout)?[-_]?footer([-_].*)?"
    r"|(modal|popup|pop-up|subscribe)([-_].*)?|(site|main|top|global|primary|mobile|header|sub|side|mega)?[-_]?(nav|navbar|navigation)([-_].*)?"
)
MENU = re.compile(r"(^|[-_])(mega|sub|dropdown|side|main|mobile)?[-_]?menu(s|bar)?($|[-_])")
LABELS = re.compile(r"breadcrumb|cookie|consent|navigation|footer")
#: Elements that no name drops; shares of links, of the page's text; sizes in characters.
SAFE = frozenset("html body main article".split())
MENU_LINKS, HEADER_LINKS, MOST_OF_PAGE, SMALL_PAGE, LEAST_HEADER, LONGEST_ROW = 0.5, 0.6, 0.6, 300, 20, 1000
#: Kinds of elements, and elements within a line.
PARAGRAPHS = "p blockquote figcaption dt dd pre address caption summary legend"
KINDS = {f"h{k}": "heading" for k in range(1, 7)} | dict.fromkeys(PARAGRAPHS.split(), "paragraph") | {"li": "list_item"}
INLINE = frozenset(
    """a abbr acronym b bdi bdo big cite code data dfn em font i img kbd label mark q rp rt ruby s samp small span strike strong
    sub sup time tt u var wbr del ins output meter progress nobr""".split()
)
SEPARATORS = re.compile(r"[|•·/\\\-–—_:;,.\s]+")
NO_WIDTH = dict.fromkeys(map(ord, "​‌‍⁠﻿­"))
#: Keys of metadata that tell when a page was published, the surest first.
DATE_KEYS = "article:published_time og:published_time og:article:published_time datepublished parsely-pub-date pubdate publishdate publish-date date dc.date dc.date.issued"

HEAD = ["title", "description", "canonical_url", "lang", "published_at"]
BLOCK = StructType([StructField("t", StringType()), StructField("k", StringType())])
PAGE = StructType([*(StructField(x, StringType()) for x in HEAD), StructField("blocks", ArrayType(BLOCK))])
#: PAGE for Arrow, and pages that are turned into it at once.
ROWS = pa.struct([*((x, pa.string()) for x in HEAD), ("blocks", pa.list_(pa.struct([("t", pa.string()), ("k", pa.string())])))])
AT_ONCE = 100


def tidy(s: str) -> str:
    """White space collapsed, characters without width gone; glyphs stay as they are."""
    return " ".join(s.translate(NO_WIDTH).split())


def label_icons(tree: Tree) -> None:
    """Icons in table cells leave what they mean behind them, as text: they are pictures, which are dropped."""
    labels: dict[int, str] = {}
    for e, tag in enumerate(tree.tags):
        if tag not in ("img", "svg"):
            continue
        above = tree.parents[e]
        while above >= 0 and tree.tags[above] not in ("td", "th"):
            above = tree.parents[above]
        if above < 0:
            continue
        own = tree.attributes[e]
        label = own.get("aria-label") or own.get("alt") or own.get("title")
        if not label and tag == "svg":
            label = next((tree.text_of(x) for x in tree.within(e) if tree.tags[x] == "title"), None)
        if label and label.strip():
            labels[tree.last[e]] = f" {label.strip()} "
    if not labels:
        return
    tokens, moved = [], []
    for k, token in enumerate(tree.tokens):
        if k in labels:
            tokens.append((TEXT, labels[k]))
        moved.append(len(tokens))
        tokens.append(token)
    if len(tree.tokens) in labels:
        tokens.append((TEXT, labels[len(tree.tokens)]))
    tree.tokens = tokens
    tree.first = [moved[k] for k in tree.first]
    tree.last = [moved[k - 1] + 1 for k in tree.last]


def is_boilerplate(tree: Tree, e: int, total: list[int], linked: list[int]) -> bool:
    tag, own = tree.tags[e], tree.attributes[e]
    if tag in SAFE:
        return False
    if own.get("role", "").strip().lower() in ROLES or own.get("aria-modal", "").lower() == "true":
        return True
    names = own.get("class", "").lower().split()
    if own.get("id", "").strip():
        names.append(own["id"].strip().lower())
    label = own.get("aria-label", "").lower()
    if any(CONSENT.search(x) or NO_CONTENT.fullmatch(x) for x in names) or LABELS.search(label):
        return True
    if tag == "a" and tidy(tree.text_of(e)).lower().startswith("skip to"):
        return True
    if any(MENU.search(x) for x in names) or "menu" in label:
        a, b = tree.first[e], tree.last[e]
        return linked[b] - linked[a] >= MENU_LINKS * (total[b] - total[a])
    return False


def dropped(tree: Tree) -> bytearray:
    """For each token whether it goes."""
    gone = bytearray(len(tree.tokens))

    def drop(e: int) -> None:
        gone[tree.first[e] : tree.last[e]] = b"\1" * (tree.last[e] - tree.first[e])

    total, linked = tree.sums()
    body = next((e for e, tag in enumerate(tree.tags) if tag == "body"), None)
    whole = total[-1] if body is None else total[tree.last[body]] - total[tree.first[body]]
    for e, tag in enumerate(tree.tags):
        a, b = tree.first[e], tree.last[e]
        if gone[a] or tag == "html":
            continue
        # a wrapper with a banner's name must not take the page with it
        veto = whole > SMALL_PAGE and total[b] - total[a] > MOST_OF_PAGE * whole
        if tag in DROPPED or (not veto and is_boilerplate(tree, e, total, linked)):
            drop(e)
    total, linked = tree.sums(gone)
    for e, tag in enumerate(tree.tags):
        if tag == "header" and not gone[tree.first[e]]:
            n = total[tree.last[e]] - total[tree.first[e]]
            links = linked[tree.last[e]] - linked[tree.first[e]]
            if not n or links >= HEADER_LINKS * n or n - links < LEAST_HEADER:
                drop(e)
    return gone


def apart(before: str, after: str) -> bool:
    """Whether two characters that meet at the edge of inline elements belong to different words or amounts."""
    if before.isspace() or after.isspace() or (after.isdigit() and (before.isdigit() or before in ".,")):
        return False
    return (before.isalnum() or before in "%)]!?.,;:") and (after.isalnum() or after in "([" or unicodedata.category(after) == "Sc")


class Line:
    """Text that grows by pieces, with a blank where the edges of inline elements meet two words."""

    def __init__(self) -> None:
        self.pieces, self.edge = [], False

    def add(self, text: str) -> None:
        if text:
            if self.edge and self.pieces and apart(self.pieces[-1][-1], text[0]):
                self.pieces.append(" ")
            self.pieces.append(text)
            self.edge = False

    def take(self) -> str:
        text = tidy("".join(self.pieces))
        self.pieces, self.edge = [], False
        return text


def row_text(tree: Tree, e: int, gone: bytearray, total: list[int]) -> str | None:
    """A table row's cells in one line; None for rows that lay out a page: tables inside, or very long."""
    below = [x for x in tree.within(e) if not gone[tree.first[x]]]
    cells = [x for x in below if tree.parents[x] == e and tree.tags[x] in ("td", "th")]
    if not cells or any(tree.tags[x] == "table" for x in below) or total[tree.last[e]] - total[tree.first[e]] > LONGEST_ROW:
        return None
    texts = []
    for cell in cells:
        line = Line()
        for k in range(tree.first[cell], tree.last[cell]):
            kind, x = tree.tokens[k]
            if gone[k]:
                continue
            if kind == TEXT:
                line.add(x)
            elif tree.tags[x] in INLINE:
                line.edge = True
            else:
                line.add(" ")
        texts.append(line.take())
    return " | ".join(filter(None, texts))


def emit(tree: Tree, gone: bytearray) -> list[tuple[str, str]]:
    """Blocks in document order, as (text, kind); separators alone and repetitions of the block before are none."""
    out: list[tuple[str, str]] = []
    line, kinds, k = Line(), ["other"], 0
    total = tree.sums(gone)[0]

    def block(text: str, kind: str) -> None:
        if text and not SEPARATORS.fullmatch(text) and not (out and out[-1][0] == text):
            out.append((text, kind))

    while k < len(tree.tokens):
        kind, x = tree.tokens[k]
        k += 1
        if gone[k - 1]:
            continue
        tag = "" if kind == TEXT else tree.tags[x]
        if kind == TEXT:
            line.add(x)
        elif tag in INLINE:
            line.edge = True
        elif tag == "br":
            if kind == OPEN:
                line.add(" ")
        elif kind == CLOSE:
            block(line.take(), kinds.pop())
        else:
            block(line.take(), kinds[-1])
            row = row_text(tree, x, gone, total) if tag == "tr" else None
            if row is None:
                kinds.append(KINDS.get(tag, "other"))
            else:
                block(row, "table_row")
                k = tree.last[x]
    block(line.take(), kinds[-1])
    return out


def moment(s: str | None) -> str | None:
    """ISO time in UTC of a date as pages write them, or None."""
    try:
        found = dates.parse(s.strip()) if s and s.strip() else None
        if found is None:
            return None
        found = found.replace(tzinfo=UTC) if found.tzinfo is None else found.astimezone(UTC)
    except (ValueError, OverflowError, TypeError):
        return None
    return found.strftime("%Y-%m-%dT%H:%M:%SZ") if isinstance(found, datetime) else None


def metadata(tree: Tree, url: str | None) -> dict[str, str | None]:
    """Title, description, canonical address, language and time of publication, as the page's head tells them."""
    titles, values, canonical = [], {}, None
    for e, (tag, own) in enumerate(zip(tree.tags, tree.attributes, strict=True)):
        if tag == "title":
            above = set()
            at = tree.parents[e]
            while at >= 0:
                above.add(tree.tags[at])
                at = tree.parents[at]
            if "svg" not in above:
                titles.append(("head" not in above, e))
        elif tag == "meta":
            key = (own.get("property") or own.get("name") or own.get("itemprop") or "").strip().lower()
            if key and own.get("content", "").strip():
                values.setdefault(key, own["content"].strip())
        elif tag == "link" and canonical is None and "canonical" in own.get("rel", "").lower().split() and own.get("href", "").strip():
            try:
                canonical = urljoin(url or "", own["href"].strip())
            except ValueError:
                canonical = own["href"].strip()
    title = tidy(tree.text_of(min(titles)[1])) if titles else ""
    root = tree.attributes[0] if tree.tags[:1] == ["html"] else {}
    return {
        "title": title or values.get("og:title") or values.get("twitter:title"),
        "description": values.get("description") or values.get("og:description"),
        "canonical_url": canonical,
        "lang": (root.get("lang") or root.get("xml:lang") or "").strip() or None,
        "published_at": next(filter(None, (moment(values.get(key)) for key in DATE_KEYS.split())), None),
    }


def extract(html: str | None, url: str | None = None) -> dict:
    """One page: its metadata and blocks."""
    tree = read(html or "")
    found = metadata(tree, url)
    label_icons(tree)
    return found | {"blocks": [{"t": t, "k": k} for t, k in emit(tree, dropped(tree))]}


@F.arrow_udf(PAGE)
def page(html: pa.Array, url: pa.Array) -> pa.Array:
    """PAGE for html and the url that it came from; only some pages of a batch are Python's objects at a time."""
    out = [pa.array([], ROWS)]
    for at in range(0, len(html), AT_ONCE):
        found = zip(html[at : at + AT_ONCE], url[at : at + AT_ONCE], strict=True)
        out.append(pa.array([extract(h.as_py(), u.as_py()) for h, u in found], ROWS))
    return pa.concat_arrays(out)


def with_page(df: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """df with page, its metadata and blocks."""
    return df.withColumn("page", page(F.col(html), F.col(url)))


def page_text(of: Column) -> Column:
    """The blocks' texts, a line each."""
    return F.array_join(F.transform(of["blocks"], lambda b: b["t"]), "\n")


def words(of: Column) -> Column:
    text = page_text(of)
    return F.when(text == "", 0).otherwise(F.size(F.split(text, "[ \n]"))).cast("long")
