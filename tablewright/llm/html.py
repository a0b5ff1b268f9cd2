"""Operator 7: HTML extraction by differencing pages of nearest URL.

Pages of a host are ordered by URL path; a page's partner is its neighbour with the longer
common path prefix. Text lines of both are aligned by longest common subsequence and shared
lines are deleted as template; a copy says nothing, then the other neighbour is the partner.
Every page is differenced. If most of what is left lies inside ``article`` or ``main``
elements, the markup is confirmed and protects all their lines, repeated ones included; if
not, what differencing left is the article. Lines in menus, forms, scripts and their like
never count.
"""

from __future__ import annotations

import html as html_lib
import re
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import pairwise

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablewright.llm.common import Ranges, partitions, plain_text, rows_in_arrow

#: A page that shares more of its text than this with its partner needs the other neighbour too.
COPY_SHARE = 0.8
#: What two pages have for themselves is compared by word pairs from so many words on.
PAIR_WORDS = 20

# Fixed values of the HTML standard: element kinds.
_RAW = {"script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCK = {"address", "article", "aside", "blockquote", "body", "br", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
          "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
          "li", "main", "menu", "nav", "ol", "option", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "title", "tr", "ul"}
_CONTENT = {"article", "main"}
_NEVER = {"aside", "button", "dialog", "footer", "form", "head", "iframe", "menu", "nav", "noscript", "object", "script", "select", "style",
          "svg", "template", "textarea", "title", "xmp", "noembed", "noframes", "canvas", "audio", "video"}
# Names that sites give to what is not the article.
_NAMES = {"ad", "ads", "adslot", "advert", "advertisement", "adverts", "alert", "banner", "breadcrumb", "breadcrumbs", "comment", "comments",
          "consent", "cookie", "cookies", "disqus", "footer", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
          "pagination", "pager", "popup", "promo", "promoted", "related", "reply", "respond", "search", "share", "sharing", "sidebar", "signup",
          "social", "sponsor", "sponsored", "subscribe", "subscription", "toolbar", "widget"}
_HEADS = {"header", "masthead"}
_ROLES = {"alert", "alertdialog", "banner", "complementary", "contentinfo", "dialog", "form", "menu", "menubar", "navigation", "search"}

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

TEMPLATE, PLAIN, CONTENT = 0, 1, 2


def _unwanted(tag: str, attributes: str, in_content: bool) -> bool:
    """Whether an element is declared to be something else than the article."""
    if tag in _NEVER or (tag == "header" and not in_content):
        return True
    if not attributes or attributes.isspace():
        return False
    found = {m[1].lower(): html_lib.unescape(next((v for v in m.groups()[1:] if v is not None), "")) for m in _ATTRIBUTE.finditer(attributes)}
    if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDDEN.search(found.get("style", "")):
        return True
    if tag in ("html", "body") or tag in _CONTENT:
        return False
    if found.get("role", "").lower() in _ROLES:
        return True
    names = _NAMES if in_content else _NAMES | _HEADS
    for name in f"{found.get('class', '')} {found.get('id', '')}".lower().split():
        parts = re.split(r"[-_]+", name)
        if parts[0] not in ("has", "no", "with", "without", "is") and (parts[0] in names or parts[-1] in names):
            return True
    return False


def page_lines(page: str) -> list[tuple[str, int]]:
    """Text lines (one a block, white space folded) with TEMPLATE, PLAIN or CONTENT."""
    lines: list[tuple[str, int]] = []
    pieces: list[str] = []
    stack: list[tuple[str, int]] = []            # open elements and what their text is
    state, at = PLAIN, 0

    def flush() -> None:
        if pieces:
            text = " ".join("".join(pieces).split())
            pieces.clear()
            if text:
                lines.append((text, state))

    end = len(page)
    while at < end:
        token = _TOKEN.search(page, at)
        if token is None:
            pieces.append(html_lib.unescape(page[at:]))
            break
        if token.start() > at:
            pieces.append(html_lib.unescape(page[at:token.start()]))
        at = token.end()
        closing, tag, attributes = (token[1], token[2], token[3]) if token[2] else (token[4], token[5], token[6])
        if not tag:
            continue
        tag = tag.lower()
        if tag in _BLOCK:
            flush()
        elif tag in ("td", "th"):
            pieces.append(" ")
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == tag:
                    if any(s != (stack[k - 1][1] if k else PLAIN) for _, s in stack[k:]):
                        flush()
                    del stack[k:]
                    state = stack[-1][1] if stack else PLAIN
                    break
            continue
        if tag in _VOID or attributes.endswith("/") and tag in ("svg", "path"):
            continue
        if tag == "p" and stack and any(t == "p" for t, _ in stack):      # a paragraph ends the one before
            k = max(i for i, (t, _) in enumerate(stack) if t == "p")
            if all(t not in _BLOCK for t, _ in stack[k + 1:]):
                del stack[k]
                state = stack[-1][1] if stack else PLAIN
        now = state
        if state != TEMPLATE:
            if _unwanted(tag, attributes, state == CONTENT):
                now = TEMPLATE
            elif tag in _CONTENT:
                now = CONTENT
        if now != state:
            flush()
        stack.append((tag, now))
        state = now
        if tag in _RAW:
            close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(page, at)
            stop = close.start() if close else end
            if tag in ("title", "textarea"):
                pieces.append(html_lib.unescape(page[at:stop]))
                flush()
            at = stop
    flush()
    return lines


def shared_lines(a: list[str], b: list[str]) -> set[int]:
    """Places in ``a`` of a longest common subsequence with ``b``, bit-parallel."""
    places: dict[str, int] = {}
    for i, line in enumerate(a):
        places[line] = places.get(line, 0) | (1 << i)
    full = (1 << len(a)) - 1
    row, rows = full, []
    for line in b:
        hit = row & places.get(line, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    found: set[int] = set()
    i, j = len(a), len(b)
    while i and j:
        if rows[j - 1] >> (i - 1) & 1:
            i -= 1
        else:
            j -= 1
            if not j or rows[j - 1] >> (i - 1) & 1:
                i -= 1
                found.add(i)
    return found


def _differ(page: list[tuple[str, int]], other: list[tuple[str, int]], shared: set[int]) -> bool:
    """Whether two pages tell different things: what either has for itself is no edit of the other's."""
    there = shared_lines([t for t, _ in other], [t for t, _ in page])
    own = [w for i, (t, kind) in enumerate(page) if kind != TEMPLATE and i not in shared for w in t.split()]
    others = [w for i, (t, kind) in enumerate(other) if kind != TEMPLATE and i not in there for w in t.split()]
    if min(len(own), len(others)) >= PAIR_WORDS:                 # long texts of a language share many single words
        own, others = list(pairwise(own)), list(pairwise(others))
    return bool(own and others) and 2 * (Counter(own) & Counter(others)).total() < min(len(own), len(others))


def template_lines(lines: list[tuple[str, int]], neighbours: Sequence[list[tuple[str, int]]]) -> set[int]:
    """Places of lines that neighbours telling something else have too; copies are passed over.

    The nearest neighbour decides. If it has nearly all of the page, that may be a short text
    in a long template or the same text beside other links, so the next one must agree.
    """
    found = [shared_lines([t for t, _ in lines], [t for t, _ in other]) for other in neighbours]
    found = [shared for other, shared in zip(neighbours, found) if _differ(lines, other, shared)]
    if not found:
        return set()
    sizes = {i: len(t) for i, (t, kind) in enumerate(lines) if kind != TEMPLATE}
    most = sum(n for i, n in sizes.items() if i in found[0]) > COPY_SHARE * sum(sizes.values())
    if most and len(found) == 1:
        return {i for i in found[0] if lines[i][1] != CONTENT}
    return set.intersection(*found) if most else found[0]


def main_text(lines: list[tuple[str, int]], *neighbours: list[tuple[str, int]] | None) -> str:
    """The article of a page beside its neighbours' lines, the nearest first.

    What differencing leaves is the article. If most of that is declared, the markup is right about
    the page: its declared lines are the article, with those that neighbours repeat.
    """
    shared = template_lines(lines, [x for x in neighbours if x])
    left = [(t, kind) for i, (t, kind) in enumerate(lines) if kind != TEMPLATE and i not in shared]
    declared = sum(len(t) for t, kind in left if kind == CONTENT)
    if declared and 2 * declared >= sum(len(t) for t, _ in left):
        left = [(t, kind) for t, kind in lines if kind == CONTENT]
    return "\n".join(t for t, _ in left)


def _alike(a: str, b: str) -> int:
    """Length of the common prefix of two paths."""
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    return low


def extract(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` of every page, from its whole html.

    A NULL or empty html gives an empty text; a NULL url is a host of its own; a page alone on
    its host has no partner; repeated rows are partners of each other and stay. Equal paths
    are ordered by url and page_id, of two neighbours alike the earlier is the partner. An
    unclosed comment or script runs to the end of the page. Other columns are not read.
    """
    n = partitions(pages.sparkSession)
    url = plain_text("url")
    host = F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1))
    path = F.regexp_replace(F.regexp_replace(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*", ""), r"[?#].*$", "")
    source = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), host.alias("host"), path.alias("path"), plain_text("html").alias("html"))
    key = F.concat_ws("\u0001", "host", "path", plain_text("url"), F.lpad(plain_text(F.col("page_id").cast("string")), 20, "0"))
    ranges = Ranges(source, key, 2 * n)
    dealt = ranges.with_guests(source.withColumn("key", key), F.col("key"), before=True, after=True)
    order = F.when(F.col("guest") == -1, 0).when(F.col("guest") == 0, 1).otherwise(2)
    dealt = dealt.repartition(n, "range").sortWithinPartitions("range", order, "key", "html")

    def articles(rows: Iterator[tuple]) -> Iterator[tuple]:
        held: list[tuple] = []           # up to three neighbours: (range, host, path, id, url, guest, lines)

        def done(before, page, after):
            near = [x for x in (before, after) if x is not None and x[:2] == page[:2]]
            near.sort(key=lambda x: -_alike(x[2], page[2]))
            text = main_text(page[6], *(x[6] for x in near))
            return page[3], page[4], text, len(text)

        for page_id, url, host, path, page, place, guest in rows:
            held.append((place, host, path, page_id, url, guest, page_lines(page)))
            if len(held) == 3:
                if not held[1][5]:
                    yield done(*held)
                del held[0]
            elif len(held) == 2 and not held[0][5]:
                yield done(None, *held)
        if held and not held[-1][5]:
            yield done(held[-2] if len(held) > 1 else None, held[-1], None)

    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
    run = rows_in_arrow(articles, schema, ["page_id", "url", "host", "path", "html", "range", "guest"], batch_rows=512)
    return dealt.select("page_id", "url", "host", "path", "html", "range", "guest").mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
