"""Main text of web pages by a maximum-scoring run of words and tags.

A page is a sequence of words (positive) and tags (negative). The weight of a word follows from the element it stands in,
that of a tag from its name; both are log-odds of lying inside or outside the article, counted on labelled pages:
pages of a bounded sample (``LABELLED``) that mark exactly one ``article`` element. One linear scan finds the contiguous run with the
highest sum. A run inside an ``article`` or ``main`` element grows to the outermost such element around it, else to whole blocks.

What is never text is left out before: scripts, styles, head, comments in markup. Menus, headers and footers of the page, sidebars,
notices, adverts, forms and reader comments are noise, by element or by a whole name in ``class``, ``id`` or ``role``. What holds an
``article`` or ``main`` is not noise by such a name, nor is a heading; an ``id`` counts on a ``div`` or list only, as it often is the slug of a
title. Noise counts nothing while there is other text; on a page without other text it is scored like the rest, at a price per element.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined by a line
feed; a line break (``br``) is white space. Defined cases: null, empty and textless pages give an empty text; unclosed
elements end with their parent, a script or comment without an end takes the rest of the page; a ``<`` that opens no tag is text;
without labelled pages equal default weights are used. Repeated pages are extracted each; other columns are not read.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenframe.llm import arrays as A

LABELLED = 2000

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>",
    re.S,
)
#: Start of a tag that never ends: the rest of a cut page.
OPEN_END = re.compile(r"<(?:/?[a-zA-Z]|!--)[^<>]*\Z")
ATTRIBUTE = re.compile(r"""([^\s"'=/>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
PART = re.compile(r"[-_]+")
RAW = {"script", "style", "noscript", "textarea", "title", "template", "iframe", "xmp", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
SKIP = {"head", "svg", "canvas", "audio", "video", "select", "button", "datalist"} | RAW
#: Elements that are noise; those of FRAMES are not where they hold an article.
ASIDE = {"nav", "aside", "footer", "menu", "dialog"}
FRAMES = {"form", "fieldset"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark",
          "label", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr",
          "math", "mrow", "mi", "mn", "mo", "ms", "mtext", "mspace", "msub", "msup", "msubsup", "mfrac", "msqrt", "mroot", "munder", "mover",
          "munderover", "mtable", "mtr", "mtd", "mstyle", "mpadded", "mphantom", "semantics", "annotation"}
#: Names in class, id or role that mark what is not the article.
NOISE = {"ad", "ads", "adv", "advert", "adverts", "advertisement", "advertising", "banner", "sponsor", "sponsored", "promo", "promotion",
         "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "sidebar", "aside", "widget", "footer", "header", "masthead",
         "cookie", "cookies", "consent", "notice", "gdpr", "popup", "modal", "overlay", "comment", "comments", "disqus", "reply", "replies",
         "respond", "share", "sharing", "social", "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login",
         "search", "contentinfo", "complementary", "pagination", "pager", "toolbar", "alert", "site-header", "site-footer", "page-footer",
         "main-nav", "site-nav", "comments-area", "related-posts", "related-articles", "share-buttons", "social-links", "ad-container", "ad-slot"}
#: Of these, names that inside an article mark parts of its own: the title, a remark.
OWN = {"header", "masthead", "banner", "notice", "alert", "overlay"}
COMMENTS = {"comment", "comments", "comments-area", "disqus", "reply", "replies", "respond"}
#: Price of a noise element on a page without other text, in words.
PRICE = 20.0
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: An open element of this kind is closed by the next one of the kinds listed.
ENDS = {"p": {"p", "div", "ul", "ol", "h1", "h2", "h3", "h4", "h5", "h6", "table", "section", "article", "aside", "footer", "header", "form", "nav",
              "pre", "blockquote", "dl", "figure", "main", "hr", "address", "details", "fieldset", "menu"},
        "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HOLDERS = {"article", "main"}


def _named(name: str, attributes: str, inside: bool) -> list[str]:
    """The parts of the first whole name in class, id or role of which all are names of noise."""
    if not attributes or name in HOLDERS or name in HEADINGS or name in ("html", "body"):
        return []
    found = {}
    for key, value in ATTRIBUTE.findall(attributes):
        found.setdefault(key.lower(), value.strip("\"'").lower().split())
    names = found.get("class", []) + found.get("role", [])
    if name in ("div", "ul", "ol") and "section" not in names:
        names += found.get("id", [])
    for n in names:
        parts = [n] if n in NOISE else [p for p in PART.split(n) if p]
        if parts and all(p in NOISE for p in parts) and not (inside and any(p in OWN for p in parts)):
            return parts
    return []


def tokens(page: str):
    """Pieces ``(kind, value, element, holders, block, noise)`` of a page without what is never text.

    ``kind`` is ``text`` or ``tag``; ``holders`` numbers the article and main elements around, the outermost first;
    ``block`` numbers the block a text belongs to; ``noise`` numbers the outermost noise element around, 0 for none.
    """
    out, stack, at, skip = [], [], 0, 0  # stack: (name, skipped, holders around, marks around)
    holders, block, end, mark, freed = 0, 0, len(page), 0, set()
    cut = OPEN_END.search(page)
    if cut:
        end = cut.start()

    def put(kind: str, value: str, element: str) -> None:
        out.append((kind, value, element, stack[-1][2] if stack else (), block, stack[-1][3] if stack else ()))

    def close_to(depth: int) -> None:
        nonlocal skip, block
        while len(stack) > depth:
            name, skipped, *_ = stack.pop()
            skip -= skipped
            if name not in INLINE:
                block += 1

    def text(a: int, b: int) -> None:
        if a < b and not skip:
            put("text", html.unescape(page[a:b]), stack[-1][0] if stack else "")

    while at < end:
        m = TOKEN.search(page, at)
        if not m or m.start() >= end:
            text(at, end)
            break
        text(at, m.start())
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            depth = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == name), None)
            if depth is not None:
                if not skip:
                    put("tag", "/" + name, name)
                close_to(depth)
            elif name == "p":
                block += 1
            continue
        for k in range(len(stack) - 1, -1, -1):
            if name in ENDS.get(stack[k][0], ()):
                close_to(k)
                break
            if stack[k][0] not in INLINE and stack[k][0] not in ENDS:
                break
        if name not in INLINE:
            block += 1
        if name in RAW:
            done = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, at)
            at = done.end() if done else end
            continue
        skipped = name in SKIP
        chain, marks = stack[-1][2:] if stack else ((), ())
        named = [] if skip or skipped else _named(name, m.group(3), bool(chain))
        if named or name in ASIDE or name in FRAMES or (name == "header" and not chain):
            mark += 1
            # Negative: noise also where it holds an article, as reader comments below an article may.
            marks += (-mark if name in ASIDE or (holders and not COMMENTS.isdisjoint(named)) else mark,)
        if not skip and not skipped:
            out.append(("tag", name, name, chain, block, marks))
            if name == "br":
                put("text", " ", stack[-1][0] if stack else "")
        if name in VOID or m.group(3).rstrip().endswith("/"):
            continue
        if name in HOLDERS and not skip and not any(k < 0 for k in marks):
            holders += 1
            chain += (holders,)
            freed.update(marks)
        stack.append((name, skipped, chain, marks))
        skip += skipped
    return [(*t[:5], next((k for k in t[5] if k not in freed), 0)) for t in out]


def counts(page: str) -> Counter:
    """Words and tags inside and outside the article of a labelled page; empty for other pages."""
    found = [t for t in tokens(page) if not t[5]]
    if len({h[0] for _, _, _, h, _, _ in found if h}) != 1:
        return Counter()
    c = Counter()
    for kind, value, element, holder, _, _ in found:
        n = len(value.split()) if kind == "text" else 1
        c[("word:" + element if kind == "text" else "tag:" + value.lstrip("/"), bool(holder))] += n
    return c


def weights(c: Counter) -> dict[str, float]:
    """Log-odds of lying inside, words kept positive and tags negative."""
    total = {side: sum(n for (_, s), n in c.items() if s == side) for side in (True, False)}
    out = {}
    for key in {k for k, _ in c}:
        odds = math.log((c[key, True] + 1) / (total[True] + 2)) - math.log((c[key, False] + 1) / (total[False] + 2))
        out[key] = min(3.0, max(0.1, odds)) if key.startswith("word:") else max(-3.0, min(-0.1, odds - 1))
    return out


def extract(page: str | None, weight: dict[str, float]) -> str:
    """The main text of a page."""
    found = tokens(page or "")
    return _run([t for t in found if not t[5]], weight) or _run(found, weight)


def _run(found: list, weight: dict[str, float]) -> str:
    """The text of the best run, grown to whole elements."""
    best, best_range, run, begin, last = 0.0, None, 0.0, 0, 0
    for k, (kind, value, element, _, _, noise) in enumerate(found):
        if kind == "text":
            score = len(value.split()) * weight.get("word:" + element, 1.0)
        else:
            score = weight.get("tag:" + value.lstrip("/"), -0.1 if element in INLINE else -1.0)
        start = -PRICE if noise else 0.0
        run += start if noise != last else 0.0
        if run <= start:
            run, begin = start, k
        run, last = run + score, noise
        if run > best:
            best, best_range = run, (begin, k)
    if best_range is None:
        return ""
    lo, hi = best_range
    inside = Counter()
    for kind, value, _, holder, _, _ in found[lo : hi + 1]:
        if kind == "text":
            inside[holder[0] if holder else 0] += len(value)
    holder = max(inside, key=lambda h: (inside[h], h))
    if holder:
        picked = [t for t in found if t[3] and t[3][0] == holder]
    else:
        first, last = found[lo][4], found[hi][4]
        picked = [t for t in found if first <= t[4] <= last]
    blocks: dict[int, list[str]] = {}
    for kind, value, _, _, block, _ in picked:
        if kind == "text":
            blocks.setdefault(block, []).append(value)
    lines = (" ".join("".join(parts).split()) for parts in blocks.values())
    return "\n".join(line for line in lines if line)


def learn(pages: DataFrame, labelled: int = LABELLED) -> dict[str, float]:
    """Weights from a sample of at most about ``labelled`` pages of ``pages(html)``, chosen by hash."""
    many = pages.count()
    if not many:
        return {}

    def run(batches):
        c = Counter()
        for batch in batches:
            for page in batch.column(0).to_pylist():
                c += counts(page or "")
        keys = list(c)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in keys], pa.string()), pa.array([s for _, s in keys], pa.bool_()), pa.array([c[k] for k in keys], pa.int64())],
            names=["key", "inside", "n"],
        )

    part = F.pmod(F.xxhash64("html"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, labelled / many))
    rows = pages.where(part).select("html").mapInArrow(run, "key string, inside boolean, n long")
    rows = rows.groupBy("key", "inside").agg(F.sum("n").alias("n")).collect()  # as many as there are tag names in the sample
    return weights(Counter({(r[0], r[1]): r[2] for r in rows}))


def main_text(pages: DataFrame, weight: dict[str, float] | None = None) -> DataFrame:
    """``page_id, url, text`` of every row of ``pages(page_id, url, html)``."""
    A.small_batches(pages.sparkSession)
    if weight is None:
        weight = learn(pages)

    def run(batches):
        for batch in batches:
            text = [extract(p, weight) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(text, pa.string())], names=["page_id", "url", "text"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string")
