"""Main text of web pages by a maximum-scoring subsequence.

A page is read as a row of tokens: tags, and the words of text runs. Words weigh by the
context they stand in (the nearest element whose name, role or class tells something;
where nothing is told, blocks that are mostly links, and copyright lines, tell by
themselves), tags cost a little; all weights are log-odds counted on labelled pages. One
linear scan finds the contiguous run of tokens with the greatest sum, the content region;
words of it whose own context weighs against content (an advert or a form inside the
article) are left out, and the rest is cut into blocks at block-level tags. What lies
inside an element that names itself content costs nothing, so that no list of links
parts an article.

Character references are decoded, white space within a block becomes one space, blocks
are joined by an empty line. ``<br>`` and table cells are white space.

Defined results: a null or empty page, and a page without content words, has the empty
text; tags that are never closed end with the element around them; pages are read
whole at any length. Other columns are ignored.
"""

from __future__ import annotations

import html as entities
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tessella.session import lean, ship

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([A-Za-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")

#: Fixed values of HTML: elements without an end, with raw text, and of block level.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg", "noframes", "xmp"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
    "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "legend", "li", "main", "menu", "nav", "ol", "p", "pre", "search", "section", "summary",
    "table", "tbody", "tfoot", "thead", "tr", "ul", "caption",
}
SPACES = {"br", "td", "th", "wbr", "option", "img", "input"}
#: Contexts: elements, and beginnings of words of class, id and role, that name them.
CONTEXT_TAGS = {
    "nav": "menu", "menu": "menu", "header": "header", "footer": "footer", "aside": "sidebar", "form": "form", "button": "form", "select": "form", "label": "form", "search": "form",
    "dialog": "notice", "article": "content", "main": "content", "head": "raw", **dict.fromkeys(RAW, "raw"),
}
CONTEXT_WORDS = {
    "advert": ("advert", "sponsor", "promo", "banner"), "notice": ("cookie", "consent", "notice", "alert", "popup", "modal", "paywall", "disclaimer"),
    "form": ("newsletter", "subscri", "signup", "login", "search", "toolbar"), "comments": ("comment", "disqus", "respond"),
    "sidebar": ("sidebar", "related", "recommend", "complementary", "widget", "share", "sharing", "social", "trending"),
    "menu": ("menu", "nav", "breadcrumb", "paginat", "pager"), "footer": ("footer", "copyright", "contentinfo", "colophon"), "header": ("header", "masthead"),
    "content": ("article", "content", "entry", "post", "story", "main"),
}
#: Whole words only, as they begin other words too.
CONTEXT_WHOLE = {"ad": "advert", "ads": "advert", "adbox": "advert", "adsense": "advert", "reply": "comments", "replies": "comments"}
#: Words that say little before another noun inside an article: a share-price-table is a table, a share-bar is none.
LOOSE = ("nav", "share", "sharing", "social", "search", "header", "footer")
PLAIN_NOUNS = {"bar", "bars", "block", "box", "button", "buttons", "container", "icon", "icons", "item", "items", "link", "links", "list", "panel", "row", "section", "tools", "top", "bottom", "wrap", "wrapper", "area", "inner", "outer"}


#: Labelled pages: <!--main--> and <!--/main--> enclose the content.
LABELLED = [
    """<html><head><title>River towns</title><style>p{}</style><script>x()</script></head><body><header class="masthead"><p>The Daily Page</p></header><nav class="navbar"><ul><li><a href="/">Home</a></li>
<li><a href="/w">World</a></li><li><a href="/m">Money</a></li></ul></nav><div class="ad">Buy one and get one free today only</div><article><!--main--><h1>River towns grow again</h1><p>Along the river the old towns
are growing again after many quiet years.</p><p>New shops have opened and the <b>market</b> is full on most days of the week.</p><!--/main--><div class="share">Share this on your page</div><div class="comments"><h2>Comments</h2>
<p>First!</p><p>I do not agree with this at all</p></div></article><aside class="sidebar"><h3>Most read</h3><ul><li>Ten best walks</li><li>Rain again</li></ul></aside><footer>All rights reserved. Contact us.</footer></body></html>""",
    """<html><head><title>Notes on bread</title></head><body><div id="header" class="header"><a href="/">Kitchen notes</a></div><div class="menu"><a>Soups</a> <a>Breads</a> <a>Cakes</a></div><div class="cookie-notice">We use cookies
to make this page better <button>Accept</button></div><main><!--main--><h1>Notes on bread</h1><p>Good bread needs time more than it needs work.</p><ul><li>Flour and water</li><li>Salt</li></ul><blockquote>Let it rest until it has
doubled in size.</blockquote><p>Bake it hot and leave it alone until it sounds hollow.</p><!--/main--></main><div class="related"><h3>Related</h3><a>Rye bread</a> <a>Flat bread</a></div><form class="newsletter"><label>Your mail</label>
<input name="mail"><button>Subscribe</button></form><div class="footer"><p>Copyright by the cooks</p></div></body></html>""",
    """<html><body><div class="breadcrumbs">Home / Science / Stars</div><div class="login"><form><label>Name</label><select><option>One</option></select></form></div><div class="content"><!--main--><h2>Counting the stars</h2><p>Nobody has
counted all stars, yet we know about how many there are.</p><table><tr><td>Near</td><td>few</td></tr></table><!--/main--><div class="advert sponsored">A telescope for every home, order now</div><!--main--><p>The count comes from small patches
of the sky that are counted with care.</p><!--/main--></div><div class="promo banner">Last days of our big sale</div><div class="widget social">Follow us</div><div class="pagination">1 2 3 next</div><noscript>Turn on scripts</noscript></body></html>""",
    """<html><head><meta charset="utf-8"></head><body><div class="alert popup modal">You have one free page left. Sign up.</div><div role="search" class="search">Search this site</div><div class="post entry"><!--main--><p>A short story about a long
walk through the hills and back before night.</p><p>We went out early and saw nobody until noon.</p><!--/main--></div><div id="disqus" class="respond reply">Leave a reply here if you like</div><div role="complementary">More from us</div>
<div role="contentinfo">Imprint and data</div><div class="recommended">You may like these pages too</div><div class="toolbar signup subscribe">Get the news</div><div class="copyright">Copyright</div></body></html>""",
    """<html><body><div class="x1"><a href="/">Start</a> <a href="/n">News</a> <a href="/s">Sport</a> <a href="/k">Culture</a></div><div class="x2"><!--main--><p>The bridge at the old mill is open again since <a href="/b">last spring</a>,
and people walk over it every day.</p><p>It took two years to mend it.</p><!--/main--></div><ul><li><a href="/1">The next page of this series</a></li><li><a href="/2">All pages by this writer</a></li></ul><div class="x3">Copyright 2020 by the mill</div></body></html>""",
]


def tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open" or "close", tag, attributes), ("text", decoded text, ""), ("mark", comment, "")."""
    at = 0
    while at < len(page):
        found = _TOKEN.search(page, at)
        begin = found.start() if found else len(page)
        if begin > at:
            yield "text", entities.unescape(page[at:begin]), ""
        if not found:
            return
        at = found.end()
        if found[2] is None:
            if found[0].startswith("<![CDATA["):
                yield "text", found[0][9:].removesuffix("]]>"), ""
            else:
                yield "mark", found[0], ""
            continue
        tag = found[2].lower()
        yield "close" if found[1] else "open", tag, found[3]
        if not found[1] and tag in RAW and not found[3].rstrip().endswith("/"):
            end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            stop = end.start() if end else len(page)
            yield "text", page[at:stop], ""
            at = stop


def _said_by(word: str) -> set[str]:
    return {c for c, stems in CONTEXT_WORDS.items() if word.startswith(stems)} | ({CONTEXT_WHOLE[word]} if word in CONTEXT_WHOLE else set())


def context_of(tag: str, attributes: str, inside: str) -> str:
    """What an element says about its words; most elements say nothing and keep the context around them."""
    said = set()
    if attributes and tag not in ("html", "body"):
        for name, a, b, c in _ATTRIBUTE.findall(attributes):
            if name.lower() in ("class", "id", "role"):
                for named in entities.unescape(a or b or c).split():
                    words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", named).lower()) if w]
                    heads = [w for w in words if w not in PLAIN_NOUNS]
                    other = inside == "content" and heads and not _said_by(heads[-1])
                    for w in words:
                        if not (other and w.startswith(LOOSE)):
                            said |= _said_by(w)
    if tag in CONTEXT_TAGS:
        said.add(CONTEXT_TAGS[tag])
    if "header" in said and (inside == "content" or "content" in said):
        said.discard("header")
    # What marks other matter says more than what marks content: post-comments are comments.
    return min(said - {"content"}, default="content" if "content" in said else inside)


@dataclass
class Token:
    kind: str
    value: str
    context: str
    #: Inside an element that names itself content.
    within: bool
    linked: bool


#: How a copyright line begins.
_OWNED = re.compile(r"\s*(?:©|\(c\)|copyright\b)", re.I)


def annotated(page: str) -> list[Token]:
    """Tokens with the context of each."""
    stack: list[tuple[str, str, bool]] = [("", "", False)]
    out: list[Token] = []
    links = 0

    def add(kind: str, value: str) -> None:
        out.append(Token(kind, value, stack[-1][1], stack[-1][2], links > 0))

    for kind, value, attributes in tokens(page):
        if kind == "open":
            context = context_of(value, attributes, stack[-1][1])
            add(kind, value)
            if value == "p" and stack[-1][0] == "p":
                stack.pop()
            if value not in VOID:
                stack.append((value, context, stack[-1][2] or context == "content"))
                links += value == "a"
        elif kind == "close":
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == value:
                    links -= sum(s[0] == "a" for s in stack[i:])
                    del stack[i:]
                    break
                if stack[i][0] in BLOCKS and value not in BLOCKS:
                    break
            add(kind, value)
        else:
            add(kind, value)
    begin = 0
    for i in range(len(out) + 1):
        if i == len(out) or (out[i].kind in ("open", "close") and out[i].value in BLOCKS):
            _judge_block([t for t in out[begin:i] if t.kind == "text" and t.context == ""])
            begin = i + 1
    return out


def _judge_block(texts: list[Token]) -> None:
    """Where no element tells anything, a block of links is one, and a copyright line is a footer."""
    counts = [len(t.value.split()) for t in texts]
    linked, words = sum(n for n, t in zip(counts, texts) if t.linked), sum(counts)
    said = "links" if 2 * linked > words else "footer" if words < 30 and _OWNED.match("".join(t.value for t in texts)) else ""
    if said:
        for t in texts:
            t.context = said


@dataclass(frozen=True)
class Weights:
    word: dict[str, float]
    tag: float


def learn(pages: list[str]) -> Weights:
    """Log-odds of words in content against words elsewhere, for each context; the cost of a tag."""
    inside, outside, tags = Counter(), Counter(), [1, 1]
    for page in pages:
        main = False
        for t in annotated(page):
            if t.kind == "mark":
                main = {"<!--main-->": True, "<!--/main-->": False}.get(t.value, main)
            elif t.kind == "text":
                (inside if main else outside)[t.context] += len(t.value.split())
            else:
                tags[main] += 1
    names = {*inside, *outside, ""}
    words = {c: math.log((inside[c] + 0.5) / (outside[c] + 0.5)) for c in names}
    # Pages that tell nothing are read on their words alone.
    words[""] = max(words[""], 0.5)
    return Weights(words, -abs(math.log((tags[1] + 1) / (sum(tags) + 1))) / 10)


def gains(row: list[Token], weights: Weights) -> list[float]:
    """What each token adds to a run: words by their context, tags a small cost."""
    out = []
    for t in row:
        if t.kind == "text":
            weight = weights.word.get(t.context, 0.0)
            # Words against content cost little each: a long advert must not part a page's text.
            cost = 0.0 if t.within else max(weight, -1.0) / 20
            out.append(len(t.value.split()) * (weight if weight > 0 else cost))
        else:
            out.append(0.0 if t.kind == "mark" or t.within else weights.tag)
    return out


def best_run(scores: list[float]) -> tuple[int, int]:
    """Bounds of the contiguous run of the greatest sum, in one pass; of equal ones the first, empty if none is positive."""
    best, span, total, begin = 0.0, (0, 0), 0.0, 0
    for i, gain in enumerate(scores):
        total += gain
        if total <= 0:
            total, begin = 0.0, i + 1
        elif total > best:
            best, span = total, (begin, i + 1)
    return span


def main_text(page: str | None, weights: Weights) -> str:
    if not page:
        return ""
    row = annotated(page)
    begin, end = best_run(gains(row, weights))
    blocks: list[list[str]] = [[]]
    for t in row[begin:end]:
        if t.kind == "text":
            if weights.word.get(t.context, 0.0) > 0:
                blocks[-1].append(t.value)
        elif t.kind != "mark" and t.value in BLOCKS:
            blocks.append([])
        elif t.kind != "mark" and t.value in SPACES:
            blocks[-1].append(" ")
    return "\n\n".join(x for b in blocks if (x := " ".join("".join(b).split())))


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", labelled: list[str] | None = None) -> DataFrame:
    """Per page: id, url, text."""
    ship(pages.sparkSession)
    weights = learn(labelled or LABELLED)
    source = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(html_col).cast("string").alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = pa.array([main_text(h, weights) for h in batch.column("html").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), out], names=["id", "url", "text"])

    return source.mapInArrow(lean(run), T.StructType([source.schema["id"], source.schema["url"], T.StructField("text", T.StringType())]))


def digest(pages: DataFrame) -> DataFrame:
    """The contract's columns."""
    return extract(pages).select(F.col("id").alias("page_id"), "url", "text", F.char_length("text").cast("long").alias("n_chars"))
