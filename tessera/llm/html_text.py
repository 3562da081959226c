"""Main text of web pages with a site style tree.

The pages of a host are merged into one tree: a node is a path of block elements (tag,
class and id without digits), and at every node the different sequences of child elements
are counted (its styles), and at nodes that hold text the different texts. Importance of a
node, after the entropy measures of the site style tree: presentation, the entropy of its
styles over the m pages that have it (base m); content, one less the average entropy of
its texts over those pages (a text on every page weighs 0, a text on one page weighs 1);
and bottom-up (1 - g^l) * presentation + g^l * the average of its children, g = 0.9, l
styles. A branch whose nodes all stay under the threshold is low. Few pages tell little:
the importance of a node on m pages is drawn towards 1 by ``trust`` / (m + trust): a branch
of equal texts is low from two pages on, a host of one page has none.

Branches go as wholes. A low block element (div, section, ...) is removed from every page of
the host. A low text element (heading, paragraph, item, cell, ...) is judged with the block
element it stands in: between elements that are not low it is part of their text and stays
(a heading if one follows), as it does anywhere in an article that is not low; at the edges
it goes.

Element roles are known without counting: menus, footers, asides, dialogs, scripts and
styles (by element, ARIA role or hidden, by attribute or inline style) have importance 0. So have branches whose class or
id names a header, sidebar, notice, advert, form, share or comment box, headers and forms,
unless the branch holds the page's article (or main) or ``NEARLY`` all of its text. Where
articles (or main) hold at least half of the text that is left, only that is text. A page
that would lose all its text to the counted importance keeps it.

Text: character references decoded, white space in a block collapsed to one space,
blocks joined by one newline in page order; a br is white space.

Scale: a page is parsed once; host statistics are grouped counts keyed by (host, path,
text), so the pages of one host are never gathered. Defined cases: null html is empty;
unclosed, stray and wrongly nested tags are taken as browsers do for paragraphs, lists and
tables; elements nested deeper than ``MAX_DEPTH`` count as their ancestor of that depth; a
null or odd url is a host of its own; repeated pages are each returned; an empty table
gives no rows; other columns are not looked at.
"""
from __future__ import annotations

import re
import zlib
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship_package, written

GAMMA, THRESHOLD, TRUST, MAX_DEPTH = 0.9, 0.5, 1, 24
#: share of a page's text that a named branch must hold to be the page
NEARLY = 0.8

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?"
    r"|<(?P<close>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<close2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)>", re.S)
_ATTR = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
#: fixed values of the HTML standard
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 "
             "h4 h5 h6 head header hgroup hr html legend li main menu nav noscript object ol optgroup option p pre search section select summary table tbody td "
             "template tfoot th thead title tr ul script style textarea button svg canvas iframe".split())
#: an open element (value) that a start tag (key) ends, up to the nearest of the scope
_ENDS = {"li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
         "td": ({"td", "th"}, {"table", "tr"}), "th": ({"td", "th"}, {"table", "tr"}), "tbody": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
         "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"})}
_CHROME_TAGS = set("nav footer aside script style noscript template iframe object svg canvas button select menu dialog head textarea search".split())
_CHROME_ROLES = set("navigation banner contentinfo complementary search form dialog alertdialog alert menu menubar toolbar".split())
_CHROME_WORDS = set("ad ads advert adverts advertisement advertisements advertising adsense adslot banner sponsor sponsored promo promotion sidebar side nav navbar "
                    "navigation menu menubar breadcrumb breadcrumbs masthead footer cookie cookies consent gdpr notice notices popup modal overlay newsletter "
                    "subscribe subscription signup login search share sharing social comment comments disqus respond replies reply related recommended recommendations "
                    "widget widgets toolbar pagination pager copyright disclaimer form".split())
_HEADER_WORDS = {"header", "topbar", "top"}
#: elements that are text of the block element around them
_HEADINGS = set("h1 h2 h3 h4 h5 h6 hgroup dt th caption figcaption legend summary".split())
_TEXTS = _HEADINGS | set("p li ul ol dl dd pre blockquote address center table thead tbody tfoot tr td figure hr option".split())
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


def _element(tag: str, attrs: str, in_main: bool) -> tuple[str, bool, bool]:
    """Label of an element in the style tree, whether it is known not to be text, and
    whether its name says so."""
    a = {}
    if attrs and not attrs.isspace():
        for k, v in _ATTR.findall(attrs):
            a.setdefault(k.lower(), unescape(v.strip("\"'")))
    names = " ".join(a.get(k, "") for k in ("class", "id"))
    words = set(re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", names).lower()))
    label = tag + "".join(sorted({"." + re.sub(r"\d+", "", w).replace("/", "")[:40] for w in names.split()}))
    if tag in ("html", "body", "main"):
        return label, False, False
    chrome = tag in _CHROME_TAGS or a.get("role", "").lower() in _CHROME_ROLES or a.get("aria-hidden", "").lower() == "true" or "hidden" in a \
        or bool(_UNSEEN.search(a.get("style", "")))
    named = tag == "form" or bool(words & _CHROME_WORDS) or (not in_main and (tag == "header" or bool(words & _HEADER_WORDS)))
    return label, chrome, named


def _judged(blocks: list[tuple], opened_in_main: list[bool]) -> list[tuple[str, str, bool, bool]]:
    """Blocks (path, text, chrome, main) from (path, text, chrome, main, named branches): a
    name does not count if its branch holds the page's article or nearly all its text."""
    total = articles = plain = 0
    size, article = [0] * len(opened_in_main), [0] * len(opened_in_main)
    for _, text, chrome, main, names in blocks:
        if chrome:
            continue
        n = len(text)
        total += n
        articles += n * main
        plain += n * (not names)
        for k in names:
            size[k] += n
            article[k] += n * (main and not opened_in_main[k])
    page = {k for k, n in enumerate(size) if n and (n >= NEARLY * total or (article[k] and 2 * article[k] >= articles and article[k] >= plain))}
    return [(path, text, chrome or not page.issuperset(names), main) for path, text, chrome, main, names in blocks]


def parse(html: str) -> tuple[list[tuple[str, str, bool, bool]], dict[str, list[int]]]:
    """Blocks (path, text, chrome, in an article) in page order, and for every path the
    different styles (checksums of the child sequence)."""
    blocks, styles = [], {}
    opened_in_main: list[bool] = []  # per named branch
    stack = [["", "", False, False, [], ()]]  # tag, path, chrome, main, labels of its children, named branches
    pending: list[str] = []

    def flush():
        text = " ".join("".join(pending).split())
        pending.clear()
        if text:
            _, path, chrome, main, _, names = stack[-1]
            blocks.append((path, text, chrome, main, names))

    def pop():
        _, path, _, _, children, _ = stack.pop()
        styles.setdefault(path, set()).add(zlib.crc32("|".join(children).encode("utf-8", "replace")))

    def end(tags: set[str], scope: set[str]):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in scope:
                return
            if stack[i][0] in tags:
                while len(stack) > i:
                    pop()
                if not (tags & {"tr", "td", "th", "dt", "dd", "li"}):
                    return
                return end(tags, scope)

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            pending.append(unescape(html[at:]))
            break
        if m.start() > at:
            pending.append(unescape(html[at:m.start()]))
        at = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        closing = (m["close"] or m["close2"]) == "/"
        attrs = m["attrs"] if m["tag"] else m["attrs2"]
        if tag == "br":
            pending.append(" ")
            continue
        if tag not in _BLOCK:
            if tag in _RAW and not closing:
                c = re.compile(f"</{tag}[^a-z]", re.I).search(html, at)
                at = c.start() if c else n
            continue
        flush()
        if closing:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    while len(stack) > i:
                        pop()
                    break
            continue
        end({"p"}, {"button", "table", "td", "th", "caption", "object", "template"})
        if tag in _ENDS:
            end(*_ENDS[tag])
        _, path, chrome, main, children, names = stack[-1]
        label, own, named = _element(tag, attrs, main)
        if len(children) < 2 or children[-1] != label or children[-2] != label:  # runs of equals count as two
            children.append(label)
        if tag in _VOID:
            continue
        if named:
            names = (*names, len(opened_in_main))
            opened_in_main.append(main)
        deep = len(stack) > MAX_DEPTH
        stack.append([tag, path if deep else f"{path}/{label}", chrome or own, main or (tag in ("article", "main") and not (own or named)), children if deep else [], names])
        if tag in _RAW:
            c = re.compile(f"</{tag}(?![a-z])", re.I).search(html, at)
            at = c.start() if c else n
    flush()
    while len(stack) > 1:
        pop()
    return _judged(blocks, opened_in_main), {p: sorted(s) for p, s in styles.items() if p}


def home(path: str) -> tuple[str, bool]:
    """The block element that a block belongs to, and whether the block is a heading."""
    steps = path.split("/")
    heads = False
    while len(steps) > 1 and steps[-1].split(".", 1)[0] in _TEXTS:
        heads = heads or steps[-1].split(".", 1)[0] in _HEADINGS
        steps.pop()
    return "/".join(steps), heads


def kept(blocks: list[tuple[str, str, bool]], low: set[int]) -> list[str]:
    """Texts of the blocks (path, text, in an article) that stay, given which are low."""
    homes = [home(path) for path, *_ in blocks]
    first, last = {}, {}
    for i, (where, _) in enumerate(homes):
        if i not in low:
            first.setdefault(where, i)
            last[where] = i
    out = []
    for i, ((_, text, main), (where, heads)) in enumerate(zip(blocks, homes)):
        if i not in low or (where in last and (main or (i < last[where] and (heads or first[where] < i)))):
            out.append(text)
    return out or [text for _, text, _ in blocks]


_PAGE = "blocks array<struct<path:string,text:string,chrome:boolean,main:boolean>>, styles array<struct<path:string,style:long,first:int>>"


def parsed_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, blocks, styles) per row of (page_id, url, html)."""
    block = pa.list_(pa.struct([("path", pa.string()), ("text", pa.string()), ("chrome", pa.bool_()), ("main", pa.bool_())]))
    style = pa.list_(pa.struct([("path", pa.string()), ("style", pa.int64()), ("first", pa.int32())]))

    def kernel(batches):
        for b in batches:
            got = [parse(h or "") for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([
                b.column("page_id"), b.column("url"), b.column("host"),
                pa.array([[dict(zip(("path", "text", "chrome", "main"), x)) for x in g[0]] for g in got], block),
                pa.array([[{"path": p, "style": s, "first": int(k == 0)} for p, v in g[1].items() for k, s in enumerate(v)] for g in got], style)],
                ["page_id", "url", "host", "blocks", "styles"])
    host = F.lower(F.coalesce(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#]*@)?([^/?#:]*)", 1), F.lit("")))
    kind = pages.schema["page_id"].dataType.simpleString()
    return pages.withColumn("host", host).mapInArrow(kernel, f"page_id {kind}, url string, host string, {_PAGE}")


def style_tree(parsed: DataFrame, trust: float = TRUST) -> DataFrame:
    """(host, path, pages, importance, best) per node of every host's style tree; best is
    the highest importance in the node's branch."""
    s = parsed.select("host", F.explode("styles").alias("s")).groupBy("host", "s.path", "s.style").agg(F.count(F.lit(1)).alias("n"), F.sum("s.first").alias("first"))
    nodes = s.groupBy("host", "path").agg(F.sum("first").alias("pages"), F.sum("n").alias("n"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.count(F.lit(1)).alias("styles"))
    spread = (F.log("n") - F.col("nlogn") / F.col("n")) / F.log("pages")
    nodes = nodes.select("host", "path", "pages", "styles", F.when(F.col("pages") > 1, F.least(F.lit(1.0), spread)).otherwise(1.0).alias("looks"))
    # a text counts once a page
    t = parsed.select("host", F.explode(F.array_distinct(F.transform("blocks", lambda b: F.struct(b["path"].alias("path"), F.xxhash64(b["text"]).alias("text"))))).alias("t"))
    t = t.groupBy("host", "t.path", "t.text").count().groupBy("host", "path").agg(F.avg(F.log("count")).alias("common"))
    nodes = written(nodes.join(t, ["host", "path"], "left").withColumn("depth", F.size(F.split("path", "/")) - 1), "nodes")
    deepest = nodes.agg(F.max("depth")).first()[0] or 0
    content = F.when(F.col("common").isNotNull(), F.when(F.col("pages") > 1, 1 - F.least(F.lit(1.0), F.col("common") / F.log("pages"))).otherwise(1.0))
    below, levels = None, []
    for depth in range(deepest, 0, -1):  # at most MAX_DEPTH + 1 small joins
        here = nodes.where(F.col("depth") == depth).withColumn("content", content)
        if below is None:
            here = here.withColumn("kids", F.lit(None).cast("double")).withColumn("branch", F.lit(None).cast("double"))
        else:
            up = below.groupBy("host", F.regexp_replace("path", "/[^/]*$", "").alias("path")).agg(
                (F.sum(F.col("importance") * F.col("pages")) / F.sum("pages")).alias("kids"), F.max("best").alias("branch"))
            here = here.join(up, ["host", "path"], "left")
        inner = F.when(F.col("kids").isNull(), F.col("content")).when(F.col("content").isNull(), F.col("kids")).otherwise((F.col("kids") + F.col("content")) / 2)
        share = F.pow(F.lit(GAMMA), F.col("styles"))
        raw = F.when(F.col("kids").isNull() & F.col("content").isNotNull(), F.col("content")).otherwise((1 - share) * F.col("looks") + share * F.coalesce(inner, F.lit(0.0)))
        here = here.withColumn("importance", raw).withColumn("sure", 1 - F.col("pages") / (F.col("pages") + trust) * (1 - F.greatest("importance", F.coalesce("content", F.lit(0.0)))))
        below = here.select("host", "path", "pages", "importance", F.greatest("sure", F.coalesce("branch", F.lit(0.0))).alias("best"))
        if depth % 6 == 0:
            below = written(below, "level")
        levels.append(below)
    out = levels[0] if levels else nodes.select("host", "path", "pages", F.lit(1.0).alias("importance"), F.lit(1.0).alias("best"))
    for level in levels[1:]:
        out = out.union(level)
    return out


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html",
              threshold: float = THRESHOLD, trust: float = TRUST) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars."""
    ship_package(pages.sparkSession)
    p = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").cast("string").alias("url"), F.col(f"`{html_col}`").cast("string").alias("html"))
    parsed = written(parsed_pages(p).withColumn("page", F.monotonically_increasing_id()), "pages")
    text = F.filter("blocks", lambda b: ~b["chrome"])
    article = F.filter(text, lambda b: b["main"])
    size = lambda blocks: F.aggregate(blocks, F.lit(0), lambda n, b: n + F.length(b["text"]))
    text = F.when((F.size(article) > 0) & (2 * size(article) >= size(text)), article).otherwise(text)
    pages = parsed.select("page", "page_id", "url", "host", text.alias("blocks"))
    low = written(style_tree(parsed, trust).where(F.col("best") < threshold).select("host", "path"), "low")
    # a block is low if its own node is: one row per block, none gathered by host
    placed = pages.select("page", "host", F.posexplode(F.transform("blocks", lambda b: b["path"])).alias("at", "path"))
    found = placed.join(low, ["host", "path"], "left_semi").groupBy("page").agg(F.collect_list("at").alias("low"))
    both = pages.join(written(found, "low-blocks"), "page", "left").select("page_id", "url", "blocks", F.coalesce("low", F.array().cast("array<int>")).alias("low"))

    def kernel(batches):
        for b in batches:
            out = ["\n".join(kept([(x["path"], x["text"], x["main"]) for x in blocks], set(low))) for blocks, low in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.string())], ["page_id", "url", "text"])
    kind = p.schema["page_id"].dataType.simpleString()
    return both.mapInArrow(kernel, f"page_id {kind}, url string, text string").withColumn("n_chars", F.length("text").cast("long"))
