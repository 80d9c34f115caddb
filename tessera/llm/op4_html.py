"""HTML main-text extraction by consensus host paths.

Three steps. (1) Each page's containers are scored: characters of text outside boilerplate and links, times a weight
of the tag. (2) In Spark, pages vote on generalised tag-class paths (digits dropped) per host: a page's best path gets its voice, and each
of its paths the score's share of the best one. Winning paths of a host, in order of voices, then votes, are those with a 64th of its
pages' voices, so 64 at most: a host may have several templates. (3) Each page is read again and the elements at the first
winning path that has text there are extracted; a page without any uses its own best container.

Votes are summed before the shuffle. The winners' size is measured: up to ``broadcast_bytes`` they are sent to all executors and no page
is shuffled; beyond that they meet the pages in a join on the host, of which adaptive execution splits hosts with a large part of all pages.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._util import cut, table

NAME = "op4_html"

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)", re.S
)
# one attribute: its name, then its value whole, so that neither is looked for inside the other
_ATTR = re.compile(r"(=?[^\s/>=]++)(?:\s*+=\s*+(?:\"([^\"]*)(?:\"|\Z)|'([^']*)(?:'|\Z)|([^\s>]*+)))?")
_RAW = {"script", "style", "textarea", "title", "iframe", "noframes", "xmp"}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_INLINE = set("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
_BOILER = set("nav header footer aside form script style noscript template iframe noframes object embed svg canvas button select input textarea dialog menu head title audio video map".split())
_BOILER_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alertdialog", "alert", "menu", "menubar", "toolbar", "form"}
_BOILER_WORD = set(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar aside menu nav navbar navigation breadcrumb breadcrumbs header masthead "
    "footer cookie cookies consent gdpr notice popup modal overlay newsletter subscribe subscription signup login share sharing social related recommended recommendations comment comments "
    "commentlist disqus respond reply replies widget toolbar pagination pager copyright skip".split()
)
# parts that hold articles of their own; other boilerplate words may as well name a wrapper of the page's article
_OTHERS_WORD = set("ad ads adv advert adverts advertisement advertising adsense sponsor sponsored promo promotion related recommended recommendations comment comments commentlist disqus respond reply replies".split())
_STATE = re.compile(r"(?:has|with|no|without)[-_]", re.I)
_GOOD_WORD = {"content", "article", "post", "entry", "story", "main", "text", "body"}
_CONTAINER = {"body", "article", "main", "section", "div", "td"}
_CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_CLOSE_STOP = {"ul", "ol", "dl", "table", "select"}


@dataclass(slots=True)
class Node:
    tag: str
    path: str
    weight: float  # 0: no container
    boiler: bool
    firm: bool  # boilerplate for an article or main inside, too
    link: bool
    start: int
    end: int = -1


@dataclass(slots=True)
class Page:
    """nodes in page order; events: text, or None for a block's edge; for each event whether it is boilerplate or link text."""

    nodes: list[Node] = field(default_factory=list)
    events: list[str | None] = field(default_factory=list)
    boiler: list[bool] = field(default_factory=list)
    link: list[bool] = field(default_factory=list)


def _describe(tag: str, attrs: str, by_word: bool = True) -> tuple[str, float, bool, bool, bool]:
    """Path step, weight as a container, whether it is boilerplate, for articles inside too, and whether it is an article or main.

    Class words make boilerplate only where ``by_word``; those of a state, as in has-sidebar, never do.
    """
    found = {k.lower(): (a or b or c) for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
    classes = found.get("class", "").split()
    words = {w for w in re.split(r"[^a-z]+", " ".join([*classes, found.get("id", "")]).lower()) if w}
    role = found.get("role", "").lower()
    firm = boiler = tag in _BOILER or role in _BOILER_ROLE or "hidden" in found or found.get("aria-hidden", "").lower() == "true"
    if by_word and not boiler and words:
        named = {w for x in [*classes, found.get("id", "")] if not _STATE.match(x) for w in re.split(r"[^a-z]+", x.lower())}
        if tag not in ("html", "body", "article", "main") and role != "main":
            boiler = not named.isdisjoint(_BOILER_WORD)
            firm = not named.isdisjoint(_OTHERS_WORD)
        elif tag == "article":
            firm = boiler = not named.isdisjoint({"comment", "comments", "ad", "ads", "related", "promo", "sponsored"})
    name = re.sub(r"\d+", "", tag + "".join(f".{c}" for c in sorted(classes)))
    weight = {"article": 2.0, "body": 0.6, "td": 0.9}.get(tag, 1.0) if tag in _CONTAINER else 0.0
    if tag == "main" or role == "main":
        weight = 1.8
    elif tag in ("div", "section") and not words.isdisjoint(_GOOD_WORD):
        weight = 1.5
    return name, weight, boiler, firm, tag in ("article", "main") or role == "main"


def parse(source: str, by_word: bool = True) -> Page:
    """One pass over the page; end tags may be missing or misplaced, a truncated last tag is markup.

    Boilerplate is inherited, but an article or main inside an element that only a class word calls so is none.
    """
    page = Page()
    page.nodes.append(Node("html", "html", 0.0, False, False, False, 0))
    stack = [page.nodes[0]]

    def say(text: str) -> None:
        page.events.append(text)
        page.boiler.append(stack[-1].boiler)
        page.link.append(stack[-1].link)

    def edge() -> None:
        page.events.append(None)
        page.boiler.append(True)
        page.link.append(False)

    def close(depth: int) -> None:
        while len(stack) > depth:
            node = stack.pop()
            node.end = len(page.events)
            if node.tag not in _INLINE:
                edge()

    at, size = 0, len(source)
    while at < size:
        m = _TOKEN.search(source, at)
        if m is None:
            say(source[at:])
            break
        if m.start() > at:
            say(source[at : m.start()])
        at = m.end()
        if m[0].startswith("<![CDATA["):
            say(m[0][9:-3].replace("&", "&amp;"))
            continue
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        if m[1] or m[4]:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag == tag:
                    close(depth)
                    break
            continue
        if tag in ("html", "body") and any(n.tag == tag for n in stack):
            continue
        name, weight, boiler, firm, main = _describe(tag, m[3] or m[6] or "", by_word)
        if tag not in _INLINE and tag not in _VOID:
            for depth in range(len(stack) - 1, 0, -1):  # an open paragraph ends where a block starts
                if stack[depth].tag == "p":
                    close(depth)
                    break
                if stack[depth].tag not in _INLINE:
                    break
        if tag in _CLOSES:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].tag in _CLOSES[tag]:
                    close(depth)
                    break
                if stack[depth].tag in _CLOSE_STOP:
                    break
        up = stack[-1]
        if tag in _VOID:
            if tag in ("br", "hr", "img"):
                say(" ")
            if tag == "hr":
                edge()
            continue
        if tag not in _INLINE:
            edge()
        boiler = boiler or (up.firm if main else up.boiler)
        node = Node(tag, f"{up.path}>{name}" if tag not in _INLINE else up.path, 0.0 if boiler else weight, boiler, up.firm or firm, up.link or tag == "a", len(page.events))
        page.nodes.append(node)
        stack.append(node)
        if tag in _RAW:
            stop = re.compile(rf"</{re.escape(tag)}(?=[\s/>]|\Z)", re.I).search(source, at)
            at = stop.start() if stop else size
    close(0)
    return page


def scores(page: Page) -> dict[str, float]:
    """Score of each container path of the page: its elements' characters outside boilerplate and links, weighted."""
    total, sums = 0, [0]
    for text, skip, link in zip(page.events, page.boiler, page.link):
        if text is not None and not skip and not link:
            total += len(text.strip())
        sums.append(total)
    out: dict[str, float] = {}
    for n in page.nodes:
        if n.weight and sums[n.end] > sums[n.start]:
            out[n.path] = out.get(n.path, 0.0) + n.weight * (sums[n.end] - sums[n.start])
    return out


def read_page(source: str) -> tuple[Page, dict[str, float]]:
    """The page and its scores; class words are no boilerplate on a page that has no text otherwise."""
    page = parse(source)
    found = scores(page)
    if not found and not any(t is not None and not skip and t.strip() for t, skip in zip(page.events, page.boiler)):
        other = parse(source, by_word=False)
        if again := scores(other):
            return other, again
    return page, found


def blocks(page: Page, path: str | None) -> list[str]:
    """The text blocks of the elements at the path, in page order; all blocks of the page for None."""
    out: list[str] = []
    done = 0
    for n in page.nodes:
        if path is not None and (n.path != path or not n.weight):
            continue
        if n.start < done:  # inside one already read
            continue
        done, line = n.end, []
        for i in range(n.start, n.end):
            text = page.events[i]
            if text is None:
                out.append(" ".join(html.unescape("".join(line)).split()))
                line = []
            elif not page.boiler[i]:
                line.append(text)
        out.append(" ".join(html.unescape("".join(line)).split()))
        if path is None:
            break
    return [b for b in out if b]


def best(found: dict[str, float]) -> str | None:
    """The path of the highest score; ties go to the deepest, then the first by name."""
    return min(found, key=lambda p: (-found[p], -p.count(">"), p)) if found else None


def extract(df: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", broadcast_bytes: int = 16 << 20) -> DataFrame:
    """(id, url, path, text) of every page; text: blocks joined by two line feeds, empty if there are none.

    A null html counts as empty. Pages without a host (null or odd url) vote as one host of their own. Repeated rows vote
    and are extracted each. Ties go to more votes, then the deeper path, then the last by name. An empty table gives no rows; columns
    other than the three named are not read.
    """
    kind = df.schema[id_col].dataType.simpleString()
    host = F.coalesce(F.lower(F.regexp_extract(F.col(url_col), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    src = df.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), host.alias("host"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))

    def vote(batches):
        for pdf in batches:
            hosts, paths, votes, voices = [], [], [], []
            for h, source in zip(pdf["host"], pdf["html"]):
                found = read_page(source)[1]
                first, top = best(found), max(found.values(), default=0)
                for p, s in found.items():
                    hosts.append(h)
                    paths.append(p)
                    votes.append(round(1_000_000 * s / top))
                    voices.append(int(p == first))
            yield pd.DataFrame({"host": pd.Series(hosts, dtype=object), "path": pd.Series(paths, dtype=object), "vote": pd.Series(votes, dtype="int64"), "voice": pd.Series(voices, dtype="int64")})

    votes = src.select("host", "html").mapInPandas(vote, "host string, path string, vote long, voice long").groupBy("host", "path").agg(F.sum("vote").alias("votes"), F.sum("voice").alias("voices"))
    votes = cut(votes.filter("voices > 0"))
    pages = votes.groupBy("host").agg(F.sum("voices").alias("pages"))
    order = F.struct("voices", "votes", F.size(F.split("path", ">")).alias("depth"), "path")
    winners = votes.join(pages, "host").filter("voices * 64 >= pages").groupBy("host").agg(F.transform(F.sort_array(F.collect_list(order), asc=False), lambda w: w["path"]).alias("paths"))
    winners = cut(winners)
    size = winners.agg(F.sum(F.octet_length("host") + F.lit(32) + F.aggregate("paths", F.lit(0).cast("long"), lambda n, p: n + F.octet_length(p) + 16))).first()[0] or 0
    met = src.join(F.broadcast(winners) if size <= broadcast_bytes else winners, "host", "left").select("id", "url", "paths", "html")

    def read(batches):
        for pdf in batches:
            used, texts = [], []
            for paths, source in zip(pdf["paths"], pdf["html"]):
                page, found = read_page(source)
                path, own = None, []
                for path in paths if paths is not None else ():
                    own = blocks(page, path) if path in found else []
                    if own:
                        break
                if not own:
                    path = best(found)
                    own = blocks(page, path)
                used.append(path)
                texts.append("\n\n".join(own))
            yield pd.DataFrame({"id": pdf["id"], "url": pdf["url"].astype(object), "path": pd.Series(used, dtype=object), "text": pd.Series(texts, dtype=object)})

    return met.mapInPandas(read, f"id {kind}, url string, path string, text string").withColumnsRenamed({"id": id_col, "url": url_col})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


ORACLE_SQL = None
