"""Main text of web pages through site style trees."""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablesmith.llm.common import cut, steps

#: Weight of content importance against presentation importance of a node.
CONTENT_WEIGHT = 0.9
#: Odds that a node is content before the site is looked at: any element, and a plain element inside an article. An importance i speaks
#: with odds i / (1 - i), so a branch goes when its importance is below 1 / (1 + prior odds): 0.4 and 0.1. Elements that
#: are noise by kind or class have odds that no importance makes up for.
ODDS, ARTICLE_ODDS = 1.5, 9.0
#: Different pages of its host on which a node must be for its importance to count.
LEAST_PAGES = 10
#: Share of a page's text that its article elements hold at least; with less they are teasers, and the page is judged without them.
ARTICLE_SHARE = 0.25

#: Elements that begin and end a block of text.
BLOCKS = frozenset("""address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure
footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section
summary table tbody td tfoot th thead tr ul""".split())
#: Elements whose text is never content.
NOISE = frozenset("""nav footer aside form noscript template iframe object svg canvas button select textarea dialog menu
search audio video map datalist head title""".split())
#: Elements without content of their own, and those whose content is raw text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "xmp", "noembed", "noframes"))
#: Elements that a new element of the given kind closes, and the elements that stop the search for them.
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "optgroup": ("option", "optgroup")}
SCOPES = frozenset(("ul", "ol", "dl", "table", "select", "article", "main", "body", "div", "section"))
#: Words in a class, id or role that mark menus, adverts, notices, comments and the like.
HINTS = frozenset("""ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie
cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter notice overlay pager pagination popup promo
promoted recommended related reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar
widget contentinfo complementary alert alertdialog replies responses""".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))

#: Hints under which an article element is a comment or a teaser and not the article, and classes that make it one itself.
FOREIGN = frozenset("""comment comments disqus reply replies respond responses related recommended promoted sponsored advertisement""".split())
FOREIGN_CLASSES = frozenset(("comment", "comment-body", "reply"))

_TAG = re.compile(r"""<([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*"|'[^']*')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HOST = re.compile(r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)")


def host_of(url: str | None) -> str:
    found = _HOST.match(url or "")
    return found[1].lower() if found else ""


def _key(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x00".join(parts).encode("utf-8", "surrogatepass")) - (1 << 63)


class _Node:
    """An open element: its path key in the site's style tree, and what is known of it beforehand."""

    __slots__ = ("tag", "path", "noise", "mute", "byline", "foreign", "core", "asked", "inner", "children")

    def __init__(self, tag: str, path: int, noise: bool = False, mute: bool = False, byline: bool = False, foreign: bool = False,
                 core: int | None = None, asked: tuple = (), inner: tuple = ()):
        self.tag, self.path, self.noise, self.mute, self.byline, self.foreign = tag, path, noise, mute, byline, foreign
        self.core, self.asked, self.inner = core, asked, inner
        self.children: list[str] = []


class Block:
    """A block of text: noise by kind or class, the article element it is in, and the nodes it hangs from: those with the odds
    of any element (``asked``) and plain ones inside the article (``inner``)."""

    __slots__ = ("noise", "core", "asked", "inner", "text")

    def __init__(self, top: _Node, text: str):
        self.noise, self.core, self.asked, self.inner, self.text = top.noise or top.byline, top.core, top.asked, top.inner, text


class Page:
    """The blocks of one page in order, and the child sequences of its style nodes. ``article``: does the page have an article
    element with a fair share of its text?"""

    def __init__(self, source: str):
        self.blocks: list[Block] = []
        self.shapes: dict[int, list[str]] = {}
        self._text: list[str] = []
        self._stack = [_Node("", 0)]
        self._parse(source)
        self._flush()
        while len(self._stack) > 1:
            self._pop()
        size = lambda inside: sum(len(b.text) for b in self.blocks if not b.noise and (b.core is not None) == inside)
        self.article = size(True) > 0 and size(True) >= ARTICLE_SHARE * (size(True) + size(False))

    def _add(self, text: str) -> None:
        if not self._stack[-1].mute:
            self._text.append(text)

    def _flush(self) -> None:
        if self._text:
            text = " ".join("".join(self._text).split())
            self._text.clear()
            if text:
                self.blocks.append(Block(self._stack[-1], text))

    def _pop(self) -> None:
        node = self._stack.pop()
        if node.path in (*node.asked, *node.inner, node.core):
            self.shapes.setdefault(node.path, []).extend(node.children)

    @staticmethod
    def _told(tag: str, found: dict[str, str], words: set[str]) -> bool:
        """Do the attributes mark a menu, an advert, comments or the like? A heading tells its subject, not its role; an id only
        counts as a whole (``related-work`` may be a chapter)."""
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in found.get("style", "").replace(" ", ""):
            return True
        return tag not in HEADINGS and tag not in ("html", "body") and not (words | {found.get("id", "").lower()}).isdisjoint(HINTS)

    def _open(self, tag: str, attributes: str) -> None:
        block, found = tag in BLOCKS, {}
        if attributes and not attributes.isspace():
            found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)}
        words = set(re.split(r"[\s_-]+", " ".join(found.get(a, "") for a in ("class", "role")).lower()))
        foreign = self._stack[-1].foreign
        core = tag in ("article", "main") and not foreign and FOREIGN_CLASSES.isdisjoint(found.get("class", "").lower().split())
        hinted = not core and self._told(tag, found, words)
        if block:
            if not self._stack[-1].mute:
                self._flush()
            if self._stack[-1].tag == "p":
                self._pop()
            if tag in CLOSES:
                for i in range(len(self._stack) - 1, 0, -1):
                    if self._stack[i].tag in CLOSES[tag]:
                        self._cut(i)
                    elif self._stack[i].tag in SCOPES:
                        break
        elif tag == "br":
            self._add(" ")
        foreign = foreign or (tag not in ("html", "body", *HEADINGS) and not core and not (words | {found.get("id", "").lower()}).isdisjoint(FOREIGN))
        if tag in VOID or not (block or hinted or tag in NOISE):
            return
        up = self._stack[-1]
        name = tag + "." + ".".join(sorted(found.get("class", "").split()))
        path = _key(str(up.path), name)
        # an article inside a wrapper with a telling class is still the article; one in a menu or among comments is not
        kind = tag in NOISE or any(n.tag in NOISE for n in self._stack)
        noise = kind or (tag == "header" and up.core is None) or ((hinted or up.noise) and not core)
        inside = path if core and not noise else up.core
        byline = (up.byline or (tag == "header" and up.core is not None)) and tag not in HEADINGS
        asked, inner = up.asked, up.inner
        if core and not noise:
            asked, inner = (), ()  # the wrappers of an article hold menus and other text as well
        elif inside is not None and not found.get("class") and not found.get("id"):
            inner = (*inner, path)
        elif tag not in ("html", "body"):
            asked = (*asked, path)
        up.children.append(name)
        # what is noise inside a line is left out of it; the line goes on
        self._stack.append(_Node(tag, path, noise, up.mute or (noise and not block), byline, foreign, inside, asked, inner))

    def _cut(self, i: int) -> None:
        while len(self._stack) > i:
            self._pop()

    def _close(self, tag: str) -> None:
        if tag in BLOCKS and not self._stack[-1].mute:
            self._flush()
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i].tag == tag:
                self._cut(i)
                return
            if tag not in BLOCKS and self._stack[i].tag in BLOCKS and not self._stack[i].mute:
                return

    def _parse(self, s: str) -> None:
        at, n = 0, len(s)
        while at < n:
            lt = s.find("<", at)
            if lt < 0:
                self._add(html.unescape(s[at:]))
                return
            if lt > at:
                self._add(html.unescape(s[at:lt]))
            c = s[lt + 1:lt + 2]
            if s.startswith("<!--", lt):
                end = s.find("-->", lt + 4)
                at = n if end < 0 else end + 3
            elif c in ("!", "?"):
                end = s.find(">", lt)
                at = n if end < 0 else end + 1
            elif c == "/":
                end = s.find(">", lt)
                name = re.match(r"[a-zA-Z][^\s/>]*", s[lt + 2:lt + 40])
                if name and end >= 0:
                    self._close(name[0].lower())
                at = n if end < 0 else end + 1
            elif c.isascii() and c.isalpha():
                m = _TAG.match(s, lt)
                if m is None:  # an open quote: up to the next bracket; a tag without an end is dropped
                    end = s.find(">", lt)
                    if end < 0:
                        return
                    name, attributes, at = re.match(r"[a-zA-Z][^\s/>]*", s[lt + 1:end + 1])[0].lower(), "", end + 1
                else:
                    name, attributes, at = m[1].lower(), m[2], m.end()
                if name in RAW:
                    end = re.compile(f"</{re.escape(name)}", re.I).search(s, at)
                    close = s.find(">", end.start()) if end else -1
                    at = n if close < 0 else close + 1
                else:
                    self._open(name, attributes)
            else:
                self._add("<")
                at = lt + 1


SCHEMA = ("page_id {}, url string, host string, page long, blocks array<struct<asked:array<long>,inner:array<long>,core:long,feature:long,words:int,text:string>>, "
          "shapes array<struct<node:long,shape:long>>")


def parse_pages(pages: DataFrame, content: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Per page its host, a hash of its blocks, the blocks that are not noise by kind or class nor outside the page's article, each
    with its style nodes, and the child sequence of each node."""
    slim = pages.select(F.col(content).alias("t"), F.col(key).alias("page_id"), F.col(url).alias("url"))
    kind = dict(slim.dtypes)["page_id"]
    block_type = pa.list_(pa.struct([("asked", pa.list_(pa.int64())), ("inner", pa.list_(pa.int64())), ("core", pa.int64()), ("feature", pa.int64()),
                                     ("words", pa.int32()), ("text", pa.string())]))
    shape_type = pa.list_(pa.struct([("node", pa.int64()), ("shape", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, 0, 1 << 21):
                hosts, hashes, blocks, shapes = [], [], [], []
                for source, link in zip(part.column(0).to_pylist(), part.column(2).to_pylist()):
                    page = Page(source or "")
                    rows = [{"asked": b.asked, "inner": b.inner if page.article else (), "core": b.core if page.article else None,
                             "feature": _key(b.text), "words": b.text.count(" ") + 1, "text": b.text}
                            for b in page.blocks if not b.noise and (b.core is not None or not page.article)]
                    runs = {k: [c for i, c in enumerate(v) if not i or c != v[i - 1]] for k, v in page.shapes.items()}
                    hosts.append(host_of(link))
                    hashes.append(_key(*[b.text for b in page.blocks]))
                    blocks.append(rows)
                    shapes.append([{"node": k, "shape": _key(*v)} for k, v in runs.items()])
                yield pa.RecordBatch.from_arrays(
                    [part.column(1), part.column(2), pa.array(hosts), pa.array(hashes), pa.array(blocks, block_type), pa.array(shapes, shape_type)],
                    ["page_id", "url", "host", "page", "blocks", "shapes"])

    return slim.mapInArrow(run, SCHEMA.format(kind))


def node_importance(parsed: DataFrame) -> DataFrame:
    """Importance of every style node of every host: (host, node, pages, importance).

    Pages of a host that have equal blocks count once. A node's presentation importance is the entropy of its child
    sequences over its m pages, to base m. Its content importance is one minus the mean entropy of its text blocks, by
    their words: a block on one page has entropy 0, one spread evenly over all m pages 1. Only sums leave a group, so no host
    meets in one task.
    """
    shapes = parsed.select("host", "page", F.explode("shapes").alias("s")).groupBy("host", "s.node", "s.shape", "page").agg(F.lit(1).alias("one"))
    shapes = shapes.groupBy("host", "node", "shape").agg(F.count(F.lit(1)).alias("n"))
    look = shapes.groupBy("host", "node").agg(F.sum("n").alias("pages"), F.sum(F.col("n") * F.log("n")).alias("nlogn"))
    m = F.col("pages")
    look = look.withColumn("look", F.when(m > 1, (F.log(m) - F.col("nlogn") / m) / F.log(m)).otherwise(F.lit(1.0)))
    nodes = F.concat("b.asked", "b.inner", F.filter(F.array("b.core"), lambda c: c.isNotNull()))
    seen = (parsed.select("host", "page", F.explode("blocks").alias("b")).select("host", "page", "b.feature", "b.words", F.explode(nodes).alias("node"))
            .groupBy("host", "node", "feature", "page").agg(F.count(F.lit(1)).alias("n"), F.max("words").alias("words")))
    features = seen.groupBy("host", "node", "feature").agg(F.sum("n").alias("times"), F.sum(F.col("n") * F.log("n")).alias("nlogn"), F.max("words").alias("words"))
    mass = F.col("times") * F.col("words")
    spread = features.groupBy("host", "node").agg(
        F.sum(mass).alias("all"), F.sum(mass * (F.log("times") - F.col("nlogn") / F.col("times"))).alias("entropy"))
    both = look.select("host", "node", "pages", "look").join(spread.select(F.col("host").alias("h"), F.col("node").alias("k"), "all", "entropy"),
                                                             (F.col("host") == F.col("h")) & (F.col("node") == F.col("k")), "left")
    words = F.when((m > 1) & (F.col("all") > 0), 1 - F.col("entropy") / F.col("all") / F.log(m)).otherwise(F.lit(1.0))
    return both.select("host", "node", "pages", (CONTENT_WEIGHT * words + (1 - CONTENT_WEIGHT) * F.col("look")).alias("importance"))


def extract_main_text(pages: DataFrame, content: str = "html", key: str = "page_id", url: str = "url") -> DataFrame:
    """Main text of every page: ``key``, ``url``, ``text``, ``n_chars``.

    The pages of a host are merged into a style tree whose nodes are element paths with their classes. Each block hangs from
    the nodes above it, and each node has prior odds of being content by its kind and class. Menus, footers, adverts, forms,
    comments and the like, and text outside the page's article, have odds that no importance makes up for and go at once.
    Of the rest a branch goes when its importance on the host is too low for its odds (``ODDS``, ``ARTICLE_ODDS``). A plain
    branch of an article goes only if the article as a whole is not as common as that: on a host whose pages are near
    copies everything is common. What is left is decoded, white space inside a block becomes one space, and blocks are
    joined by an empty line in page order.

    Nulls: null or empty markup gives an empty text; a null url belongs to the host without a name; a null key is kept. Pages
    of hosts with few different pages are judged by the prior odds alone. Repeated rows are kept each. Other columns
    are ignored. An empty table gives an empty result.
    """
    parsed = cut(parse_pages(pages, content, key, url), "parsed-pages")
    least, least_inner = 1 / (1 + ODDS), 1 / (1 + ARTICLE_ODDS)
    low = node_importance(parsed).filter((F.col("pages") >= LEAST_PAGES) & (F.col("importance") < least))
    low = cut(low.groupBy(F.col("host").alias("low_host")).agg(
        F.collect_set("node").alias("low"), F.collect_set(F.when(F.col("importance") < least_inner, F.col("node"))).alias("lowest")), "low-nodes")
    joined = parsed.select("page_id", "url", "host", "blocks").join(low, F.col("host") == F.col("low_host"), "left")
    none = F.array().cast("array<bigint>")
    common, rare = F.coalesce("low", none), F.coalesce("lowest", none)
    goes = lambda b: (F.arrays_overlap(b["asked"], common)
                      | (F.arrays_overlap(b["inner"], rare) & ~F.array_contains(common, F.coalesce(b["core"], F.lit(0)))))
    text = F.array_join(F.transform(F.filter("blocks", lambda b: ~goes(b)), lambda b: b["text"]), "\n\n")
    return joined.select(F.col("page_id").alias(key), F.col("url").alias(url), text.alias("text"), F.length(text).cast("long").alias("n_chars"))
