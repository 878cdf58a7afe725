"""Main text of web pages by site style trees.

The element paths of all pages of a host are merged into one tree. For each node (the path of tags, classes and ids from the
root) the tree counts pages, presentations (sequences of child tags) and contents (texts inside the node). With m pages,
the entropy of the presentations and the spread of the contents, both to the base m, give the node's importance: a node that
looks the same and says the same on all pages scores 0, one with a layout and words of its own on each page scores 1. The
same path on other hosts is a prior that weighs as much as PRIOR_PAGES pages, so that hosts with few pages are served too.

A page is read whole before anything is taken out of it. Branches whose importance is below THRESHOLD go. So do elements that
are never text of the article: by tag (navigation, footer, aside, form, ...), by role, or by a word in class or id (comments,
share, advert, ...). An element that holds an article or main element goes for none of these reasons. Names do not decide for
an element with a headline (h1), nor for one with most of the text of the article around it, or of the page, unless they are
those of reader comments; importance does not decide for the only headline. If its importance would take most of a page's
text, or names all of it, they are left aside. Where one article or main element holds a headline, or several hold at least
half of what is left, the page's text is theirs; otherwise all that is left is.

Text is given in blocks: character references decoded, white space turned into single spaces, blocks joined by two line
feeds. A null html gives an empty text. Pages without a url take no part in the tree and are judged by their elements only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from hashlib import blake2b
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, shared_folder, stored

THRESHOLD = 0.3
MIN_PAGES = 8
#: A host's nodes on a smaller share of its pages are no part of its frame; so a page meets at most so many nodes per one of its own.
MIN_SHARE = 0.01
PRIOR_PAGES = 8
#: Hosts that must have a path before it is a prior for others.
PRIOR_HOSTS = 3
#: Share of a node's own presentation in its importance grows with its number of presentations; this is the rest's decay.
DECAY = 0.9
#: Elements below this many others belong to the node above them.
DEPTH = 100
HELD = 300_000

# The element names of HTML by what they mean here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark q rp rt ruby s samp small span strike "
                   "strong sub sup time tt u var wbr br".split())
OPAQUE = "script style textarea title iframe noscript template svg canvas object select noframes xmp audio video".split()
NOISE_TAGS = frozenset("head nav footer aside form button menu dialog label input embed".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE_NAMES = frozenset("ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
                        "copyright disclaimer disqus footer form header login masthead menu modal nav navbar navigation newsletter notice "
                        "notification overlay pager pagination popup promo promoted promotion recommended related replies respond search share "
                        "sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar topbar widget widgets".split())
COMMENT_NAMES = frozenset("comment comments disqus replies respond".split())
TEXT_TAGS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd td th tr".split())
ROOTS = frozenset(("article", "main"))
SAFE = frozenset(("html", "body", "main"))
#: Opening one of these ends an open one of those, unless a container stands between.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr",), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
CONTAINERS = frozenset("ul ol dl table tbody thead tfoot tr body article section div main".split())

# Splits a page into text and, for each token between, its opaque name, slash, name and attributes.
_TOKEN = re.compile(
    r"<(?:!--.*?(?:-->|\Z)"
    r"|(" + "|".join(OPAQUE) + r")\b[^>]*+(?:>.*?(?:</\1\s*>|\Z)|\Z)"
    r"|(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']++|\"[^\"]{0,5000}\"|'[^']{0,5000}'|[\"'])*+)>"
    r"|[!?][^>]*+>)", re.S | re.I)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_NOT_NAMES = re.compile(r"(?<!\S)(?:no|has|with|without|is|js)[-_]\S+")  # they say what an element has or lacks, not what it is
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_DIGITS = re.compile(r"\d+")


def host_of(url: str | None) -> str | None:
    """The host of a url in lower case, without user and port."""
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//([^/?#\\]*)", url or "")
    return m[1].rsplit("@", 1)[-1].split(":")[0].lower() or None if m else None


def short_hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


#: Why an element may not be text of the article.
NAMED, TAGGED, COMMENTS = 1, 2, 4


class Element:
    __slots__ = ("tag", "node", "path", "line", "why", "root", "parent", "children", "chars", "holds", "gone")

    def __init__(self, tag: str, node: int, path: int, line: tuple[int, ...], why: int, root: bool, parent: Element | None):
        self.tag, self.node, self.path, self.line, self.why, self.root, self.parent = tag, node, path, line, why, root, parent
        self.children: list[str] = []
        self.chars, self.holds, self.gone = 0, 0, False


class Reader:
    """Walks pages; what happens with elements and texts is up to the subclasses' ``opened``, ``closed`` and ``said``."""

    def __init__(self):
        self.nodes: dict[tuple[int, str], tuple[int, int]] = {}
        self.looks: dict[tuple[str, str], tuple[str, str, int]] = {}

    def look(self, name: str, attrs: str) -> tuple[str, str, int]:
        """The element's tag, its label in the tree, and what in its tag, role or names says that it is not article text."""
        tag = name.lower()
        found = {k.lower(): a or b or c for k, a, b, c in _ATTR.findall(attrs)} if attrs else {}
        names = f"{found.get('class', '')} {found.get('id', '')}"
        words = {w.lower() for w in _WORD.findall(_NOT_NAMES.sub(" ", names))}
        named = found.get("role", "").lower() in NOISE_ROLES or "hidden" in found or found.get("aria-hidden") == "true" or not words.isdisjoint(NOISE_NAMES)
        why = (TAGGED if tag in NOISE_TAGS else 0) | (NAMED if named and tag not in ROOTS else 0)
        why |= COMMENTS if why & NAMED and not words.isdisjoint(COMMENT_NAMES) else 0
        why = 0 if tag in SAFE else why
        return tag, f"{tag} {_DIGITS.sub('0', names).strip()}", why

    def walk(self, host: str | None, html: str) -> None:
        if len(self.nodes) > HELD:
            self.nodes.clear()
        if len(self.looks) > HELD:
            self.looks.clear()
        top = self.top = Element("", short_hash(host or ""), 0, (), 0, False, None)
        stack, looks, nodes = [top], self.looks, self.nodes
        parts = _TOKEN.split(html)
        is_open: Counter[str] = Counter()
        for i in range(0, len(parts) - 1, 5):
            if parts[i]:
                self.said(top, parts[i])
            name, attrs = parts[i + 3], parts[i + 4]
            if name is None:
                continue
            down = 0  # the element to close, with all above it
            if parts[i + 2]:
                tag = name.lower()
                down = is_open[tag] and self.last_open(stack, (tag,), CONTAINERS if tag in INLINE or tag == "p" else ())
                if not down and tag not in INLINE:
                    self.broken()
            else:
                key = name, attrs
                if key not in looks:
                    looks[key] = self.look(name, attrs)
                tag, label, why = looks[key]
                if tag not in INLINE and is_open["p"]:
                    down = self.last_open(stack, ("p",), CONTAINERS)
                elif tag in ENDS:
                    down = self.last_open(stack, ENDS[tag], ("table", "ul", "ol", "dl") if tag == "tr" else CONTAINERS - {*ENDS[tag]})
            if down:
                while len(stack) > down:
                    gone = stack.pop()
                    is_open[gone.tag] -= 1
                    self.closed(gone)
                top = stack[-1]
            if parts[i + 2]:
                continue
            if tag == "br":
                self.said(top, " ")
                continue
            if tag in INLINE or len(top.line) >= DEPTH:
                node, path, line = top.node, top.path, top.line
            else:
                if (known := nodes.get((top.node, label))) is None:
                    known = nodes[top.node, label] = short_hash(f"{top.node}/{label}"), short_hash(f"{top.path}/{label}")
                node, path = known
                line = top.line if tag in SAFE else (*top.line, node)
            top.children.append(tag)
            element = Element(tag, node, path, line, why | (TAGGED if tag == "header" and not top.root else 0), top.root or tag in ROOTS, top)
            self.opened(element, top)
            if tag in VOID:
                self.closed(element)
            else:
                stack.append(element)
                top = element
                is_open[tag] += 1
        if parts[-1]:
            self.said(top, parts[-1])
        while len(stack) > 1:
            self.closed(stack.pop())

    @staticmethod
    def last_open(stack: list[Element], tags, stops) -> int:
        for i in range(len(stack) - 1, 0, -1):
            tag = stack[i].tag
            if tag in tags:
                return i
            if tag in stops:
                return 0
        return 0

    def opened(self, element: Element, parent: Element) -> None: ...

    def closed(self, element: Element) -> None: ...

    def broken(self) -> None: ...

    def said(self, top: Element, text: str) -> None: ...


PAGES, STYLE, CONTENT = 0, 1, 2


class Census(Reader):
    """Collects what a page adds to its host's tree: (node, kind, value), each once per page."""

    def page(self, host: str, html: str) -> set[tuple[int, int, int]]:
        self.found: set[tuple[int, int, int]] = set()
        self.paths: dict[int, int] = {}
        self.walk(host, html)
        return self.found

    def closed(self, element: Element) -> None:
        if element.tag not in INLINE and element.tag not in SAFE:
            self.found.add((element.node, PAGES, 0))
            self.paths[element.node] = element.path
            self.found.add((element.node, STYLE, short_hash(",".join(element.children))))

    def said(self, top: Element, text: str) -> None:
        if top.line and (text := text.strip()):
            value = short_hash(text)
            self.found.update([(node, CONTENT, value) for node in top.line])


ROOT, HEADLINE = 1, 2


class Extractor(Reader):
    """Collects the text blocks of a page, after it has been read whole."""

    def blocks(self, host: str | None, html: str, noise: set[int]) -> list[str]:
        self.elements: list[Element] = []
        self.parts: list[tuple[Element, str] | None] = []  # pieces of text, and None between blocks
        self.walk(host, html)
        self.weigh()
        self.mark(set(), True)
        if not (plain := self.left()):
            self.mark(set(), False)
            plain = self.left()
        elif noise:
            self.mark(noise, True)
            kept = self.left()
            if 2 * sum(map(len, kept)) >= sum(map(len, plain)):
                return kept
        return plain

    def weigh(self) -> None:
        """Of each element: the characters of text in it, and whether it holds articles or the headline."""
        for part in self.parts:
            if part:
                part[0].chars += len(part[1].strip())
        for e in reversed(self.elements):
            e.holds |= ROOT if e.tag in ROOTS else HEADLINE if e.tag == "h1" else 0
            e.parent.chars += e.chars
            e.parent.holds |= e.holds

    def mark(self, noise: set[int], use_names: bool) -> None:
        """Which elements go, with all below them."""
        alone = sum(e.tag == "h1" for e in self.elements) == 1
        around: dict[Element, Element] = {}  # the article around an element, or the page
        for e in self.elements:
            scope = around[e] = e if e.tag in ROOTS else around.get(e.parent, self.top)
            e.gone = e.parent.gone
            if e.gone or e.holds & ROOT:
                continue
            if e.why & TAGGED and e.tag != "form":
                e.gone = True
            elif use_names and e.why and not e.holds & HEADLINE:
                e.gone = e.why & COMMENTS != 0 or 2 * e.chars <= scope.chars
            # A host may hold many copies of one article: its paragraphs are no branches of the site.
            if e.node in noise and e.tag not in INLINE and e.tag not in SAFE and not (e.root and e.tag in TEXT_TAGS):
                e.gone = e.gone or not (e.holds & HEADLINE and alone)

    def left(self) -> list[str]:
        """The blocks of what is left."""
        blocks, held, inside = [], [], False
        for part in [*self.parts, None]:
            if part is None:
                if held and (text := " ".join(unescape("".join(held)).split())):
                    blocks.append((text, inside))
                held = []
            elif not part[0].gone:
                inside = part[0].root
                held.append(part[1])
        in_roots = [t for t, root in blocks if root]
        roots = [e for e in self.elements if e.tag in ROOTS and not e.gone and not e.parent.root]
        if len(roots) == 1 and roots[0].holds & HEADLINE and in_roots or 2 * sum(map(len, in_roots)) >= sum(len(t) for t, _ in blocks):
            return in_roots
        return [t for t, _ in blocks]

    def opened(self, element: Element, parent: Element) -> None:
        self.elements.append(element)
        if element.tag not in INLINE:
            self.parts.append(None)

    def closed(self, element: Element) -> None:
        if element.tag not in INLINE:
            self.parts.append(None)

    def broken(self) -> None:
        self.parts.append(None)

    def said(self, top: Element, text: str) -> None:
        self.parts.append((top, text))


def site_trees(pages: DataFrame) -> DataFrame:
    """Importance of the nodes of all hosts: host, node, path, n_pages, share (of the host's pages) and importance.

    Counts are combined in each task first. The importance of a path on all hosts, weighed by pages, is the prior of its nodes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        census, count, places = Census(), Counter(), {}

        def flush():
            keys = list(count)
            known = [places.get(k[0], (None, None)) if k[1] == PAGES else (None, None) for k in keys]
            return pa.record_batch([pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int32()),
                                    pa.array([k[2] for k in keys], pa.int64()), pa.array([h for h, _ in known], pa.string()),
                                    pa.array([p for _, p in known], pa.int64()), pa.array(count.values(), pa.int64())],
                                   names=["node", "kind", "value", "host", "path", "n"])

        for batch in batches:
            for small in bounded(batch, 4_000_000):
                for url, html in zip(small.column(0).to_pylist(), small.column(1).to_pylist()):
                    if (host := host_of(url)) is None:
                        continue
                    count.update(census.page(host, html))
                    places.update((node, (host, path)) for node, path in census.paths.items())
                    if len(count) > HELD:
                        yield flush()
                        count, places = Counter(), {}
        if count:
            yield flush()

    rows = pages.select("url", "html").where("url is not null and html is not null")
    counted = (rows.mapInArrow(run, "node bigint, kind int, value bigint, host string, path bigint, n bigint")
               .groupBy("node", "kind", "value").agg(F.sum("n").alias("n"), F.max("host").alias("host"), F.max("path").alias("path")))

    def over(kind: int, value):
        return F.sum(F.when(F.col("kind") == kind, value).otherwise(0.0))

    n = F.col("n").cast("double")
    total = counted.groupBy("node").agg(
        F.max("host").alias("host"), F.max("path").alias("path"), over(PAGES, n).alias("m"), F.count_if(F.col("kind") == STYLE).alias("styles"),
        over(STYLE, n).alias("sn"), over(STYLE, n * F.ln(n)).alias("snln"), over(CONTENT, n).alias("cn"), over(CONTENT, n * F.ln(n)).alias("cnln"))
    base = F.ln("m")
    presentation = F.when(F.col("m") > 1, F.least((F.ln("sn") - F.col("snln") / F.col("sn")) / base, F.lit(1.0))).otherwise(1.0)
    content = F.when((F.col("m") > 1) & (F.col("cn") > 0), 1 - F.col("cnln") / F.col("cn") / base).otherwise(F.when(F.col("m") > 1, 0.0).otherwise(1.0))
    rest = F.pow(F.lit(DECAY), F.col("styles"))
    own = stored(total.select("host", "node", "path", "m", ((1 - rest) * presentation + rest * content).alias("own")),
                 f"{shared_folder(pages.sparkSession, 'trees')}/own")
    on_all = own.groupBy("path").agg((F.sum(F.col("own") * F.col("m")) / F.sum("m")).alias("prior"), F.count("*").alias("hosts")).where(F.col("hosts") >= PRIOR_HOSTS)
    pages_of = own.groupBy("host").agg(F.max("m").alias("host_pages"))
    weighed = own.join(on_all, "path", "left").join(pages_of, "host")
    importance = F.when(F.col("prior").isNull(), F.col("own")).otherwise((F.col("own") * F.col("m") + F.col("prior") * PRIOR_PAGES) / (F.col("m") + PRIOR_PAGES))
    return weighed.select("host", "node", "path", F.col("m").cast("bigint").alias("n_pages"), (F.col("m") / F.col("host_pages")).alias("share"),
                          F.col("prior").isNotNull().alias("has_prior"), importance.alias("importance"))


def extract(pages: DataFrame, threshold: float = THRESHOLD, min_pages: int = MIN_PAGES, min_share: float = MIN_SHARE) -> DataFrame:
    """page_id, url, text, n_chars of every page. A ``threshold`` of 0 leaves the trees aside.

    The nodes to remove are gathered per host and written down before they meet the pages, so Spark knows their size: it sends
    them to every executor where they are few and joins by host where they are not. They are on ``min_share`` of the host's pages
    at least, hence no more than 1 / min_share times the nodes of a page.
    """
    known = (F.col("n_pages") >= min_pages) | F.col("has_prior")
    trees = site_trees(pages).where((F.col("importance") < threshold) & known & (F.col("share") >= min_share))
    noise = stored(trees.groupBy("host").agg(F.collect_list("node").alias("noise")), f"{shared_folder(pages.sparkSession, 'trees')}/noise")
    host = F.lower(F.regexp_extract("url", r"^\s*(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//(?:[^/?#\\]*@)?([^/?#\\:@]*)", 1)).alias("host")
    joined = pages.select("page_id", "url", "html", host).join(noise, "host", "left").select("page_id", "url", "html", "noise")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Extractor()
        for batch in batches:
            for small in bounded(batch, 4_000_000):
                texts = ["\n\n".join(reader.blocks(host_of(url), html or "", set(noise or ())))
                         for url, html, noise in zip(*(small.column(i).to_pylist() for i in (1, 2, 3)))]
                yield pa.record_batch([small.column(0), small.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                                      names=["page_id", "url", "text", "n_chars"])

    return joined.mapInArrow(run, "page_id bigint, url string, text string, n_chars bigint")
