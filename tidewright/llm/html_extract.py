"""Main text of web pages by tree scoring.

A page is read into a tree (end tags that authors leave out are implied). Elements
that are no prose by kind (menus, page headers, footers, asides, forms, scripts,
styles) or by the words of their class, id or role (adverts, notices, reader
comments and the like) are set aside; inside an article, a part whose name also
holds words of its own and whose paragraphs read as prose stays, whatever its name.
Every paragraph gives points for its length and commas to its parent, half of them to
the grandparent and a third to the next, and each container's points are discounted
by the share of its text that is links. The best container is kept, raised to the
article that it is part of, with those siblings, articles included, that score well or
read as prose. The text of what is kept is the result.

Each row is handled alone in an Arrow batch bounded in bytes: no shuffle, no state.

Edge cases: null and empty html, and pages without prose, give an empty text; a
document that ends inside a tag or comment is read as far as it goes; tags may be
nested to any depth; repeated rows are extracted one by one; nulls in other kept columns stay; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewright.llm.shared import bound_batches, frugal

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTR = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)

# What HTML says of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noframes xmp template".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split()
)
ENDS_P = BLOCK - frozenset("td th tr tbody thead tfoot caption li dd dt".split())
ENDS_SAME = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tbody", "thead", "tr", "td", "th"), "thead": ("tbody",), "tfoot": ("tbody", "tr", "td", "th")}
FENCES = {"li": frozenset(("ul", "ol", "menu")), "dt": frozenset(("dl",)), "dd": frozenset(("dl",))}
TABLE = frozenset(("table",))

# Elements and words that mark what is no prose.
NO_PROSE = frozenset("nav footer aside form button select input textarea dialog menu search fieldset head svg canvas object audio video map".split())
NO_PROSE_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar tablist".split())
NO_PROSE_WORDS = frozenset(
    """ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promos promotion promoted banner banners
    cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups modal overlay paywall newsletter subscribe
    subscription signup login register sidebar sidebars aside rail widget widgets related recommended recommendations recommend more share
    sharing social follow nav navbar navigation navigations menu menus submenu breadcrumb breadcrumbs pagination pager toolbar topbar footer
    footers foot masthead header headers comment comments commentlist disqus reply replies respond discussion discussions responses feedback copyright legal
    disclaimer skip search form hidden hide tags""".split()
)
#: Words of reader comments, and words that only say what kind of box something is.
COMMENT_WORDS = frozenset("comment comments commentlist disqus reply replies respond discussion discussions responses".split())
BOX_WORDS = frozenset(
    """box block container wrapper wrap inner outer list item items area section group row col column grid panel card cards module bar top bottom left right main side center
    link links button buttons icon icons text title heading head body content post posts article articles entry story stories page site blog news you we us our the a an by of to for and on in with more
    up out all new latest popular this it form field input label image img media count number total author user name date time meta info author avatar thread depth odd even byuser bypostauthor
    wp js el id no is has default primary secondary small large big wide full fixed sticky floating inline print mobile desktop hidden visible active open closed container fluid clearfix cf""".split()
)
#: Words of the above that are also used for the frame of an article; they count outside an article only.
FRAME_WORDS = frozenset("header headers more tags legal discussion discussions alert alerts respond responses feedback promotion search form skip hide follow rail notice".split())
#: Words of page frames; one that holds most of the page's prose is kept whatever else it is called (with-sidebar, no-menu).
LAYOUT_WORDS = frozenset("with has no content main page wrapper wrap container layout body post article entry story text".split())
PARAGRAPHS = frozenset("html p pre blockquote td th dd dt li h1 h2 h3 h4 h5 h6 figcaption div section article main body address caption summary center".split())
CONTAINERS = frozenset(("html", "body", "main", "article"))

#: Share of link text from which a list of LINKS links or more is a menu; in an article, links of so many characters on average are references.
MENU_DENSITY, LINKS, REFERENCE = 0.8, 3, 25
#: Characters of a paragraph that reads as prose, most of its share of links, and the share of the best score from which a sibling article stays.
PROSE, PROSE_DENSITY, SIBLING = 100, 0.25, 0.3


class Node:
    __slots__ = ("tag", "words", "role", "unseen", "parent", "children", "chars", "links", "commas", "points", "gone")

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.words: frozenset[str] = frozenset()
        self.role = ""
        self.unseen = False
        self.children: list[Node | str] = []
        self.chars = self.links = self.commas = 0
        self.points = 0.0
        self.gone = False


def _describe(node: Node, attributes: str) -> None:
    words: list[str] = []
    for name, a, b, c in _ATTR.findall(attributes):
        name, value = name.lower(), a or b or c
        if name == "style":
            node.unseen |= bool(_UNSEEN.search(value))
        elif name == "hidden":
            node.unseen |= value != "until-found"
        elif name == "aria-hidden":
            node.unseen |= value.lower() == "true"
        elif name == "role":
            node.role = value.strip().lower()
        else:
            words += _PART.findall(value)
    node.words = frozenset(w.lower() for w in words)


def parse(html: str) -> Node:
    root = Node("html", None)
    here, at, end = root, 0, len(html)
    open_: dict[str, int] = {}  # elements of each tag that enclose `here`

    def leave(to: Node) -> Node:
        at = here
        while at is not to:
            open_[at.tag] -= 1
            at = at.parent
        return to

    while at < end:
        m = _TAG.search(html, at)
        if m is None:
            here.children.append(html[at:])
            break
        if m.start() > at:
            here.children.append(html[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            continue
        tag, closing = tag.lower(), m[1] or m[4]
        if closing:
            up, block = here if open_.get(tag) or tag == "html" else None, tag in BLOCK
            while up is not None and up.tag != tag:
                if not block and up.tag in BLOCK or up.tag in TABLE and tag not in TABLE and tag in ("p", "li", "div"):
                    up = None  # an end tag without its start
                    break
                up = up.parent
            if up is not None and up.parent is not None:
                here = leave(up.parent)
            elif tag == "p":
                here.children.append("\n")
            continue
        if tag in ("html", "body") and (tag == "html" or any(isinstance(c, Node) and c.tag == "body" for c in root.children)):
            _describe(here, m[3] or m[6] or "") if here.tag == tag else None
            continue
        if tag in RAW:
            stop = re.compile(f"</{tag}[\\s/>]", re.I).search(html, at)
            at = stop.start() if stop else end
            at = html.find(">", at) + 1 or end
            continue
        if tag == "body":
            here = leave(root)
        if tag in ENDS_P or tag in ENDS_SAME:
            up, ended = here if open_.get("p") and tag in ENDS_P or any(open_.get(t) for t in ENDS_SAME.get(tag, ())) else None, None
            ends, fence = ENDS_SAME.get(tag, ()), FENCES.get(tag, TABLE)
            while up is not None and up.tag not in TABLE and up.tag not in fence:
                if up.tag in ends or up.tag == "p" and tag in ENDS_P:
                    ended = up
                if up.tag in BLOCK and up.tag not in ends and up.tag != "p" and (not ends or up.tag in ("article", "section", "body")):
                    break
                up = up.parent
            if ended is not None:
                here = leave(ended.parent)
        node = Node(tag, here)
        attributes = m[3] or m[6] or ""
        if attributes and not attributes.isspace():
            _describe(node, attributes)
        here.children.append(node)
        if tag not in VOID and not (attributes.endswith("/") and tag not in BLOCK and tag not in ("a", "b", "i", "em", "strong", "span")):
            here = node
            open_[tag] = open_.get(tag, 0) + 1
    return root


def _order(root: Node) -> list[Node]:
    """Nodes, each before those inside it."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        found.append(node)
        todo += [c for c in reversed(node.children) if not isinstance(c, str)]
    return found


def _measure(nodes: list[Node]) -> None:
    """Characters, characters in links, and commas of what is inside each node and not gone."""
    for node in nodes:
        node.chars = node.links = node.commas = 0
    for node in reversed(nodes):
        if node.gone:
            continue
        for c in node.children:
            if isinstance(c, str):
                node.chars += len(c.strip())
                node.commas += c.count(",") + c.count("、") + c.count("，")
        if node.tag == "a":
            node.links = node.chars
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.links += node.links
            up.commas += node.commas


def _reads_as_prose(node: Node) -> bool:
    """Whether a paragraph inside is long and no list of links."""
    todo = [node]
    while todo:
        x = todo.pop()
        if x.gone:
            continue
        if x.tag in ("p", "blockquote", "pre") and x.chars - x.links >= PROSE and x.links < PROSE_DENSITY * x.chars:
            return True
        todo += [c for c in x.children if not isinstance(c, str)]
    return False


def _set_aside(nodes: list[Node]) -> None:
    _measure(nodes)
    whole = nodes[0].chars
    inside: set[int] = set()
    for node in nodes:
        up = node.parent
        nested = up is not None and id(up) in inside
        if nested or node.tag == "article":
            inside.add(id(node))
        if up is not None and up.gone:
            node.gone = True
            continue
        if node.tag == "article" and node.words & COMMENT_WORDS and (nested or node.words <= COMMENT_WORDS | BOX_WORDS):
            node.gone = 2 * (node.chars - node.links) <= whole
            continue
        if node.tag in CONTAINERS:
            continue
        within = id(node) in inside
        marked = node.words & NO_PROSE_WORDS
        if within and node.words & FRAME_WORDS and node.words & {"article", "entry", "post", "content", "story"}:
            marked = marked - FRAME_WORDS
        named = bool(marked) or node.role in NO_PROSE_ROLES
        own = node.words - NO_PROSE_WORDS - BOX_WORDS
        if named and within and len({w for w in own if len(w) > 2}) >= 1 and node.role not in NO_PROSE_ROLES and node.tag not in NO_PROSE:
            named = not (_reads_as_prose(node) and (not marked & COMMENT_WORDS or _titled(node)))
        holds = bool(node.words & LAYOUT_WORDS) and 2 * (node.chars - node.links) > whole
        if node.tag in NO_PROSE or node.unseen or node.tag == "header" and not within:
            node.gone = not (node.tag in ("form", "fieldset") and 2 * (node.chars - node.links) > whole)
        elif named and node.tag not in ("p", "h1", "span", "a", "b", "i", "em", "strong") or named and node.tag in ("p", "span", "a") and not node.words <= FRAME_WORDS:
            node.gone = not holds
    _measure(nodes)
    counts: dict[int, int] = {}
    for node in reversed(nodes):
        n = counts.get(id(node), 0) + (node.tag == "a" and not node.gone)
        if node.parent is not None and n:
            counts[id(node.parent)] = counts.get(id(node.parent), 0) + n
    for node in nodes:
        if node.parent is not None and node.parent.gone:
            node.gone = True
        elif node.tag in ("ul", "ol", "dl", "div", "table", "section") and node.chars and counts.get(id(node), 0) >= LINKS and node.links >= MENU_DENSITY * node.chars:
            node.gone = not (id(node) in inside and node.links >= REFERENCE * counts[id(node)])
    _measure(nodes)


def _titled(node: Node) -> bool:
    """Whether an element's name is that of its first heading, as anchors of sections are."""
    for c in node.children:
        if not isinstance(c, str) and c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            said = {w.lower() for w in _PART.findall(_text([c]))}
            return len(said) > 1 and node.words <= said
    return False


def _score(nodes: list[Node]) -> None:
    for node in nodes:
        if node.gone or node.tag not in PARAGRAPHS:
            continue
        blocks = [c for c in node.children if not isinstance(c, str) and c.tag in BLOCK]
        if node.tag in ("p", "pre", "h1", "h2", "h3", "h4", "h5", "h6") or not blocks:
            chars, commas = node.chars - node.links, node.commas
        else:  # only what it says itself
            own = [c for c in node.children if isinstance(c, str)]
            chars, commas = sum(len(c.strip()) for c in own), sum(c.count(",") for c in own)
        if chars <= 0:
            continue
        points = min(chars / 25, 1.0) + commas + min(chars / 100, 3.0)
        up, share = node.parent if node.tag not in ("body", "html", "article", "main") else node, 1
        while up is not None and share <= 3:
            up.points += points / share
            up, share = up.parent, share + 1
    for node in nodes:
        if node.chars:
            node.points *= 1 - node.links / node.chars


def _kept(nodes: list[Node]) -> list[Node]:
    able = [n for n in nodes if not n.gone and n.points > 0]
    if not able:
        return []
    best = max(able, key=lambda n: n.points)
    up, chosen = best, None
    while up is not None:
        if up.tag == "article":
            chosen = up
        elif chosen is None and (up.tag == "main" or up.role == "main"):
            chosen = up
            break
        up = up.parent
    if chosen is not None:
        if chosen.tag != "article" or chosen.parent is None:
            return [chosen]
        # Parts of one text that are articles of their own.
        least = SIBLING * max(chosen.points, best.points)
        beside = [c for c in chosen.parent.children if not isinstance(c, str) and c.tag == "article" and not c.gone]
        return [c for c in beside if c is chosen or c.points >= least and _reads_as_prose(c)]
    # A container whose parent holds much more prose of the same kind is only a part.
    while best.parent is not None and best.parent.tag not in ("html", "body") and best.parent.points >= 0.6 * best.points and best.parent.chars - best.parent.links > 1.2 * (best.chars - best.links):
        best = best.parent
    if best.parent is None:
        return [best]
    kept = []
    for c in best.parent.children:
        if isinstance(c, str) or c.gone:
            continue
        prose = c.chars - c.links
        dense = c.links / c.chars if c.chars else 1.0
        if c is best or c.points >= max(3.0, 0.2 * best.points) or c.tag in ("p", "h1", "h2", "h3", "blockquote", "pre") and dense < 0.25 and prose > 0 or prose > 80 and dense < 0.25 and c.commas:
            kept.append(c)
    return kept


def _text(kept: list[Node]) -> str:
    parts: list[str] = []
    todo: list[Node | str] = list(reversed(kept))
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            parts.append(x)
        elif not x.gone:
            if x.tag in BLOCK:
                parts.append("\n")
                todo.append("\n")
            elif x.tag == "br":
                parts.append("\n")
            todo += reversed(x.children)
    # References are decoded piece by piece: text on two sides of a tag makes no reference.
    return " ".join("".join(unescape(p) if "&" in p else p for p in parts).split())


def main_text(html: str | None) -> str:
    if not html:
        return ""
    nodes = _order(parse(html.replace("\x00", "")))
    _set_aside(nodes)
    _score(nodes)
    return _text(_kept(nodes))


def _run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        *others, html = batch.columns
        texts = pa.array([main_text(x) for x in html.to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([*others, texts], names=[*batch.schema.names[:-1], "text"])


def extract(pages: DataFrame, html: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """keep, the main text, and its length in code points, for each row of pages."""
    bound_batches(pages.sparkSession)
    rows = pages.select(*keep, F.col(html).cast("string").alias("_html"))
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("text", T.StringType())])
    return rows.mapInArrow(frugal(_run), schema).withColumn("n_chars", F.length("text").cast("long"))
