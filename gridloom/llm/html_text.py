"""Main text of HTML pages by tree scoring.

Blocks of text pass points (one, one per comma, one per 100 characters up to three) to their container and, halved and
in ever smaller parts, to its ancestors; a container's score is discounted by its link density. The best container and
those siblings, of it and of its ancestors, that look like text are kept.

Boilerplate is left out before the scores are made. Elements that are never text go at once; those that only a name, a role or a
form marks are judged by what they hold: one that holds more points than all that stands outside of such elements is a
wrapper around the text, not boilerplate, and what it holds is judged in turn.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: element names of HTML
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea title xmp noembed noframes select object canvas audio video desc metadata".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr output q rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br picture svg math".split())
DROPPED = frozenset("head nav footer aside button dialog menu datalist dir".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split())
#: Items that the next one of their kind closes: the place in Node.near, and what ends the search for an open one.
CLOSES = {"li": 1, "dt": 2, "dd": 2, "td": 3, "th": 3, "tr": 4, "option": 5}
ENDS = {"ul": (1,), "ol": (1,), "dl": (2,), "table": (3, 4), "select": (5,)}
ENDS_ALL = frozenset("div article section main body".split())

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
ATTR = re.compile(r"(class|id|role|style|hidden|aria-hidden)(?![\w-])(?:\s*=\s*(\"[^\"]*\"?|'[^']*'?|[^\s>]+))?", re.I)
#: Parts of names of what is boilerplate unless it wraps the heading or the article (STRICT), and of what may as well be a wrapper (LOOSE).
STRICT = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|advertising|adsbox|adslot|sponsor(?:ed|s)?|promos?|promotions?|cookies?|cookie-?bar|consent|gdpr|popups?|modals?|newsletters?|subscribe|subscriptions?|"
    r"side-?bars?|menus?|nav|navs|navbar|navigation|breadcrumbs?|foot|footer|comments?|commentlist|disqus|repl(?:y|ies)|respond|discussion|related|recommend(?:ed|ations?)?|shar(?:e|ing)|social|pagination|pager|skip-?links?|search|search-?form|copyright|disclaimer)(?:$|[\s_-])",
    re.I,
)
LOOSE = re.compile(r"(?:^|[\s_-])(?:banners?|notices?|alerts?|overlays?|signup|login|header|masthead|topbar|widgets?|toolbar)(?:$|[\s_-])", re.I)
#: Names that tell of a page's layout, not of the element itself.
LAYOUT = re.compile(r"(?:^|\s)(?:no|has|with|without|is|not|hide|show)[_-]\S*", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar note".split())
CLEAN, SOFT, NAMED, HARD = range(4)


class Node:
    __slots__ = ("tag", "up", "kids", "score", "points", "chars", "linked", "noise", "inside", "head", "near", "marks")

    def __init__(self, tag: str, up: Node | None, noise: int = CLEAN, head: bool = False):
        self.tag, self.up, self.kids, self.score, self.points, self.chars, self.linked, self.noise = tag, up, [], 0.0, 0.0, 0, 0, noise
        self.inside = up is not None and (up.inside or up.tag in ("article", "main"))
        self.head = head or up is not None and up.head  # in a header: only its headings may be text
        near = list(up.near) if up is not None else [None] * 6
        if tag in ENDS_ALL:
            near = [None] * 6
        elif tag in CLOSES_P:
            near[0] = None
        for k in ENDS.get(tag, ()):
            near[k] = None
        if tag == "tr":
            near[3] = None
        if tag == "p":
            near[0] = self
        elif tag in CLOSES:
            near[0] = None
            near[CLOSES[tag]] = self
        self.near = near
        self.marks = 0  # headings of the first order, articles and main elements in it
        if up is not None:
            up.kids.append(self)


class Block:
    __slots__ = ("text", "linked", "up")

    def __init__(self, text: str, linked: int, up: Node):
        self.text, self.linked, self.up = text, linked, up
        up.kids.append(self)

    def points(self) -> float:
        n = (1 + self.text.count(",") + min(len(self.text) // 100, 3)) * (1 - self.linked / len(self.text))
        return 0.2 * n if self.up.tag in HEADINGS else n


def _noise(tag: str, attrs: str) -> tuple[int, bool]:
    """What an element's tag and attributes make of it, and whether it is a header."""
    if tag in DROPPED:
        return HARD, False
    found, head = SOFT if tag in ("form", "fieldset") else CLEAN, tag == "header"
    if "=" not in attrs and "hidden" not in attrs:
        return found, head
    for k, v in ATTR.findall(attrs):
        k, v = k.lower(), v.strip("\"'").strip().lower()
        if k == "hidden" and v != "until-found" or k == "aria-hidden" and v == "true":
            return HARD, False
        if k == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", v):
            return HARD, False
        if k == "role" and v in ROLES:
            found = max(found, SOFT if v in ("banner", "alert", "note", "toolbar") else NAMED)
        if k in ("class", "id") and tag not in ("html", "body", "main", "p", *HEADINGS):
            v = LAYOUT.sub(" ", v)
            if STRICT.search(v):
                found = NAMED
            elif LOOSE.search(v):
                found = max(found, SOFT)
                head = head or re.search(r"(?:^|[\s_-])header(?:$|[\s_-])", v) is not None
    return found, head


def parse(page: str) -> Node:
    """The tree of block elements; inline elements only tell how much of a block is linked. Linear in the page's length."""
    root = node = Node("#root", None)
    opened: Counter = Counter()
    text: list[str] = []
    linked, anchors, drawn, at, n = 0, 0, 0, 0, len(page)
    find = TAG.search

    def end_block() -> None:
        nonlocal linked
        if text:
            s = " ".join(html.unescape("".join(text)).split())
            text.clear()
            if s and node.noise != HARD:
                Block(s, min(linked, len(s)), node)
            linked = 0

    def leave(last: Node) -> Node:
        """Closes all elements up to this one."""
        x = node
        while True:
            opened[x.tag] -= 1
            if x is last:
                return x.up
            x = x.up

    while at < n:
        m = find(page, at)
        upto = m.start() if m else n
        if upto > at:
            text.append(page[at:upto])
            if anchors:
                linked += upto - at
        if not m:
            break
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text.append(m[0][9:].removesuffix("]]>"))
            continue
        tag, closing = m[2].lower(), m[1]
        if tag in INLINE:
            if tag == "br":
                text.append(" ")
            elif tag == "a":
                anchors = max(0, anchors + (-1 if closing else 1))
            elif tag in ("svg", "math"):
                drawn = max(0, drawn + (-1 if closing else not m[3].rstrip().endswith("/")))
            continue
        if tag in RAW:
            if not closing and not m[3].rstrip().endswith("/"):
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>?", re.I).search(page, at)
                at = stop.end() if stop else n
                text.append(" ")
            continue
        if drawn and tag not in CLOSES_P:
            continue  # parts of a formula or a drawing
        drawn = 0
        end_block()
        anchors = 0
        if closing:
            if opened[tag] > 0:
                x = node
                while x.tag != tag:
                    x = x.up
                node = leave(x)
            continue
        if tag in VOID:
            continue
        if tag in CLOSES_P and node.near[0] is not None:
            node = leave(node.near[0])
        if tag in CLOSES:
            last = node.near[CLOSES[tag]] or (node.near[3] if tag == "tr" else None)
            if last is not None:
                node = leave(last)
        kind, head = (HARD, False) if node.noise == HARD else _noise(tag, m[3])
        if head and not node.inside and kind == CLEAN:
            kind = SOFT
        node = Node(tag, node, kind, head)
        opened[tag] += 1
        if m[3].rstrip().endswith("/") and tag not in CLOSES_P and tag not in CLOSES:
            node = leave(node)
    end_block()
    return root


def _walk(node: Node | Block, enter=lambda x: True) -> Iterator[Node | Block]:
    """In page order; elements that aren't to be entered are given, not what they hold."""
    stack = [node]
    while stack:
        x = stack.pop()
        yield x
        if isinstance(x, Node) and (x is node or enter(x)):
            stack.extend(reversed(x.kids))


def _clean(x: Node) -> bool:
    return x.noise == CLEAN


def _judge(root: Node) -> None:
    """Marks elements that are noise by name only, but wrap the text, as clean."""
    nodes = [x for x in _walk(root) if isinstance(x, Node)]
    for x in reversed(nodes):
        x.points += sum(k.points() for k in x.kids if isinstance(k, Block))
        x.marks += x.tag in ("h1", "article", "main")
        if x.up is not None and x.noise != HARD:
            x.up.points += x.points
            x.up.marks += x.marks
    outside, marks, waiting, no = 0.0, 0, [], 0

    def look(top: Node) -> None:
        """Adds what stands in an element outside of noise; the noise in it waits, the richest first."""
        nonlocal outside, marks, no
        for x in _walk(top, _clean):
            if isinstance(x, Block):
                outside += x.points() if x.up.noise == CLEAN else 0.0
            elif x is not top and x.noise in (SOFT, NAMED):
                heappush(waiting, (-x.points, no := no + 1, x))
            elif x.noise == CLEAN:
                marks += x.tag in ("h1", "article", "main")

    look(root)
    while waiting:
        _, _, x = heappop(waiting)
        if x.points > outside and (x.noise == SOFT or x.marks and not marks):
            x.noise = CLEAN
            x.head = False
            look(x)


def _density(node: Node) -> float:
    return node.linked / node.chars if node.chars else 0.0


def _texts(node: Node | Block) -> list[str]:
    """Texts of an element in page order, without the noise in it; of headers, the headings."""
    if isinstance(node, Block):
        return [node.text]
    out, stack = [], [(node, node.head and node.noise != CLEAN)]
    while stack:
        x, head = stack.pop()
        if isinstance(x, Block):
            if not head or x.up.tag in HEADINGS:
                out.append(x.text)
            continue
        head = head or x.tag == "header" or x.noise == SOFT and x.head
        if x is node or x.noise == CLEAN or x.noise == SOFT and x.head:
            stack.extend((k, head) for k in reversed(x.kids))
    return out


def main_text(page: str | None) -> str:
    """Text of the main container: its blocks in page order, joined by a blank line; empty where there is no text."""
    if not page:
        return ""
    root = parse(page)
    _judge(root)
    nodes, blocks = [], []
    for x in _walk(root, _clean):
        if isinstance(x, Node):
            if x.noise == CLEAN:
                nodes.append(x)
        elif x.up.noise == CLEAN:
            blocks.append(x)
    if not blocks:
        return ""
    for b in blocks:
        b.up.chars += len(b.text)
        b.up.linked += b.linked
        points = b.points()
        up = b.up.up if b.up.tag in ("p", "pre", "blockquote", *HEADINGS) and b.up.up is not None else b.up
        share, level = 1.0, 0
        while up is not None and level < 5:
            up.score += points * share
            level += 1
            share = 0.5 if level == 1 else 1 / (3 * level)
            up = up.up
    for x in reversed(nodes):
        if x.up is not None:
            x.up.chars += x.chars
            x.up.linked += x.linked
    best = max(nodes, key=lambda x: x.score * (1 - _density(x)))
    least = max(10.0, 0.2 * best.score * (1 - _density(best)))
    before, out, after, x, level = [], _texts(best), [], best, 0
    while x.up is not None and x.tag not in ("body", "html"):
        side = before_side = []
        after_side: list[str] = []
        for s in x.up.kids:
            if s is x:
                side = after_side
            elif _kept(s, least, level, side is before_side):
                side += _texts(s)
        before, after = before_side + before, after + after_side
        x, level = x.up, level + 1
    return "\n\n".join([*before, *out, *after])


def _kept(s: Node | Block, least: float, level: int, first: bool) -> bool:
    """Whether a sibling of the best container (level 0) or of its ancestors belongs to the text; first: it stands before."""
    if isinstance(s, Block):
        return len(s.text) > 80 and s.linked < 0.25 * len(s.text)
    if s.noise != CLEAN:
        return s.noise == SOFT and s.head and first and s.marks > 0
    if s.tag in HEADINGS:
        return level == 0 or first and s.tag in ("h1", "h2")
    if s.tag == "header":
        return first and bool(_texts(s))
    if s.score * (1 - _density(s)) >= least:
        return True
    if s.tag != "p" or not s.chars or level:
        return False
    return s.chars > 80 and _density(s) < 0.25 or not s.linked and re.search(r"[.!?](\s|$)", " ".join(_texts(s))) is not None


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts = [main_text(x) for x in b.column(2).to_pylist()]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points). Null or empty html, and pages without text, give an
    empty text and 0; repeated rows and null ids stay as they are; other columns are ignored. No shuffle: one page is read at a time."""
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return src.mapInArrow(_extract, "page_id long, url string, text string, n_chars long").withColumnsRenamed({"page_id": id_col, "url": url_col})


def op4_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract_main_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
