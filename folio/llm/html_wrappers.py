"""Main-text extraction by union-free wrappers: pages of one host are aligned into one template with slots.

A wrapper is a union-free regular expression over tags: elements, each once, optional or repeated, around text slots that are
constant or vary. Two wrappers are aligned tag stream by tag stream, from the page's down to each element's; what mismatches becomes
optional, what recurs side by side becomes a repeated group, text that differs becomes a slot, and marks that differ from page to page become
an attribute slot. A page is a wrapper too, so that any number of pages fold in any grouping. The main text is where the
host's pages vary in prose: neither constants nor repeated groups of short slots, as menus are, count.
"""

from __future__ import annotations

import hashlib
import json
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, small_batches, strings

#: The wrappers of so many hosts, those with most pages, and of so many characters are broadcast; others are joined by host.
BROADCAST_HOSTS, BROADCAST_CHARS = 5_000, 64 << 20
#: Longer constants are held in wrappers as hashes, which compare as the texts do.
LONGEST_CONSTANT = 40
#: A constant is a host's own text once so many pages share it whose texts differ; copies of a page count once.
SHARED_BY = 3
#: Elements of one name at one place, none on every page, whose marks are so many become one element with any marks.
MARK_VARIANTS = 8
#: A repeated slot of fewer characters on average is a menu's; the main text is the deepest element that holds this share of the prose.
MENU_CHARS, MAIN_SHARE = 25, 0.6
#: Characters of wrappers that are sent on at once.
EMIT_CHARS = 4_000_000
#: Levels of the tree; what is nested deeper belongs to the deepest level, its blocks stay apart.
MAX_DEPTH = 120
_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/<>]*+)((?:[^<>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/<>]*+)([^<>]*+)>|[^<]++|<""", re.S)
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)
#: Numbers of a page: any in an id, long ones in a class.
_NUMBER, _LONG_NUMBER = re.compile("[0-9]+"), re.compile("[0-9]{4,}")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "iframe", "noembed", "noframes", "xmp"}
#: Structural elements; all others are inline and dissolve into the text around them.
BLOCK = {
    "html", "head", "body", "address", "article", "aside", "blockquote", "button", "caption", "center", "dd", "details", "dialog", "dir", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "legend", "li", "main", "menu", "nav",
    "noscript", "ol", "optgroup", "option", "p", "pre", "search", "section", "select", "summary", "svg", "table", "tbody", "template", "tfoot", "thead", "tr", "ul", "label",
}
#: A start tag that ends an open paragraph, and elements that end their own like.
_ENDS_P = BLOCK - {"html", "head", "body", "option", "optgroup", "svg", "label", "button", "select"}
_LIKE = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "option": {"option"}, "tbody": {"tbody", "thead", "tfoot"}, "tfoot": {"tbody", "thead"}, "body": {"head"}}
_LIKE_STOP = {"ul", "ol", "dl", "table", "menu", "dir", "select", "article", "section", "body"}
_P_STOP = _LIKE_STOP | {"div"}
EXCLUDED = {"head", "nav", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "noscript", "svg", "template", "fieldset", "legend", "search", "label"}
#: Words of a class, id or role that mark what is not the article.
NOT_MAIN = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertisements?|adbox|adslot|banners?|breadcrumbs?|comments?|commentlist|cookies?|consent|disqus|dropdown|footer|gdpr|login|masthead|menus?|modal|nav|navbar|navigation|newsletter|"
    r"notices?|pagination|pager|popups?|promos?|promotions?|recommended|related|replies|respond|search|share|sharing|sidebars?|signup|skip|social|sponsors?|sponsored|subscribe|subscription|toolbar|widgets?|contentinfo|complementary)(?:$|[\s_-])",
    re.I,
)
#: Elements that can't be the main region themselves, but hold a part of it.
PARTS = {"p", "li", "dd", "dt", "ul", "ol", "dl", "dir", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "header", "table", "tbody", "thead", "tfoot", "tr", "caption", "figure", "figcaption", "details", "summary", "address", "hr"}
#: Elements that can't be the main region themselves, but hold a part of it.
PARTS = {"p", "li", "dd", "dt", "ul", "ol", "dl", "dir", "blockquote", "pre", "h1", "h2", "h3", "h4", "h5", "h6", "hgroup", "header", "table", "tbody", "thead", "tfoot", "tr", "caption", "figure", "figcaption", "details", "summary", "address", "hr"}
MAIN = re.compile(r"\b(?:main|article|post|entry|story|content)\b")
RESULT = "page_id long, url string, text string, n_chars long"


def digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


class Node:
    __slots__ = ("children", "count", "key", "optional", "pages", "repeated", "size", "text")

    def __init__(self, key: str, text: str | None = None):
        self.key, self.text, self.children = key, text, []
        self.optional = self.repeated = False
        self.size, self.count = len(text or ""), 1  # characters, and how many elements or texts are merged here
        self.pages: list[int] = []  # of a constant: the smallest SHARED_BY marks of pages that hold it

    @property
    def tag(self) -> str:
        return self.key.split("|")[0]

    def dump(self) -> list:
        return [self.key, self.text, int(self.optional) + 2 * int(self.repeated), self.size, self.count, [c.dump() for c in self.children], self.pages]

    @classmethod
    def load(cls, x: list) -> Node:
        n = cls(x[0], x[1])
        n.optional, n.repeated, n.size, n.count = bool(x[2] & 1), bool(x[2] & 2), x[3], x[4]
        n.children, n.pages = [cls.load(c) for c in x[5]], x[6]
        return n


@lru_cache(20_000)
def mark_key(marked: str) -> str:
    """Class, id and role in a key: what the whole of them says ("-" is not the article, "+" may be its root), then they themselves, long ones as a hash."""
    said = ("-" if marked.startswith("hidden") or NOT_MAIN.search(marked) else "") + ("+" if MAIN.search(marked) else "")
    return f"{said}:{marked if len(marked) <= 80 else '#' + digest(marked)}".replace("/", "_")


def any_marks(key: str) -> str:
    """The key of the element with any marks that say the same."""
    tag, _, marks = key.partition("|")
    return f"{tag}|{marks.partition(':')[0]}:*" if marks else key


def excluded(key: str, in_main: bool) -> bool:
    tag, _, marks = key.partition("|")
    return tag in EXCLUDED or (tag == "header" and not in_main) or marks.startswith("-")


def parse(html: str) -> Node:
    """The structural tree of a page; inline tags are dropped, texts stay whole under "#text" nodes."""
    root = Node("#page")
    stack: list[Node] = [root]
    text: list[str] = []

    def flush() -> None:
        if text:
            joined = " ".join(unescape("".join(text)).split())
            text.clear()
            if joined and not (deep and deep[-1][0]):
                stack[min(len(stack), MAX_DEPTH) - 1].children.append(Node("#text", joined))

    deep: list[tuple[bool, bool]] = []  # of open elements below the deepest level: whether excluded, whether in the main text
    places: dict[str, list[int]] = {}  # where in the stack each name is open

    def last(names) -> int:
        return max([at[-1] for name, at in places.items() if at and name in names], default=0)

    def close(i: int) -> None:
        while len(stack) > i:
            places[stack.pop().tag].pop()
        del deep[max(0, i - MAX_DEPTH) :]

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.match(html, at)
        at = m.end()
        name = m[2] or m[5]
        if not name:
            s = m[0]
            if s[0] != "<" or s == "<":
                text.append(s)
            elif s.startswith("<![CDATA["):
                text.append(s[9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        name, closing, attributes = name.lower(), m[1] or m[4], m[3] or m[6] or ""
        if closing:
            if name in BLOCK:
                i = last((name,))
                if name != "p" or i:
                    flush()
                if i > (last(_LIKE_STOP) if name in ("p", "li") else 0):
                    close(i)
            elif name in ("td", "th"):
                text.append(" ")
            continue
        if name in RAW:
            end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(html, at)
            at = end.end() if end else n
            continue
        if name in BLOCK:
            flush()
            if name in _ENDS_P and (i := last(("p",))) > last(_P_STOP):
                close(i)
            if name in _LIKE and (i := last(_LIKE[name])) > last(_LIKE_STOP):
                close(i)
            marks = {a.lower(): (b or c or d or "") for a, b, c, d in _ATTRIBUTE.findall(attributes)} if attributes else {}
            marked = " ".join(filter(None, ["hidden" if "hidden" in marks or marks.get("aria-hidden") == "true" else "", _LONG_NUMBER.sub("0", marks.get("class", "")), _NUMBER.sub("0", marks.get("id", "")), marks.get("role", "")]))
            node = Node(f"{name}|{mark_key(marked)}" if marked else name)
            if len(stack) < MAX_DEPTH:
                if name in ("ul", "ol", "dl", "menu") and stack[-1].key in ("div", "section") and not stack[-1].children:
                    stack[-1].key += "|:list"  # an unmarked element that begins with a list is of its own kind
                stack[-1].children.append(node)
            if name not in VOID and not attributes.endswith("/"):
                if len(stack) >= MAX_DEPTH:
                    dead, main = deep[-1] if deep else (False, any(x.tag in ("article", "main") for x in stack))
                    deep.append((dead or excluded(node.key, main), main or name in ("article", "main")))
                places.setdefault(name, []).append(len(stack))
                stack.append(node)
        elif name in ("br", "td", "th"):
            text.append(" ")
    flush()
    return root


def merge(a: Node, b: Node, key: str | None = None) -> Node:
    """The template of two nodes of one key, or of two that `key` stands for."""
    out = Node(key or a.key, a.text if a.text == b.text else None)
    out.optional, out.repeated, out.size, out.count = a.optional or b.optional, a.repeated or b.repeated, a.size + b.size, a.count + b.count
    if out.text is not None:
        out.pages = a.pages if a.pages == b.pages else sorted({*a.pages, *b.pages})[:SHARED_BY]
    out.children = align(a.children, b.children)
    return out


def fold_repeats(children: list[Node], longest: int = 3) -> list[Node]:
    """Like neighbours become one repeated node, recurring sequences of two or three a repeated group."""
    if len({c.key for c in children}) == len(children):
        return children
    out: list[Node] = []
    for c in children:
        if out and out[-1].key == c.key:
            optional = out[-1].optional and c.optional
            out[-1] = merge(out[-1], c)
            out[-1].repeated, out[-1].optional = True, optional
        else:
            out.append(c)
    for period in range(2, longest + 1):
        i, done = 0, []
        while i < len(out):
            names = [c.key for c in out[i : i + period]]
            j = i + period
            while len(names) == period and [c.key for c in out[j : j + period]] == names:
                j += period
            if j > i + period:
                group = Node("#group " + " ".join(names))
                group.repeated = True
                group.children = out[i : i + period]
                for k in range(i + period, j, period):
                    group.children = [merge(x, y) for x, y in zip(group.children, out[k : k + period], strict=True)]
                done.append(group)
                i = j
            else:
                done.append(out[i])
                i += 1
        out = done
    return out


def _regroup(children: list[Node], other: list[Node]) -> list[Node]:
    """A sequence that the other side knows as a repeated group becomes a group that occurs once."""
    for g in (x for x in other if x.key.startswith("#group ")):
        names = [c.key for c in g.children]
        for i in range(len(children) - len(names) + 1):
            if [c.key for c in children[i : i + len(names)]] == names:
                group = Node(g.key)
                group.children = children[i : i + len(names)]
                children = [*children[:i], group, *children[i + len(names) :]]
                break
    return children


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Of pairs with ascending first numbers, a longest chain whose second ones ascend too."""
    tails, chain, before = [], [], []
    for i, (_, y) in enumerate(pairs):
        k = bisect_left(tails, y)
        tails[k:] = [y]
        chain[k:] = [i]
        before.append(chain[k - 1] if k else -1)
    out, i = [], chain[-1] if chain else -1
    while i >= 0:
        out.append(pairs[i])
        i = before[i]
    return out[::-1]


def matched(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of equal keys, ascending on both sides: keys that each side has once anchor the alignment, between them each key meets the next of its like."""
    where: dict[str, list[int]] = {}
    for j, k in enumerate(b):
        where.setdefault(k, []).append(j)
    times = Counter(a)
    anchors = _rising([(i, where[k][0]) for i, k in enumerate(a) if times[k] == 1 and len(where.get(k, ())) == 1])
    out, low, j = [], 0, 0
    for i_end, j_end in [*anchors, (len(a), len(b))]:
        for i in range(low, i_end):
            own = where.get(a[i], ())
            at = bisect_left(own, j)
            if at < len(own) and own[at] < j_end:
                out.append((i, own[at]))
                j = own[at] + 1
        out.append((i_end, j_end))
        low, j = i_end + 1, j_end + 1
    return out[:-1]


def align(a: list[Node], b: list[Node]) -> list[Node]:
    """Elements of equal keys merge in order; what only one side has becomes optional."""
    a, b = _regroup(a, b), _regroup(b, a)
    i = 0
    while i < len(a) and i < len(b) and a[i].key == b[i].key:
        i += 1
    j, out = i, [merge(x, y) for x, y in zip(a[:i], b[:i], strict=True)]
    if i == len(a) == len(b):
        return fold_repeats(_with_any_marks(out))
    lone: list[Node] = []
    for x, y in [*((x + i, y + i) for x, y in matched([n.key for n in a[i:]], [n.key for n in b[i:]])), (len(a), len(b))]:
        lone += [*a[i:x], *b[j:y]]
        out += [*a[i:x], *b[j:y]]
        if x < len(a):
            out.append(merge(a[x], b[y]))
        i, j = x + 1, y + 1
    for n in lone:
        n.optional = True
    return fold_repeats(_with_any_marks(out))


def _with_any_marks(children: list[Node]) -> list[Node]:
    """Optional elements of MARK_VARIANTS marks or more become one with any marks, repeated, where the first of them stands."""
    kinds: dict[str, set[str]] = {}
    for c in children:
        if c.optional and "|" in c.key:
            kinds.setdefault(any_marks(c.key), set()).add(c.key)
    wide = {k for k, keys in kinds.items() if len(keys) >= MARK_VARIANTS or k in keys}
    if not wide:
        return children
    out, place = [], {}
    for c in children:
        k = any_marks(c.key) if c.optional and "|" in c.key else None
        if k not in wide:
            out.append(c)
        elif k in place:
            out[place[k]] = merge(out[place[k]], c, k)
            out[place[k]].repeated = True
        else:
            place[k] = len(out)
            out.append(_renamed(c, k))
    return out


def _renamed(node: Node, key: str) -> Node:
    out = Node(key, node.text)
    out.optional, out.repeated, out.size, out.count, out.children, out.pages = node.optional, node.repeated, node.size, node.count, node.children, node.pages
    return out


def page_mark(page: Node) -> int:
    """What the texts of a page hash to: the same for copies."""
    texts, nodes = [], [page]
    while nodes:
        node = nodes.pop()
        if node.text is not None:
            texts.append(node.text)
        nodes += node.children
    return int(digest("\0".join(texts))[:15], 16)


def template(node: Node, mark: int | None = None) -> Node:
    """A page's tree as a wrapper: repeats folded from the leaves up, long texts as hashes."""
    mark = page_mark(node) if mark is None else mark
    out = Node(node.key, node.text if len(node.text or "") <= LONGEST_CONSTANT else "#" + digest(node.text))
    out.pages = [] if node.text is None else [mark]
    out.children = fold_repeats([template(c, mark) for c in node.children])
    out.size = len(node.text or "")
    return out


class _Place:
    """An element's place in a wrapper; groups dissolve into the places around them."""

    __slots__ = ("constant", "dead", "inner", "key", "main", "prose", "texts")

    def __init__(self, key: str, dead: bool, main: bool):
        self.key, self.dead, self.main = key, dead, main  # main: inside an article or main element
        self.inner: dict[str, _Place] = {}
        self.prose = self.texts = 0
        self.constant = True

    @property
    def tag(self) -> str:
        return self.key.split("|")[0]

    def at(self, key: str) -> _Place | None:
        return self.inner.get(key) or self.inner.get(any_marks(key))


def _fill(place: _Place, nodes: list[Node], repeated: bool) -> None:
    for n in nodes:
        if n.key == "#text":
            same = n.text is not None and len(n.pages) >= SHARED_BY
            place.constant, place.texts = place.constant and same, place.texts + 1
            if not place.dead and not same and not (repeated and n.size < MENU_CHARS * n.count):
                place.prose += n.size
        elif n.key.startswith("#group "):
            _fill(place, n.children, True)
        else:
            main = place.main or place.tag in ("article", "main")
            own = place.inner.get(n.key)
            if own is None:
                own = place.inner[n.key] = _Place(n.key, place.dead or excluded(n.key, main), main)
            before = own.prose
            _fill(own, n.children, repeated or n.repeated)
            place.prose += own.prose - before


def rules(wrapper: Node) -> tuple[_Place, list[_Place]]:
    """The wrapper's places, and the roots of the main text.

    The region is the deepest element with MAIN_SHARE of the prose that varies, with the headings and other plain blocks beside it.
    Names break ties: an article or main element around it, or else inside it, or one that is marked as content, takes its place.
    """
    top = _Place("#page", False, False)
    _fill(top, wrapper.children, False)
    path = [top]
    while True:
        below = [c for c in path[-1].inner.values() if not c.dead and c.prose >= MAIN_SHARE * top.prose > 0]
        if not below:
            break
        path.append(max(below, key=lambda c: (c.prose, c.key)))
    while path[-1].tag in PARTS:
        path.pop()
    for named in (lambda c: c.tag == "article", lambda c: c.tag == "main", lambda c: "+" in c.key.partition("|")[2].partition(":")[0]):
        around = [c for c in path if named(c)]
        if around:
            return top, around[-1:]
        inside = _below(path[-1], named, 1 if top.prose else 0)  # where nothing is prose, any text may be
        if inside:
            return top, inside
    while len(path) > 1 and path[-2].tag not in ("#page", "html", "body") and all(c is path[-1] or c.dead or c.tag in PARTS or not c.inner for c in path[-2].inner.values()):
        path.pop()
    return top, [path[-1]]


def _below(place: _Place, named, least: int) -> list[_Place]:
    """The outermost elements so named with so much prose."""
    found: list[_Place] = []
    nodes = [place]
    while nodes:
        for c in nodes.pop().inner.values():
            if not c.dead and c.prose >= least:
                (found if named(c) else nodes).append(c)
    return found


def extract(page: Node, known: tuple[_Place, list[_Place]] | None) -> str:
    """Blocks under the roots of the host's main text; outside article and main, text that pages of a host share goes, if they differ elsewhere.

    A page that has none of the roots is read by its own tree.
    """
    own = known is None
    top, roots = known or rules(template(page))
    blocks: list[str] = []
    met = False

    def walk(node: Node, place: _Place | None, dead: bool, main: bool, root: _Place | None) -> None:
        nonlocal met
        if node.key == "#text":
            if not dead and root is not None and not (place is not None and place.texts and place.constant and not root.main and root.tag not in ("article", "main")):
                blocks.append(node.text)
            return
        dead = dead or excluded(node.key, main)
        place = place.at(node.key) if place is not None else None
        if root is None and place is not None and any(place is r for r in roots):
            root, met = place, True
        for c in node.children:
            walk(c, place, dead, main or node.tag in ("article", "main"), root)

    whole = top if any(r is top for r in roots) else None
    met = whole is not None
    for c in page.children:
        walk(c, top, False, False, whole)
    if not met and not own:
        return extract(page, None)
    return "\n\n".join(blocks)


def host():
    """The host of a url; that of a null or odd one is empty."""
    return F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]*)", 1))


def _packed(wrapper: Node) -> str:
    return json.dumps(wrapper.dump(), separators=(",", ":"))


_SHAPE = "host string, wrapper string, pages long"


def _rows(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, (pa.string(), pa.string(), pa.int64()), strict=True)], names=["host", "wrapper", "pages"])


def _emit(folded: dict[str, tuple[Node, int]]) -> Iterator[pa.RecordBatch]:
    rows, held = [], 0
    for name, (wrapper, pages) in folded.items():
        rows.append((name, _packed(wrapper), pages))
        held += len(rows[-1][1])
        if held > EMIT_CHARS:
            yield _rows(rows)
            rows, held = [], 0
    folded.clear()
    yield _rows(rows)


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    folded: dict[str, tuple[Node, int]] = {}
    for batch in batches:
        for name, html in zip(batch.column(0).to_pylist(), strings(batch.column(1)), strict=True):
            one, have = template(parse(html)), folded.get(name)
            folded[name] = (merge(have[0], one), have[1] + 1) if have else (one, 1)
        if len(folded) > 2000:
            yield from _emit(folded)
    if folded:
        yield from _emit(folded)


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by host: wrappers of one host into one; what is held is one host's."""
    name, wrapper, pages = None, None, 0
    for batch in batches:
        out = []
        for h, w, n in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
            node = Node.load(json.loads(w))
            if h != name and wrapper is not None:
                out.append((name, _packed(wrapper), pages))
                wrapper, pages = None, 0
            name, wrapper, pages = h, merge(wrapper, node) if wrapper is not None else node, pages + n
        yield _rows(out)
    if wrapper is not None:
        yield _rows([(name, _packed(wrapper), pages)])


def infer_wrappers(pages: DataFrame) -> DataFrame:
    """host, wrapper, pages of every host, from all its pages: folded where they are read, then in two rounds, so that a hot host's parts meet as few small rows."""
    small_batches(pages.sparkSession)
    parts = pages.select(host().alias("host"), "html").mapInArrow(_fit, _SHAPE).withColumn("part", F.spark_partition_id() % 32)
    half = parts.repartition("host", "part").sortWithinPartitions("host", "part", "wrapper").select("host", "wrapper", "pages").mapInArrow(_join, _SHAPE)
    return half.repartition("host").sortWithinPartitions("host", "wrapper").mapInArrow(_join, _SHAPE)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict[str | None, tuple | None] = {None: None}
    for batch in batches:
        texts = []
        for html, wrapper in zip(strings(batch.column(2)), batch.column(3).to_pylist(), strict=True):
            if wrapper not in known:
                if len(known) > 2000:
                    known = {None: None}
                known[wrapper] = rules(Node.load(json.loads(wrapper)))
            texts.append(extract(parse(html), known[wrapper]))
        yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract_text(pages: DataFrame) -> DataFrame:
    """A row for each row of pages: the main text, from the whole html by its host's wrapper.

    A null html is empty, a null or odd url belongs to the host "". Repeated rows stay, and count as one page where text
    that pages share is looked for. A long page is one row; equal shares of prose go to the greater key; an empty table
    gives no rows; other columns are not read. The wrappers of the hosts with most pages are broadcast, so that no task
    gets all pages of one of them.
    """
    scratch = Scratch(pages.sparkSession, "wrappers")
    wrappers = scratch.write(infer_wrappers(pages), "wrappers").select("host", "wrapper", "pages")
    most = wrappers.orderBy(F.desc("pages"), "host").limit(BROADCAST_HOSTS)
    upto = F.sum(F.length("wrapper")).over(Window.orderBy(F.desc("pages"), "host"))  # over BROADCAST_HOSTS rows at most
    most = scratch.write(most.withColumn("upto", upto).where(F.col("upto") <= BROADCAST_CHARS).select("host", "wrapper"), "most")
    rows = pages.select(F.col("page_id").cast("long"), "url", "html", host().alias("host"))
    with_most = rows.join(F.broadcast(most), "host", "left")
    if wrappers.count() > most.count():
        hosts = F.broadcast(most.select("host"))
        others = rows.join(hosts, "host", "left_anti").join(wrappers.join(hosts, "host", "left_anti").select("host", "wrapper"), "host", "left")
        with_most = with_most.where("wrapper is not null").unionByName(others)
    return with_most.select("page_id", "url", "html", "wrapper").mapInArrow(_extract, RESULT)
