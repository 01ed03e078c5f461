"""Main-text extraction by wrapper induction.

Three pages of each host are its references, and so are three of each layout that the host has (the pairs of containers that follow each other, with
their names): the shortest, and two picked by hashes. Every other page is aligned with those of its host and layout by simple tree matching: two
nodes match if their labels agree, and the children of matched nodes are aligned in order for the largest number of matches and, among
these, of equal texts. A text slot that holds the same text on most of the pages where it was aligned belongs to the template; slots that vary
hold content. Article landmarks mark where the content is if a page has them, with headings and paragraphs beside them in <main>; elsewhere it
is the body. Articles within an article are its comments. Menus, forms, notices and
the like are recognised by element, and template texts are left out inside and outside landmarks. A class, id or role drops a block if all of its
words are those of a menu, notice or the like, or if one of them is and the block holds a template text but not most of the content;
it never drops html, body, headings or landmarks.

Pages are parsed one at a time where they lie. Only counts per host and slot (a digest) are shuffled, added up per batch first, so a host
with a third of all pages is no bottleneck. References and templates reach the pages by a join on the host, broadcast only if their measured size is
at most ``BROADCAST_BYTES``.

Defined cases: a NULL or empty html gives the empty text; a NULL url, or one without a host, puts a page among those of
the empty host; pages equal to a reference say nothing about the template; if all text is template, it is kept, and so is all in blocks dropped by name if nothing else is left; every row is
extracted on its own, so repeated rows give repeated results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkloom.llm.urlfilter import host_and_path
from linkloom.session import durable

SAME = 0.6  # of the pages where a slot was aligned: from this share on its text is template
LEAST_PAGES = 3
BROADCAST_BYTES = 16 << 20
DEEPEST = 150  # elements nested deeper become siblings; their end tags are still theirs
MOST_CELLS = 1 << 18  # of one table; the alignment of longer lists is split
MOST_TREES = 3000  # references held by a task
_NODE = 1 << 24  # what a matched node weighs; an equal text weighs 1

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|[^<]+|<", re.S)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_ARTICLE = re.compile(r"<article\b", re.I)
_WORD = re.compile(r"[^a-z0-9]+")
_RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "xmp"}
_RAW_END = {tag: re.compile(rf"</{tag}\s*>", re.I) for tag in _RAW}
_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset", "figcaption",
    "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "html", "li", "main", "menu", "nav", "ol", "p",
    "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
_SCOPES = {"article", "body", "button", "caption", "html", "main", "section", "table", "td", "th"}
_SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_LISTS = {"ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "select", "menu"}
_CONTAINER = r"(?i)<(/?(?:body|div|section|article|main|nav|aside|header|footer|form|table|ul|ol|dl)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
_NAMES_IN_TAG = r"""(?i)(\b(?:class|id|role)\s*=\s*(?:"[^"]*"|'[^']*'|[^\s>]+))"""
_LANDMARKS = {"article", "main"}
_NOT_CONTENT = {
    "head", "nav", "aside", "footer", "form", "button", "select", "input", "label", "menu", "dialog", "svg", "canvas", "object", "audio", "video", "map",
} | _RAW
_NOT_CONTENT_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disqus "
    "footer header login masthead menu modal nav navbar navigation newsletter notice pagination popup promo promotion related reply replies "
    "share sharing sidebar signup social sponsor sponsored subscribe toolbar widget".split()
)
_COMMENTS = {"comment", "comments", "disqus", "replies", "reply", "respond", "responses"}
_AROUND_COMMENTS = set("area block body box container count feed holder item items list main post reader readers section thread user users wrap wrapper".split())
_LEADS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "blockquote", "pre", "figure", "header"}  # beside an article in <main>, these are its lead
_PLACES = set("bar bottom box global left main mobile page primary right secondary site sticky top".split())  # may stand beside such a name
_IN_ARTICLES = {"header", "related", "social", "widget"}  # there these may be content
_NOT_IN_ARTICLES = _NOT_CONTENT_NAMES - _IN_ARTICLES
_NEVER_BY_NAME = {"html", "body", "h1", "h2", "h3", "h4", "h5", "h6"} | _LANDMARKS


_NOTHING: frozenset[str] = frozenset()


class Node:
    """An element, or a text when ``tag`` is ``#text``."""

    __slots__ = ("tag", "names", "label", "children", "text", "shape", "size", "whole", "said")

    def __init__(self, tag: str, names: str = "", text: str = ""):
        self.tag, self.names, self.label, self.text = tag, names, f"{tag}.{names}", text
        self.children: list[Node] = []
        self.shape = self.size = self.whole = 0
        words = " ".join(text.split()) if tag == "#text" else ""
        self.said: frozenset[str] = frozenset((words,)) if words else _NOTHING

    def measure(self) -> None:
        """From the leaves up, set ``size``, the number of nodes, ``shape``, equal for trees of equal labels, ``said``, the texts, and ``whole``, equal for equal trees."""
        children = self.children
        if self.tag == "#text":
            self.size, self.shape, self.whole = 1, hash((self.label,)), hash((self.label, next(iter(self.said), "")))
        elif not children:
            self.size, self.shape = 1, hash((self.label,))
            self.whole = self.shape
        else:
            for child in children:
                child.measure()
            self.size = 1 + sum([c.size for c in children])
            self.shape = hash((self.label, *[c.shape for c in children]))
            self.whole = hash((self.label, *[c.whole for c in children]))
            self.said = children[0].said if len(children) == 1 else _NOTHING.union(*[c.said for c in children])

    def texts(self) -> list[Node]:
        return [self] if self.tag == "#text" else [t for c in self.children for t in c.texts()]


def parse(html: str, measured: bool = True) -> Node:
    """A forgiving tree: blocks end open paragraphs, list items end their like, stray end tags are ignored."""
    root = Node("#root")
    stack, opened = [root], defaultdict(int)
    at, end, match = 0, len(html), _TOKEN.match
    while at < end:
        token = match(html, at)
        at = token.end()
        whole, closing, tag, attributes = token.group(0, 1, 2, 3)
        if tag is None:
            if whole[:2] not in ("<!", "<?"):
                inside = stack[min(len(stack), DEEPEST) - 1].children
                if not whole.isspace():
                    inside.append(Node("#text", text=whole))
                elif inside:
                    inside.append(Node("#text", text=" "))
            continue
        tag = tag.lower()
        if closing:
            if opened[tag]:
                _close(stack, opened, {tag}, set())
            continue
        if tag in _BLOCKS and opened["p"]:
            _close(stack, opened, {"p"}, _SCOPES)
        if tag in _SIBLINGS:
            _close(stack, opened, _SIBLINGS[tag], _LISTS)
        found = _NAMES.findall(attributes) if attributes else ()
        names = " ".join(sorted(" ".join([a or b or c for a, b, c in found]).lower().split())) if found else ""
        node = Node(tag, names)
        stack[min(len(stack), DEEPEST) - 1].children.append(node)
        if tag in _RAW:
            close = _RAW_END[tag].search(html, at)
            node.text, at = html[at : close.start() if close else end], close.end() if close else end
        elif tag not in _VOID and not attributes.endswith("/"):
            stack.append(node)
            opened[tag] += 1
    if measured:
        root.measure()
    return root


def _close(stack: list[Node], opened: dict[str, int], tags: set[str], scopes: set[str]) -> None:
    for depth in range(len(stack) - 1, 0, -1):
        if stack[depth].tag in tags:
            for node in stack[depth:]:
                opened[node.tag] -= 1
            del stack[depth:]
            return
        if stack[depth].tag in scopes:
            return


def align(a: Node, b: Node, known: dict[tuple[int, int], int] | None = None) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the number of matched nodes and the matched texts.

    Of the largest matchings, one with the most equal texts is taken. Trees of equal shape match as wholes. So do equal
    children at either end of two lists, which no alignment can better; what lies between is aligned by dynamic programming.
    ``known`` keeps what pairs of trees weigh for further calls.
    """
    total, pairs, todo, known = 0, [], [(a, b)], {} if known is None else known
    while todo:
        x, y = todo.pop()
        if x.shape == y.shape:
            total += x.size
            pairs += zip(x.texts(), y.texts(), strict=True)
        elif x.label == y.label:
            total += 1
            ends, left, right = _ends(x, y)
            todo += ends
            if left and right:
                todo += [(left[i], right[j]) for i, j in _Weights(left, right, known).matched(0, len(left), 0, len(right))]
    return total, pairs


def _ends(a: Node, b: Node) -> tuple[list[tuple[Node, Node]], list[Node], list[Node]]:
    """Equal children at either end of two nodes, and the children between."""
    left, right = a.children, b.children
    most = min(len(left), len(right))
    head = next((i for i in range(most) if left[i].whole != right[i].whole), most)
    tail = next((i for i in range(most - head) if left[-1 - i].whole != right[-1 - i].whole), most - head)
    ends = [*zip(left[:head], right[:head], strict=True), *zip(left[len(left) - tail :], right[len(right) - tail :], strict=True)]
    return ends, left[head : len(left) - tail], right[head : len(right) - tail]


def _weigh(a: Node, b: Node, known: dict[tuple[int, int], int]) -> int:
    """What the best matching of two trees weighs: ``_NODE`` for each matched node and 1 for each equal text."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        if a.said.isdisjoint(b.said):
            return a.size * _NODE
        return a.size * _NODE + sum(x.said == y.said != frozenset() for x, y in zip(a.texts(), b.texts(), strict=True))
    common = a.said & b.said
    key = (_masked(a, common), _masked(b, common))
    if key not in known:
        ends, left, right = _ends(a, b)
        known[key] = _NODE + sum(_weigh(x, y, known) for x, y in ends) + (_Weights(left, right, known).best() if left and right else 0)
    return known[key]


def _masked(node: Node, kept: frozenset[str] | set[str]) -> int:
    """A hash of a tree's labels and of those of its texts that are in ``kept``."""
    if node.said.isdisjoint(kept):
        return node.shape
    return hash((node.label, *[_masked(c, kept) for c in node.children])) if node.children else node.whole


class _Weights:
    """The weights of all pairs from two lists of nodes, a row at a time."""

    def __init__(self, left: list[Node], right: list[Node], known: dict[tuple[int, int], int]):
        self.left, self.known = left, known
        common = set().union(*[x.said for x in left]) & set().union(*[y.said for y in right])
        # Texts that only one list has make no difference, so nodes that differ in nothing else are of one kind.
        self.row_kind = [_masked(x, common) for x in left]
        kinds: dict[int, int] = {}
        self.kinds: list[Node] = []
        kind = []
        for y in right:
            kind.append(kinds.setdefault(_masked(y, common), len(kinds)))
            if kind[-1] == len(self.kinds):
                self.kinds.append(y)
        self.kind = np.array(kind)
        self.saying: dict[str, list[int]] = {}
        for k, y in enumerate(self.kinds):
            for text in y.said & common:
                self.saying.setdefault(text, []).append(k)
        self.rows: dict[int, np.ndarray] = {}
        self.bare: dict[int, list[int]] = {}

    def row(self, i: int) -> np.ndarray:
        x, kind = self.left[i], self.row_kind[i]
        if kind not in self.rows:
            if x.shape not in self.bare:
                self.bare[x.shape] = [_bare(x, y, self.known) for y in self.kinds]
            weights = self.bare[x.shape]
            alike = {k for text in x.said if text in self.saying for k in self.saying[text]}
            if alike:
                weights = weights.copy()
                for k in alike:
                    weights[k] = _weigh(x, self.kinds[k], self.known)
            if len(self.rows) * len(self.kind) > 4 * MOST_CELLS:
                self.rows.clear()
            self.rows[kind] = np.array(weights, np.int64)[self.kind]
        return self.rows[kind]

    def last(self, rows: Iterable[int], columns: slice) -> np.ndarray:
        """What the best alignment of these rows with the first 0, 1, ... of these columns weighs."""
        best = None
        for i in rows:
            row = self.row(i)[columns]
            best = np.zeros(len(row) + 1, np.int64) if best is None else best
            best[1:] = np.maximum.accumulate(np.maximum(best[:-1] + row, best[1:]))
        return best

    def best(self) -> int:
        return int(self.last(range(len(self.left)), slice(None))[-1])

    def matched(self, a: int, b: int, c: int, d: int) -> list[tuple[int, int]]:
        """The pairs of a best alignment of rows ``a`` to ``b`` with columns ``c`` to ``d``."""
        out, todo = [], [(a, b, c, d)]
        while todo:
            a, b, c, d = todo.pop()
            if a == b or c == d:
                continue
            if b - a > 1 and (b - a) * (d - c) > MOST_CELLS:  # where the columns part between two halves of the rows
                middle = (a + b) // 2
                upper = self.last(range(a, middle), slice(c, d))
                lower = self.last(range(b - 1, middle - 1, -1), slice(d - 1, c - 1 if c else None, -1))[::-1]
                cut = c + int(np.argmax(upper + lower))
                todo += [(a, middle, c, cut), (middle, b, cut, d)]
                continue
            best = np.zeros((b - a + 1, d - c + 1), np.int64)
            for i in range(a, b):
                best[i - a + 1, 1:] = np.maximum.accumulate(np.maximum(best[i - a, :-1] + self.row(i)[c:d], best[i - a, 1:]))
            i, j = b - a, d - c
            while i and j:
                if best[i, j] == best[i - 1, j]:
                    i -= 1
                elif best[i, j] == best[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((a + i, c + j))
        return out


def _bare(a: Node, b: Node, known: dict[tuple[int, int], int]) -> int:
    """What two trees weigh by their shapes alone."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        return a.size * _NODE
    key = (a.shape, b.shape)
    if key not in known:
        left, right = a.children, b.children
        best = [0] * (len(right) + 1)
        rows: dict[int, list[int]] = {}
        for x in left:
            if x.shape not in rows:
                rows[x.shape] = [_bare(x, y, known) for y in right]
            here = [0]
            for j, weight in enumerate(rows[x.shape]):
                here.append(max(best[j] + weight, best[j + 1], here[j]))
            best = here
        known[key] = _NODE + best[-1]
    return known[key]


class Texts:
    """The texts of a tree in page order, and the places where each of them stands."""

    __slots__ = ("root", "nodes", "words", "places", "said")

    def __init__(self, root: Node):
        self.root, self.nodes = root, root.texts()
        self.words = [next(iter(t.said), "") for t in self.nodes]
        places: dict[str, list[int]] = {}
        for i, words in enumerate(self.words):
            places.setdefault(words, []).append(i)
        self.places = {words: tuple(at) for words, at in places.items()}
        self.said = places.keys() - {""}


class Alignments:
    """Alignments by what they depend on: the shapes of two trees and where they have equal texts.

    Pages of a host differ in their words far more than in these, so most pairs of pages are looked up.
    """

    def __init__(self):
        self.known: dict[tuple[int, int], int] = {}
        self.pairs: dict[tuple, list[tuple[int, int]]] = {}
        self.kept = 0

    def places(self, a: Texts, b: Texts) -> list[tuple[int, int]]:
        """The matched texts of :func:`align` as places in ``a`` and ``b``, but for those of white space alone."""
        common = frozenset((a.places[t], b.places[t]) for t in a.said & b.said)
        key = (a.root.shape, b.root.shape, common, a.places.get(""), b.places.get(""))
        found = self.pairs.get(key)
        if found is None:
            if len(self.known) > MOST_CELLS:
                self.known.clear()
            left, right = ({id(t): i for i, t in enumerate(x.nodes)} for x in (a, b))
            found = [(left[id(x)], right[id(y)]) for x, y in align(a.root, b.root, self.known)[1] if x.said]
            self.kept += len(found) + 1
            if self.kept > MOST_CELLS:
                self.pairs.clear()
                self.kept = len(found) + 1
            self.pairs[key] = found
        return found


def _slots(root: Node) -> dict[int, bytes]:
    """The texts by node, each named by a digest of its path of labels and its text."""
    out: dict[int, bytes] = {}
    todo = [(root, "")]
    while todo:
        node, path = todo.pop()
        if node.tag == "#text":
            if node.said:
                out[id(node)] = hashlib.blake2b(f"{path}|{' '.join(node.text.split())}".encode("utf-8", "surrogatepass"), digest_size=16).digest()
        elif node.children:
            path = f"{path}/{node.label}"
            todo += [(c, path) for c in node.children]
    return out


def _is_content(node: Node, in_landmark: bool, by_name: bool = True) -> bool:
    if node.tag in _NOT_CONTENT or node.tag == "header" and not in_landmark:
        return False
    if not by_name or not node.names or node.tag in _NEVER_BY_NAME:
        return True
    listed = _NOT_IN_ARTICLES if in_landmark else _NOT_CONTENT_NAMES
    return not _named_so(node.names, listed)


@lru_cache(1 << 14)
def _named_so(names: str, listed: frozenset[str]) -> bool:
    """Whether one of the names consists of words of menus, notices, comments and the like alone."""
    words = [{w for w in _WORD.split(name) if w} for name in names.split()]
    return any(w & _COMMENTS and w <= _COMMENTS | _AROUND_COMMENTS or w & listed and w <= listed | _PLACES for w in words)


def _is_furniture(node: Node, template: dict[int, bytes], content: int) -> bool:
    """Whether a block has a suspect word among its names and a template text, but not half of the ``content`` (characters that vary)."""
    if not node.names or node.tag in _NEVER_BY_NAME or _NOT_CONTENT_NAMES.isdisjoint(_WORD.split(node.names)):
        return False
    texts = node.texts()
    return any(id(t) in template for t in texts) and 2 * _varying(texts, template) < content and not _landmarks(node, False)


def _varying(texts: list[Node], template: dict[int, bytes]) -> int:
    return sum(len(t.text) for t in texts if t.said and id(t) not in template)


def _landmarks(node: Node, by_name: bool) -> list[Node]:
    if node.tag == "article":
        return [node]
    if node.tag == "main":
        return _with_leads(node, by_name) or [node]
    return [x for c in node.children if _is_content(c, False, by_name) for x in _landmarks(c, by_name)]


def _with_leads(node: Node, by_name: bool) -> list[Node]:
    """The landmarks inside ``<main>``, with the headings and paragraphs that stand beside them; nothing if there are none."""
    out, found = [], False
    for child in node.children:
        inner = [child] if child.tag in _LANDMARKS else _with_leads(child, by_name) if _is_content(child, True, by_name) else []
        found = found or bool(inner)
        out += inner or ([child] if child.tag in _LEADS and _is_content(child, True, by_name) else [])
    return out if found else []


def _replies(article: Node) -> set[int]:
    """Articles within an article: its comments, unless they say more each than the article itself (then it is a list of articles)."""
    nested, todo = [], list(article.children)
    while todo:
        node = todo.pop()
        if node.tag == "article":
            nested.append(node)
        else:
            todo += node.children
    size = lambda texts: sum(len(t.text) for t in texts if t.said)
    within = sum(size(n.texts()) for n in nested)
    return {id(n) for n in nested} if within <= (size(article.texts()) - within) * len(nested) else set()


def extract(html: str | None, template: frozenset[bytes] = frozenset()) -> str:
    """The main text of a page, one block a line."""
    root = parse(html or "", measured=False)
    marked = _landmarks(root, True) or _landmarks(root, False)
    slots = {k: s for k, s in _slots(root).items() if s in template} if template else {}
    replies = set().union(*[_replies(m) for m in marked if m.tag == "article"]) if len(_ARTICLE.findall(html or "")) > 1 else set()

    def blocks(skipped: dict[int, bytes], by_name: bool) -> list[str]:
        out: list[list[str]] = [[]]
        todo: list[Node | None] = list(reversed(marked or root.children))
        content = _varying([t for n in todo for t in n.texts()], skipped) if skipped else 0
        while todo:
            node = todo.pop()
            if node is None:
                out.append([])
            elif id(node) in replies:
                continue
            elif node.tag == "#text":
                if id(node) not in skipped:
                    out[-1].append(entities.unescape(node.text))
            elif node.tag == "br":
                out[-1].append(" ")
            elif _is_content(node, bool(marked), by_name) and not (skipped and _is_furniture(node, skipped, content)):
                edge = [None] if node.tag in _BLOCKS else []
                todo += [*edge, *reversed(node.children), *edge]
        return [t for t in (" ".join("".join(b).split()) for b in out) if t]

    return "\n".join((slots and blocks(slots, True)) or blocks({}, True) or blocks({}, False))


def _sized(df: DataFrame, size) -> DataFrame:
    """``df`` kept in the shared folder, with a broadcast hint if its measured size allows it."""
    kept = durable(df)
    return F.broadcast(kept) if (kept.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_BYTES else kept


def layout(html: str) -> Column:
    """A hash of the containers that follow each other in a page, by tag and names; how often does not count, nor do digits."""
    tags = F.regexp_extract_all(html, F.lit(_CONTAINER), F.lit(1))
    tags = F.transform(tags, lambda t: F.lower(F.regexp_replace(F.concat(F.regexp_extract(t, r"^/?\w+", 0), F.array_join(F.regexp_extract_all(t, F.lit(_NAMES_IN_TAG), F.lit(1)), " ")), r"\d+", "")))
    pairs = F.zip_with(F.concat(F.array(F.lit("")), tags), F.concat(tags, F.array(F.lit(""))), lambda a, b: F.concat_ws(">", a, b))
    return F.xxhash64(F.array_sort(F.array_distinct(pairs)))


def templates(pages: DataFrame) -> DataFrame:
    """``host`` and ``template``, the named texts that its pages share, from ``host``, ``page_id`` and ``html``."""
    full = pages.filter("html <> ''").withColumns({"version": F.xxhash64("html"), "layout": layout("html")})
    orders = [F.length("html").cast("long"), F.xxhash64(F.lit(1), "html"), F.xxhash64(F.lit(2), "html")]
    firsts = [F.min(F.struct(o.alias("o"), "version")).alias(f"r{i}") for i, o in enumerate(orders)]
    of_layout = durable(full.groupBy("host", "layout").agg(*firsts))
    of_host = of_layout.groupBy("host").agg(*[F.min(f"r{i}").alias(f"h{i}") for i in range(len(orders))])
    versions = F.array_distinct(F.array(*[F.col(f"{x}{i}.version") for x in "rh" for i in range(len(orders))]))
    wanted = durable(of_layout.join(of_host, "host").select("host", "layout", F.explode(versions).alias("version")))
    chosen = _sized(wanted.select("host", "version").distinct(), F.length("host") + 8)
    same = full.join(chosen, ["host", "version"]).select("host", "version", "html").distinct()
    gathered = wanted.join(same, ["host", "version"]).groupBy("host", "layout").agg(F.array_sort(F.collect_set("html")).alias("references"))
    refs = _sized(gathered, F.length(F.concat_ws("", "references")) + F.length("host"))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees: dict[str, tuple[Texts, list[bytes | None]]] = {}
        alignments = Alignments()
        for batch in batches:
            aligned, equal = Counter(), Counter()
            for host, html, references in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "references")), strict=True):
                others = [r for r in references if r != html]
                if not others:
                    continue
                page, met, same_text = Texts(parse(html)), set(), set()
                for reference in others:
                    if reference not in trees:
                        if len(trees) >= MOST_TREES:
                            trees.clear()
                        texts = Texts(parse(reference))
                        slots = _slots(texts.root)
                        trees[reference] = (texts, [slots.get(id(t)) for t in texts.nodes])
                    texts, names = trees[reference]
                    for i, j in alignments.places(texts, page):
                        met.add(names[i])
                        if texts.words[i] == page.words[j]:
                            same_text.add(names[i])
                aligned.update((host, name) for name in met)
                equal.update((host, name) for name in same_text)
            columns = [[k[0] for k in aligned], [k[1] for k in aligned], list(aligned.values()), [equal[k] for k in aligned]]
            kinds = (pa.string(), pa.binary(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["host", "slot", "pages", "n"])

    counted = full.select("host", "layout", "html").join(refs, ["host", "layout"]).select("host", "html", "references")
    sums = counted.mapInArrow(count, "host string, slot binary, pages long, n long").groupBy("host", "slot").agg(F.sum("pages").alias("pages"), F.sum("n").alias("n"))
    constant = sums.filter((F.col("pages") >= LEAST_PAGES) & (F.col("n") >= SAME * F.col("pages")))
    # A host's template has at most as many texts as its references.
    return constant.groupBy("host").agg(F.collect_set("slot").alias("template"))


def main_texts(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Per page: id, url, ``text`` and ``n_chars``."""
    host, _ = host_and_path(F.col(url))
    read = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), host.alias("host"))
    known = read.join(_sized(templates(read), F.size("template") * 16 + F.length("host")), "host", "left")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(h, frozenset(t or ())) for h, t in zip(batch.column("html").to_pylist(), batch.column("template").to_pylist(), strict=True)]
            sizes = pa.array([len(t) for t in texts], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    page_type = dict(read.dtypes)["page_id"]
    return known.select("page_id", "url", "html", "template").mapInArrow(run, f"page_id {page_type}, url string, text string, n_chars long")
