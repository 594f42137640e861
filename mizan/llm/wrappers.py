"""Main text of web pages by inferred wrappers.

The pages of a host follow a few templates, told apart by their outer structure. A page's token stream becomes a tree of
elements (tag and classes) whose leaves are its texts. The trees of a template are aligned one after another into a
union-free regular expression, the wrapper. Where they agree, it says so; where they don't, the mismatch is resolved:

* texts that differ become a slot, texts that are the same on all pages stay constant;
* runs of like elements that differ in number become one repeated group;
* elements that only some pages have become optional.

The wrapper then decides what is main text: constants, groups of links and repeated groups of replies are out, and of what
is left the element that holds most of it is the region. Each page is matched against its template's wrapper and read
there. Tags that mean an aside are out by what HTML says of them. Classes that name an aside only count
where the element does not hold most of the text.

Alignment is a tree of partial aggregates: each task folds its pages into a tree for each template, and these are folded in
rounds of bounded groups, so a host of any size, or one with most of the pages, is spread over tasks.
"""

from __future__ import annotations

import html
import json
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from hashlib import blake2b
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_limits, saved, scratch

_TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)""", re.S)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_SPACE = re.compile(r"\s+")
#: Fixed names of HTML.
RAW = frozenset("script style noscript template textarea title iframe svg math object select button".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that hold running text; a region is never inside one.
TEXT_BLOCKS = HEADINGS | frozenset("p li dt dd td th tr blockquote pre caption figcaption summary address".split())
#: An element that ends when one of these begins inside it.
ENDS = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "head": {"body"}}
#: Elements that HTML itself sets aside.
ASIDE = frozenset("nav header footer aside form head menu dialog fieldset".split())
#: Last words of class names that tell of an aside, and words that may follow them.
ASIDE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments complementary contentinfo cookie cookies consent disqus footer header menu modal nav navbar navigation newsletter notice notices popup promo promoted recommended related replies reply respond search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
_FOLLOWING = frozenset("area bar block body box buttons col column container content inner items left links list main outer panel posts right section top bottom wrap wrapper".split())
#: Elements whose nesting tells templates apart.
CONTAINERS = frozenset("article center div main section table".split())
#: Elements nested deeper than this count as of this depth, as in browsers; no text is lost.
DEPTH = 200
#: A text is constant if so many pages, and this share of those that could, have it and it is the same on all.
CONSTANT_PAGES, CONSTANT_SHARE = 3, 0.2
#: Share of a template's text that an element must hold for the region to lie inside it.
REGION_SHARE = 0.7
#: Letters up to which the first text of a repeated group is a name or a date.
BYLINE = 40
#: Trees that are folded in one group of a round, and templates that a task folds at once.
FAN, OPEN_TEMPLATES = 64, 2000
#: Cells up to which an alignment is read from a whole table, as that takes less time for short lists; else from rows of bits.
EXACT_CELLS = 1 << 8
#: Bits of rows that an alignment keeps at least, and the power of two of the names, the most frequent ones, whose places it keeps as bits.
ROW_BITS, FREQUENT = 8 << 20, 10


@lru_cache(1 << 16)
def _name(tag: str, attributes: str) -> str:
    """Tag and classes; numbers in these don't count."""
    if not attributes or tag in ("html", "body"):
        return tag
    found = {re.sub(r"[0-9]+", "0", w.lower()) for m in _NAMES.finditer(attributes) for w in (m[1] or m[2] or m[3] or "").replace("/", " ").split()}
    return ".".join([tag, *sorted(x.replace(".", "") for x in found)])


@lru_cache(1 << 16)
def _named_aside(name: str) -> bool:
    for token in name.split(".")[1:]:
        own = [w for w in re.split(r"[^a-z]+", token) if w]
        while len(own) > 1 and own[-1] in _FOLLOWING:
            own.pop()
        if own and own[-1] in ASIDE_WORDS and own[0] not in ("no", "without", "has", "with") or own[:1] in (["ad"], ["ads"]):
            return True
    return False


Path = tuple[tuple[str, int], ...]


def walk(page: str) -> Iterator[tuple[Path, int, str, bool]]:
    """(path of block elements: name and number of each, number of the block, text, whether in a link) of each text.

    Inline elements leave no trace. The number grows where a block begins or ends.
    """
    path: list[tuple[str, int]] = []
    tags: list[str] = []
    block, at, over, link = 0, 0, 0, False
    for m in _TOKEN.finditer(page):
        if m.start() < at:
            continue
        if m.start() > at:
            yield tuple(path), block, page[at : m.start()], link
        end, tag, attributes = (m[1], m[2], m[3]) if m[2] else (m[4], m[5], m[6])
        at = m.end()
        if not tag:
            continue
        tag = tag.lower()
        if tag in RAW and not end:
            if not (attributes or "").endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}(?=[\s>/])", re.I).search(page, at)
                at = close.start() if close else len(page)
            block += tag not in ("svg", "math", "object", "button")
        elif tag == "a":
            link = not end
        elif tag in BLOCK and tag != "hr":
            block += 1
            if end:
                if over:
                    over -= 1
                elif tag in tags:
                    cut = len(tags) - 1 - tags[::-1].index(tag)
                    del path[cut:], tags[cut:]
            else:
                while tags and tag in ENDS.get(tags[-1], ()):
                    path.pop()
                    tags.pop()
                if len(path) < DEPTH:
                    path.append((_name(tag, attributes or ""), block))
                    tags.append(tag)
                else:
                    over += 1
        elif tag == "br":
            yield tuple(path), block, " ", link
        elif tag == "hr":
            block += 1
    if at < len(page):
        yield tuple(path), block, page[at:], link


def blocks(page: str) -> list[tuple[Path, str, int]]:
    """(path, text, letters in links) of each block with text; references decoded, white space made one space."""
    out, path, last, parts, linked = [], (), -1, [], []

    def close() -> None:
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            links = len(_SPACE.sub(" ", html.unescape("".join(linked))).strip()) if linked else 0
            out.append((path, text, min(links, len(text))))

    for where, number, text, link in walk(page):
        if number != last or where != path:
            close()
            path, last, parts, linked = where, number, [], []
        parts.append(text)
        if link:
            linked.append(text)
    close()
    return out


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode(errors="surrogatepass"), digest_size=8).digest(), "big", signed=True)


class Node:
    """An element of a wrapper; a text slot has no kids.

    parents: instances of the element around it that have it; instances: how often it stands there in all; hash: of the text
    if it is the same everywhere."""

    __slots__ = ("chars", "hash", "instances", "keep", "kids", "links", "mass", "name", "parents", "repeated")

    def __init__(self, name: str, kids: list[Node] | None = None, repeated: bool = False, parents: int = 1, instances: int = 1, hash: int | None = None, chars: int = 0, links: int = 0):
        self.name, self.kids, self.repeated, self.parents, self.instances = name, kids, repeated, parents, instances
        self.hash, self.chars, self.links, self.mass, self.keep = hash, chars, links, 0, False

    @property
    def tag(self) -> str:
        return self.name.partition(".")[0]


def dump(n: Node) -> list:
    head = [n.name, n.repeated, n.parents, n.instances]
    return [*head, n.hash, n.chars, n.links, n.keep] if n.kids is None else [*head, [dump(k) for k in n.kids]]


def load(x: list) -> Node:
    if len(x) == 5:
        return Node(x[0], [load(k) for k in x[4]], *x[1:4])
    n = Node(x[0], None, *x[1:7])
    n.keep = x[7]
    return n


def tree(found: list[tuple[Path, str, int]]) -> Node:
    """A page's tree, from its blocks; its leaves are in the order of these."""
    root = Node("", [])
    open_, before = [root], ()
    for path, text, links in found:
        same = 0
        while same < min(len(path), len(before)) and path[same] == before[same]:
            same += 1
        del open_[same + 1 :]
        for name, _ in path[same:]:
            node = Node(name, [])
            open_[-1].kids.append(node)
            open_.append(node)
        open_[-1].kids.append(Node("#", None, hash=_hash(text), chars=len(text), links=links))
        before = path
    return root


def _by_table(a: list[str], b: list[str]) -> Iterator[tuple[int, int]]:
    """The pairs of a longest common subsequence of two lists: from the first places on, a place of ``a`` is left alone if
    nothing is lost by that, else it is paired with the next one of its name."""
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        row, below = best[i], best[i + 1]
        for j in range(len(b) - 1, -1, -1):
            row[j] = below[j + 1] + 1 if a[i] == b[j] else max(below[j], row[j + 1])
    i = j = 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            yield i, j
            i, j = i + 1, j + 1
        elif best[i + 1][j] >= best[i][j + 1]:
            i += 1
        else:
            j += 1


def _by_rows(a: list[str], b: list[str]) -> Iterator[tuple[int, int]]:
    """The pairs that _by_table gives, for lists of any length.

    A row of the table is one number, of a bit for each place of b, from its end, that is clear where the length grows. Rows
    are made from the last one; if they are many, some are kept and those between are made again."""
    n, m = len(a), len(b)
    places: dict[str, list[int]] = {}
    for j, x in enumerate(b):
        places.setdefault(x, []).append(j)
    whole, masks, rare = (1 << m) - 1, {}, m >> FREQUENT

    def mask(x: str) -> int:
        if x in masks or x not in places:
            return masks.get(x, 0)
        bits = bytearray(m // 8 + 1)
        for j in places[x]:
            bits[m - 1 - j >> 3] |= 1 << (m - 1 - j & 7)
        made = int.from_bytes(bits, "little")
        if len(places[x]) > rare:
            masks[x] = made
        return made

    def above(row: int, i: int) -> int:
        both = row & mask(a[i])
        return (row + both | row ^ both) & whole

    step = max(math.isqrt(n) + 1, ROW_BITS // (m + 1))
    kept, row = {n: whole}, whole
    for i in range(n - 1, -1, -1):
        row = above(row, i)
        if i % step == 0:
            kept[i] = row
    j, left = 0, m - row.bit_count()
    for start in range(0, n, step):
        end = min(start + step, n)
        rows = [kept[end]]
        for i in range(end - 1, start, -1):
            rows.append(above(rows[-1], i))
        for i in range(start, end):
            below, own = rows.pop(), places.get(a[i], ())
            at = bisect_left(own, j)
            if at == len(own):
                continue
            if own[at] == j or left > m - j - (below & (1 << m - j) - 1).bit_count():
                yield i, own[at]
                j, left = own[at] + 1, left - 1


def pairs(a: list[str], b: list[str]) -> list[tuple[int | None, int | None]]:
    """An alignment of two lists of names that keeps their order: pairs of places of one name, as many as there can be, or of
    one place and none."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    out, i, j = [], 0, 0
    for x, y in [*(_by_table if len(a) * len(b) <= EXACT_CELLS else _by_rows)(a, b), (len(a), len(b))]:
        out += [(k, None) for k in range(i, x)] + [(None, k) for k in range(j, y)]
        if x < len(a):
            out.append((x, y))
        i, j = x + 1, y + 1
    return out


def _runs(kids: list[Node]) -> tuple[list[str], list[list[Node]]]:
    own = [list(g) for _, g in groupby(kids, lambda k: k.name)]
    return [g[0].name for g in own], own


def align(a: Node, b: Node, parents: int | None = None) -> Node:
    """The wrapper of what two elements of one name hold."""
    out = Node(a.name, None, a.repeated or b.repeated, a.parents + b.parents if parents is None else parents, a.instances + b.instances)
    if a.kids is None:
        out.hash, out.chars, out.links = a.hash if a.hash == b.hash else None, a.chars + b.chars, a.links + b.links
        return out
    out.kids = []
    (left_names, left), (right_names, right) = _runs(a.kids), _runs(b.kids)
    for i, j in pairs(left_names, right_names):
        if i is None or j is None:
            out.kids += left[i] if j is None else right[j]
            continue
        x, y = left[i], right[j]
        if len(x) == len(y) and not (x[0].repeated or y[0].repeated):
            out.kids += [align(p, q) for p, q in zip(x, y, strict=True)]
        else:
            having = max(k.parents for k in x) + max(k.parents for k in y)
            one = (x + y)[0]
            for k in (x + y)[1:]:
                one = align(one, k, having)
            one.repeated, one.parents = True, having
            out.kids.append(one)
    return out


def weigh(n: Node, around: int, total: int, names: bool, constants: bool, replies: bool) -> tuple[int, bool, list[Node]]:
    """Sets the mass of what is below: letters that may be main text. Gives (letters in links, whether a heading or paragraph is
    there, its slots)."""
    if n.kids is None:
        constant = constants and n.hash is not None and n.parents >= max(CONSTANT_PAGES, CONSTANT_SHARE * around)
        n.mass = 0 if constant or 2 * n.links > n.chars else n.chars - n.links
        return n.links, False, [n]
    inside = replies and (n.tag != "article" or n.repeated)  # an article's own groups are no replies to it
    found = [weigh(k, n.instances, total, names, constants, inside) for k in n.kids]
    links, slots = sum(f[0] for f in found), [s for f in found for s in f[2]]
    running = n.tag in TEXT_BLOCKS or any(f[1] for f in found)
    n.mass = sum(k.mass for k in n.kids)
    chars = sum(s.chars for s in slots)
    heading = any(k.tag in HEADINGS for k in _elements(n))
    # who and when, then what: a group of replies; plain list items are the text's own
    reply = replies and n.repeated and (n.tag in ("div", "section", "article") or n.tag == "li" != n.name) and len(slots) > 1 and not heading and slots[0].chars <= BYLINE * slots[0].instances
    if n.tag in ASIDE or 2 * links > chars or reply or names and _named_aside(n.name) and not (running and 2 * n.mass > total):
        n.mass = 0
    return links, running, slots


def _has(n: Node, test: Callable[[Node], bool]) -> bool:
    return any(map(test, _leaves(n)))


def restore(n: Node) -> None:
    """Marks the text blocks that stand among marked ones in one element: a sentence that all pages share or that is mostly a
    link belongs to the text around it. A heading must have text before and after it; a link beside links is a menu's."""
    kept = lambda k: _has(k, lambda x: x.keep)
    linked = lambda k: 2 * sum(x.links for x in _leaves(k)) > sum(x.chars for x in _leaves(k))
    own = [k for k in n.kids if k.kids is not None]
    text = [i for i, k in enumerate(own) if k.tag in TEXT_BLOCKS and k.tag not in HEADINGS and kept(k)]
    for i, k in enumerate(own):
        if kept(k):
            restore(k)
        elif text and k.tag in TEXT_BLOCKS and k.tag != "h1" and not _named_aside(k.name):
            beside = any(linked(x) and not kept(x) for x in own[max(0, i - 1) : i] + own[i + 1 : i + 2])
            if (k.tag in HEADINGS and not text[0] < i < text[-1]) or linked(k) and (beside or not text[0] < i < text[-1]):
                continue
            for x in _leaves(k):
                x.keep = True


def _elements(n: Node) -> Iterator[Node]:
    todo = [n]
    while todo:
        k = todo.pop()
        if k.kids is not None:
            yield k
            todo += k.kids


def decide(root: Node) -> Node:
    """Marks the slots of the main text. root: the wrapper of a template."""
    for constants, replies in ((True, True), (False, True), (False, False)):
        weigh(root, root.instances, 0, False, constants, replies)
        total = root.mass
        weigh(root, root.instances, total, True, constants, replies)
        if root.mass:
            break
    at, before, total = root, [], root.mass
    while total:
        heavy = max((k for k in at.kids if k.kids is not None), key=lambda k: k.mass, default=None)
        # running text beside an element belongs to it, so that the region is around both
        beside = any(k.mass and k is not heavy and (k.tag == "#" or k.tag in TEXT_BLOCKS and k.tag != "h1") for k in at.kids)
        if heavy is None or heavy.repeated or heavy.tag in TEXT_BLOCKS or heavy.mass < REGION_SHARE * total or beside:
            break
        before += at.kids[: next(i for i, k in enumerate(at.kids) if k is heavy)]
        at = heavy

    def mark(n: Node) -> bool:
        if n.mass and n.kids is None:
            n.keep = True
            return False
        return n.mass > 0 and any([mark(k) for k in n.kids or ()]) or n.mass > 0 and n.tag == "h1"

    title = mark(at)
    restore(at)
    if not title:  # the title may stand before the region
        for n in before:
            for k in _elements(n) if n.mass else ():
                if k.tag == "h1" and k.mass:
                    mark(k)
    return root


def matched(wrapper: Node, page: Node) -> Iterator[bool]:
    """For each text of the page, in order, whether the wrapper has it in the main text. What the wrapper lacks is not."""
    if page.kids is None:
        yield wrapper.keep
        return
    (names, own), (page_names, there) = _runs(wrapper.kids), _runs(page.kids)
    for i, j in pairs(names, page_names):
        if j is None:
            continue
        for at, k in enumerate(there[j]):
            if i is None:
                yield from [False] * sum(1 for _ in _leaves(k))
            else:
                yield from matched(own[i][min(at, len(own[i]) - 1)], k)


def _leaves(n: Node) -> Iterator[Node]:
    if n.kids is None:
        yield n
    else:
        for k in n.kids:
            yield from _leaves(k)


def _host(url: str | None) -> str:
    m = re.match(r"[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


def template(found: Iterable[Path]) -> str:
    """The outer structure of a page by the paths of its blocks: the first two containers of what HTML does not set aside."""
    outer = set()
    for path in found:
        names = [x for x, _ in path]
        tags = [x.partition(".")[0] for x in names]
        if ASIDE.isdisjoint(tags) and not any(map(_named_aside, names)):
            outer.add("/".join([x for x, t in zip(names, tags, strict=True) if t in CONTAINERS][:2]))
    return "%016x" % (_hash("\n".join(sorted(outer))) % (1 << 64))


def _packed(n: Node) -> str:
    return json.dumps(dump(n), separators=(",", ":"))


def parsed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, host, template, tree, text) of each page: its tree and its blocks. Pages without a host share ''."""
    arrow_limits(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), F.col(url_col).cast("string").alias("address"), F.col(html_col).cast("string").alias("html"))
    names = ["page_id", "url", "host", "template", "tree", "text"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            hosts, templates, trees, texts = [], [], [], []
            for url, page in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
                found = blocks(page or "")
                hosts.append(_host(url))
                templates.append(template([x[0] for x in found]))
                trees.append(_packed(tree(found)))
                texts.append([x[1] for x in found])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(c, pa.string()) for c in (hosts, templates, trees)), pa.array(texts, pa.list_(pa.string()))], names)

    kinds = dict(src.dtypes)
    return src.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, host string, template string, tree string, text array<string>")


_TREES = "host string, template string, part long, tree string"


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, template, tree) -> one tree for each template that the task meets; all are given out when too many are open."""
    part, done, own = TaskContext.get().partitionId(), 0, {}

    def out() -> pa.RecordBatch:
        rows = [(h, t, done << 32 | part, _packed(n)) for (h, t), n in own.items()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.string(), pa.string(), pa.int64(), pa.string()), strict=True)], ["host", "template", "part", "tree"])

    for b in batches:
        for host, name, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
            page, key = load(json.loads(t)), (host, name)
            own[key] = align(own[key], page) if key in own else page
            if len(own) >= OPEN_TEMPLATES:
                yield out()
                own, done = {}, done + 1
    if own:
        yield out()


def _merged(pdf: pd.DataFrame) -> pd.DataFrame:
    first, *rest = [load(json.loads(t)) for t in pdf.sort_values(["part", "tree"])["tree"]]
    for t in rest:
        first = align(first, t)
    return pd.DataFrame({"host": pdf["host"].iloc[:1].tolist(), "template": pdf["template"].iloc[:1].tolist(), "part": [int(pdf["part"].min())], "tree": [_packed(first)]})


def infer(seen: DataFrame, fan: int = FAN) -> DataFrame:
    """(host, template, wrapper) of parsed pages; in the wrapper the slots of the main text are marked."""
    group = ["host", "template"]
    with scratch() as keep:
        trees = saved(seen.select(*group, "tree").mapInArrow(_folded, _TREES), "page-trees")
        while True:
            counts = trees.groupBy(*group).count().where("count > 1")
            largest = counts.agg(F.max("count")).first()[0] or 1
            if largest == 1:
                break
            dealt = trees.join(saved(counts, "tree-counts"), group, "left")
            share = F.pmod(F.xxhash64("part"), F.greatest(F.lit(1), F.ceil(F.col("count") / fan)))
            trees = saved(dealt.withColumn("share", F.coalesce(share, F.lit(0))).groupBy(*group, "share").applyInPandas(_merged, _TREES), "page-trees")

        def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                done = [_packed(decide(load(json.loads(t)))) for t in b.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(done, pa.string())], ["host", "template", "wrapper"])

        return keep(trees.select(*group, "tree").mapInArrow(choose, "host string, template string, wrapper string"), "wrappers")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) of each page: its blocks in the slots of its template's main text, joined by newlines.

    Null html or no main text: the empty text. Null urls and ids and repeated rows stay.
    """
    seen = saved(parsed(pages, id_col, url_col, html_col), "parsed-pages")
    placed = seen.join(infer(seen), ["host", "template"], "left").select("page_id", "url", "wrapper", "tree", "text")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        for b in batches:
            texts = []
            for wrapper, t, own in zip(*(b.column(i).to_pylist() for i in (2, 3, 4)), strict=True):
                if wrapper not in known:
                    known = {wrapper: load(json.loads(wrapper))} if len(known) > 99 else known | {wrapper: load(json.loads(wrapper))}
                texts.append("\n".join(x for x, kept in zip(own, matched(known[wrapper], load(json.loads(t))), strict=True) if kept))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kinds = dict(seen.dtypes)
    return placed.mapInArrow(read, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long")


def op7(pages: DataFrame) -> DataFrame:
    return extract(pages)
