"""HTML extraction by wrapper induction.

Pages become element trees. The trees of a host are aligned by simple tree matching (the largest order-preserving match of equal
elements, level by level) and merged into one wrapper tree: up to GROUP_PAGES trees in a task, then those results again, until
the host has one. Each node of a wrapper counts the different pages that have it and whether its text is one and the same: such
nodes are template, nodes whose texts vary are slots. Equal trees of a host enter once, with their number.

A host's content container is the element, outside menus, headers, footers, sidebars, notices, adverts, forms and comments, around
four fifths of the slot text; of several an article or main element, else the innermost. Every page is aligned with its host's
wrapper: its text is what lies in the element aligned with the container, less blocks that are template there (a node of LEAST_SAME
pages or more whose one text it is, while the container's slots hold more text than its constant nodes; else the host's pages are
copies of each other and none is). Pages without such a wrapper (fewer than LEAST_SAME different trees, no slots, or the
container is not in the page) take the blocks of their own article or main elements, else all blocks outside boilerplate.

Rows in: `url`, `html`. Null and empty html has an empty text; unclosed, cut-off, deeply nested and very long markup is read as far
as it goes, without recursion. A null url is a host of its own. Repeated rows come out as often; other columns, whatever their
names, stay inside `row`. An empty table gives an empty result.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed_schema, steps, stored
from .urls import host_and_path

#: Trees of one host that are merged in one task.
GROUP_PAGES = 64
#: Parts that the trees of a host with several groups are dealt to on their way into groups.
SALTS = 32
#: Different pages with one same text that make a node template, and different trees that make a wrapper.
LEAST_SAME = 3
#: A merged wrapper keeps the nodes that one of so many of its pages has.
RARE = 50
_UNREAD = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style|textarea|title|noscript|iframe|template)\b[^>]*>.*?(?:</\1\s*>|\Z)", re.S | re.I)
_TOKEN = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
#: Elements of HTML by their part in a page.
_VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
_RAW = frozenset("svg math iframe object select option button canvas".split())
_BLOCK = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
_BOILERPLATE = frozenset("nav header footer aside form dialog menu head".split())
_PART = r"(?:ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|disqus|footer|header|masthead|menu|nav|navbar|navigation|newsletter|notice|popup|promo\w*|related|share|sharing|sidebar|social|sponsor\w*|subscribe|widget|contentinfo|complementary|search)"
#: Whole names made of such words; other names that hold one say nothing sure.
_WORDS = re.compile(rf"(?:^|\s){_PART}(?:[_-]{_PART})*(?=$|\s)", re.I)
#: How an element is marked as boilerplate.
BY_TAG, BY_NAME = 1, 2
#: Elements that an article or main element cannot be meant to lie in.
_NEVER_AROUND = frozenset("nav header menu head".split())
#: A new block closes an open paragraph up to these.
_SCOPE = frozenset("p li article main section div td body".split())
_MARKUP = frozenset("abcdefghijklmnopqrstuvwxyz/!?")


class Node:
    """An element: its tag, how it names itself, its children and the numbers of the blocks of text whose element it is."""

    __slots__ = ("children", "label", "marked", "parent", "skipped", "tag", "texts")

    def __init__(self, tag: str, label: str, parent: Node | None, skipped: bool, marked: int = 0):
        self.tag, self.label, self.parent, self.skipped, self.marked = tag, label, parent, skipped, marked
        self.children: list[Node] = []
        self.texts: list[int] = []


def parse(source: str) -> tuple[Node, list[tuple[Node, str]]]:
    """The element tree and the blocks (their element and their text, white space made single) in page order. Boilerplate has no blocks.

    The start of an article or main element ends an open nav, header, menu or head, which no page means to hold it.
    """
    source = _UNREAD.sub("", source)
    root = node = Node("", "", None, False)
    nodes: list[Node] = []
    found_: list[tuple[Node, list[tuple[Node, str]]]] = []
    open_: list[tuple[Node, str]] = []

    def flush() -> None:
        if not open_:
            return
        owner = node
        while owner.tag and owner.tag not in _BLOCK:
            owner = owner.parent
        found_.append((owner, open_.copy()))
        open_.clear()

    def up_to(tags: frozenset | set) -> Node | None:
        at = node
        while at is not root and at.tag not in tags:
            at = at.parent
        return None if at is root else at

    for found in _TOKEN.finditer(source):
        tag = found[2]
        if tag is None:
            piece = found[0]
            if piece == "<" and (source[found.end() : found.end() + 1] or "!").lower() in _MARKUP:
                break  # cut off inside a tag
            if (piece == "<" or piece[0] != "<") and not node.skipped:
                open_.append((node, piece))
            continue
        tag = tag.lower()
        if tag == "br":
            open_.append((node, " "))
            continue
        if tag in _BLOCK:
            flush()
        if found[1]:
            if closed := up_to({tag}):
                node = closed.parent
            continue
        if tag in _BLOCK and (before := up_to(_SCOPE)) and (before.tag == "p" or before.tag == tag == "li"):
            node = before.parent
        while tag in ("article", "main") and (before := up_to(_NEVER_AROUND)) and before is up_to(_NEVER_AROUND | {"article", "main"}):
            node = before.parent
        if tag in _VOID:
            continue
        marks = " ".join(a or b or c for _, a, b, c in _ATTRIBUTE.findall(found[3])) if found[3] else ""
        named = marks and tag not in ("html", "body") and _WORDS.search(marks)
        inner = Node(tag, f"{tag}.{marks}" if marks else tag, node, node.skipped or tag in _RAW, BY_NAME if named else BY_TAG if tag in _BOILERPLATE else 0)
        nodes.append(inner)
        node.children.append(inner)
        node = inner
    flush()
    _settle(nodes, found_)
    blocks: list[tuple[Node, str]] = []
    for owner, pieces in found_:
        text = "".join(piece for at, piece in pieces if not at.skipped)
        text = " ".join((entities.unescape(text) if "&" in text else text).split())
        if text:
            owner.texts.append(len(blocks))
            blocks.append((owner, text))
    return root, blocks


def _settle(nodes: list[Node], found: list[tuple[Node, list[tuple[Node, str]]]]) -> None:
    """Skip elements that their tag or name marks, with all inside them, but none that a page's content lies in.

    The page's keys are its article and main elements, or without any its only h1. A header inside an article, or inside main where
    it has the h1 or the page has no article, is no page header, and a form with a key in it is just around the page. If all keys lie in
    marked elements, those are kept; so is, on a page without article and main, an element with four fifths of the text.
    """
    if not any(n.marked and not n.skipped for n in nodes):
        return
    articles = [n for n in nodes if n.tag in ("article", "main") and not n.skipped]
    heads = [n for n in nodes if n.tag == "h1" and not n.skipped]
    keys = articles or (heads if len(heads) == 1 else [])
    holds_key, holds_head = _around(keys), _around(heads)
    is_single = not any(n.tag == "article" for n in articles)
    inside: dict[int, str] = {}
    for n in nodes:
        outer = inside.get(id(n.parent), "")
        inside[id(n)] = "article" if n.tag == "article" else outer or (n.tag if n.tag == "main" else "")
        if n.marked == BY_TAG and (n.tag == "header" and (outer == "article" or outer == "main" and (is_single or id(n) in holds_head)) or n.tag == "form" and id(n) in holds_key):
            n.marked = 0
    under: dict[int, int] = {}
    for n in nodes:
        under[id(n)] = n.marked | under.get(id(n.parent), 0)
    holds = holds_key if all(under[id(n)] for n in keys) else set()
    # characters in all, and those outside elements that their tag marks
    chars: dict[int, int] = defaultdict(int)
    plain: dict[int, int] = defaultdict(int)
    for _, pieces in found:
        for at, piece in pieces:
            chars[id(at)] += len(piece.strip())
            if not under.get(id(at), 0) & BY_TAG:
                plain[id(at)] += len(piece.strip())
    total, total_plain = sum(chars.values()), sum(plain.values())
    for n in reversed(nodes):
        chars[id(n.parent)] += chars[id(n)]
        plain[id(n.parent)] += plain[id(n)]
    for n in nodes:
        most = 5 * chars[id(n)] >= 4 * total if n.marked == BY_TAG else plain[id(n)] and 5 * plain[id(n)] >= 4 * total_plain
        content = id(n) in holds or (not articles and most)
        n.skipped = n.skipped or n.parent.skipped or bool(n.marked and not content)


def _around(nodes: list[Node]) -> set[int]:
    """The nodes and all elements around them."""
    out: set[int] = set()
    for at in nodes:
        while at is not None and id(at) not in out:
            out.add(id(at))
            at = at.parent
    return out


class Tree:
    """An element tree as lists: labels, parents and children by node, nodes in page order at first. texts: node -> [pages, least hash, largest hash, characters]; seen: pages that have the node."""

    __slots__ = ("kids", "labels", "pages", "parents", "seen", "texts")

    def __init__(self) -> None:
        self.labels: list[str] = []
        self.parents: list[int] = []
        self.kids: list[list[int]] = []
        self.seen: list[int] = []
        self.texts: dict[int, list[int]] = {}
        self.pages = 1

    def add(self, label: str, parent: int, seen: int, after: int | None = None) -> int:
        """A new node, the last child of its parent or the one after a given child (-1: the first)."""
        at = len(self.labels)
        self.labels.append(label)
        self.parents.append(parent)
        self.kids.append([])
        self.seen.append(seen)
        if parent >= 0:
            kids = self.kids[parent]
            kids.insert(len(kids) if after is None else kids.index(after) + 1 if after >= 0 else 0, at)
        return at

    def dumped(self) -> bytes:
        return pickle.dumps((self.labels, self.parents, self.kids, self.seen, self.texts, self.pages))

    @classmethod
    def loaded(cls, data: bytes) -> Tree:
        tree = cls()
        tree.labels, tree.parents, tree.kids, tree.seen, tree.texts, tree.pages = pickle.loads(data)
        return tree

    def down(self, start: int = 0) -> Iterator[int]:
        """Nodes from the given one down, parents first, in page order."""
        open_ = [start]
        while open_:
            at = open_.pop()
            yield at
            open_.extend(reversed(self.kids[at]))


def skeleton(root: Node, blocks: list[tuple[Node, str]]) -> tuple[Tree, dict[int, int]]:
    """The tree of a page without boilerplate, and the tree's node of every element (by id) that it has."""
    tree, place = Tree(), {}
    open_ = [(root, -1)]
    while open_:
        node, parent = open_.pop()
        at = place[id(node)] = tree.add(node.label, parent, 1)
        if node.texts:
            texts = [blocks[i][1] for i in node.texts]
            mine = crc32("\n".join(texts).encode())
            tree.texts[at] = [1, mine, mine, sum(map(len, texts))]
        open_.extend((c, at) for c in reversed(node.children) if not c.skipped)
    return tree, place


class Shapes:
    """Interned shapes of subtrees (label and the children's shapes) and how well two of them match."""

    MOST = 1_000_000

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.ids: dict[tuple, int] = {}
        self.labels: list[str] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.known: dict[tuple[int, int], int] = {}

    def of(self, tree: Tree) -> list[int]:
        """Shape of each node."""
        out = [0] * len(tree.labels)
        for at in reversed(list(tree.down())):
            key = (tree.labels[at], tuple(out[c] for c in tree.kids[at]))
            if (known := self.ids.get(key)) is None:
                known = self.ids[key] = len(self.labels)
                self.labels.append(key[0])
                self.kids.append(key[1])
                self.sizes.append(1 + sum(self.sizes[c] for c in key[1]))
            out[at] = known
        return out

    def match(self, a: int, b: int) -> int:
        """Size of the largest match of two shapes: 0 if their labels differ."""
        if self.labels[a] != self.labels[b]:
            return 0
        if a == b:
            return self.sizes[a]
        open_ = [(a, b)]
        while open_:
            pair = open_[-1]
            if pair in self.known:
                open_.pop()
                continue
            rows, columns, same = trimmed(*(self.kids[x] for x in pair))
            wanted = {(x, y) for x in set(rows) for y in set(columns) if x != y and self.labels[x] == self.labels[y] and (x, y) not in self.known}
            if wanted:
                open_.extend(wanted)
                continue
            self.known[pair] = 1 + sum(self.sizes[x] for x in same) + int(self._best(rows, columns, len(rows), False)[-1])
            open_.pop()
        return self.known[a, b]

    def _known(self, a: int, b: int) -> int:
        return 0 if self.labels[a] != self.labels[b] else self.sizes[a] if a == b else self.known[a, b]

    def _best(self, rows: tuple[int, ...], columns: tuple[int, ...], upto: int, backward: bool) -> np.ndarray:
        """Best order-preserving match of the first (backward: last) `upto` rows with each prefix (suffix) of the columns. One line of the table at a time."""
        if backward:
            rows, columns = rows[::-1], columns[::-1]
        kinds, column = np.unique(np.array(columns, np.int64), return_inverse=True)
        weights: dict[int, np.ndarray] = {}
        line = np.zeros(len(columns) + 1, np.int64)
        for x in rows[:upto]:
            if x not in weights:
                weights[x] = np.array([self._known(x, int(y)) for y in kinds], np.int64)[column] if len(columns) else np.zeros(0, np.int64)
            line[1:] = np.maximum(line[1:], line[:-1] + weights[x])
            np.maximum.accumulate(line, out=line)
        return line

    def pairs(self, rows: tuple[int, ...], columns: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of the rows and columns that a best order-preserving match pairs, by halving the rows: memory in proportion to the columns."""
        out, open_ = [], [(0, len(rows), 0, len(columns))]
        while open_:
            a, b, c, d = open_.pop()
            if a == b or c == d:
                continue
            if b - a == 1:
                scores = [self._known(rows[a], columns[j]) for j in range(c, d)]
                best = max(range(d - c), key=lambda j: scores[j])
                if scores[best]:
                    out.append((a, c + best))
                continue
            middle = (a + b) // 2
            ahead, back = self._best(rows[a:middle], columns[c:d], middle - a, False), self._best(rows[middle:b], columns[c:d], b - middle, True)
            cut = c + int((ahead + back[::-1]).argmax())
            open_ += [(a, middle, c, cut), (middle, b, cut, d)]
        return out


def trimmed(rows: tuple[int, ...], columns: tuple[int, ...]) -> tuple[tuple[int, ...], tuple[int, ...], tuple[int, ...]]:
    """What is left of two lists of shapes without equal ends, and the equal ones. Equal shapes at an end are in some best match."""
    low, most = 0, min(len(rows), len(columns))
    while low < most and rows[low] == columns[low]:
        low += 1
    high = 0
    while high < most - low and rows[-1 - high] == columns[-1 - high]:
        high += 1
    return rows[low : len(rows) - high], columns[low : len(columns) - high], rows[:low] + rows[len(rows) - high :]


def align(one: Tree, two: Tree, shapes: Shapes) -> dict[int, int]:
    """Simple tree matching: node of `two` -> node of `one`, parents before their children."""
    if len(shapes.labels) > shapes.MOST or len(shapes.known) > shapes.MOST:
        shapes.clear()
    a, b = shapes.of(one), shapes.of(two)
    out, open_ = {}, [(0, 0)]
    while open_:
        x, y = open_.pop()
        out[y] = x
        mine, other = one.kids[x], two.kids[y]
        if a[x] == b[y]:
            open_.extend(zip(mine, other, strict=True))
            continue
        rows, columns = tuple(a[k] for k in mine), tuple(b[k] for k in other)
        shapes.match(a[x], b[y])
        left, right, _ = trimmed(rows, columns)
        low = 0
        while low < min(len(rows), len(columns)) and rows[low] == columns[low]:
            low += 1
        open_.extend(zip(mine[:low], other[:low], strict=True))
        tail = len(rows) - low - len(left)
        open_.extend(zip(mine[len(mine) - tail :], other[len(other) - tail :], strict=True))
        open_.extend((mine[low + i], other[low + j]) for i, j in shapes.pairs(left, right))
    return out


def merge(one: Tree, two: Tree, shapes: Shapes) -> None:
    """Put the pages of `two` into `one`: aligned nodes add up, the others are inserted after their aligned or inserted sibling."""
    place = align(one, two, shapes)
    for at in two.down():
        if at in place:
            one.seen[place[at]] += two.seen[at]
        else:
            siblings = two.kids[two.parents[at]]
            before = siblings.index(at)
            place[at] = one.add(two.labels[at], place[two.parents[at]], two.seen[at], place[siblings[before - 1]] if before else -1)
        if mine := two.texts.get(at):
            if held := one.texts.get(place[at]):
                held[:] = held[0] + mine[0], min(held[1], mine[1]), max(held[2], mine[2]), held[3] + mine[3]
            else:
                one.texts[place[at]] = list(mine)
    one.pages += two.pages


def pruned(tree: Tree) -> Tree:
    """Without nodes that fewer than one of RARE pages has, so that a wrapper's size is bounded by that of its pages. Trees of few pages keep all."""
    least = -(-tree.pages // RARE)
    if all(n >= least for n in tree.seen):
        return tree
    out, place = Tree(), {-1: -1}
    out.pages = tree.pages
    for at in tree.down():
        if tree.seen[at] >= least and tree.parents[at] in place:
            place[at] = out.add(tree.labels[at], place[tree.parents[at]], tree.seen[at])
            if at in tree.texts:
                out.texts[place[at]] = tree.texts[at]
    return out


_shapes = Shapes()


def _merged(key: tuple, rows: pa.Table) -> pa.Table:
    """The trees of one group as one."""
    data = sorted(rows.column("tree").to_pylist(), key=crc32)
    whole = Tree.loaded(data[0])
    for more in data[1:]:
        merge(whole, Tree.loaded(more), _shapes)
    host = pa.array([key[0].as_py()], pa.string())
    return pa.table([host, pa.array([pruned(whole).dumped()], pa.binary())], names=["host", "tree"])


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, "html"):
        trees = [skeleton(*parse(h or ""))[0].dumped() for h in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("host"), pa.array(trees, pa.binary())], ["host", "tree"])


def induce(pages: DataFrame) -> DataFrame:
    """host and wrapper (a pickled tree) of every host; pages: host, html. Each round merges groups of trees, so no group gathers a host."""
    made = pages.select("host", "html").mapInArrow(_trees, "host string, tree binary")
    trees = stored(made.groupBy("host", F.xxhash64("tree").alias("own")).agg(F.first("tree").alias("tree")).select("host", "tree"), "wrapper-trees")
    while True:
        counts = trees.groupBy("host").agg(F.count("*").alias("n"))
        many = stored(counts.where("n > 1").select("host", F.ceil(F.col("n") / GROUP_PAGES).alias("groups")), "wrapper-counts")
        if many.isEmpty():
            return trees.withColumnRenamed("tree", "wrapper")
        # a host's number of groups goes to each of its trees; the first round has most, and hot hosts are dealt by a salt
        dealt = trees.withColumn("own", F.xxhash64("tree"))
        first = dealt.join(many.where("groups = 1"), "host").select("host", "tree", F.lit(0).cast("long").alias("group"))
        hot = dealt.withColumn("salt", F.pmod("own", F.lit(SALTS).cast("long"))).join(_spread(many), ["host", "salt"]).select("host", "tree", F.pmod(F.xxhash64("own"), "groups").alias("group"))
        alone = trees.join(many, "host", "left_anti")
        merged = first.union(hot).groupBy("host", "group").applyInArrow(_merged, "host string, tree binary")
        trees = stored(alone.select("host", "tree").union(merged), "wrapper-trees")


def _spread(many: DataFrame) -> DataFrame:
    """Hosts of several groups, once for each salt."""
    return many.where("groups > 1").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))


def container_of(wrapper: Tree) -> int | None:
    """The node around four fifths of the slot text: an article or main element, else the innermost."""
    slots = {at: t[3] for at, t in wrapper.texts.items() if t[1] != t[2]}
    total = sum(slots.values())
    if wrapper.pages < LEAST_SAME or not total:
        return None
    held, order = [0] * len(wrapper.labels), list(wrapper.down())
    depth = [0] * len(wrapper.labels)
    for at in order:
        depth[at] = depth[wrapper.parents[at]] + 1 if wrapper.parents[at] >= 0 else 0
    for at in reversed(order):
        if wrapper.parents[at] >= 0:
            # elements around a slot, not the slot: one long paragraph is not all of the content
            held[wrapper.parents[at]] += held[at] + slots.get(at, 0)
    enough = [at for at in order if 5 * held[at] >= 4 * total]
    named = [at for at in enough if wrapper.labels[at].partition(".")[0] in ("article", "main")]
    return max(named or enough, key=lambda at: depth[at], default=None)


def template_of(wrapper: Tree, container: int) -> dict[int, int]:
    """Constant nodes in the container and the hash of their text; none if they hold more than the slots there."""
    inside = [(at, wrapper.texts[at]) for at in wrapper.down(container) if at in wrapper.texts]
    same = {at: t for at, t in inside if t[0] >= LEAST_SAME and t[1] == t[2]}
    slots = sum(t[3] for at, t in inside if t[1] != t[2])
    return {at: t[1] for at, t in same.items()} if sum(t[3] for t in same.values()) < slots else {}


class Wrapper:
    """A host's tree with its container and template, ready to be applied."""

    def __init__(self, tree: Tree):
        self.tree, self.container = tree, container_of(tree)
        self.template = {} if self.container is None else template_of(tree, self.container)


def main_text(source: str, wrapper: Wrapper | None) -> str:
    """The text of a page by its host's wrapper, else by the page's own elements."""
    root, blocks = parse(source)
    if not blocks:
        return ""
    if wrapper and wrapper.container is not None:
        tree, place = skeleton(root, blocks)
        aligned = align(wrapper.tree, tree, _shapes)
        top = next((at for at, other in aligned.items() if other == wrapper.container), None)
        inside = set(tree.down(top)) if top is not None else ()
        scope = [(place[id(node)], text) for node, text in blocks if place[id(node)] in inside]
        left = [text for at, text in scope if wrapper.template.get(aligned.get(at)) != tree.texts[at][1]]
        if scope:
            return "\n\n".join(left or [text for _, text in scope])
    own = _articles(root)
    return "\n\n".join([text for node, text in blocks if id(node) in own] or [text for _, text in blocks])


def _articles(root: Node) -> set[int]:
    """Elements (by id) in article and main elements."""
    out, open_ = set(), [(root, False)]
    while open_:
        node, inside = open_.pop()
        inside = inside or (node.tag in ("article", "main") and not node.skipped)
        if inside:
            out.add(id(node))
        open_.extend((c, inside) for c in node.children)
    return out


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[bytes | None, Wrapper | None] = {}
    for batch in steps(batches, "html"):
        texts = []
        for source, data in zip(batch.column("html").to_pylist(), batch.column("wrapper").to_pylist(), strict=True):
            if data not in held:
                held = {} if len(held) > 100 else held
                held[data] = None if data is None else Wrapper(Tree.loaded(data))
            texts.append(main_text(source or "", held[data]))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string())], ["row", "text"])


def extract(pages: DataFrame) -> DataFrame:
    """`row` (all columns of pages) and `text` of every page. The html is read twice: to induce wrappers and to apply them."""
    read = pages.select(F.struct("*").alias("row"), host_and_path(F.col("url"))[0].alias("host"), F.col("html").cast("string").alias("html"))
    wrappers = induce(read.select("host", "html"))
    joined = read.join(wrappers, "host", "left").select("row", "html", "wrapper")
    return joined.mapInArrow(_texts, packed_schema(joined.schema["row"], "text string"))
