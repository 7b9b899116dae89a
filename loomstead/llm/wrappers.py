"""Wrapper induction: what the pages of a host have in common is template, what varies is content.

The DOM trees of a host's pages are aligned by simple tree matching, which finds the greatest set of matching
nodes that keeps parents and order. A text that stands at matched nodes of nearly all pages is template.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections import Counter
from collections.abc import Callable, Iterator, Sequence
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.session import discard, rows_known_below, spread, write_once

#: Different pages of a host that a template needs, and in what share of the others a text of it stands.
LEAST_PAGES, SHARE = 3, 0.8
#: In a matching the number of nodes comes first, then that of equal subtrees, which are fewer than this.
_FIRST = 1 << 24
_PAGE = re.compile(r"\s*(?:<!doctype\s+html|<html[\s>]|<head[\s>]|<body[\s>])", re.I)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset(("script", "style"))
#: Opening and closing marks of elements whose contents aren't shown.
HIDDEN = (re.compile(r"<(script|style)\b[^<>]*>", re.I), re.compile(r"</(script|style)\s*>", re.I), None)
#: Elements of which clean text shows a mark even if they are empty.
_MARKED = frozenset(("li", "h1", "h2", "h3", "h4", "h5", "h6"))


class Node:
    __slots__ = ("tag", "text", "children", "shape", "same", "span", "close")

    def __init__(self, tag: str, text: str | None = ""):
        self.tag, self.text, self.children = tag, text, []
        #: Where the text or start tag, and where the end tag stands in the source.
        self.span = self.close = (0, 0)


class _Builder(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]
        self.lines = [0, *(m.end() for m in re.finditer("\n", source))]
        self.waiting: list[tuple[Node, str, int]] = []

    def _at(self) -> int:
        line, column = self.getpos()
        return self.lines[line - 1] + column

    def updatepos(self, i, j):
        # Called after each event with its end.
        j = super().updatepos(i, j)
        for node, what, start in self.waiting:
            setattr(node, what, (start, self._at()))
        self.waiting.clear()
        return j

    def _add(self, tag: str) -> Node:
        node = Node(tag)
        self.open[-1].children.append(node)
        self.waiting.append((node, "span", self._at()))
        return node

    def handle_starttag(self, tag, attrs):
        if tag in ("li", "tr", "td", "th", "p", "dt", "dd", "option") and self.open[-1].tag == tag:
            self.open.pop()
        node = self._add(tag)
        if tag not in _VOID:
            self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self._add(tag)

    def handle_endtag(self, tag):
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag == tag:
                self.waiting.append((self.open[i], "close", self._at()))
                del self.open[i:]
                break

    def handle_data(self, data):
        if data.strip() and self.open[-1].tag not in _HIDDEN:
            self._add("#text").text = " ".join(data.split())


def parse(text: str) -> Node:
    builder = _Builder(text)
    builder.feed(text)
    builder.close()
    return builder.root


def is_page(text: str) -> bool:
    return bool(_PAGE.match(text))


class _Forest:
    """Trees with their subtrees numbered: `shape` by tags alone, `same` by tags and texts."""

    def __init__(self, *roots: Node):
        self.shapes: dict[tuple, int] = {}
        self.sames: dict[tuple, int] = {}
        self.parts: list[tuple[str, tuple[int, ...]]] = []
        self.size: list[int] = []
        self.known: dict[tuple[int, int], int] = {}
        for root in roots:
            for _, node in reversed(_nodes(root)):
                key = (node.tag, tuple(c.shape for c in node.children))
                node.shape = self.shapes.setdefault(key, len(self.shapes))
                if node.shape == len(self.parts):
                    self.parts.append(key)
                    self.size.append(1 + sum(self.size[s] for s in key[1]))
                node.same = self.sames.setdefault((node.tag, node.text, tuple(c.same for c in node.children)), len(self.sames))

    def score(self, a: int, b: int) -> int:
        """The greatest number of matching nodes of two shapes; each pair of shapes is compared once."""
        todo = [(a, b)]
        while todo:
            pair = x, y = todo[-1]
            (tag, p), (other, q) = self.parts[x], self.parts[y]
            if pair in self.known:
                todo.pop()
            elif tag != other or x == y:
                self.known[pair] = self.size[x] if x == y else 0
            else:
                head, tail = _ends(p, q)
                equal = sum(self.size[s] for s in (*p[:head], *p[len(p) - tail :]))
                p, q = p[head : len(p) - tail], q[head : len(q) - tail]
                missing = [(i, j) for i in set(p) for j in set(q) if (i, j) not in self.known]
                if missing:
                    todo += missing
                else:
                    self.known[pair] = 1 + equal + _align(self.weights(p, q), len(p), len(q))[0]
        return self.known[a, b]

    def weights(self, p: tuple[int, ...], q: tuple[int, ...]) -> Callable[[int], np.ndarray]:
        up, ip = np.unique(np.array(p, np.int64), return_inverse=True)
        uq, iq = np.unique(np.array(q, np.int64), return_inverse=True)
        table = np.array([[self.score(s, t) for t in uq.tolist()] for s in up.tolist()], np.int64).reshape(len(up), len(uq))
        return lambda i: table[ip[i]][iq]

    def children(self, a: Node, b: Node) -> list[tuple[Node, Node]]:
        """The children of two matched nodes that are matched; of the greatest matchings one with most equal subtrees."""
        if not a.children or not b.children:
            return []
        p, q = [c.same for c in a.children], [c.same for c in b.children]
        head, tail = _ends(p, q)
        n, m = len(p) - tail, len(q) - tail
        out = [*zip(a.children[:head], b.children[:head]), *zip(a.children[n:], b.children[m:])]
        left, right = a.children[head:n], b.children[head:m]
        if not left or not right:
            return out
        by_shape = self.weights(tuple(c.shape for c in left), tuple(c.shape for c in right))
        mine, theirs = p[head:n], np.array(q[head:m], np.int64)
        got = _align(lambda i: by_shape(i) * _FIRST + (theirs == mine[i]), len(left), len(right), True)[1]
        return out + [(left[i], right[j]) for i, j in got]


def _ends(p: Sequence[int], q: Sequence[int]) -> tuple[int, int]:
    """How many equal items stand at the beginning and at the end; a matching of equal subtrees can't be bettered."""
    least = min(len(p), len(q))
    head = next((i for i in range(least) if p[i] != q[i]), least)
    return head, next((i for i in range(least - head) if p[-1 - i] != q[-1 - i]), least - head)


def _align(weights: Callable[[int], np.ndarray], n: int, m: int, traced: bool = False) -> tuple[int, list[tuple[int, int]]]:
    """The greatest sum of weights of pairs that don't cross, and the pairs; weights(i) is row i."""
    before, taken, above = np.zeros(m + 1, np.int64), [], []
    for i in range(n):
        w = weights(i)
        with_it = before[:-1] + w
        now = np.zeros(m + 1, np.int64)
        np.maximum.accumulate(np.maximum(before[1:], with_it), out=now[1:])
        if traced:
            # A bit for each place, so that long lists fit.
            taken.append(np.packbits((w > 0) & (now[1:] == with_it)))
            above.append(np.packbits(now[1:] == before[1:]))
        before = now
    pairs, i, j = [], n - 1, m - 1
    while traced and i >= 0 and j >= 0:
        byte, bit = j >> 3, 128 >> (j & 7)
        if taken[i][byte] & bit:
            pairs.append((i, j))
            i, j = i - 1, j - 1
        elif above[i][byte] & bit:
            i -= 1
        else:
            j -= 1
    return int(before[-1]), pairs


def match(a: Node, b: Node, _limit: object = None) -> tuple[int, list[tuple[Node, Node]]]:
    """The greatest number of matching nodes of two trees, and the pairs (simple tree matching); nothing is limited."""
    if a.tag != b.tag:
        return 0, []
    forest = _Forest(a, b)
    out, todo = [], [(a, b)]
    while todo:
        pair = todo.pop()
        out.append(pair)
        todo += forest.children(*pair)
    return forest.score(a.shape, b.shape), out


def _nodes(root: Node) -> list[tuple[int, Node]]:
    """The nodes in the order of the document, with their depths."""
    out, todo = [], [(0, root)]
    while todo:
        depth, node = todo.pop()
        out.append((depth, node))
        todo += [(depth + 1, c) for c in reversed(node.children)]
    return out


def keys(text: str) -> set[int]:
    """The texts of a page with the tags above them, hashed; constant texts of a host are among those of nearly all pages."""
    out, chain = set(), [b""]
    for depth, node in _nodes(parse(text)):
        if node.tag == "#text":
            out.add(int.from_bytes(hashlib.blake2b(node.text.encode("utf-8", "replace"), digest_size=8, key=chain[depth - 1]).digest(), "little", signed=True))
        else:
            del chain[max(depth, 1) :]
            chain.append(hashlib.blake2b(node.tag.encode("utf-8", "replace"), digest_size=8, key=chain[-1]).digest())
            if not depth:
                del chain[0]
    return out


def constant(reference: str, page: str) -> list[int]:
    """The numbers of the texts of a reference page that stand at the matched nodes of a page too."""
    a = parse(reference)
    number = {id(node): n for n, (_, node) in enumerate(_nodes(a))}
    return sorted(number[id(x)] for x, y in match(a, parse(page))[1] if x.tag == "#text" and x.text == y.text)


def skeleton(reference: str, kept: set[int]) -> list[list]:
    """The nodes of a reference page as (depth, tag, text), with only those texts that are kept."""
    return [[depth, node.tag, node.text if n in kept else None] for n, (depth, node) in enumerate(_nodes(parse(reference)))]


def _grown(nodes: list[list]) -> Node:
    open_: list[Node] = []
    for depth, tag, text in nodes:
        node = Node(tag, text)
        del open_[depth:]
        if open_:
            open_[-1].children.append(node)
        open_.append(node)
    return open_[0]


def induce(pages: list[str]) -> str | None:
    """The template of pages: skeletons of some with the texts that stand at matched nodes of nearly all.

    The pages to take skeletons of are chosen until they hold all texts that nearly all pages have. Null for too few
    different pages, and where nothing is constant.
    """
    pages = sorted(set(pages))
    if len(pages) < LEAST_PAGES:
        return None
    need = SHARE * (len(pages) - 1)
    of = [keys(p) for p in pages]
    counts = Counter(k for own in of for k in own)
    left, out = {k for k, n in counts.items() if n - 1 >= need}, []
    while left:
        best = max(range(len(pages)), key=lambda i: len(of[i] & left))
        left -= of[best]
        found = Counter(n for i, p in enumerate(pages) if i != best for n in constant(pages[best], p))
        kept = {n for n, c in found.items() if c >= need}
        if kept:
            out.append(skeleton(pages[best], kept))
    return json.dumps(out) if out else None


def without_template(text: str, template: str) -> str:
    """A page without the texts of its template; all else of the source stays as it is.

    List items and headings that hold nothing else lose their tags too, as they would leave a mark.
    """
    page = parse(text)
    gone = {
        id(y) for nodes in json.loads(template) for x, y in match(_grown(nodes), page)[1] if x.tag == "#text" and x.text == y.text
    }
    cuts: list[tuple[int, int]] = []
    emptied: dict[int, bool] = {}
    for _, node in reversed(_nodes(page)):
        if node.tag == "#text":
            emptied[id(node)] = id(node) in gone
            if id(node) in gone:
                start, end = node.span
                said = text[start:end]
                cuts.append((start + len(said) - len(said.lstrip()), end - len(said) + len(said.rstrip())))
            continue
        inside = [emptied[id(c)] for c in node.children if id(c) in emptied]
        if inside:
            emptied[id(node)] = all(inside)
            if node.tag in _MARKED and all(inside):
                cuts += [node.span, node.close]
    at, out = 0, []
    for start, end in sorted(c for c in cuts if c[0] < c[1]):
        out.append(text[at:start])
        at = end
    return "".join([*out, text[at:]])


def templates(df: DataFrame, text: str, host: str) -> DataFrame:
    """(_host, template) of hosts with enough different whole pages, as induce() makes it, from all of these pages.

    Counts are merged, so that the pages of a host need not fit into a task. A round takes one page of each host as
    reference, that with most of the common texts which none before it has; as each common text is missing from few
    pages, a round leaves at most a fifth of them.
    """
    spark = df.sparkSession
    pages = df.select(F.col(host).alias("_host"), F.col(text).alias("_page")).where(
        F.col("_host").isNotNull() & F.col("_page").rlike(r"(?i)^\s*(<!doctype\s+html|<html[\s>]|<head[\s>]|<body[\s>])")
    )
    pages = write_once(pages.withColumn("_id", F.sha2("_page", 256)).dropDuplicates(["_host", "_id"]), "pages")
    sizes = pages.groupBy("_host").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_PAGES)
    none = spark.createDataFrame([], "_host string, template string")
    if rows_known_below(sizes, 1):
        return none
    need = F.lit(SHARE) * (F.col("n") - 1)

    def all_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, i, page in zip(*(batch.column(c).to_pylist() for c in ("_host", "_id", "_page"))):
                own = sorted(keys(page))
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(own), pa.string()), pa.array([i] * len(own), pa.string()), pa.array(own, pa.int64())], ["_host", "_id", "key"])

    keyed = write_once(spread(pages.join(sizes, "_host", "left_semi")).mapInArrow(all_keys, "_host string, _id string, key long"), "keys")
    common = keyed.groupBy("_host", "key").agg(F.count("*").alias("c")).join(sizes, "_host").where(F.col("c") - 1 >= need)
    left = write_once(keyed.join(common, ["_host", "key"], "left_semi"), "common")
    references = None
    while not rows_known_below(left, 1):
        best = left.groupBy("_host", "_id").agg(F.count("*").alias("c")).groupBy("_host")
        best = write_once(best.agg(F.max_by("_id", F.struct("c", "_id")).alias("_id")), "best")
        references = best if references is None else references.unionByName(best)
        covered = left.join(best, ["_host", "_id"], "left_semi").select("_host", "key")
        left, before = write_once(left.join(covered, ["_host", "key"], "left_anti"), "left"), left
        discard(before)
    if references is None:
        return none
    references = write_once(references.join(pages, ["_host", "_id"]).select("_host", F.col("_id").alias("_ref"), F.col("_page").alias("_first")), "references")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, ref, first, page in zip(*(batch.column(c).to_pylist() for c in ("_host", "_ref", "_first", "_page"))):
                own = constant(first, page)
                yield pa.RecordBatch.from_arrays([pa.array([h] * len(own), pa.string()), pa.array([ref] * len(own), pa.string()), pa.array(own, pa.int64())], ["_host", "_ref", "node"])

    pairs = spread(pages.join(references, "_host").where("_id <> _ref").select("_host", "_ref", "_first", "_page"))
    nodes = pairs.mapInArrow(compare, "_host string, _ref string, node long").groupBy("_host", "_ref", "node").agg(F.count("*").alias("c"))
    nodes = nodes.join(sizes, "_host").where(F.col("c") >= need).groupBy("_host", "_ref").agg(F.collect_list("node").alias("nodes"))

    def skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [json.dumps(skeleton(p, set(n))) for p, n in zip(batch.column("_first").to_pylist(), batch.column("nodes").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("_host"), pa.array(made, pa.string())], ["_host", "one"])

    made = references.join(nodes, ["_host", "_ref"]).select("_host", "_first", "nodes").mapInArrow(skeletons, "_host string, one string")
    whole = made.groupBy("_host").agg(F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("one")), ","), F.lit("]")).alias("template"))
    return write_once(whole, "templates")


_BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 "
    "h5 h6 header hr html li main nav ol p pre section summary table tbody tfoot thead tr ul".split()
)


def html_to_text(text: str, elements: frozenset, tag: re.Pattern) -> str:
    """Replace tags (what HIDDEN encloses is gone before): headings and list items by their marks, cells by bars, blocks by line ends; others go."""
    def one(m: re.Match) -> str:
        name, closing = m[2].lower(), bool(m[1])
        if name not in elements:
            return m[0]
        if len(name) == 2 and name[0] == "h" and name[1].isdigit():
            return "\n" if closing else "\n" + "#" * int(name[1]) + " "
        if name == "li":
            return "" if closing else "\n- "
        if name in ("td", "th"):
            return " | " if closing else ""
        return "\n" if name in _BLOCKS else ""

    return tag.sub(one, text)
