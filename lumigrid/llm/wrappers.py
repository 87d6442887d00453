"""HTML extraction by wrapper induction: pages of a host share a template; what varies in it is content (operator 12).

Every page is read into a tree (``pages``). A host's wrapper is the union of its pages' skeletons, aligned by simple tree matching: a
pair of nodes with equal labels scores one plus the best order-keeping matching of their children. Skeletons are merged per part of
a host, then per host, so no task holds more than the distinct ways a host builds its pages. Each skeleton is then aligned with its
wrapper. A text that one place of the wrapper shows in ``CONSTANT`` of the host's differing pages (at least ``PAGES``) is template;
the other places are slots, and the main slot is an article or main element, or one named so, or else the deepest place that holds most
of the varying text outside links. Pages without a host have only their own skeleton, so nothing is constant there.

Whatever the wrapper, elements that say what they are (navigation, footers, asides, forms, scripts, hidden ones, classes and ids like
``cookie-notice`` or ``comments``; ``pages.MARKS``) aren't content, unless they hold all there is. Paragraphs, lists, tables and headings
inside an article or main element are never template, even if many pages repeat them.

Defined cases: null and empty html gives ''; text without markup is one block; unclosed and crossed tags are closed where a
browser would, about; null and odd urls have no host; repeated rows get equal rows, and copies of a page count once in what is
constant; an empty table gives none; other columns never enter the plan. Ties between skeletons go by text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .pages import FLOW, Page

PAGES, CONSTANT = 3, 0.8
#: Share of the varying text that an article or main element must hold to be the main slot, and that one child must hold to be looked into.
NAMED, MOST = 0.25, 0.6
#: Share of linked text from which a place is a menu, where no element names the article.
LINKED = 0.7
#: Parts a host's skeletons are merged in first; pairs of children from which not all scores are held at once (results are the same).
SPREAD, WIDE = 32, 40_000
#: Verdicts that are broadcast: rows and bytes.
VERDICT_ROWS, VERDICT_BYTES = 100_000, 32 << 20
#: Facts a task sums before it hands them on.
HELD = 100_000

_CONTENT = re.compile(r"[a-z]+\.(?:[a-z-]*-)?(?:content|article|post|entry|story|main)(?:-[a-z-]*)?")


class Tree:
    """A skeleton's nodes in order of appearance: labels, children, own numbers."""

    __slots__ = ("label", "children", "number")

    def __init__(self, label: str, number: int):
        self.label, self.children, self.number = label, [], number

    @classmethod
    def parse(cls, skeleton: str) -> tuple[Tree, list[Tree]]:
        nodes = [cls("", 0)]
        open_, begin = [nodes[0]], 0
        for m in re.finditer(r"[(,)]", skeleton):
            if open_[-1].label == "":
                open_[-1].label = skeleton[begin : m.start()]
            if m[0] != "(":
                open_.pop()
            if m[0] != ")":
                child = cls("", len(nodes))
                open_[-1].children.append(child)
                nodes.append(child)
                open_.append(child)
                begin = m.end()
        if nodes[0].label == "":
            nodes[0].label = skeleton
        return nodes[0], nodes

    def text(self) -> str:
        return self.label + (f"({','.join(c.text() for c in self.children)})" if self.children else "")


def _pairs(a: list[Tree], b: list[Tree], memo: dict) -> tuple[int, list[tuple[int, int]]]:
    """The best matching of two child lists in order, whatever their lengths: its score and its pairs.

    Of long lists only every so many rows of scores stay; those between are made again on the way back, and what their members' trees
    share isn't remembered. Both save memory and change nothing else.
    """
    if not a or not b:
        return 0, []
    places: dict[str, list[int]] = {}
    for j, y in enumerate(b):
        places.setdefault(y.label, []).append(j)
    wide = len(a) * len(b) > WIDE

    def after(i: int, above: np.ndarray) -> np.ndarray:
        gain = np.zeros(len(b), np.int64)
        for j in places.get(a[i].label, ()):
            gain[j] = match(a[i], b[j], {} if wide else memo)
        row = np.zeros(len(b) + 1, np.int64)
        np.maximum.accumulate(np.maximum(above[1:], above[:-1] + gain), out=row[1:])
        return row

    step = math.isqrt(len(a)) if wide else len(a)
    kept, row = [np.zeros(len(b) + 1, np.int64)], np.zeros(len(b) + 1, np.int64)
    score = [row]
    for i in range(len(a)):
        row = after(i, row)
        if not wide:
            score.append(row)
        elif (i + 1) % step == 0:
            kept.append(row)
    best, first = int(row[-1]), 0
    if wide:
        first, score = len(a) + 1, []
    out, i, j = [], len(a), len(b)
    while i and j:
        if i - 1 < first:
            first = (i - 1) // step * step
            score = [kept[first // step]]
            for k in range(first, i):
                score.append(after(k, score[-1]))
        now, above = score[i - first], score[i - 1 - first]
        if now[j] == above[j]:
            i -= 1
        elif now[j] == now[j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            out.append((i, j))
    return best, out[::-1]


def match(a: Tree, b: Tree, memo: dict) -> int:
    """Simple tree matching: how many nodes of two trees go together, order and ancestry kept."""
    if a.label != b.label:
        return 0
    if not a.children or not b.children:
        return 1
    key = id(a), id(b)
    if key not in memo:
        memo[key] = 1 + _pairs(a.children, b.children, memo)[0]
    return memo[key]


def align(wrapper: Tree, page: Tree, memo: dict | None = None) -> list[tuple[Tree, Tree]]:
    """Pairs of nodes (of the wrapper, of the page) of a best matching; roots always go together."""
    memo = {} if memo is None else memo
    out, todo = [], [(wrapper, page)]
    while todo:
        w, p = todo.pop()
        out.append((w, p))
        todo += [(w.children[i], p.children[j]) for i, j in _pairs(w.children, p.children, memo)[1]]
    return out


def merge(wrapper: Tree, page: Tree) -> None:
    """Adds to the wrapper what the page has more, behind the matched node before it."""
    for w, p in align(wrapper, page):
        pairs = _pairs(w.children, p.children, {})[1]
        at = dict((j, i) for i, j in pairs)
        new, done = [], 0
        for j, child in enumerate(p.children):
            if j in at:
                new += w.children[done : at[j] + 1]
                done = at[j] + 1
            else:
                new.append(child)
        w.children = new + w.children[done:]


def induced(skeletons: list[str]) -> str:
    """The wrapper of skeletons, the first as its base."""
    root = Tree.parse(skeletons[0])[0]
    for s in skeletons[1:]:
        merge(root, Tree.parse(s)[0])
    return root.text()


def chosen(skeleton: str, chars: list[int], links: list[int]) -> tuple[list[int], list[int]]:
    """The main slot's nodes with all below, and the menus among them, from the text outside links and inside links of each node."""
    root, nodes = Tree.parse(skeleton)
    kept = [0 if n.label.endswith("!") else c for n, c in zip(nodes, chars, strict=True)]
    total, under = list(kept), [[n.number] for n in nodes]
    for n in reversed(nodes):
        for c in n.children:
            total[n.number] += total[c.number]
            under[n.number] += under[c.number]

    def below(tops: list[int]) -> list[int]:
        return sorted({v for t in tops for v in under[t]})

    tag = [n.label.partition(".")[0] for n in nodes]
    for name in ("article", "main"):
        tops = [n.number for n in nodes if tag[n.number] == name and not n.label.endswith("!")]
        inner = {c for t in tops for c in under[t] if c != t}
        tops = [t for t in tops if t not in inner]
        if tops and sum(total[t] for t in tops) >= NAMED * total[0]:
            return below(tops), []
    menus = [v for v in range(len(nodes)) if links[v] > LINKED * (links[v] + kept[v]) and links[v] > 0]
    named = [n.number for n in nodes if _CONTENT.fullmatch(n.label) and tag[n.number] not in FLOW]
    best = max(named, key=lambda v: (total[v], -v), default=None)
    if best is not None and total[best] >= MOST * total[0]:
        return below([best]), menus
    at = root
    while at.children:
        child = max(at.children, key=lambda c: (total[c.number], -c.number))
        if total[child.number] < MOST * total[at.number] or tag[child.number] in FLOW:
            break
        at = child
    return below([at.number]), menus


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _slots(page: Page, explicit_only: bool) -> Iterator[tuple[int, int]]:
    """(node, hash of the text) where a text may be template."""
    for node, text, _ in page.blocks:
        if not explicit_only or node.label.partition(".")[0] not in FLOW:
            yield node.number, _hash(text)


_FACTS = "site string, skeleton long, shape string, node int, pages long, chars long, links long, text long, content long"
_FACT_TYPES = pa.schema([("site", pa.string()), ("skeleton", pa.int64()), ("shape", pa.string()), ("node", pa.int32()), *((c, pa.int64()) for c in ("pages", "chars", "links", "text", "content"))])


def _site(host: str, skeleton: int) -> str:
    """Pages without a host meet only pages of their own skeleton."""
    return host or f"\0{skeleton}"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of three kinds: a skeleton and its pages (shape); a node's sums (chars); a text seen at a node in a content (text)."""
    shapes: dict[tuple, list] = {}
    sums: dict[tuple, list[int]] = {}
    seen: dict[tuple, None] = {}

    def take() -> Iterator[pa.RecordBatch]:
        rows = [(k[0], k[1], v[0], None, v[1], None, None, None, None) for k, v in shapes.items()]
        rows += [(k[0], k[1], None, k[2], None, v[0], v[1], None, None) for k, v in sums.items()]
        rows += [(k[0], k[1], None, k[2], None, None, None, k[3], k[4]) for k in seen]
        for d in (shapes, sums, seen):
            d.clear()
        for i in range(0, len(rows), 1 << 14):
            yield common.batch_of(_FACT_TYPES, *(list(c) for c in zip(*rows[i : i + (1 << 14)], strict=True)))

    for part in common.chunks(batches, "html"):
        for host, source in zip(part.column(0).to_pylist(), part.column(1), strict=True):
            page = Page(source.as_py())
            skeleton = _hash(page.skeleton)
            site = _site(host, skeleton)
            shapes.setdefault((site, skeleton), [page.skeleton, 0])[1] += 1
            for node, text, linked in page.blocks:
                s = sums.setdefault((site, skeleton, node.number), [0, 0])
                s[0] += max(len(text) - linked, 0)
                s[1] += min(linked, len(text))
            if host:
                content = _hash("\n\n".join(b[1] for b in page.blocks))
                seen.update(((site, skeleton, node, text, content), None) for node, text in _slots(page, page.explicit))
        if len(shapes) + len(sums) + len(seen) > HELD:
            yield from take()
    yield from take()


_BLOCKS = "{key}, url string, site string, skeleton long, blocks array<struct<node:int,hash:long,text:string>>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pages as blocks with their places; texts that are never template have no hash."""
    kind = pa.list_(pa.struct([("node", pa.int32()), ("hash", pa.int64()), ("text", pa.string())]))
    for part in common.chunks(batches, "html"):
        sites, skeletons, blocks = [], [], []
        for host, source in zip(part.column(2).to_pylist(), part.column(3), strict=True):
            page = Page(source.as_py())
            skeleton = _hash(page.skeleton)
            sites.append(_site(host, skeleton))
            skeletons.append(skeleton)
            explicit = page.explicit
            blocks.append([{"node": n.number, "hash": None if not host or explicit and n.label.partition(".")[0] in FLOW else _hash(t), "text": t} for n, t, _ in page.blocks])
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(sites, pa.string()), pa.array(skeletons, pa.int64()), pa.array(blocks, kind)], names=["page_id", "url", "site", "skeleton", "blocks"])


def _aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, skeleton, shape, wrapper) with the wrapper's node for each node of the skeleton (-1: none)."""
    for b in batches:
        maps = []
        for shape, wrapper in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), strict=True):
            page, nodes = Tree.parse(shape)
            to = [-1] * len(nodes)
            for w, p in align(Tree.parse(wrapper)[0], page):
                to[p.number] = w.number
            maps.append(to)
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(maps, pa.list_(pa.int32()))], names=["site", "skeleton", "shape", "places"])


def _mains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a wrapper with sums per node: its main slot's nodes and menus."""
    for b in batches:
        main, menus = [], []
        for wrapper, sums in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
            n = len(Tree.parse(wrapper)[1])
            chars, links = [0] * n, [0] * n
            for s in sums or []:
                chars[s["place"]], links[s["place"]] = s["chars"], s["links"]
            found = chosen(wrapper, chars, links)
            main.append(found[0])
            menus.append(found[1])
        ints = pa.list_(pa.int32())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(main, ints), pa.array(menus, ints)], names=["site", "main", "menus"])


_VERDICT = "site string, skeleton long, keep array<int>, constant array<string>"


def _verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(site, skeleton, shape, places, main, menus, constants, sums): which nodes of a skeleton are kept, and ``node:hash`` of its template texts."""
    for b in batches:
        keep, constant = [], []
        for shape, places, main, menus, constants, sums in zip(*(b.column(i).to_pylist() for i in range(2, 8)), strict=True):
            root, nodes = Tree.parse(shape)
            inside, away = set(main), set(menus)
            kept, todo = set(), [(root, False)]
            while todo:  # all below a node of the main slot
                n, within = todo.pop()
                within = within or places[n.number] in inside
                if within and places[n.number] not in away:
                    kept.add(n.number)
                todo += [(c, within) for c in n.children]
            if not kept:  # this page has no such place: its own sums decide
                chars, links = [0] * len(nodes), [0] * len(nodes)
                for s in sums or []:
                    chars[s["node"]], links[s["node"]] = s["chars"], s["links"]
                own, own_menus = chosen(shape, chars, links)
                kept = set(own) - set(own_menus)
            texts: dict[int, list[int]] = {}
            for c in constants or []:
                texts.setdefault(c["place"], []).append(c["text"])
            keep.append(sorted(kept))
            constant.append([f"{v}:{t}" for v in sorted(kept) for t in texts.get(places[v], [])])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(keep, pa.list_(pa.int32())), pa.array(constant, pa.list_(pa.string()))], names=["site", "skeleton", "keep", "constant"])


def _merged(column: str):
    def run(group: pa.Table) -> pa.Table:
        rows = sorted(zip(group["pages"].to_pylist(), group[column].to_pylist(), strict=True), key=lambda r: (-r[0], r[1]))
        return pa.table({"site": group["site"][:1], "wrapper": [induced([r[1] for r in rows])], "pages": [sum(r[0] for r in rows)]})

    return run


def verdicts(pages: DataFrame) -> DataFrame:
    """(site, skeleton, keep, constant) from pages (host, html): a table with a row per way a site builds its pages."""
    facts = common.table(pages.mapInArrow(_facts, _FACTS), "page-facts", "zstd")
    shapes = common.table(facts.filter("shape is not null").groupBy("site", "skeleton").agg(F.min("shape").alias("shape"), F.sum("pages").alias("pages")), "skeletons", "zstd")
    sums = common.table(facts.filter("chars is not null").groupBy("site", "skeleton", "node").agg(F.sum("chars").alias("chars"), F.sum("links").alias("links")), "page-sums", "zstd")
    # wrappers: parts of a site, then sites
    out = "site string, wrapper string, pages long"
    parts = shapes.withColumn("part", F.pmod("skeleton", F.lit(SPREAD))).groupBy("site", "part").applyInArrow(_merged("shape"), out)
    wrappers = common.table(parts.groupBy("site").applyInArrow(_merged("wrapper"), out), "wrappers", "zstd")
    placed = shapes.join(wrappers.select("site", "wrapper"), "site").select("site", "skeleton", "shape", "wrapper")
    placed = common.table(placed.mapInArrow(_aligned, "site string, skeleton long, shape string, places array<int>"), "placed", "zstd")
    place = F.element_at("places", F.col("node") + 1).alias("place")
    at = placed.select("site", "skeleton", "places")
    of_places = sums.join(at, ["site", "skeleton"]).groupBy("site", place).agg(F.sum("chars").alias("chars"), F.sum("links").alias("links")).filter("place >= 0")
    of_places = of_places.groupBy("site").agg(F.collect_list(F.struct("place", "chars", "links")).alias("sums"))  # no more than the wrapper's nodes
    mains = wrappers.join(of_places, "site", "left").select("site", "wrapper", "sums").mapInArrow(_mains, "site string, main array<int>, menus array<int>")
    mains = common.table(mains, "mains", "zstd")
    # template texts: contents that differ count, copies don't
    seen = facts.filter("text is not null").join(at, ["site", "skeleton"]).select("site", place, "text", "content").filter("place >= 0").distinct()
    each = seen.groupBy("site", "place", "text").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= PAGES)
    all_ = seen.select("site", "place", "content").distinct().groupBy("site", "place").agg(F.count(F.lit(1)).alias("all"))
    constants = each.join(all_, ["site", "place"]).filter(F.col("n") >= CONSTANT * F.col("all"))
    constants = constants.groupBy("site").agg(F.collect_list(F.struct("place", "text")).alias("constants"))  # a place has few: each is in most of its contents
    own = sums.groupBy("site", "skeleton").agg(F.collect_list(F.struct("node", "chars", "links")).alias("sums"))
    all_of = placed.join(mains, "site").join(constants, "site", "left").join(own, ["site", "skeleton"], "left")
    ruled = all_of.select("site", "skeleton", "shape", "places", "main", "menus", "constants", "sums").mapInArrow(_verdicts, _VERDICT)
    ruled = common.table(ruled, "verdicts", "zstd")
    common.drop(facts, shapes, sums, wrappers, placed, mains)
    return ruled


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) of every page: the main text's blocks in order, two line feeds between them."""
    common.ship(pages.sparkSession)
    host = F.regexp_extract(F.lower("url"), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.coalesce(host, F.lit("")).alias("host"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    ruled = verdicts(rows.select("host", "html"))
    size = ruled.agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("keep") * 4 + F.aggregate("constant", F.lit(0), lambda a, x: a + F.length(x)) + 64).alias("bytes")).first()
    if size.n <= VERDICT_ROWS and (size.bytes or 0) <= VERDICT_BYTES:
        ruled = F.broadcast(ruled)
    key = f"page_id {rows.schema['page_id'].dataType.simpleString()}"
    read = rows.mapInArrow(_read, _BLOCKS.format(key=key)).join(ruled, ["site", "skeleton"])
    content = F.filter("blocks", lambda b: F.array_contains("keep", b["node"]) & ~F.coalesce(F.array_contains("constant", F.concat_ws(":", b["node"].cast("string"), b["hash"].cast("string"))), F.lit(False)))
    text = F.array_join(F.transform(content, lambda b: b["text"]), "\n\n")
    return read.select("page_id", "url", text.alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def query(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))
