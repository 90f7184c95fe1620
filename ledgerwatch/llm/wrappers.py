"""Main text of web pages by wrapper induction.

All pages of a host are aligned by simple tree matching: what their structures share becomes the host's slots, and
each page's texts are counted by slot. Siblings with the same label next to each
other count as one repeated node. A node without blocks in it whose text is the same on nearly all of the pages belongs to the
host's template; the others are slots. A page's text is what its slots say, less the slots that stand in
menus, headers, footers, sidebars, notices, adverts, forms and comments.
"""

from __future__ import annotations

import html as references
import json
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import count

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ledgerwatch.llm.common import joined_small, seeded, small_batches
from ledgerwatch.llm.url_filter import host_of
from ledgerwatch.workspace import written

FAN = 64  # structures of a host that are merged at once
SURE = 0.8  # share of a host's pages that must say the same
LEAST = 4  # and how many pages at least
DEEPEST = 100  # levels of a template; what is deeper is a slot

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|[^<]+|<", re.DOTALL)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
NAME = re.compile(r"[a-z]+")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp".split())
INLINE = frozenset(
    "a abbr b bdi bdo big cite code data del dfn em font i ins kbd mark q s samp small span strong sub sup time tt u var".split()
)
PARAGRAPH_ENDERS = frozenset(
    "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre "
    "section table ul".split()
)
CLOSES = {
    "li": ("li", frozenset(("ul", "ol", "menu"))),
    "dt": ("dt dd", frozenset(("dl",))),
    "dd": ("dt dd", frozenset(("dl",))),
    "tr": ("tr td th", frozenset(("table",))),
    "td": ("td th", frozenset(("tr", "table"))),
    "th": ("td th", frozenset(("tr", "table"))),
    "option": ("option", frozenset(("select",))),
}
# what is no article, by element and by word in class, id or role
ASIDE_TAGS = frozenset("nav aside footer form head script style noscript iframe button select option input textarea svg menu dialog template title".split())
ASIDE_WORDS = frozenset(
    "nav navbar navigation menu breadcrumb breadcrumbs header masthead footer sidebar ad ads advert advertisement adverts sponsor "
    "sponsored promo banner cookie cookies consent notice alert popup modal newsletter subscribe comment comments disqus replies "
    "reply share sharing social related toolbar search login signup contentinfo complementary".split()
)


@dataclass(slots=True)
class Node:
    label: str
    tag: str
    aside: bool
    content: list = field(default_factory=list)  # strings and nodes in order
    shape: str = ""
    runs: list = field(default_factory=list)  # neighbours with one label

    def said(self) -> str:
        """The text of a node that holds no blocks, else nothing."""
        parts: list[str] = []
        todo = list(reversed(self.content))
        while todo:
            item = todo.pop()
            if isinstance(item, str):
                parts.append(item)
            elif item.tag in INLINE:
                todo.extend(reversed(item.content))
            else:
                return ""
        return " ".join("".join(parts).split())


def _label(tag: str, attributes: str, in_article: bool) -> tuple[str, bool]:
    """A node's label, and whether it is no article. The header of an article, by element or class, is part of it."""
    words: set[str] = set()
    if attributes:
        for found in ATTRIBUTE.finditer(attributes):
            words.update(NAME.findall((found[2] or found[3] or found[4] or "").lower()))
    label = f"{tag}.{'.'.join(sorted(words))}" if words else tag
    aside = tag in ASIDE_TAGS or not words.isdisjoint(ASIDE_WORDS - {"header"})
    return label, aside or (not in_article and (tag == "header" or "header" in words))


def parse(source: str | None) -> Node:
    """A tree from any text; end tags without a start are skipped, missing ones added."""
    root = Node("#", "#", False)
    stack = [root]
    at, text = 0, source or ""
    while True:
        token = TOKEN.match(text, at)
        if token is None:
            break
        at = token.end()
        tag = token[2]
        if tag is None:
            if not token[0].startswith(("<!", "<?")):
                stack[-1].content.append(references.unescape(token[0]))
            continue
        tag = tag.lower()
        if token[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag in PARAGRAPH_ENDERS:
            _close(stack, ("p",), frozenset(("article", "section", "div", "body", "td", "li")))
        if tag in CLOSES:
            _close(stack, CLOSES[tag][0].split(), CLOSES[tag][1])
        label, aside = _label(tag, token[3], any(n.tag in ("article", "main") for n in stack))
        node = Node(label, tag, aside)
        stack[-1].content.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\b[^>]*>", re.IGNORECASE).search(text, at)
            at = end.end() if end else len(text)
        elif tag not in VOID and not (token[3].endswith("/") and tag == "svg"):
            stack.append(node)
    _shape(root)
    return root


def _close(stack: list[Node], tags, until: frozenset[str]) -> None:
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].tag in tags:
            del stack[i:]
            return
        if stack[i].tag in until:
            return


def _shape(root: Node) -> None:
    """Runs of equal neighbours, and a text that is the same for equal structures."""
    order, todo = [], [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo.extend(x for x in node.content if not isinstance(x, str))
    for node in reversed(order):
        for child in node.content:
            if isinstance(child, str):
                continue
            if node.runs and node.runs[-1][0].label == child.label:
                node.runs[-1].append(child)
            else:
                node.runs.append([child])
        inner = (next(iter(s)) if len(s := {c.shape for c in run}) == 1 else "|".join(sorted(s)) for run in node.runs)
        shape = f"{node.label}({','.join(inner)})"
        node.shape = shape if len(shape) < 200 else f"{node.label}#{hash(shape)}"


@dataclass
class Slot:
    """A node of the template. ``children`` hold no two neighbours with one label; ``number`` is its place in preorder."""

    label: str
    children: list[Slot] = field(default_factory=list)
    number: int = 0

    def packed(self) -> list:
        return [self.label, [c.packed() for c in self.children]]

    @classmethod
    def unpacked(cls, data: list, numbers: Iterator[int] | None = None) -> Slot:
        numbers = count() if numbers is None else numbers
        own = next(numbers)
        return cls(data[0], [cls.unpacked(c, numbers) for c in data[1]], own)


def _digest(number: int, text: str) -> int:
    """64 bits, signed, of what a slot says."""
    found = xxhash.xxh64_intdigest(f"{number}:{text}".encode("utf-8", "replace"))
    return found - (1 << 64) if found >> 63 else found


class Aligner:
    """Simple tree matching of pages to one template, remembered by shape while the template stays as it is."""

    def __init__(self) -> None:
        self.sizes: dict[tuple[int, str], int] = {}
        self.pairs: dict[tuple[int, str], list[int]] = {}

    def size(self, slot: Slot, node: Node) -> int:
        """Nodes in the largest matching that keeps order and ancestry."""
        if slot.label != node.label:
            return 0
        key = (id(slot), node.shape)
        if key not in self.sizes:
            if len(self.sizes) > 200_000:
                self.sizes.clear()
            self.sizes[key] = 1 + (self._table(slot, node)[-1][-1] if slot.children and node.runs else 0)
        return self.sizes[key]

    def _table(self, slot: Slot, node: Node) -> list[list[int]]:
        rows = [[0] * (len(node.runs) + 1)]
        for child in slot.children:
            row = [0]
            for j, run in enumerate(node.runs):
                gain = max(self.size(child, x) for x in run[:8]) if child.label == run[0].label else 0
                row.append(max(rows[-1][j + 1], row[-1], rows[-1][j] + gain if gain else 0))
            rows.append(row)
        return rows

    def match(self, slot: Slot, node: Node) -> list[int]:
        """For each run of the node's children the place of its slot, or -1."""
        key = (id(slot), node.shape)
        if key not in self.pairs:
            if len(self.pairs) > 200_000:
                self.pairs.clear()
            out = [-1] * len(node.runs)
            if slot.children and node.runs:
                rows = self._table(slot, node)
                i, j = len(slot.children), len(node.runs)
                while i and j:
                    if rows[i][j] == rows[i - 1][j]:
                        i -= 1
                    elif rows[i][j] == rows[i][j - 1]:
                        j -= 1
                    else:
                        i, j = i - 1, j - 1
                        out[j] = i
            self.pairs[key] = out
        return self.pairs[key]


def _merge(slot: Slot, nodes: list[Node], depth: int = 0) -> None:
    """Add a page's nodes to their slot: slots for what has none yet."""
    if depth == DEEPEST:
        return
    grouped: dict[int, list[Node]] = {}
    for node in nodes:
        places = Aligner().match(slot, node)
        fresh = list(slot.children)
        at = 0
        for run, place in zip(node.runs, places, strict=True):
            if place >= 0:
                found = slot.children[place]
                at = fresh.index(found) + 1
            else:
                near = [c for c in (fresh[at - 1] if at else None, fresh[at] if at < len(fresh) else None) if c is not None and c.label == run[0].label]
                if near:
                    found = near[0]
                    at = fresh.index(found) + 1
                else:
                    found = Slot(run[0].label)
                    fresh.insert(at, found)
                    at += 1
            grouped.setdefault(id(found), []).extend(run)
        slot.children = fresh
    for child in slot.children:
        if id(child) in grouped:
            _merge(child, grouped[id(child)], depth + 1)


def structure(pages: list[Node]) -> str:
    """The slots of some pages as JSON."""
    template = Slot("#")
    for page in pages:
        _merge(template, [page])
    return json.dumps(template.packed(), ensure_ascii=False)


def _as_page(slots: list) -> Node:
    """Slots as a page that has each of them once."""

    def made(data: list) -> Node:
        return Node(data[0], data[0], False, [made(c) for c in data[1]])

    root = made(slots)
    _shape(root)
    return root


def joined_structures(structures: list[str]) -> str:
    """The slots of several pages or groups of pages, in an order of their own."""
    return structure([_as_page(json.loads(x)) for x in sorted(set(structures))])


def least_pages(pages: int) -> float:
    """How many of a host's pages must say the same."""
    return max(LEAST, SURE * pages)


def template_of(slots: str, sure: list[int]) -> str:
    return json.dumps({"slots": json.loads(slots), "sure": sorted(sure)}, ensure_ascii=False)


def induce(pages: list[str]) -> str:
    """The template of a host as JSON, from its different pages."""
    slots = joined_structures([structure([parse(page)]) for page in pages])
    known = Extractor(template_of(slots, []))
    said = Counter(x for page in pages for x in known.said(page))
    return template_of(slots, [x for x, n in said.items() if n >= least_pages(len(pages))])


class Extractor:
    def __init__(self, template: str) -> None:
        data = json.loads(template)
        self.template = Slot.unpacked(data["slots"])
        self.sure = frozenset(data["sure"])
        self.aligner = Aligner()

    def said(self, page: str | None) -> list[int]:
        """What the page's slots say outside menus and the like, each once."""
        out: set[int] = set()
        todo = [(parse(page), self.template)]
        while todo:
            node, slot = todo.pop()
            if node.aside:
                continue
            text = node.said()
            if text:
                out.add(_digest(slot.number, text))
            slots = self._slots(node, slot)
            todo.extend((x, slots[id(x)]) for x in node.content if id(x) in slots)
        return sorted(out)

    def text(self, page: str | None) -> str:
        """What the page's slots say outside menus and the like; where it has articles, inside those."""
        root = parse(page)
        articles = self._inside(root)
        blocks: list[str] = []
        open_block: list[str] = []

        def close() -> None:
            said = " ".join("".join(open_block).split())
            if said:
                blocks.append(said)
            open_block.clear()

        # (node, its slot, whether within an article); None closes a block
        todo: list = [(root, self.template, not articles)]
        while todo:
            item = todo.pop()
            if item is None:
                close()
                continue
            if isinstance(item, str):
                open_block.append(item)
                continue
            node, slot, shown = item
            if node.aside:
                close()
                continue
            if node.tag in ("br", "hr"):
                close()
                continue
            shown = shown or (articles and node.tag == articles)
            block = node.tag not in INLINE
            if block:
                close()
                todo.append(None)
            if slot is not None and self.sure and _digest(slot.number, node.said()) in self.sure:
                continue
            slots = self._slots(node, slot)
            for child in reversed(node.content):
                if isinstance(child, str):
                    if shown:
                        todo.append(child)
                else:
                    todo.append((child, slots.get(id(child)), shown))
        close()
        return " ".join(blocks)

    def _slots(self, node: Node, slot: Slot | None) -> dict[int, Slot]:
        if slot is None or not slot.children:
            return {}
        places = self.aligner.match(slot, node)
        return {id(x): slot.children[p] for run, p in zip(node.runs, places, strict=True) if p >= 0 for x in run}

    @staticmethod
    def _inside(root: Node) -> str:
        """The element that holds the article: ``article``, else ``main``, else none."""
        found, todo = set(), [root]
        while todo:
            node = todo.pop()
            if not node.aside:
                found.add(node.tag)
                todo.extend(x for x in node.content if not isinstance(x, str))
        return "article" if "article" in found else "main" if "main" in found else ""


def _structures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        yield pd.DataFrame({"host": batch.host, "slots": [structure([parse(x)]) for x in batch.html]}, dtype=object).drop_duplicates()


def _joined(group: pd.DataFrame) -> pd.DataFrame:
    return pd.DataFrame({"host": [group.host.iloc[0]], "slots": [joined_structures(group.slots.tolist())]})


def host_slots(rows: DataFrame) -> DataFrame:
    """``host, slots`` from all rows (host, html): different structures are merged some ``FAN`` at a time.

    Who meets whom goes by a hash of the structures, so neither the order nor the layout of the rows matters.
    """
    shape = "host string, slots string"
    found = written(rows.select("host", "html").mapInPandas(_structures, shape).distinct(), "page_slots")
    while True:
        sizes = found.groupBy("host").agg(F.count("*").alias("n"))
        if (sizes.agg(F.max("n")).first()[0] or 0) <= 1:
            return found
        group = F.pmod(F.xxhash64("slots"), F.ceil(F.col("n") / FAN)).alias("part")
        dealt = found.join(sizes, "host").select("host", "slots", group)
        found = written(dealt.groupBy("host", "part").applyInPandas(_joined, shape).distinct(), "host_slots")


def templates(rows: DataFrame) -> DataFrame:
    """``host, template`` from all rows (host, html) with a page; equal pages of a host count once."""
    rows = rows.where(F.length("html") > 0)
    slots = host_slots(rows)

    @F.pandas_udf("array<long>")
    def said(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        extractors: dict[str, Extractor] = {}
        for own, sources in batches:
            yield pd.Series([_extractor(extractors, x).said(y) for x, y in zip(own, sources, strict=True)], dtype=object)

    bare = slots.withColumn("template", F.concat(F.lit('{"sure": [], "slots": '), "slots", F.lit("}"))).drop("slots")
    known = joined_small(rows.select("host", "html"), bare, "host", limit=5_000)
    each = known.select("host", seeded(5, F.col("html")).alias("mark"), said("template", "html").alias("said"))
    each = written(each.groupBy("host", "mark").agg(F.first("said").alias("said")), "page_texts")
    pages = each.groupBy("host").agg(F.count("*").alias("pages"))
    counts = each.select("host", F.explode("said").alias("digest")).groupBy("host", "digest").agg(F.count("*").alias("n"))
    enough = F.col("n") >= F.greatest(F.lit(float(LEAST)), SURE * F.col("pages"))
    # at most as many as a page has nodes, over ``SURE``
    sure = counts.where(F.col("n") >= LEAST).join(pages, "host").where(enough).groupBy("host").agg(F.collect_list("digest").alias("sure"))

    @F.pandas_udf("string")
    def packed(slots: pd.Series, sure: pd.Series) -> pd.Series:
        return pd.Series([template_of(x, [int(d) for d in y]) for x, y in zip(slots, sure, strict=True)], dtype=object)

    none = F.array().cast("array<long>")
    return slots.join(sure, "host", "left").select("host", packed("slots", F.coalesce("sure", none)).alias("template"))


def _extractor(known: dict[str, Extractor], template: str) -> Extractor:
    if template not in known:
        if len(known) > 1_000:
            known.clear()
        known[template] = Extractor(template)
    return known[template]


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """One row per input row: ``page_id, url, text``.

    The template of a host is fitted on all its different pages; pages without a host share one. A host with fewer
    than four different pages has no template texts, only slots. Null and empty pages give empty text, repeated rows
    are repeated, other columns are ignored.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))
    rows = rows.withColumn("host", host_of("url"))
    found = written(templates(rows), "templates")
    full = rows.where(F.length("html") > 0)
    empty = rows.where(F.coalesce(F.length("html"), F.lit(0)) == 0).select("page_id", "url", F.lit("").alias("text"))

    @F.pandas_udf("string")
    def text(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        extractors: dict[str, Extractor] = {}
        for own, sources in batches:
            yield pd.Series([_extractor(extractors, x).text(y) for x, y in zip(own, sources, strict=True)], dtype=object)

    known = joined_small(full, found, "host", limit=5_000)
    return known.select("page_id", "url", text("template", "html").alias("text")).unionByName(empty)
