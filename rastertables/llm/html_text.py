"""HTML extraction by wrapper induction.

1. Every page becomes a small tree: block elements that hold text, siblings of
   the same tag and class (or, without a class, of the same tag and structure)
   folded into one repeated node.  Tree, text sizes and block digests go into a
   narrow table; the pages themselves stay where they are.
2. The commonest trees of a host (by tags, up to REFERENCES of them) are its
   references.  Every tree is aligned by simple tree matching (ordered, by tag;
   equal class names weigh a little more) with the one it shares most nodes with.
   A node that the reference lacks is told by its own place below its aligned
   ancestor.
3. For each node of a host it is learned over the host's different pages how
   much text it holds, how much of it in links, how often it repeats, and which
   texts are constant there: those are template.
4. A page's content is the subtree that the varying text leads to: from the root
   on, the child that holds most text besides links and template is entered while
   it holds at least half of its parent's and does not repeat.  In the subtree,
   template and nodes that are nearly all links are left out.

Tags and class words (navigation, advert, comment, ...) only break ties: a node
with such a word counts as a quarter of its text, and within the content, where
structure does not tell it from the rest, it is left out.

Counts are grouped by (host, node), copies of a page count once, and tables per
host are joined by ``split_join``, so a host with a third of all pages is spread
over all tasks.

Defined cases: null html is the empty page, with empty text; a null or odd url
is a host of its own; on a host of one page, that page alone is learned from;
repeated rows give a row each; unclosed and stray tags are repaired as browsers
do for paragraphs and list items; comments are dropped; other columns are
ignored; no rows give no rows.  Nothing is recursive, so nesting may be deep.
"""

from __future__ import annotations

import hashlib
import html
import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import split_join, stored, text_or_empty

#: Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
CLOSED_BY_BLOCK = frozenset("p h1 h2 h3 h4 h5 h6".split())
#: Elements that are seldom content, and words of a class, id or role that say so.
ROLES = frozenset("nav header footer aside form script style noscript template button select option textarea iframe svg object menu dialog head title canvas audio video".split())
HINTS = frozenset(
    "ad ads advert adverts advertisement sponsor sponsored promo banner sidebar menu nav navbar navigation breadcrumb breadcrumbs footer header masthead comment comments "
    "respond cookie cookies consent notice newsletter subscribe signup share sharing social related recommended popup modal login search widget pagination toolbar disclaimer".split()
)
#: Elements that hold the content, whatever words describe the page's layout.
WHOLE = frozenset("html body main article".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>?", re.S)
ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: A text is template if the lower confidence bound (one standard error) of its
#: share of the pages that have its node reaches CONSTANT: 4 of 4, 18 of 20 pages.
CONSTANT = 0.8
#: Share of a parent's text that leads further, mean repetition from which a node
#: is a record, share of link text of a list of links, weight of a named role.
LEADS, REPEATS, LINKED, TIE = 0.5, 1.5, 0.8, 0.25
#: Reference trees of a host, each on at least this share of its pages (but one).
REFERENCES, COMMON = 4, 0.02
#: Nodes on a smaller share of a host's pages are judged by the page alone.
RARE = 0.05


class Node:
    __slots__ = ("block", "children", "name", "role", "tag")

    def __init__(self, tag: str, name: str = "", role: bool = False):
        self.tag, self.name, self.role, self.block, self.children = tag, name, role, False, []


def parse(page: str) -> Node:
    """A page's tree; children are nodes and strings.  ``block`` says whether a
    block element (or a named role) is inside."""
    root = Node("")
    stack, at, n = [root], 0, len(page)
    while at < n:
        m = TOKEN.search(page, at)
        if m is None:
            stack[-1].children.append(page[at:])
            break
        if m.start() > at:
            stack[-1].children.append(page[at : m.start()])
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag == tag:
                    del stack[i:]
                    break
            continue
        if tag not in INLINE and tag not in VOID:
            _close(stack, tag)
        words = [w for a in ATTRIBUTE.finditer(m[3]) for w in re.split(r"[^a-z]+", (a[2] or a[3] or a[4] or "").lower()) if w]
        node = Node(tag, " ".join(words), tag in ROLES or tag not in WHOLE and not HINTS.isdisjoint(words))
        if tag not in VOID and (tag not in INLINE or node.role):
            for above in reversed(stack):
                if above.block:
                    break
                above.block = True
        stack[-1].children.append(node)
        if tag in RAW:
            end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
            stop = end.start() if end else n
            if tag == "textarea" or tag == "title":
                node.children.append(page[at:stop])
            close = page.find(">", stop) if end else -1
            at = close + 1 if close >= 0 else n
        elif tag not in VOID and not m[3].rstrip().endswith("/"):
            stack.append(node)
    return root


def _close(stack: list[Node], tag: str) -> None:
    """End what a new block ends: an open paragraph or heading with the inline
    elements in it, or the list item, row or cell before."""
    same = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}.get(tag, ())
    for i in range(len(stack) - 1, 0, -1):
        open_tag = stack[i].tag
        if open_tag in CLOSED_BY_BLOCK or open_tag in same:
            del stack[i:]
            return
        if open_tag not in INLINE:
            return


class Page:
    """The folded tree of a page and its blocks in page order.

    Nodes are numbered parents first: up, tag, name, role, kids, times (elements
    folded into the node), chars and links (code points in the node's subtree,
    and those in links).  blocks: (node, text, code points in links)."""

    def __init__(self, source: str):
        elements, blocks = _elements(parse(source))
        self._fold(elements, blocks)
        self.chars, self.links = [0] * len(self.up), [0] * len(self.up)
        for node, text, linked in self.blocks:
            self.chars[node] += len(text)
            self.links[node] += linked
        for i in range(len(self.up) - 1, 0, -1):
            self.chars[self.up[i]] += self.chars[i]
            self.links[self.up[i]] += self.links[i]

    def _fold(self, elements: list[tuple[int, Node]], blocks: list[tuple[int, str, int]]) -> None:
        ups = [up for up, _ in elements]
        holds = [False] * len(elements)
        for e, _, _ in blocks:
            while e >= 0 and not holds[e]:
                holds[e], e = True, ups[e]
        holds[0] = True
        # Structure of every element, children first, as a number within the page.
        numbers: dict[tuple, int] = {}
        inside: list[dict[int, None]] = [{} for _ in elements]
        shape = [0] * len(elements)
        for e in range(len(elements) - 1, -1, -1):
            if holds[e]:
                shape[e] = numbers.setdefault((elements[e][1].tag, *inside[e]), len(numbers))
                if e:
                    inside[ups[e]][shape[e]] = None
        self.up, self.tag, self.name, self.role, self.times, self.kids = [], [], [], [], [], []
        place, at = {}, [0] * len(elements)
        for e, (up, node) in enumerate(elements):
            if not holds[e]:
                continue
            parent = at[up] if e else -1
            key = (parent, node.tag, node.name or shape[e])
            if key not in place:
                place[key] = len(self.up)
                for field, value in ((self.up, parent), (self.tag, node.tag), (self.name, node.name), (self.role, node.role), (self.times, 0), (self.kids, [])):
                    field.append(value)
                if e:
                    self.kids[parent].append(place[key])
            at[e] = place[key]
            self.times[at[e]] += 1
        self.blocks = [(at[e], text, linked) for e, text, linked in blocks]

    def shape(self) -> str:
        return json.dumps([self.up, self.tag, self.name], separators=(",", ":"), ensure_ascii=False)


def _elements(root: Node) -> tuple[list[tuple[int, Node]], list[tuple[int, str, int]]]:
    """Block elements, parents first, as (parent, node), and the text blocks in
    page order as (element, text, code points in links)."""
    elements, blocks, open_text = [(-1, root)], [], [[]]

    def flush(e: int) -> None:
        parts, open_text[e] = open_text[e], []
        text = " ".join(html.unescape("".join(p for p, _ in parts)).split())
        if text:
            linked = sum(len(" ".join(html.unescape(p).split())) for p, link in parts if link)
            blocks.append((e, text, min(linked, len(text))))

    frames = [(iter(root.children), 0, False, True)]
    while frames:
        children, e, link, own = frames[-1]
        child = next(children, None)
        if child is None:
            frames.pop()
            if own:
                flush(e)
        elif isinstance(child, str):
            open_text[e].append((child, link))
        elif child.tag in VOID:
            open_text[e].append((" " if child.tag in ("br", "hr") else "", False))
        elif child.tag in INLINE and not child.role and not child.block:
            frames.append((iter(child.children), e, link or child.tag == "a", False))
        else:
            flush(e)
            elements.append((e, child))
            open_text.append([])
            frames.append((iter(child.children), len(elements) - 1, link or child.tag == "a", True))
    return elements, blocks


def _kids(up: list[int]) -> list[list[int]]:
    kids: list[list[int]] = [[] for _ in up]
    for i, parent in enumerate(up):
        if parent >= 0:
            kids[parent].append(i)
    return kids


def tree_match(a: tuple[list, list, list], b: tuple[list, list, list]) -> tuple[int, dict[int, int]]:
    """Simple tree matching of two trees (up, tag, name): the weight of the best
    mapping that keeps order and parents and joins nodes of one tag (2 a pair, 3
    if their names are equal too), and the mapping."""
    (up_a, tag_a, name_a), (up_b, tag_b, name_b) = a, b
    kids_a, kids_b = _kids(up_a), _kids(up_b)
    pairs, todo = [], [(0, 0)]
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        todo += [(i, j) for i in kids_a[x] for j in kids_b[y] if tag_a[i] == tag_b[j]]
    weight: dict[tuple[int, int], int] = {}
    chosen: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y in reversed(pairs):  # children before parents
        left, right = kids_a[x], kids_b[y]
        best = [[0] * (len(right) + 1)]
        for i in left:
            row = [0]
            for n, j in enumerate(right):
                row.append(max(best[-1][n + 1], row[n], best[-1][n] + weight.get((i, j), 0)))
            best.append(row)
        m, n, taken = len(left), len(right), []
        while m and n:
            if best[m][n] == best[m - 1][n]:
                m -= 1
            elif best[m][n] == best[m][n - 1]:
                n -= 1
            else:
                m, n = m - 1, n - 1
                taken.append((left[m], right[n]))
        weight[x, y], chosen[x, y] = 2 + (name_a[x] == name_b[y]) + best[-1][-1], taken
    mapping, todo = {}, [(0, 0)]
    while todo:
        x, y = todo.pop()
        mapping[x] = y
        todo += chosen[x, y]
    return weight[0, 0], mapping


def node_ids(shape: str, references: str, cache: dict) -> list[int]:
    """For each node of a page the node of a reference it is aligned with (as
    10^6 times the reference's number plus the node's), or a hash of its place
    below its parent's.  references: the shapes as a JSON list."""
    key = (shape, references)
    if key not in cache:
        if sum(map(len, cache.values())) > 200_000:
            cache.clear()
        own, best = json.loads(shape), (-1.0, 0, {})
        for r, reference in enumerate(json.loads(references)):
            weight, mapping = tree_match(own, json.loads(reference))
            shared = 2 * len(mapping) / (len(own[0]) + len(json.loads(reference)[0]))
            if (shared, weight) > (best[0], best[1]):
                best = (shared, weight, {x: r * 10**6 + y for x, y in mapping.items()})
        ids, seen, mapping = [], {}, best[2]
        for i, (parent, tag, name) in enumerate(zip(*own, strict=True)):
            if i in mapping:
                ids.append(mapping[i])
                continue
            place = (ids[parent], tag, name)
            seen[place] = seen.get(place, 0) + 1
            ids.append(_digest(json.dumps([*place, seen[place]])))
        cache[key] = ids
    return cache[key]


def _digest(text: str) -> int:
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "little", signed=True)


def content(page: Page, ids: list[int], known: dict[int, tuple[float, float, float]], constants: set[tuple[int, int]]) -> list[str]:
    """The content's blocks.  known: node -> mean chars, links and times over the
    host's pages that have it; constants: (node, digest) of template texts."""
    n = len(ids)
    facts = [known.get(ids[i]) or (page.chars[i], page.links[i], page.times[i]) for i in range(n)]
    template, cut = [], [0] * n
    for node, text, _ in page.blocks:
        template.append((ids[node], _digest(text)) in constants)
        cut[node] += len(text) * template[-1]
    for i in range(n - 1, 0, -1):
        cut[page.up[i]] += cut[i]
    value = [max(0.0, facts[i][0] - facts[i][1] - cut[i]) for i in range(n)]
    root, path = 0, {0}
    while page.kids[root]:
        best = max(page.kids[root], key=lambda c: (value[c] * (TIE if page.role[c] else 1), -c))
        if not value[best] or value[best] < LEADS * value[root] or facts[best][2] >= REPEATS or not page.kids[best]:
            break
        root = best
        path.add(root)
    # Below the root: lists of links, and named roles that structure does not tell apart.
    inside, out = [False] * n, [False] * n
    inside[root] = True
    for i in range(root + 1, n):
        up = page.up[i]
        inside[i] = inside[up]
        out[i] = inside[i] and (out[up] or page.role[i] or facts[i][0] > 0 and facts[i][1] >= LINKED * facts[i][0])
    kept = []
    for (node, text, _), fixed in zip(page.blocks, template, strict=True):
        title = page.tag[node] == "h1" and not page.role[node] and page.up[node] in path
        if not fixed and (inside[node] and not out[node] or title and not inside[node]):
            kept.append(text)
    return kept


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""
    host = F.coalesce(F.try_parse_url("url", F.lit("HOST")), F.col("url"), F.lit(""))
    rows = pages.select("page_id", "url", text_or_empty("html").alias("html"), host.alias("host"))
    hosts = stored(_hosts(rows), "wrapper-hosts")
    joined = split_join(rows, hosts, "host", "pages")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for b in batches:
            texts = []
            for source, references, stats, fixed in zip(b["html"], b["references"], b["stats"], b["constants"], strict=True):
                page = Page(source)
                known = {s["id"]: (s["chars"], s["links"], s["times"]) for s in stats}
                texts.append("\n\n".join(content(page, node_ids(page.shape(), references, cache), known, {(c["id"], c["digest"]) for c in fixed})))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": texts})

    schema = f"page_id {dict(pages.dtypes)['page_id']}, url {dict(pages.dtypes)['url']}, text string"
    found = joined.select("page_id", "url", "html", "references", "stats", "constants").mapInPandas(run, schema)
    return found.withColumn("n_chars", F.char_length("text").cast("long"))


def _hosts(rows: DataFrame) -> DataFrame:
    """What is learned of every host: host, pages (rows), references, stats and
    constants.  A page has a bounded number of nodes, and a host keeps nodes of a
    share RARE of its pages and texts that are constant, so these lists are small."""

    def shapes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for source in b["html"]:
                page = Page(source)
                texts = list({(node, _digest(text)) for node, text, _ in page.blocks})
                form = _digest(json.dumps([page.up, page.tag]))
                out.append((form, page.shape(), page.chars, page.links, page.times, [t[0] for t in texts], [t[1] for t in texts]))
            columns = dict(zip(("form", "shape", "chars", "links", "times", "nodes", "digests"), map(list, zip(*out, strict=True)), strict=True)) if out else {}
            yield pd.DataFrame({"host": b["host"], "page": b["page"], **columns})

    fields = "chars array<long>, links array<long>, times array<long>, nodes array<int>, digests array<long>"
    every = rows.select("host", "html", F.xxhash64("html").alias("page")).mapInPandas(shapes, f"host string, page long, form long, shape string, {fields}")
    every = stored(every, "wrapper-shapes")
    # Copies of a page count once.
    lists = F.struct("form", "shape", "chars", "links", "times", "nodes", "digests")
    single = every.groupBy("host", "page").agg(F.first(lists).alias("p"), F.count(F.lit(1)).alias("copies")).select("host", "copies", "p.*")
    single = stored(single, "wrapper-different")
    forms = single.groupBy("host", "form").agg(F.count(F.lit(1)).alias("n"), F.min("shape").alias("shape"), F.sum("copies").alias("rows"))
    forms = stored(forms, "wrapper-forms")
    totals = forms.groupBy("host").agg(F.sum("n").alias("all"), F.sum("rows").alias("pages"), F.max(F.struct("n", F.col("form")))["form"].alias("first"))
    # At most 1 / COMMON trees of a host, and its commonest one.
    common = forms.join(totals, "host").filter((F.col("n") >= COMMON * F.col("all")) | (F.col("form") == F.col("first")))
    ranked = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), (-F.col("form")).alias("f"), "shape"))), 1, REFERENCES)
    references = common.groupBy("host").agg(F.to_json(F.transform(ranked, lambda x: x["shape"])).alias("references"), F.max("all").alias("all"), F.max("pages").alias("pages"))
    references = stored(references, "wrapper-references")

    def align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache: dict = {}
        for b in batches:
            yield b.drop(columns=["shape", "references"]).assign(ids=[node_ids(s, r, cache) for s, r in zip(b["shape"], b["references"], strict=True)])

    aligned = split_join(single, references.select("host", "references", "all"), "host", "all")
    aligned = aligned.select("host", "shape", "references", "chars", "links", "times", "nodes", "digests").mapInPandas(align, f"host string, {fields}, ids array<long>")
    aligned = stored(aligned, "wrapper-aligned")
    nodes = aligned.select("host", F.explode(F.arrays_zip("ids", "chars", "links", "times")).alias("x"))
    stats = nodes.groupBy("host", F.col("x.ids").alias("id")).agg(
        F.count(F.lit(1)).alias("n"), F.avg("x.chars").alias("chars"), F.avg("x.links").alias("links"), F.avg("x.times").alias("times")
    )
    stats = stored(stats, "wrapper-nodes")
    seen = F.explode(F.transform(F.arrays_zip("nodes", "digests"), lambda x: F.struct(F.element_at("ids", x["nodes"] + 1).alias("id"), x["digests"].alias("digest")))).alias("x")
    texts = aligned.select("host", seen).groupBy("host", "x.id", "x.digest").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    shares = texts.join(stats.select("host", "id", "n"), ["host", "id"])
    p, n = F.col("k") / F.col("n"), F.col("n")
    lower = (p + 1 / (2 * n) - F.sqrt(F.greatest(p * (1 - p), F.lit(0.0)) / n + 1 / (4 * n * n))) / (1 + 1 / n)
    constants = shares.filter(lower >= CONSTANT - 1e-9).groupBy("host").agg(F.collect_list(F.struct("id", "digest")).alias("constants"))
    usual = stats.join(references.select("host", "all"), "host").filter(n >= RARE * F.col("all"))
    usual = usual.groupBy("host").agg(F.collect_list(F.struct("id", "chars", "links", "times")).alias("stats"))
    empty = F.array().cast("array<struct<id: bigint, digest: bigint>>")
    out = references.select("host", "references", "pages").join(usual, "host").join(constants, "host", "left")
    return out.withColumn("constants", F.coalesce("constants", empty))
