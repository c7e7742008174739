"""Main text of web pages by wrappers: trees of same-host pages are aligned, what stays the same is template, what varies is content."""

from __future__ import annotations

import json
import re
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WordHash, cut, shingles, table

#: Fixed lists. Elements without an end tag; whose content is no markup; that are no blocks of their own.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title iframe noembed noframes xmp".split())
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements inside which an open paragraph, list item, term, row or cell is none of the outer one's.
BARRIER = {"p": "td th table caption button object", "li": "ul ol menu", "dt": "dl", "dd": "dl", "tr": "table", "td": "table", "th": "table"}
CLOSES = {"li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th"}
#: Elements and names (parts of class, id and role) that are never main text.
ASIDE_TAGS = set("head nav footer aside menu noscript template button select dialog svg canvas object audio video".split())
ASIDE_NAMES = set(
    "nav navbar navigation menu breadcrumb breadcrumbs masthead footer sidebar aside ad ads advert adverts advertisement advertising sponsor sponsored promo banner "
    "cookie cookies consent gdpr notice notification alert popup modal overlay newsletter subscribe signup login search share sharing social comment comments respond "
    "reply replies disqus discussion related recommended recommendations widget pagination pager toolbar skip copyright disclaimer contentinfo complementary".split()
)
MAIN_NAMES = set("article main articlebody".split())
#: Parts of names that make a header one of the article's, not of the site.
OWN_HEADER = set("article content entry page post story title".split())
#: Elements of which neighbours are one in a shape; of others, only runs of more than RUN are.
REPEATED, RUN = set("# p li dt dd option h2 h3 h4 h5 h6 blockquote pre".split()), 3
#: Elements that hold others; a root of the main text is looked for among these.
HOLDS = set("html body div main article section center table tbody tr td form".split())
#: Elements deeper than this are joined with the one at this depth; children of a shape, neighbours of one label as one.
DEEPEST, WIDEST = 150, 64
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*"|'[^']*'|["'])*+)(?:>|\Z)""", re.S)
NAMED = re.compile(r"""(?:^|\s)(class|id|role|itemprop|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
HIDDEN = re.compile(r"display\s*:\s*none", re.I)


class Node:
    """An element, or (tag `#`) a block's text; linked counts its characters in links."""

    __slots__ = ("tag", "label", "aside", "kids", "text", "linked")

    def __init__(self, tag: str, label: str, aside: bool = False):
        self.tag, self.label, self.aside, self.kids, self.text, self.linked = tag, label, aside, [], "", 0


@lru_cache(maxsize=20000)
def described(tag: str, attributes: str) -> tuple[str, bool, bool]:
    """(label, whether it is never main text, whether it is a header) of an element: its tag and the words of its class, id
    and role."""
    aside, names = tag in ASIDE_TAGS, []
    for name, value in NAMED.findall(attributes):
        name, value = name.lower(), unescape(value.strip("\"'"))
        if name == "style":
            aside |= bool(HIDDEN.search(value))
        elif name in ("hidden", "aria-hidden"):
            aside |= name == "hidden" or value.lower() == "true"
        else:
            names += value.split()
    parts = [[p.lower() for p in PART.findall(n)] for n in names]
    if tag not in ("html", "body", "main", "article"):
        aside |= any(ASIDE_NAMES.intersection(p) and not {"with", "has", "no", "without"}.intersection(p) for p in parts)
    header = tag == "header" or any("header" in p and not OWN_HEADER.intersection(p) for p in parts)
    return " ".join([tag, *sorted({"-".join(p) for p in parts if p})]), aside, header


class Builder:
    """A page's tree of blocks. Unclosed elements end where a following one or the end of the page ends them."""

    def __init__(self):
        self.root = Node("html", "html")
        self.stack, self.deeper = [self.root], 0
        self.buffer, self.linked, self.links = [], 0, 0

    def words(self, text: str) -> None:
        if text:
            text = unescape(text) if "&" in text else text
            self.buffer.append(text)
            if self.links:
                self.linked += len(text.strip())

    def flush(self) -> None:
        text = " ".join("".join(self.buffer).split())
        if text:
            leaf = Node("#", "#")
            leaf.text, leaf.linked = text, min(self.linked, len(text))
            self.stack[-1].kids.append(leaf)
        self.buffer, self.linked = [], 0

    def close(self, tags: set[str], barrier: set[str]) -> None:
        for k in range(len(self.stack) - 1, 0, -1):
            if self.stack[k].tag in tags:
                self.flush()
                del self.stack[k:]
                self.links = 0
                return
            if self.stack[k].tag in barrier:
                return

    def start(self, tag: str, attributes: str) -> None:
        if tag in ("br", "hr"):
            self.buffer.append(" ")
            return
        if tag in VOID:
            return
        label, aside, header = described(tag, attributes)
        if tag == "a":
            self.links = 1
        if (tag in INLINE) and not aside:
            return
        self.flush()
        if tag not in INLINE:
            self.close({"p"}, set(BARRIER["p"].split()))
        if tag in CLOSES:
            self.close(set(CLOSES[tag].split()), set(BARRIER[tag].split()))
        if tag in ("html", "body") and any(n.tag == tag for n in self.stack[: 2 if tag == "html" else None]):
            return
        if len(self.stack) >= DEEPEST:
            self.deeper += 1
            return
        if header and tag not in ("html", "body", "main", "article"):
            aside = aside or not any(n.tag in ("article", "main") for n in self.stack)
        node = Node(tag, label, aside)
        self.stack[-1].kids.append(node)
        self.stack.append(node)

    def end(self, tag: str) -> None:
        if tag == "a":
            self.links = 0
        if tag in INLINE and not any(n.tag == tag for n in self.stack):
            return
        if self.deeper and tag not in INLINE and tag != "p":
            self.flush()
            self.deeper -= 1
        elif tag not in ("html", "body"):
            self.close({tag}, set(BARRIER.get(tag, "").split()))


@lru_cache(maxsize=64)
def ending(tag: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(tag)}(?=[\s/>])[^>]*>?", re.I)


def parse(html: str) -> Node:
    """The tree of a page's blocks; character references are decoded, white space in a block is one space."""
    b, at = Builder(), 0
    while (m := TOKEN.search(html, at)) is not None:
        b.words(html[at : m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            b.end(tag)
        elif tag in RAW:
            stop = ending(tag).search(html, at)
            at = stop.end() if stop else len(html)
        else:
            b.start(tag, m[3])
    b.words(html[at:])
    b.flush()
    return b.root


# A shape is (label, shapes of the children). Runs of neighbours with the same label may be one; its label ends with `*`.


def plain(label: str) -> str:
    return label.removesuffix("*")


def union(a: tuple, b: tuple) -> tuple:
    """A shape that both fit into, in order of their children; where they differ, those of a come first."""
    if a[1] == b[1] or not b[1]:
        return a
    if not a[1]:
        return a[0], b[1]
    out, i0, j0 = [], 0, 0
    for i, j in [*matched(a[1], b[1]), (len(a[1]), len(b[1]))]:
        out += [*a[1][i0:i], *b[1][j0:j]]
        if i < len(a[1]):
            both = union(a[1][i], b[1][j])
            out.append((max(a[1][i][0], b[1][j][0], key=len), both[1]))
        i0, j0 = i + 1, j + 1
    return a[0], folded(out)


def merged(run: list[tuple]) -> tuple:
    """The union of neighbours as one."""
    one = run[0]
    for s in run[1:]:
        one = union(one, s)
    return plain(one[0]) + "*", one[1]


def folded(shapes: list[tuple]) -> tuple:
    """Neighbours with one label as one, where these are elements that repeat, or more than RUN; where more than WIDEST are left,
    all with one label."""
    runs: list[list[tuple]] = []
    for s in shapes:
        if runs and plain(runs[-1][0][0]) == plain(s[0]):
            runs[-1].append(s)
        else:
            runs.append([s])
    out: list[tuple] = []
    for run in runs:
        repeats = run[0][0].split()[0].removesuffix("*") in REPEATED or any(s[0].endswith("*") for s in run)
        out += [merged(run)] if repeats or len(run) > RUN else run
    if len(out) <= WIDEST:
        return tuple(out)
    of: dict[str, list] = {}
    for s in out:
        of.setdefault(plain(s[0]), []).append(s)
    return tuple(merged(run) for run in of.values())


def shape_of(node: Node) -> tuple:
    return node.label, folded([shape_of(k) for k in node.kids])


def matched(a: tuple, b: tuple) -> list[tuple[int, int]]:
    """Pairs (i, j) of children, in order, with the greatest sum of simple tree matching."""
    best = np.zeros((len(a) + 1, len(b) + 1), np.int64)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            g = tree_matching(a[i - 1], b[j - 1])
            best[i, j] = max(best[i - 1, j], best[i, j - 1], best[i - 1, j - 1] + g if g else 0)
    pairs, i, j = [], len(a), len(b)
    while i and j:
        if best[i, j] == best[i - 1, j]:
            i -= 1
        elif best[i, j] == best[i, j - 1]:
            j -= 1
        else:
            i, j = i - 1, j - 1
            pairs.append((i, j))
    return pairs[::-1]


@lru_cache(maxsize=50000)
def tree_matching(a: tuple, b: tuple) -> int:
    """Nodes of the largest matching of two shapes that keeps labels, parents and order."""
    if plain(a[0]) != plain(b[0]):
        return 0
    if a[1] == b[1]:
        return 1 + sum(tree_matching(k, k) for k in a[1])
    return 1 + sum(tree_matching(a[1][i], b[1][j]) for i, j in matched(a[1], b[1]))


@lru_cache(maxsize=5000)
def aligned(shape: tuple, wrapper: tuple, slot: str = "0") -> tuple:
    """(slot, those of the children) for a shape: nodes that match the wrapper's have its places (0.2.1), others the labels
    below the last one that does (0.2+div+p)."""
    partner = dict(matched(shape[1], wrapper[1]))
    return slot, tuple(aligned(k, wrapper[1][partner[i]], f"{slot}.{partner[i]}") if i in partner else added(k, slot) for i, k in enumerate(shape[1]))


def added(shape: tuple, slot: str) -> tuple:
    slot = f"{slot}+{plain(shape[0])}"
    return slot, tuple(added(k, slot) for k in shape[1])


def size_of(node: Node) -> int:
    return len(node.text) + sum(map(size_of, node.kids))


def holds_main(node: Node) -> bool:
    return any(k.tag in ("article", "main", "h1") or holds_main(k) for k in node.kids)


def blocks_of(page: Node, wrapper: tuple | None) -> list[tuple[str, Node]]:
    """(slot, text) of the blocks that may be main text, in page order. An element whose name speaks against it stays where
    it holds most of the page and an article, a main part or a first heading; a form counts only then."""
    shape, whole, out = shape_of(page), size_of(page), []

    def walk(node: Node, shape: tuple, slots: tuple) -> None:
        if node.tag == "#":
            out.append((slots[0], node))
            return
        if (node.aside and node.tag not in ASIDE_TAGS or node.tag == "form") and not (2 * size_of(node) > whole and holds_main(node)) or node.tag in ASIDE_TAGS:
            return
        j, n = 0, len(shape[1])
        for k in node.kids:
            at = next((i for i in (*range(j, n), *range(j)) if plain(shape[1][i][0]) == k.label), None)
            if at is None:
                own = shape_of(k)
                walk(k, own, added(own, slots[0]))
            else:
                j = at if shape[1][at][0].endswith("*") else at + 1
                walk(k, shape[1][at], slots[1][at])

    walk(page, shape, aligned(shape, wrapper or shape))
    return out


def slot_texts(blocks: list[tuple[str, Node]]) -> dict[str, list]:
    """slot -> [its whole text on the page, characters, characters in links]."""
    found: dict[str, list] = {}
    for slot, leaf in blocks:
        f = found.setdefault(slot, [[], 0, 0])
        f[0].append(leaf.text)
        f[1] += len(leaf.text)
        f[2] += leaf.linked
    return {slot: ["\n".join(t), n, k] for slot, (t, n, k) in found.items()}


def signed(text: str) -> int:
    h = xxhash.xxh64_intdigest(text)
    return h - (1 << 64) if h >> 63 else h


def root_of(wrapper: tuple, masses: dict[str, int]) -> str:
    """The slot below which the main text stands: an article or main part that holds three tenths of what varies, or else,
    from the page down, the element that holds nine tenths of it and every first heading."""
    total = sum(masses.values())

    def mass(slot: str) -> int:
        return sum(n for s, n in masses.items() if s == slot or s.startswith((slot + ".", slot + "+")))

    def headed(shape: tuple) -> bool:
        return plain(shape[0].split()[0]) == "h1" or any(map(headed, shape[1]))

    def named(shape: tuple, slot: str):
        if MAIN_NAMES.intersection(plain(shape[0]).split()) and 10 * mass(slot) >= 3 * total:
            yield slot
            return
        for j, k in enumerate(shape[1]):
            yield from named(k, f"{slot}.{j}")

    if total and len(found := list(named(wrapper, "0"))) == 1:
        return found[0]
    shape, slot = wrapper, "0"
    while total:
        for j, k in enumerate(shape[1]):
            if plain(k[0]).split()[0] in HOLDS and 10 * mass(f"{slot}.{j}") >= 9 * total and (headed(k) or not headed(shape)):
                shape, slot = k, f"{slot}.{j}"
                break
        else:
            break
    return slot


class Wrapper:
    """What a host's pages have in common: their shape, slots full of links, constant texts, and the root of the main text."""

    def __init__(self, text: str | None):
        d = json.loads(text) if text else {}
        tuples = lambda s: (s[0], tuple(map(tuples, s[1])))
        self.shape = tuples(d["shape"]) if "shape" in d else None
        stats = d.get("slots", [])
        self.linked = {s for s, n, links in stats if 2 * links > n}
        self.constant = {tuple(x) for x in d.get("constant", [])}
        masses: dict[str, int] = {}
        for s, n, _ in stats:
            if s not in self.linked:
                masses[s] = masses.get(s, 0) + n
        self.root = root_of(self.shape, masses) if self.shape else "0"

    def main_text(self, html: str) -> str:
        blocks = blocks_of(parse(html), self.shape)
        same = {slot for slot, (text, _, _) in slot_texts(blocks).items() if (slot, signed(text)) in self.constant}
        inside = lambda s: s.startswith((self.root + ".", self.root + "+")) or s == self.root
        rooted = [(slot, leaf) for slot, leaf in blocks if inside(slot)] or blocks
        return " ".join(leaf.text for slot, leaf in rooted if slot not in self.linked and slot not in same)


@lru_cache(maxsize=256)
def wrapper_of(text: str | None) -> Wrapper:
    return Wrapper(text)


def host(url):
    """Lower-case host of an address, empty where it has none."""
    return F.lower(F.regexp_extract(F.coalesce(url, F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))


#: Bytes of wrappers up to which they are broadcast; copies of each of them for a join by shuffle.
BROADCAST_BYTES, SALTS = 64 << 20, 16


def with_wrapper(pages: DataFrame, wrappers: DataFrame) -> DataFrame:
    """pages (with grp) and the wrapper of their group: by broadcast if all wrappers are small, else by a salted join."""
    if (wrappers.agg(F.sum(F.octet_length("wrapper") + 64)).first()[0] or 0) <= BROADCAST_BYTES:
        return pages.join(F.broadcast(wrappers), "grp", "left")
    copies = wrappers.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return pages.withColumn("salt", F.pmod(F.xxhash64("page_id", "html"), F.lit(SALTS)).cast("int")).join(copies, ["grp", "salt"], "left").drop("salt")


def mapped(pages: DataFrame, run, schema: str, fields: list[pa.Field]) -> DataFrame:
    """run(row values) -> rows, for every row of pages; a batch at a time, rows of the results sent on with it."""

    def batches(parts):
        for b in parts:
            rows = [r for values in zip(*(c.to_pylist() for c in b.columns)) for r in run(*values)]
            columns = list(zip(*rows)) or [[] for _ in fields]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields)], schema=pa.schema(fields))

    return pages.mapInArrow(batches, schema)


def shapes(pages: DataFrame) -> DataFrame:
    """(grp, shape) of the pages (page_id, grp, html), each page's shape as JSON."""
    run = lambda grp, html: [(grp, json.dumps(shape_of(parse(html))))]
    return mapped(pages.select("grp", "html"), run, "grp string, shape string", [pa.field("grp", pa.string()), pa.field("shape", pa.string())])


FACTS = "grp string, slot string, text long, sketch long, chars long, linked long"


def slot_facts(pages: DataFrame, frames: DataFrame) -> DataFrame:
    """FACTS: each slot of each page with the hash of its text, its characters, and the page's sketch: the least hash of
    three words of its longest slot, which copies of an article, near ones too, have in common."""
    kinds = [pa.string(), pa.string(), *[pa.int64()] * 4]
    fields = [pa.field(x.split()[0], k) for x, k in zip(FACTS.split(", "), kinds)]
    hashes = WordHash()

    def run(grp, html, wrapper):
        found = slot_texts(blocks_of(parse(html), wrapper_of(wrapper).shape))
        longest = max(found.items(), key=lambda f: (f[1][1] - f[1][2], f[0]))[1][0] if found else ""
        sketch = shingles(longest, hashes, 3)
        sketch = int(sketch.min().astype(np.int64)) if len(sketch) else 0
        return [(grp, slot, signed(text), sketch, n, links) for slot, (text, n, links) in found.items()]

    return mapped(with_wrapper(pages, frames).select("grp", "html", "wrapper"), run, FACTS, fields)


def induce(pages: DataFrame, share: float = 0.5, least: int = 4) -> DataFrame:
    """(grp, wrapper): one wrapper for each group of pages (page_id, grp, html), as JSON.

    The wrapper's shape is the most frequent one of the group (ties: the shortest, then the least). All pages are aligned
    with it by simple tree matching. A slot's text is constant where it stands in that slot on `share` of the group's
    articles, and on `least` of them; copies of one article count once. What varies is summed up by slot.

    Counts and sums are partial aggregates by group and slot, so a host with a third of all pages is no larger a row than
    another; a wrapper has a row's size: the slots of one host.
    """
    counts = shapes(pages).groupBy("grp", "shape").agg(F.count("*").alias("n"))
    frames = counts.groupBy("grp").agg(F.min_by("shape", F.struct(-F.col("n"), F.length("shape"), "shape")).alias("shape"))
    frames = cut(frames, "shapes")
    facts = cut(slot_facts(pages, frames.select("grp", F.concat(F.lit('{"shape":'), "shape", F.lit("}")).alias("wrapper"))), "slots")
    articles = facts.groupBy("grp").agg(F.count_distinct("sketch").alias("articles"))
    repeated = facts.groupBy("grp", "slot", "text").agg(F.count_distinct("sketch").alias("n")).filter(F.col("n") >= least)
    constant = cut(repeated.join(articles, "grp").filter(F.col("n") >= F.col("articles") * share).select("grp", "slot", "text"), "constant")
    varying = facts.join(constant, ["grp", "slot", "text"], "left_anti").groupBy("grp", "slot").agg(F.sum("chars").alias("n"), F.sum("linked").alias("l"))
    same = constant.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("slot", "text"))).alias("constant"))
    slots = varying.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("slot", "n", "l"))).alias("slots"))
    d = frames.join(same, "grp", "left").join(slots, "grp", "left")
    fields = [pa.field("grp", pa.string()), pa.field("wrapper", pa.string())]

    def packed(grp, shape, constant, slots):
        rows = lambda x: [list(r.values()) for r in x or []]
        return [(grp, json.dumps({"shape": json.loads(shape), "constant": rows(constant), "slots": rows(slots)}))]

    return mapped(d.select("grp", "shape", "constant", "slots"), packed, "grp string, wrapper string", fields)


def main_text(pages: DataFrame, least: int = 4) -> DataFrame:
    """(page_id, url, text) of every row of pages (page_id, url, html): the article, blocks in page order joined by one space.

    Wrappers are made for each host with `least` pages or more; pages of all other hosts, and those whose address is null
    or has no host, share one. Null and empty html give an empty text. Repeated rows are answered each and null ids stay
    null; an empty table gives an empty one; other columns play no part. Pages are whole, however long: a task holds one
    batch of them.
    """
    p = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host(F.col("url")).alias("grp"))
    many = cut(p.groupBy("grp").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("grp", F.lit("").alias("wrapper")), "hosts")
    p = with_wrapper(p, many)
    p = p.withColumn("grp", F.when(F.col("wrapper").isNotNull(), F.col("grp")).otherwise("")).drop("wrapper")
    wrappers = cut(induce(p, least=least), "wrappers")
    kind = pages.schema["page_id"].dataType.simpleString()
    read = with_wrapper(p, wrappers).select("page_id", "url", "html", "wrapper")

    def run(batches):
        for b in batches:
            texts = [wrapper_of(w).main_text(h) for h, w in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["page_id", "url", "text"])

    return read.mapInArrow(run, f"page_id {kind}, url string, text string")


def op13_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The article of every page."""
    return main_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).withColumn("n_chars", F.length("text").cast("long"))
