"""Main text of web pages by wrapper induction.

A few pages of each host are its references. Each page of the host is aligned with them by simple tree matching and
belongs to the one that fits it best, so a host may have several layouts. Over all pages of a layout, Spark counts
for each aligned place how much text it holds, how much of it in links, and how often each text comes. A text that
nearly all pages have in a place is template; from the rest the wrapper is induced: the region of the tree that holds
most of the varying text that isn't links, without the places in it that are mostly links. Element and class names
only decide about what holds little of the region, and where no place holds most of the text. What the wrapper's
places hold in a page is its main text.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch_path, written
from .html_tree import ARTICLE, FLOW, REMARKS, Matcher, Node, Slot, Text, read, slots
from .quality import let

#: Reference pages of a host, drawn by hash: so many layouts can be told apart.
REFERENCES = 3
#: Share of a layout's pages that have a text in a place, from which it is template; two pages at least.
TEMPLATE_SHARE = 0.8
#: Share of a place's varying text from which one of its children holds the region.
REGION_SHARE = 0.6
#: Share of the region from which a place's name can't rule it out, and weight of a named place when the region is sought.
NAMED_SHARE = 0.5
NAMED_WEIGHT = 0.1
#: Share of a place's text in links from which it is a menu, outside of an article element and of running text.
LINK_SHARE = 0.7
HEADINGS = frozenset(["h1", "h2"])
#: Bytes of reference pages, or of wrappers, up to which they are broadcast; beyond, pages are dealt by host and salt.
BROADCAST_BYTES = 64 << 20
SALTS = 64
#: Hosts whose reference trees a worker keeps, and pairs of tree shapes whose weight it keeps.
KEPT_HOSTS = 300
KEPT_PAIRS = 200_000

BLOCK = "struct<slot:int,key:long,chars:int,links:int,aside:boolean,own:boolean,text:string>"
ALIGNED = f"page_id long, url string, host string, layout int, slots array<int>, blocks array<{BLOCK}>"


def key(text: str) -> int:
    """64 bits of a text."""
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def wrapper(order: list[Slot], plain: dict[int, int], linked: dict[int, int]) -> tuple[set[int], set[int]]:
    """The places of a tree, as numbers in ``order``, that hold the main text, and the roots of its region.

    ``plain`` and ``linked``: characters of varying text outside and inside of links that a place itself holds.
    """
    number = {id(s): i for i, s in enumerate(order)}
    below, links, sought = ([d.get(i, 0) for i in range(len(order))] for d in (plain, linked, plain))
    for i in range(len(order) - 1, -1, -1):  # children come after their parents
        for child in order[i].children:
            k = number[id(child)]
            below[i] += below[k]
            links[i] += links[k]
            sought[i] += sought[k]
        if order[i].boiler and order[i].tag not in ("body", "html"):
            sought[i] *= NAMED_WEIGHT
    path, chosen = [0], []
    while not chosen:
        at = path[-1]
        inner = [number[id(c)] for c in order[at].children if c.children or c.tag in ARTICLE]
        best = max(inner, key=lambda k: sought[k], default=None)
        whole = plain.get(at, 0) + sum([sought[number[id(c)]] for c in order[at].children])
        if order[at].tag == "article":
            chosen = [at]
        elif best is not None and sought[best] and sought[best] >= REGION_SHARE * whole:
            path.append(best)
        else:
            chosen = [at] if order[at].tag in ARTICLE else articles(order, number, at) or [at]
    # headings beside the path to the region belong to it
    heads = [k for at in path[:-1] for c in order[at].children if c.tag in HEADINGS and not c.boiler and below[k := number[id(c)]]]
    total = sum([below[k] for k in chosen])
    out, waiting = set(heads), [(k, order[k].tag in ARTICLE) for k in chosen]
    while waiting:
        at, article = waiting.pop()
        slot, article = order[at], article or order[at].tag in ARTICLE
        menu = links[at] and links[at] >= LINK_SHARE * (links[at] + below[at]) and not article and slot.tag not in FLOW
        if at not in chosen and ((menu or slot.boiler) and below[at] < NAMED_SHARE * total or remarks(slot) and below[at] < total):
            continue
        out.add(at)
        waiting += [(number[id(c)], article) for c in slot.children]
    return out, set(chosen)


def remarks(slot: Slot) -> bool:
    """Whether a place is a run of readers' comments: so named, and repeated or of repeated parts."""
    named = slot.boiler and any(part in REMARKS for n in slot.names for part in n.replace("_", "-").split("-"))
    return named and (len(slot.nodes) > 1 or any(len(c.nodes) > 1 for c in slot.children))


def articles(order: list[Slot], number: dict[int, int], top: int) -> list[int]:
    """The outermost article or main elements below a place."""
    found, waiting = [], [order[top]]
    while waiting:
        slot = waiting.pop()
        if slot.tag in ARTICLE:
            found.append(number[id(slot)])
        elif not slot.boiler:
            waiting += slot.children
    return found


def own_chars(order: list[Slot]) -> tuple[dict[int, int], dict[int, int]]:
    """Characters outside and inside of links that each place of one page holds."""
    plain, linked = {}, {}
    for i, slot in enumerate(order):
        held = [x for n in slot.nodes for x in n.items if isinstance(x, Text)]
        linked[i] = sum([x.links for x in held])
        plain[i] = sum([len(x.text) for x in held]) - linked[i]
    return plain, linked


class Aligner:
    """Aligns pages with their hosts' references."""

    def __init__(self) -> None:
        self.hosts: dict[str, list[list[Slot]]] = {}
        self.matcher = Matcher()

    def references(self, host: str, pages: list[str]) -> list[list[Slot]]:
        if host not in self.hosts:
            if len(self.hosts) >= KEPT_HOSTS:
                self.hosts.clear()
            self.hosts[host] = [slots(read(x)) for x in pages]
        return self.hosts[host]

    def align(self, page: str, references: list[list[Slot]]) -> tuple[int, list[int], list[tuple]]:
        """The layout (the best reference's place), the reference's slots that the page has, and the page's blocks.

        A block's slot is that of its node, or of the nearest node around it that is aligned. ``aside``: a node
        between the two is named as no part of an article and holds little of the page. ``own``: the page by itself
        has the block in its region.
        """
        tree, matcher = read(page), self.matcher
        order = slots(tree)
        if len(matcher.known) > KEPT_PAIRS:
            matcher.known.clear()
        likeness = [2 * matcher.weight(order[0], x[0]) / (len(order) + len(x)) for x in references]
        layout = max(range(len(references)), key=lambda k: likeness[k])
        number = {id(s): i for i, s in enumerate(references[layout])}
        place = {id(n): number[id(b)] for a, b in matcher.match(order[0], references[layout][0]) for n in a.nodes}
        plain, linked = own_chars(order)
        region, _ = wrapper(order, plain, linked)
        mine = {id(n) for i in region for n in order[i].nodes}
        small = self.chars_below(order, plain)
        blocks: list[tuple] = []
        waiting: list = [(tree, 0, False)]
        while waiting:  # in page order
            x, slot, aside = waiting.pop()
            if id(x) in place:
                slot, aside = place[id(x)], False
            elif x.boiler and small[id(x)] < NAMED_SHARE * small[id(tree)]:
                aside = True
            held: list = []
            for y in x.items:
                held.append((slot, key(y.text), len(y.text), y.links, aside, id(x) in mine, y.text) if isinstance(y, Text) else (y, slot, aside))
            waiting += reversed(held)
            while waiting and len(waiting[-1]) == 7:
                blocks.append(waiting.pop())
        return layout, sorted(set(place.values())), blocks

    @staticmethod
    def chars_below(order: list[Slot], plain: dict[int, int]) -> dict[int, int]:
        """Characters outside of links in each node's subtree, those of a run of like siblings together."""
        total = dict(plain)
        number = {id(s): i for i, s in enumerate(order)}
        for i in range(len(order) - 1, -1, -1):
            total[i] += sum([total[number[id(c)]] for c in order[i].children])
        return {id(n): total[i] for i, s in enumerate(order) for n in s.nodes}


_aligners: dict[str, Aligner] = {}


def by_host(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, host``; the host of a url in lower case, '' where there is none."""
    host = F.coalesce(F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))
    return pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"), host.alias("host"))


def reference_pages(rows: DataFrame) -> DataFrame:
    """``host, pages``: the pages of each host with the smallest hashes of a few salts."""
    hashed = F.xxhash64("url", "html")
    full = rows.where("html <> ''").select("host", "html", hashed.alias("_h"), F.pmod(hashed, F.lit(REFERENCES)).alias("_salt"))
    drawn = full.groupBy("host", "_salt").agg(F.min_by("html", F.struct("_h", "html")).alias("html"))
    return written(drawn.groupBy("host").agg(F.sort_array(F.collect_list("html")).alias("pages")), "reference-pages")


def beside(rows: DataFrame, small: DataFrame, on: list[str], size: int) -> DataFrame:
    """Each row beside what is known of its host: broadcast if that is small, else joined by host and salt, so no host is one task's work."""
    if size <= BROADCAST_BYTES:
        return rows.join(F.broadcast(small), on, "left")
    salted = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*on, "_salt"], "left").drop("_salt")


def aligned(rows: DataFrame, references: DataFrame) -> DataFrame:
    """Every page's blocks with their places in its layout, written once: pages are parsed only here."""
    size = references.agg(F.sum(F.aggregate("pages", F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x)))).first()[0] or 0
    token = uuid.uuid4().hex  # references of another call aren't these

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if token not in _aligners:
            _aligners.clear()
            _aligners[token] = Aligner()
        aligner = _aligners[token]
        for batch in batches:
            for part in (batch.slice(i, 1000) for i in range(0, batch.num_rows, 1000)):
                made = []
                for k, (host, page) in enumerate(zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True)):
                    known = aligner.hosts.get(host) or (aligner.references(host, part.column("pages")[k].as_py()) if page else None)
                    made.append(aligner.align(page, known) if page else (0, [], []))
                columns = zip(*[x for m in made for x in m[2]], strict=True) if any(m[2] for m in made) else [[]] * 7
                kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.string())
                names = ("slot", "key", "chars", "links", "aside", "own", "text")
                flat = pa.StructArray.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds, strict=True)], names)
                ends = [0]
                for m in made:
                    ends.append(ends[-1] + len(m[2]))
                yield pa.RecordBatch.from_arrays(
                    [
                        *(part.column(c) for c in ("page_id", "url", "host")),
                        pa.array([m[0] for m in made], pa.int32()),
                        pa.array([m[1] for m in made], pa.list_(pa.int32())),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat),
                    ],
                    ["page_id", "url", "host", "layout", "slots", "blocks"],
                )

    made = beside(rows, references, ["host"], size).select("page_id", "url", "html", "host", "pages").mapInArrow(run, ALIGNED)
    path = scratch_path(rows.sparkSession, "aligned-pages")
    made.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.schema(made.schema).parquet(path)


def wrappers(pages: DataFrame, references: DataFrame) -> DataFrame:
    """``host, layout, places, roots, template``: the wrapper of each layout from all its pages.

    All is counted by Spark: pages by place, and pages, characters and characters in links by place and text. What is
    gathered in one row is as large as one reference page: its places, and the texts that most pages have in them.
    """
    layout = ["host", "layout"]
    held = pages.select(*layout, F.explode("slots").alias("slot")).groupBy(*layout, "slot").agg(F.count("*").alias("pages"))
    own = F.array_distinct(F.transform("blocks", lambda b: F.struct(b["slot"].alias("slot"), b["key"].alias("key"), b["chars"].alias("chars"), b["links"].alias("links"))))
    texts = pages.select(*layout, F.explode(own).alias("b")).groupBy(*layout, "b.slot", "b.key").agg(F.count("*").alias("n"), F.sum("b.chars").alias("chars"), F.sum("b.links").alias("links"))
    counted = written(texts, "text-counts")
    # only texts that come twice are looked up by place: the rest, most of a large host's, need no join
    fixed = written(
        counted.where("n >= 2").join(held, [*layout, "slot"]).where(F.col("n") >= TEMPLATE_SHARE * F.col("pages")).select(*layout, "slot", "key", "chars", "links"), "fixed-texts"
    )
    signed = counted.select(*layout, "slot", "chars", "links").union(fixed.select(*layout, "slot", -F.col("chars"), -F.col("links")))
    varying = signed.groupBy(*layout, "slot").agg(F.sum(F.col("chars") - F.col("links")).alias("plain"), F.sum("links").alias("linked")).where("plain > 0 or linked > 0")
    fixed = fixed.groupBy(*layout).agg(F.collect_list(F.struct("slot", "key")).alias("template"))
    stats = varying.groupBy(*layout).agg(F.collect_list(F.struct("slot", "plain", "linked")).alias("stats"))

    def induced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places, roots = [], []
            for page, found in zip(batch.column("page").to_pylist(), batch.column("stats").to_pylist(), strict=True):
                one = wrapper(slots(read(page)), {x["slot"]: x["plain"] for x in found}, {x["slot"]: x["linked"] for x in found})
                places.append(sorted(one[0]))
                roots.append(sorted(one[1]))
            lists = pa.list_(pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("host"), batch.column("layout"), pa.array(places, lists), pa.array(roots, lists)], [*layout, "places", "roots"])

    page = stats.join(references, "host").select(*layout, F.get("pages", F.col("layout")).alias("page"), "stats")
    made = page.mapInArrow(induced, "host string, layout int, places array<int>, roots array<int>")
    return written(made.join(fixed, layout, "left"), "wrappers")


def main_text() -> Column:
    """The text of a page beside its layout's wrapper.

    A page most of whose main text is template is a copy of others and keeps it. A page without the wrapper's
    region is of no layout that the references have; its own region counts.
    """
    chars = lambda blocks: F.aggregate(blocks, F.lit(0), lambda a, b: a + b["chars"])
    inside = F.filter("blocks", lambda b: F.array_contains("places", b["slot"]) & ~b["aside"])
    constant = lambda b: F.exists("template", lambda t: (t["slot"] == b["slot"]) & (t["key"] == b["key"]))

    def without_template(found: Column) -> Column:
        kept = F.filter(found, lambda b: ~constant(b))
        return F.when(F.col("template").isNull(), found).otherwise(let(kept, lambda k: F.when(2 * chars(k) >= chars(found), k).otherwise(found)))

    own = F.filter("blocks", lambda b: b["own"] & ~b["aside"])
    chosen = F.when(F.arrays_overlap("slots", "roots"), let(inside, without_template)).otherwise(own)
    return F.array_join(F.transform(chosen, lambda b: b["text"]), "\n")


def extract(pages: DataFrame) -> DataFrame:
    """``page_id, url, text``: the main text of every page, an empty one if there is none.

    Character references are decoded, white space inside a block is one space. Null or empty html: empty text. Null
    url: pages of the host ''. Null ids and repeated rows: rows of their own. A host with one page: its own text
    alone tells where its article is. Very long or deeply nested pages: as they are, nothing is cut. Broken markup is
    read as far as it goes. Columns beside page_id, url and html aren't read. Empty table: no rows.
    """
    rows = by_host(pages)
    references = reference_pages(rows)
    placed = aligned(rows, references)
    learned = wrappers(placed, references)
    size = learned.agg(F.sum(F.length("host") + 8 * F.size("places") + 16 * F.size(F.coalesce("template", F.array())))).first()[0] or 0
    return beside(placed, learned, ["host", "layout"], size).select("page_id", "url", F.coalesce(main_text(), F.lit("")).alias("text"))
