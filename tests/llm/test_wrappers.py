import random
from collections import Counter

import pytest

from photolake.llm import html_tree, wrappers
from photolake.llm.html_tree import read, slots

PAGE = """<!DOCTYPE html><html lang="en"><head><title>T {n}</title><style>p{{margin:0}}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/a">menu {n}</a></li></ul></nav><header class="site-header">Site</header><!-- c --><div class="ad">buy {n}</div>
<article><h1>Head &amp; {n}</h1><p><b>First {n}<br><p>two {n} &lt;b&gt;\n  more&nbsp;x</p><p>Read our terms of use.</p>
<div class="comments"><p>nice {n}</p></div><form><p>mail</p></form></article>
<aside>other {n}</aside><div id="cookie-notice">cookies</div><footer>&copy; f{n}</footer></body></html>"""


def want(n):
    return f"Head & {n}\nFirst {n}\ntwo {n} <b> more x"


@pytest.fixture
def make_pages(spark):
    def make(rows):
        return spark.createDataFrame([(*r, "x", "y") for r in rows], "page_id long, url string, html string, host string, text string")

    return make


def texts(df):
    return {r.page_id: r.text for r in df.collect()}


def test_article_without_template(make_pages):
    rows = [(i, f"http://a.example.com/{i}", PAGE.format(n=i)) for i in range(8)]
    assert texts(wrappers.extract(make_pages(rows))) == {i: want(i) for i in range(8)}


def test_a_notice_goes_from_two_pages_on(make_pages):
    rows = [(i, "http://a.example.com/", PAGE.format(n=i)) for i in range(2)]
    assert texts(wrappers.extract(make_pages(rows))) == {i: want(i) for i in range(2)}
    alone = texts(wrappers.extract(make_pages(rows[:1])))[0]
    assert alone == want(0) + "\nRead our terms of use."  # nothing tells that it is no part of the only article


def test_running_text_of_an_article_stays(make_pages):
    """Names and links rule out no paragraph, quote or list of an article, and comments no page that has no article element."""
    inside = "<p class='social-history'>A history of {n}.</p><blockquote class='related-quote'>Quoted {n}</blockquote><p>See <a href='/x'>a very long link that is most of it {n}</a> ok</p><ul><li><a href='/y'>first {n}</a></li><li><a href='/z'>second {n}</a></li></ul><p>End {n}.</p>"
    rows = [(i, f"http://a.example.com/{i}", f"<body><nav><a href='/'>home</a></nav><article><h1>Head {i}</h1>{inside.format(n=i)}<div class='ad-box'>buy</div></article></body>") for i in range(6)]
    got = texts(wrappers.extract(make_pages(rows)))
    assert got == {i: f"Head {i}\nA history of {i}.\nQuoted {i}\nSee a very long link that is most of it {i} ok\nfirst {i}\nsecond {i}\nEnd {i}." for i in range(6)}
    body = lambda i: "".join(f"<p>Paragraph {k} of text {i} with its own words.</p>" for k in range(4))
    said = lambda i: "".join(f"<div class='comment'><p>Reader {k} of {i} says so and so, at length, and so on and on.</p></div>" for k in range(10))
    rows = [(i, f"http://b.example.com/{i}", f"<body><div class='post'><h1>Head {i}</h1>{body(i)}</div><div class='comments'>{said(i)}</div></body>") for i in range(6)]
    got = texts(wrappers.extract(make_pages(rows)))
    assert got == {i: "\n".join([f"Head {i}", *(f"Paragraph {k} of text {i} with its own words." for k in range(4))]) for i in range(6)}


def test_copies_of_a_page_keep_their_text(make_pages):
    rows = [(i, f"http://a.example.com/{i}", PAGE.format(n=7)) for i in range(30)]
    got = texts(wrappers.extract(make_pages(rows)))
    assert set(got.values()) == {want(7) + "\nRead our terms of use."}


def test_salted_references_give_the_same(make_pages, monkeypatch):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", PAGE.format(n=i)) for i in range(16)]
    broadcast = texts(wrappers.extract(make_pages(rows)))
    monkeypatch.setattr(wrappers, "BROADCAST_BYTES", 0)
    assert texts(wrappers.extract(make_pages(rows))) == broadcast


def test_edge_rows(make_pages):
    rows = [(1, None, None), (2, "x", ""), (None, None, "<p>a&#233; b"), (4, "not a url", "plain  text &am"), (5, "http://b/", "<div class='x>broken <p>q</p>"), (5, "http://b/", "<script>no end"), (6, "http://c/", "<p>" * 2000 + "deep")]
    deep = "<div>" * 3000 + "<p>in</p>" + "</div>" * 2990 + "<p>mid</p>" + "</div>" * 10 + "<p>outer text</p>"
    rows += [(7, "http://e/", deep), (8, "http://e/", "<span class=ad>" * 3000 + "x"), (9, "http://e/", "<ul><li>" * 400 + "z")]
    got = wrappers.extract(make_pages(rows)).collect()
    assert len(got) == len(rows)
    by = {(r.page_id, r.text) for r in got}
    assert {(1, ""), (2, ""), (None, "aé b"), (4, "plain text &am"), (6, "deep"), (7, "in\nmid\nouter text"), (9, "z")} <= by
    assert wrappers.extract(make_pages([])).count() == 0


def test_without_article_menus_go(make_pages):
    page = "<body><ul><li><a href=1>Home</a><li><a href=2>News</a></ul><div><p>The text itself, with a <a href=3>link</a>.</p></div><div class=sidebar>s</div></body>"
    assert texts(wrappers.extract(make_pages([(1, "http://d/", page)]))) == {1: "The text itself, with a link."}


WORDS = "alba brine coral dune ember fjord grove heath islet knoll ledge marsh".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)) + "."


def neutral(rng, links=5):
    """A page without any telling tag or name; the article is the third block, its heading and paragraphs vary."""
    menu = "".join(f"<li><a href=x>{rng.choice(WORDS)}</a>" for _ in range(links))
    body = "".join(f"<p>{prose(rng, rng.randrange(5, 40))}</p>" for _ in range(rng.randrange(2, 6)))
    head = prose(rng, 4)
    page = f"<body><div><ul>{menu}</ul></div><div>{prose(rng, 6)}</div><div><h1>{head}</h1>{body}<p>All rights reserved by us.</p></div><div>{prose(rng, 7)}</div></body>"
    return page, head + "\n" + body.replace("</p><p>", "\n").replace("<p>", "").replace("</p>", "")


def test_neutral_pages_are_told_by_their_slots(make_pages, monkeypatch):
    rng = random.Random(4)
    made = [neutral(rng) for _ in range(40)]
    rows = [(i, "http://n.example.com/", p) for i, (p, _) in enumerate(made)]
    assert texts(wrappers.extract(make_pages(rows))) == {i: w for i, (_, w) in enumerate(made)}
    monkeypatch.setattr(wrappers, "wrapper", lambda *_: (set(), {0}))  # without induction nothing is right
    assert set(texts(wrappers.extract(make_pages(rows))).values()) == {""}


def test_two_layouts_of_a_host(make_pages):
    rng = random.Random(6)
    made = [neutral(rng) for _ in range(30)]
    other = lambda p: p.replace("<body>", "<body><table><tr><td>").replace("</body>", "</td><td><div><ol><li><a>z</a></ol></div></td></tr></table></body>")
    rows = [(i, "http://n.example.com/", other(p) if i % 2 else p) for i, (p, _) in enumerate(made)]
    assert texts(wrappers.extract(make_pages(rows))) == {i: w for i, (_, w) in enumerate(made)}


def test_names_around_the_article_drop_nothing(make_pages):
    long = " ".join(WORDS * 5)
    page = "<body class='has-sidebar'><div id='page' class='header-fixed'><form><article class='post share-enabled'><header><h1>Head {n}</h1></header><p>" + long + " {n}</p><math>x={n}</math></article></form><div class='widget'>w {n}</div></div></body>"
    rows = [(i, "http://w/", page.format(n=i)) for i in range(6)]
    assert texts(wrappers.extract(make_pages(rows))) == {i: f"Head {i}\n{long} {i}\nx={i}" for i in range(6)}


def test_self_closed_elements_take_nothing(make_pages):
    page = "<article><p>a</p><svg/><p>b</p><canvas/><p>c</p><iframe/><p>d <span class=ad>e</span> f</p><video><p>g</p></article>"
    assert texts(wrappers.extract(make_pages([(1, "http://s/", page)])))[1] == "a\nb\nc\nd e f\ng"


def brute_weight(a, b):
    """The most pairs and of these the most equal names, by trying all ways."""
    if a.tag != b.tag:
        return 0

    def lists(x, y):
        if not x or not y:
            return 0
        return max(lists(x[1:], y), lists(x, y[1:]), lists(x[1:], y[1:]) + brute_weight(x[0], y[0]))

    return html_tree.PAIR + (a.names == b.names) + lists(a.children, b.children)


def test_tree_matching_finds_the_most_pairs(monkeypatch):
    pages = ["<div><ul><li>a</ul><section><p>x<h2>y</h2><p>z</section><table></table></div>", "<div><section><h2>y</h2><p>z</p><ul></ul></section><ul></ul><ol></ol><table><tr></table></div>", "<div><p>1</p><div><p>2</p></div><p>3</p></div>", "<div class=a><p>1</p></div><div class=b><p>1</p><h2>2</h2></div><div class=c></div>", "<div class=b><h2>1</h2></div><div class=c><p>x</p></div>"]
    for cells in (256, 0):  # small tables, and rows as arrays
        monkeypatch.setattr(html_tree, "TABLE_CELLS", cells)
        for p in pages:
            for q in pages:
                a, b = slots(read(p))[0], slots(read(q))[0]
                matcher = html_tree.Matcher()
                assert matcher.weight(a, b) == brute_weight(a, b)
                found = matcher.match(a, b)
                assert len(found) == brute_weight(a, b) // html_tree.PAIR == len({id(x) for x, _ in found}) == len({id(y) for _, y in found})


def test_long_lists_align_like_short_ones(monkeypatch):
    rng = random.Random(8)
    page = lambda: "<dl>" + "".join(rng.choice(["<dt>t", "<dd>d", "<dd><p>p</p><p>q</p>", "<dt><ul><li>x</ul>"]) for _ in range(90)) + "</dl>"
    for _ in range(5):
        a, b = slots(read(page()))[0], slots(read(page()))[0]
        long = html_tree.Matcher().weight(a, b)
        monkeypatch.setattr(html_tree, "TABLE_CELLS", 1 << 40)
        assert html_tree.Matcher().weight(a, b) == long
        monkeypatch.setattr(html_tree, "TABLE_CELLS", 256)
    wide = "<dl>" + "<dt>a<dd><p>b</p><ul><li>c</ul>" * 3000 + "</dl>"
    tree = slots(read(wide))[0]
    assert html_tree.Matcher().weight(tree, tree) // html_tree.PAIR == 2 + 6000 + 6000 + 3000


# a twin of the whole extraction, on trees of (tag, items) by plain loops; an item is a text, a link or a tree


def drawn(rng, kind):
    """A page of one of two outlines as a tree; some of its texts are the same on all pages."""
    link = lambda: ("a", prose(rng, 1))
    menu = ("div", [("ul", [("li", [link()]), ("li", [link()])])])
    article = ("div", [("h1", [prose(rng, 3)]), *[("p", [prose(rng, rng.randrange(3, 30))]) for _ in range(rng.randrange(1, 4))], ("p", ["Reserved."]), ("ul", [("li", [link()])])])
    parts = [menu, article, ("div", [prose(rng, rng.randrange(2, 9))])] if kind else [("h2", ["Name"]), ("section", [article]), menu]
    return ("body", parts)


def markup(tree):
    tag, items = tree
    return f"<{tag}>" + "".join(x if isinstance(x, str) else f"<a href=u>{x[1]}</a>" if x[0] == "a" else markup(x) for x in items) + f"</{tag}>"


class Place:
    """A run of like siblings of a page; leaves of one tag are alike."""

    def __init__(self, tag, trees):
        self.tag, self.trees, self.children = tag, trees, []
        self.texts = [(x, 0) if isinstance(x, str) else (x[1], len(x[1])) for t in trees for x in t[1] if isinstance(x, str) or x[0] == "a"]
        for t in trees:
            for x in t[1]:
                if not isinstance(x, str) and x[0] != "a":
                    leaf = all(isinstance(y, str) or y[0] == "a" for y in x[1])
                    last = self.children[-1] if self.children else None
                    if last and last.tag == x[0] and leaf and not last.children:
                        self.children[-1] = Place(x[0], [*last.trees, x])
                    else:
                        self.children.append(Place(x[0], [x]))


def pairs(a, b):
    """The largest alignment, all tried."""
    if a.tag != b.tag:
        return []

    def lists(x, y):
        if not x or not y:
            return []
        one = pairs(x[0], y[0])
        return max(([*one, *lists(x[1:], y[1:])] if one else []), lists(x[1:], y), lists(x, y[1:]), key=len)

    return [(a, b), *lists(a.children, b.children)]


def spread(place):
    return [place, *[y for c in place.children for y in spread(c)]]


def brute_extract(pages):
    """Main texts of pages of one host that are all references."""
    trees = [Place("body", [t]) for t in pages]
    fits = [max(range(len(trees)), key=lambda k: (2 * len(pairs(t, trees[k])) / (len(spread(t)) + len(spread(trees[k]))), -k)) for t in trees]
    out = {}
    for k in set(fits):
        own = [n for n, f in enumerate(fits) if f == k]
        at = {n: {id(a): b for a, b in pairs(trees[n], trees[k])} for n in own}
        have, seen = Counter(), Counter()
        for n in own:
            have.update(id(b) for b in at[n].values())
            seen.update({(id(at[n][id(p)]), x) for p in spread(trees[n]) if id(p) in at[n] for x in p.texts})
        fixed = {x for x, c in seen.items() if c >= 2 and c >= 0.8 * have[x[0]]}
        plain = lambda p: sum(c * (len(x[0]) - x[1]) for (i, x), c in seen.items() if i == id(p) and (i, x) not in fixed) + sum(map(plain, p.children))  # noqa: E731, B023
        links = lambda p: sum(c * x[1] for (i, x), c in seen.items() if i == id(p) and (i, x) not in fixed) + sum(map(links, p.children))  # noqa: E731, B023
        region = trees[k]
        while (inner := [c for c in region.children if c.children]) and (best := max(inner, key=plain)) and plain(best) >= 0.6 * plain(region) > 0:
            region = best
        menus = [p for p in spread(region) if p is not region and links(p) and links(p) >= 0.7 * (links(p) + plain(p)) and plain(p) < 0.5 * plain(region)]
        places = {id(p) for p in spread(region)} - {id(q) for p in menus for q in spread(p)}
        for n in own:
            found = [(id(at[n][id(p)]), x) for p in spread(trees[n]) if id(at[n].get(id(p))) in places for x in p.texts]
            kept = [x for x in found if x not in fixed]
            if 2 * sum(len(x[0]) for _, x in kept) < sum(len(x[0]) for _, x in found):
                kept = found
            out[n] = "\n".join(x[0] for _, x in kept)
    return out


@pytest.mark.parametrize("seed", range(3))
def test_matches_brute_force(make_pages, monkeypatch, seed):
    rng = random.Random(seed)
    pages = [drawn(rng, i % 2) for i in range(6)]
    monkeypatch.setattr(wrappers, "REFERENCES", 1 << 30)  # every page is a reference
    rows = [(i, "http://b/", markup(p)) for i, p in enumerate(pages)]
    order = sorted(range(6), key=lambda i: rows[i][2])  # references are in the order of their markup
    want = brute_extract([pages[i] for i in order])
    assert texts(wrappers.extract(make_pages(rows))) == {order[n]: t for n, t in want.items()}
