"""The table of nodes against a brute-force walk, and the readers on it over markup that the driver's pages lack."""

import random
import re

import pytest
from pyspark.sql import functions as F

from venuelake.operators import page_reading
from venuelake.sources import markup

PAGE = """<html><head><title>not shown</title></head><body><nav><a href='/a'>A <b>b</b></a></nav><h2>Great Hall hire</h2><table><tr><td>Theatre<td>120<tr><td>Standing<td>1,500</table>
<h3>Loft</h3><dl><dt>Banquet<dd>80<dd>90<dt>Doors<dd>7</dl><p>one<p>two <b>three<br>four</b></p><div hidden>no</div><script>var t = "<p>";</script>
<table><tr><th>Room<th>Theatre<th>Standing</tr><tr><td>Main <table><tr><td>Seated</td><td>30</td></tr><tr><td>x</td><td>y</td></tr></table></td><td>10</td><td>20</td></tr><tr><td>Small Bar</td><td>11</td><td>21</td></table>
<footer><a href="/b">&copy;</a></footer><a>no target</a><p unfinished"""
CARDS = """<main><div class="grid_item x event" data-date="2024-07-01"><h2>Band <i>One</i></h2><p class="date">7:30PM doors</p><p class="location">Hall</p><a class="event_link" href="https://t.org/1">Buy</a><img src="/i.png"></div>
<div class="grid_item event" data-date="2024-01-05"><h2>Two</h2><p class=date>12:05am</div><div class="grid_item event" data-date="soon"><h2>Three</h2></div><div class="event_grid_item" data-date="2024-01-06"><h2>Four</h2></div></main>"""
ARTICLE = """<article data-item-id=" E 1 "><h1>My <i>Event</i></h1><time datetime="2024-05-01T19:00:00Z"></time><time datetime="2024-05-02"></time><time datetime="2024-05-01T22:00+01:00">x</time>
<div itemprop="location">The <b>Hall</b></div><div class="sqs-html-content">About<p>it</div><a href="http://x.org/tickets">Tickets</a><a href="https://x.org/t">Book now</a></article><article><h1>Other</h1></article>"""


@pytest.fixture(scope="module")
def nodes(spark):
    rows = [(1, "https://a.org/x", PAGE), (2, "https://a.org/events/one", ARTICLE), (3, "https://a.org/about", ARTICLE), (4, "https://a.org/gigs/", CARDS), (5, None, None), (6, "https://a.org/events/x", "<article><h1> </h1></article>"), (None, "u", "")]
    pages = spark.createDataFrame(rows, "page long, url string, html string")
    return pages, markup.nodes(pages, "page", "html").cache()


def found(frame, *columns):
    return sorted((tuple(r[c] for c in columns) for r in frame.collect()), key=str)


def test_lines(nodes):
    got = [r.text for r in markup.shown_lines(nodes[1]).filter("id = 1").orderBy("line").collect()]
    assert got == ["A b", "Great Hall hire", "Theatre", "120", "Standing", "1,500", "Loft", "Banquet", "80", "90", "Doors", "7", "one", "two three", "four", "Room", "Theatre", "Standing", "Main", "Seated", "30", "x", "y", "10", "20", "Small Bar", "11", "21", "©", "no target"]


def test_capacities_of_tables_and_lists_under_headings(nodes):
    assert found(page_reading.table_capacities(nodes[1]), "space", "layout", "count") == sorted(
        [("Great Hall", "theatre", 120), ("Great Hall", "standing", 1500), ("Loft", "seated", 30), ("Main Seated 30 x y", "theatre", 10), ("Main Seated 30 x y", "standing", 20), ("Small Bar", "theatre", 11), ("Small Bar", "standing", 21)], key=str
    )
    assert found(page_reading.definition_capacities(nodes[1]), "space", "layout", "count", "statement") == [("Loft", "banquet", 80, "Banquet 80")]


def test_links_events_and_cards(nodes):
    pages, tree = nodes
    assert found(page_reading.links(tree.filter("id = 1")), "href", "label", "navigation") == [("/a", "A b", True), ("/b", "©", True)]
    (event,) = page_reading.article_events(tree, pages, "page", "url").collect()
    assert (event.id, event.title, event.external_id, event.venue, event.description, event.ticket_url) == (2, "My Event", "E 1", "The Hall", "About it", "https://x.org/t")
    assert (str(event.start_at), str(event.end_at)) == ("2024-05-01 19:00:00", "2024-05-01 21:00:00")
    cards = page_reading.card_events(tree).orderBy("node").collect()
    assert [(r.title, str(r.start_at), r.venue, r.ticket_url, r.image_url) for r in cards] == [("Band One", "2024-07-01 18:30:00", "Hall", "https://t.org/1", "/i.png"), ("Two", "2024-01-05 00:05:00", None, None, None)]


@pytest.mark.parametrize(("heading", "space"), [("Great Hall", "Great Hall"), ("The Loft hire", "The Loft"), ("Our spaces", None), ("private hire", None), ("Room 2", "Room 2"), ("Accessible Toilets", None), ("great hall", None), ("One Two Three Four Five Six Seven", None), ("Stop!", None), (None, None)])
def test_spaces_of_headings(spark, heading, space):
    assert spark.createDataFrame([(heading,)], "h string").select(page_reading.heading_space(F.col("h")).alias("s")).first().s == space


def test_intervals_hold_the_nodes_whose_path_names_them(spark):
    rng = random.Random(3)
    tags = ["div", "p", "b", "td", "tr", "table", "li", "ul", "br", "script", "dd", "dl"]
    pages = []
    for i in range(40):
        pages.append((i, "".join(rng.choice([f"<{t}>", f"</{t}>", f"<{t} hidden a=1 a=2>", f"t{k} ", "&amp; < ", "<!-- x -->"]) for k, t in enumerate(rng.choices(tags, k=80)))))
    rows = markup.nodes(spark.createDataFrame(pages, "id long, html string"), "id", "html").collect()
    by_page = {}
    for r in rows:
        by_page.setdefault(r.id, []).append(r)
    assert len(by_page) == 40
    for tree in by_page.values():
        assert [r.node for r in tree] == list(range(1, len(tree) + 1))
        for r in tree:
            assert {p.node for p in r.path} == {o.node for o in tree if o.tag != "#text" and o.node < r.node <= o.last}
            assert all(tree[p.node - 1].tag == p.tag for p in r.path)
            assert r.tag == "#text" or r.attributes in ({}, {"hidden": "", "a": "1"})


def test_empty_table_and_plain_text(spark):
    none = markup.nodes(spark.createDataFrame([], "id string, html string"), "id", "html")
    assert none.collect() == [] and page_reading.tables(none).collect() == [] and markup.shown_lines(none).collect() == []
    plain = markup.nodes(spark.createDataFrame([("k", "a < b\n &lt;c")], "id string, html string"), "id", "html")
    assert [re.sub(r"\s+", " ", r.text) for r in markup.shown_lines(plain).collect()] == ["a < b <c"]


def test_pictures_by_source_and_place(spark):
    html = """<div class="hero"><img srcset="a.jpg 300w, b.jpg 900w" src="c.jpg" alt="Main hall"></div><header class="site-logo"><img src="d.png"></header>
<img src="spacer.gif" data-lazy-src="e.jpg" alt="the bar"><img src="https://x.org/pixel.gif"><img src="f.jpg" width="49"><img srcset="g1.jpg 1x, g2.jpg 2x" alt="inside">
<ul class="swiper-wrapper"><li><img src="h.jpg"></ul><img src="e.jpg" alt="again"><img><img src="brand-logo.svg"><img data-src="data:x" src="i.jpg?w=1">"""
    pages = spark.createDataFrame([(1, "https://a.org/", html), (2, "https://a.org/gallery/", "<img src=z.jpg><img src=y.jpg alt=facade>"), (3, None, None)], "page long, url string, html string")
    got = page_reading.images(markup.nodes(pages, "page", "html"), pages, "page", "url").orderBy("id", "node").collect()
    assert [(r.id, r.url, r.role) for r in got] == [
        (1, "b.jpg", "HERO"), (1, "d.png", "LOGO"), (1, "e.jpg", "SPACE"), (1, "g2.jpg", "INTERIOR"), (1, "h.jpg", "GALLERY"), (1, "brand-logo.svg", "LOGO"), (1, "i.jpg?w=1", "OTHER"),
        (2, "z.jpg", "GALLERY"), (2, "y.jpg", "EXTERIOR"),
    ]
