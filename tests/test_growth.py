"""Queries that must not grow faster than their input, on small tables that are hard on them."""

from __future__ import annotations

import datetime
import random
import re

import pyarrow as pa
from pyspark.sql import functions as F

from venuelake.functions import capacities, contacts
from venuelake.operators import harvest, page_reading, planning, resolution, reviews
from venuelake.plans import document_queries
from venuelake.sources import markup
from venuelake.streaming import ingest, state

DAY = datetime.datetime(2024, 1, 1, 5)


def test_calendar_facts_counts_crowded_days_without_pairs(spark, tmp_path):
    """20,000 facts and 20,000 candidates of one day, address and page are 400 million pairs; a fact without an address is found by its page."""
    event = F.struct((F.col("id") * 9 + 3).alias("event_id"), F.lit(7).cast("long").alias("user_id"), F.lit(DAY).cast("timestamp_ntz").alias("ts"))
    rows = spark.range(20_000).select(event.alias("x")).select("x.*").unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS event_id, 7L AS user_id, TIMESTAMP_NTZ '2024-01-01 23:00:00' AS ts"))
    rows.write.parquet(f"{tmp_path}/events.parquet")
    spark.range(20_000).select((F.col("id") * 1200 * 3 + 0).alias("o_orderkey"), F.lit(57).cast("long").alias("o_custkey")).unionByName(spark.sql("SELECT 3L AS o_orderkey, 8L AS o_custkey")).write.parquet(f"{tmp_path}/orders.parquet")
    found = {r["candidate"]: r["facts"] for r in document_queries.calendar_facts(spark, str(tmp_path)).collect()}
    assert found == {k * 3600: 20_001 for k in range(20_000)}


def test_fuzzy_names_moves_no_pairs(spark, monkeypatch):
    """The plan neither groups nor deals pairs after the joins that make them, and every pair stands once, hot words in shares."""
    monkeypatch.setattr(resolution, "SHARE_ROWS", 3)
    words = ["grand hall", "the grand hall", "hall", "a", "city art museum", "art", "ha", "grand old hall of arts"]
    left = spark.createDataFrame([(i, f"{words[i % 8]} {i // 16}".strip()) for i in range(80)] + [(1000, "hall"), (1001, "hall"), (1001, "hall")], "a long, n string")
    right = spark.createDataFrame([(i, f"{words[i % 7]} {i // 14}") for i in range(60)] + [(1000, "hall"), (1002, "grand")], "b long, n string")
    found = resolution.fuzzy_pairs(left, right, "a", "b", "n", "n")
    got = [tuple(r) for r in found.collect()]
    expected = set()
    for a, n in left.collect():
        for b, m in right.collect():
            x, y = set(n.split()), set(m.split())
            if n in m or m in n or len(x & y) >= 2 and 2 * len(x & y) >= max(len(x), len(y)):
                expected.add((a, b, len(x & y), len(x & y) / max(len(x), len(y))))
    assert len(got) == len(set(got)) and set(got) == expected
    plan = found._jdf.queryExecution().optimizedPlan().toString().splitlines()
    assert "Union" in plan[0]


def test_fuzzy_names_broadcast_no_side(spark):
    """Names by their words or letters are more rows than an estimate tells, so even small sides are merged, not sent to the driver; words
    beyond the common ones, which have no bit of their own, are found through their sketches."""
    many = [(i, f"n{i} n{i + 1} n{i // 2 * 7}") for i in range(200)] + [(1000, "n5 n6")]
    left, right = spark.createDataFrame(many, "a long, n string"), spark.createDataFrame(many[::3] + many[-1:], "b long, n string")
    found = resolution.fuzzy_pairs(left, right, "a", "b", "n", "n")
    expected = set()
    for a, n in many:
        for b, m in many[::3] + many[-1:]:
            x, y = set(n.split()), set(m.split())
            if n in m or m in n or len(x & y) >= 2 and 2 * len(x & y) >= max(len(x), len(y)):
                expected.add((a, b, len(x & y), len(x & y) / max(len(x), len(y))))
    assert {tuple(r) for r in found.collect()} == expected
    joins = [line for line in found._jdf.queryExecution().executedPlan().toString().splitlines() if "Join [key" in line and "share" in line]
    assert joins and all("SortMergeJoin" in line for line in joins)


def test_mails_in_long_runs_are_found_in_one_pass(spark):
    """A run of 400,000 characters that a mailbox may have takes one pass; mailboxes right after one another are all seen."""
    run = "a" * 400_000
    texts = [(1, f"{run} Jo@hall.org"), (2, "a@b.com_c@d.org and Jo@hall.org"), (3, "a@b.com_c@d.org, so Jo@hall.org"), (4, "x@y.zz" + "z" * 9 + "%q@w.io! Jo@hall.org")]
    found = spark.createDataFrame(texts, "i int, t string").select("i", contacts.before_mail(F.col("t"), F.lit("jo@hall.org"), 30).alias("c"))
    assert {r.i: r.c for r in found.collect()} == {1: "a" * 29 + " Jo@hall.org", 2: " and Jo@hall.org", 3: ", so Jo@hall.org", 4: "! Jo@hall.org"}


def test_hidden_mails_of_all_bytes(spark):
    def hidden(text, key):
        return bytes([key, *(ord(c) ^ key for c in text)]).hex()

    codes = [hidden("jo@hall.org", 200), hidden("jo@hall.org", ord("j")), hidden("joathall", 7), hidden("ab@", 0), "zz00", "00", None, hidden("jo@hall.org", 9)[:-1]]
    found = spark.createDataFrame([(i, c) for i, c in enumerate(codes)], "i int, c string").select("i", contacts.decoded_mail(F.col("c")).alias("m"))
    assert {r.i: r.m for r in found.collect()} == {0: "jo@hall.org", 1: "jo@hall.org", 2: None, 3: "ab@", 4: None, 5: None, 6: None, 7: None}


def test_site_signals_read_a_page_once(spark):
    """The page's text is made once, not once for each of the words sought in it: its scripts are cut by a pattern that the plan names once a text."""
    page = spark.createDataFrame([("<title>Fest</title><script type='application/ld+json'>{\"@type\":\"Place\"}</script><p>Tickets &amp; seating",)], "h string")
    found = page.select(harvest.site_signals(F.col("h")).alias("s"))
    assert found.first().s == ["SCHEMA_PLACE_OR_VENUE", "FESTIVAL_OR_SERIES_LANGUAGE", "TICKETING_OR_MEDIA_LANGUAGE", "FACILITY_LANGUAGE", "FESTIVAL_PLACE_CONFLICT"]
    assert found._jdf.queryExecution().analyzed().toString().count("<style") <= 6  # the title's, and once the text's


def test_inventory_actions_move_no_notes(spark):
    """Notes decide before the join, which moves their verdict only."""
    candidates = spark.createDataFrame([(1, "RESEARCHED", "call", True)], "k long, status string, next_action string, approved boolean")
    asked = spark.createDataFrame([(1, 1, "BLOCK", "n" * 1001, None), (2, 1, "BLOCK", "n" * 1000, None), (3, 1, "SET_NEXT_ACTION", None, "  go "), (4, 2, "RESTORE", None, None), (5, 1, "SET_NEXT_ACTION", None, " ")], "i long, k long, action string, note string, wanted string")
    found = reviews.decided(candidates, asked, "k").select("i", "error", "new_action", "revoked")
    assert sorted(tuple(r) for r in found.collect()) == [(1, "PROSPECT_BLOCK_NOTE_TOO_LONG", "call", False), (2, None, "call", True), (3, None, "go", False), (4, "PROSPECT_NOT_FOUND", None, False), (5, "PROSPECT_NEXT_ACTION_INVALID", "call", False)]
    joined = [line for line in found._jdf.queryExecution().optimizedPlan().toString().split("Join LeftOuter")[0].splitlines()]
    assert not any("note#" in line for line in joined)  # nothing above the join reads a note
    assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def _pages(count):
    rng = random.Random(5)
    tags = ["div", "p", "b", "td", "tr", "table", "li", "ul", "br", "img", "dd", "dl", "h2", "section", "option"]
    one = lambda t: rng.choice([f"<{t}>", f"</{t}>", f"<{t.upper()} hidden a=1 A='2' class=\"x y\">", f"<{t} id=k >", " t ", "&amp; x", "&copy", "\n", f"</{t} >"])
    return ["".join(one(t) for t in rng.choices(tags, k=60)) + rng.choice(["", "end &am", "<p", "<br/>", "<!-- c -->", "<script>a<b</script>", "a < b"]) for _ in range(count)]


def test_pages_cut_by_a_pattern_equal_pages_fed_to_the_parser(monkeypatch):
    pages = _pages(300)
    asked = frozenset(["div", "td", "img", "h2"])
    cut = [(markup.tree(p), markup.tree(p, asked)) for p in pages]
    monkeypatch.setattr(markup, "_OPAQUE", re.compile(""))  # leaves every page to the parser
    assert cut == [(markup.tree(p), markup.tree(p, asked)) for p in pages]


def test_elements_have_the_texts_that_joins_find(spark):
    """Readers of elements deal a page's once and join nothing, as a table of nodes with its texts must."""
    pages, tags = spark.createDataFrame(list(enumerate(_pages(60))), "id long, html string"), ("div", "p", "td", "img", "h2")
    whole = markup.with_text(markup.nodes(pages, "id", "html"), F.lit(True), tags)
    found = markup.elements(pages, "id", "html", tags)
    columns = ["id", "node", "last", "tag", "content", "attributes", "hidden", "path"]
    rows = lambda d: sorted((tuple(r) for r in d.select(columns).collect()), key=lambda r: r[:2])
    assert rows(found) == rows(whole)
    for reader, asked in ((page_reading.card_events, page_reading.CARD_TAGS), (page_reading.table_capacities, page_reading.TABLE_TAGS), (page_reading.definition_capacities, page_reading.LIST_TAGS)):
        plan = reader(markup.elements(pages, "id", "html", asked))._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") + plan.count("Exchange REPARTITION") <= 1 and "Join" not in plan


def test_first_arrivals_ask_no_state_of_python(spark, tmp_path):
    """Only the fold by canonical key talks to the state store from Python, not each submission; of rows of a batch the least stays, null keys are one."""
    at = lambda n: DAY + datetime.timedelta(seconds=n)
    rows = [("s", str(n // 5 if n % 2 else 7), n, f"k{n}", None, None if n == 11 else at(n * 7919 % 60_000), at(0)) for n in range(40_000)] + [("s", None, n, "k", None, at(n), at(0)) for n in (50_002, 50_001)]
    schema = "source_system string, source_record_id string, id long, canonical_key string, category string, received_at timestamp, occurred_at timestamp"
    spark.createDataFrame(rows, schema).repartition(3).write.parquet(f"{tmp_path}/in")
    given = ingest.first_arrivals(spark.readStream.schema(schema).parquet(f"{tmp_path}/in"))
    assert "TransformWithState" not in given._jdf.queryExecution().analyzed().toString()
    with state.rocksdb(spark):
        query = given.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    query.awaitTermination(300)
    best = {}
    for r in rows:
        order = (r[5] or datetime.datetime.min, r[2])
        best[r[:2]] = min(best.get(r[:2], order), order)
    assert query.exception() is None and sorted(r.id for r in spark.read.parquet(f"{tmp_path}/out").collect()) == sorted(i for _, i in best.values())


def test_crawl_rounds_answer_a_batch_at_once(spark, monkeypatch):
    """A batch of many sites is one answer, not one a site; null dimensions, null sites and sites across batches count."""
    plan = spark.createDataFrame([(1, "a", ["R"], 1)], "site long, page string, dims array<string>, position long")
    taken = []
    monkeypatch.setattr(type(plan), "mapInArrow", lambda d, walk, schema: taken.append(walk) or d)
    planning.rounds(plan, "site", "page", ["R", "O"], budget=3, attempts=2)
    sites = [None, None, *[str(i // 3) for i in range(3000)]]
    dims = [["O"], None, *[[["R", "O"], ["O", "R"], ["R"]][i % 3] for i in range(3000)]]
    whole = pa.record_batch([pa.array(sites, pa.string()), pa.array([f"p{i}" for i in range(3002)]), pa.array(dims, pa.list_(pa.string()))], names=["site", "page", "dims"])
    answer = taken[0](iter([whole]))
    one, last = answer
    rows = [tuple(r.values()) for b in (one, last) for r in b.to_pylist()]
    assert rows[0] == (None, "p0", "O", 1) and rows[1:3] == [("0", "p2", "R", 1), ("0", "p3", "O", 2)] and len(rows) == 2001
    assert [tuple(r.values()) for b in taken[0](iter([whole.slice(0, 5), whole.slice(5)])) for r in b.to_pylist()] == rows


def test_cells_of_digits_are_not_read_for_words(spark):
    """A cell without a letter names neither layout nor space, and one without a digit has no count; one test tells each."""
    cells = ["1,200", " (250) ", "-", "", None, "Max capacity:", "up to 99 pax", "Loft 2", "Ⅻ", "K", "CocKtail", "٣٤"]
    text = F.col("c")
    found = spark.createDataFrame([(c,) for c in cells], "c string").select(capacities.layout_of(text).alias("l"), capacities.count_of(text).alias("n"), capacities.space_name(text).alias("s"))
    assert [tuple(r) for r in found.collect()] == [(None, 1200, None), (None, None, None), (None, None, None), (None, None, None), (None, None, None), ("unspecified", None, None), (None, 99, "up to 99 pax"), (None, None, "Loft 2"), *[(None, None, None)] * 2, ("cocktail", None, None), (None, None, None)]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("CASE WHEN RLIKE(c#") == 2 and plan.count("CASE WHEN (RLIKE(c#") == 1


def test_pictures_are_read_without_casts_of_empty_texts(spark):
    """A cast of an empty text costs an exception each; numbers are cast only where there are digits."""
    pages = spark.createDataFrame([(1, "https://a.org/", "<img srcset='a.jpg 9w, b.jpg 60w, c.jpg 1.5x, d.jpg' src=e.jpg><img src=f.jpg width=60px height=''><img src=g.jpg width=' 49'>")], "page long, url string, html string")
    found = page_reading.images(markup.elements(pages, "page", "html", ["img"]), pages, "page", "url")
    assert [r.url for r in found.orderBy("node").collect()] == ["c.jpg", "f.jpg"]
    plan = found._jdf.queryExecution().analyzed().toString()
    assert plan.count("try_cast(") == plan.count("THEN try_cast(") > 0


def test_pages_of_one_template_share_their_form():
    """Texts and attributes differ, tags and what hides do not: the tree is built once, and each page has its own texts."""
    pages = [f"<div id=k{i} class='c{i % 3}'><p>t{i}  x<b>{i}</b><img src={i}.png><p hidden>no" for i in range(50)]
    before = markup._form.cache_info().misses
    trees = [markup.tree(p, frozenset(("p", "img"))) for p in pages]
    assert markup._form.cache_info().misses == before + 1
    assert [[(r[3], r[4], r[7][0][2:]) for r in t] for t in trees] == [[([], f"t{i} x{i}", (f"c{i % 3}", f"k{i}")), ([("src", f"{i}.png")], "", (f"c{i % 3}", f"k{i}")), ([("hidden", "")], "", (f"c{i % 3}", f"k{i}"))] for i in range(50)]


def test_cards_find_what_an_element_says_once(spark):
    """Classes are sought as words of a list, whatever white space is between, and not cut into lists; the aggregates read columns."""
    html = "<div class='x\tevent\ngrid_item' data-date=2024-01-05><h2>A</h2><h2>B</h2><p class='date soon'>9:00am<p class='dates'>1:00pm<p class='a location'>Hall</p><a class=event_links href=/n>n</a><a class='y event_link' href=/t>t</a><img src=i></div><div class='grid_items event' data-date=2024-01-06><h2>C</h2></div>"
    pages = spark.createDataFrame([(1, html)], "id long, html string")
    found = page_reading.card_events(markup.elements(pages, "id", "html", page_reading.CARD_TAGS))
    assert [(r.title, str(r.start_at), r.venue, r.ticket_url, r.image_url) for r in found.collect()] == [("A", "2024-01-05 09:00:00", "Hall", "/t", "i")]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "split(" not in plan and not any("attributes" in line for line in plan.splitlines() if "Aggregate" in line)


def test_cells_are_read_as_columns_before_they_meet(spark):
    """Steps that are columns tell of a cell what the functions tell; the facts of a table are found without a pattern."""
    cells = ["Theatre", " Theatre\n(style):", "Max  capacity", "up to\t99 pax", "1,200", "Wing O 3", "a\u00a0b", "", " ", None, "Loft*:", "Room", "One two three four five six seven", "Stop!", "seated dinner\r\ndance", "9" * 9, "0", "K", "120 guests"]
    given = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    want = given.select("i", F.struct(capacities.layout_of(F.col("c")).alias("layout"), capacities.count_of(F.col("c")).alias("count"), capacities.space_name(F.col("c")).alias("space")).alias("c"))
    got = {r.i: tuple(r.c) for r in capacities.read_cells(given, "c").collect()}
    assert got == {r.i: tuple(r.c) for r in want.collect()}
    assert (got[1], got[3], got[10], got[14]) == (("theatre", None, None), (None, 99, "up to 99 pax"), (None, None, "Loft"), ("dinner", None, None))
    pages = spark.createDataFrame([(1, "<table><tr><th>Room<th>Theatre<th>Standing<tr><td>Loft A<td>10<td>20</table>")], "id long, html string")
    found = page_reading.table_capacities(markup.elements(pages, "id", "html", page_reading.TABLE_TAGS))
    assert sorted((r.space, r.layout, r["count"]) for r in found.collect()) == [("Loft A", "standing", 20), ("Loft A", "theatre", 10)]
    above = found._jdf.queryExecution().optimizedPlan().toString().split("Aggregate")[0]
    assert "cabaret" not in above
