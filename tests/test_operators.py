"""Small cases of the operators that the driver's tables do not show."""

import random
from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from venuelake.functions import addresses, contacts, text
from venuelake.operators import catalogue, harvest, inventory, leads, ledgers, resolution, reviews, scoring
from venuelake.sources import documents


def one(spark, column, **values):
    return spark.createDataFrame([Row(**values)]).select(column.alias("v")).first().v


def test_robots_longest_rule_wins_and_allow_wins_ties(spark):
    body = "User-agent: *\nDisallow: /\n\nUser-agent: Crawler\nUser-agent: Other\nDisallow: /private\nAllow: /private/open # note\nDisallow: /*.pdf$\n"
    rules = documents.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"), "host", "body")
    urls = spark.createDataFrame([("h", p) for p in ("/", "/private/x", "/private/open/y", "/a.pdf", "/a.pdf?x")] + [("none", "/private")], "host string, path string")
    got = {(r.host, r.path): r.allowed for r in documents.robots_allowed(urls, rules, "crawler").collect()}
    assert got == {("h", "/"): True, ("h", "/private/x"): False, ("h", "/private/open/y"): True, ("h", "/a.pdf"): False, ("h", "/a.pdf?x"): True, ("none", "/private"): True}
    assert not documents.robots_allowed(urls.filter("path = '/'"), rules, "stranger").first().allowed


@pytest.mark.parametrize(
    ("body", "path", "allowed"),
    [
        ("User-agent: *\nDisallow: /\n\nUser-agent: Crawler\nDisallow:", "/x", True),  # named without a rule
        ("User-agent: Crawler\nDisallow:\n\nUser-agent: *\nDisallow: /", "/x", False),  # a rule without value ends no group
        ("User-agent: crawl\nDisallow: /\nUser-agent: *\nAllow: /", "/x", False),  # part of the name
        ("User-agent: *\nDisallow: /***a\nAllow: /b/a", "/b/a", True),  # stars do not count
        ("User-agent: *\nDisallow: /a$b", "/a$bc", False),
        ("Disallow: /\nUser-agent: *\nAllow: /y", "/x", True),  # before any agent
    ],
)
def test_robots_groups_and_lengths(spark, body, path, allowed):
    rules = documents.robots_rules(spark.createDataFrame([("h", body)], "host string, body string"), "host", "body")
    assert documents.robots_allowed(spark.createDataFrame([("h", path)], "host string, path string"), rules, "Crawler").first().allowed == allowed


@pytest.mark.parametrize(("category", "consent", "marketing"), [("NEWSLETTER_SIGNUP", "UNKNOWN", False), ("NEWSLETTER_SIGNUP", None, False), ("NEWSLETTER_SIGNUP", "GRANTED", True), ("RESOURCE_DOWNLOAD", "opted_in", True), ("RESOURCE_DOWNLOAD", "OPTED_OUT", False), ("DEMO_REQUEST", "GRANTED", False)])
def test_marketing_needs_recorded_consent(spark, category, consent, marketing):
    frame = spark.createDataFrame([(category, consent)], "c string, s string")
    sent = frame.select(scoring.communication_policy(F.col("c"), F.col("s")).alias("p")).first().p
    assert any(c.startswith("Marketing") for c in sent.communications) == marketing


def test_outbound_text_is_refused_not_mended(spark):
    rows = [("Hi [name]", "x"), ("Hi", "see https://a.org/x, and www.b.org."), ("world-class", None), ("a   b", "one\n\n\n\ntwo  "), ("x", "evidence-id: 12"), ("x", "Best regards,\nPartnerships")]
    frame = spark.createDataFrame(rows, "s string, b string")
    got = [tuple(r.t) for r in frame.select(reviews.sanitised(F.col("s"), F.col("b"), F.array(F.lit("https://a.org/x")), "Partnerships").alias("t")).collect()]
    signed = "\n\nBest regards,\nPartnerships"
    assert got == [
        (None, None, "INTERNAL_EVIDENCE_OR_PLACEHOLDER"), ("Hi", "see https://a.org/x and" + signed, None), (None, None, "UNSUPPORTED_CLAIM"), ("a b", "one\n\ntwo" + signed, None),
        (None, None, "INTERNAL_EVIDENCE_OR_PLACEHOLDER"), ("x", "Best regards,\nPartnerships", None),
    ]


def test_sitemaps_search_results_and_kinds(spark):
    maps = [(1, "<urlset><url><loc> https://a.org/1 </loc></url><url><loc>https://a.org/2</loc></url></urlset>"), (2, "<sitemapindex><sitemap><loc>https://a.org/m</loc></sitemap></sitemapindex>"), (3, "https://a.org/t\nno url\n"), (4, None)]
    got = documents.sitemap_urls(spark.createDataFrame(maps, "id int, body string"), "id", "body").collect()
    assert sorted((r.id, r.kind, r.position, r.url) for r in got) == [(1, "URLSET", 0, "https://a.org/1"), (1, "URLSET", 1, "https://a.org/2"), (2, "INDEX", 0, "https://a.org/m"), (3, "TEXT", 0, "https://a.org/t")]
    found = documents.search_results(spark.createDataFrame([(1, '{"organic":[{"title":"A","link":"https://a.org/"},{"title":"B","link":"ftp://b"}]}'), (2, "broken")], "id int, body string"), "id", "body").collect()
    assert [(r.id, r["rank"], r.title) for r in found] == [(1, 1, "A")]
    assert one(spark, documents.content_kind(F.col("t"), F.col("b")), t="text/html", b="%PDF-1.7") == "PDF"
    assert one(spark, documents.content_kind(F.col("t"), F.col("b")), t="application/json", b="{}") == "JSON"


@pytest.mark.parametrize(("number", "want"), [("+44 (0)20 7946 0000", "+442079460000"), ("020 7946 0000", "+442079460000"), ("0044 20 7946 0000", "+442079460000"), ("12", "12")])
def test_phone(spark, number, want):
    assert one(spark, contacts.phone(F.col("n"), F.lit("hall.co.uk")), n=number) == want


def test_strings(spark):
    assert one(spark, contacts.role_mailbox(F.col("m")), m="Info@a.org") is True
    assert one(spark, contacts.mail_verdict(F.col("m")), m="no mail") == "INVALID_EMAIL"
    assert one(spark, addresses.registrable_domain(F.col("h")), h="www.venue.co.uk") == "venue.co.uk"
    assert one(spark, addresses.without_tracking(F.col("u")), u="https://a.org/x?utm_source=1&id=2&ref=3#top") == "https://a.org/x?id=2&ref=3"
    assert one(spark, text.visible_text(F.col("h")), h="<p>a &amp; b</p><script>x</script> c") == "a & b c"
    assert one(spark, text.slug_key(F.col("n"), F.col("d")), n="The Grand Hall!", d="a.org") == "the-grand-hall|a.org"
    assert one(spark, text.escaped_ilike(F.col("n"), "50%_"), n="has 50%_ off") is True
    assert one(spark, text.escaped_ilike(F.col("n"), "5%0"), n="5x0") is False


def test_projection_follows_the_fold(spark):
    def fold(categories):
        intent = priority = stage = None
        for n, c in enumerate(categories, 1):
            rank = leads.RANKS[c]
            step = "VERY_HIGH" if rank >= 5 else "HIGH" if rank == 4 else "MEDIUM" if n >= 3 else None
            intent = step or ("NURTURE" if rank == 0 else None) or (intent if n > 1 else "LOW")
            priority = step or (priority if n > 1 else "LOW")
            stage = ("TRIAL_ACTIVE" if c == "TRIAL_STARTED" else "NEW") if n == 1 else "REVIEWING" if stage == "NEW" and rank >= 4 else stage
        return intent, priority, stage, len(categories)

    from itertools import product

    cases = list(product(["TALK_TO_SALES", "TRIAL_STARTED", "RESOURCE_DOWNLOAD", "NEWSLETTER"], repeat=3)) + [("NEWSLETTER",), ("RESOURCE_DOWNLOAD", "NEWSLETTER")]
    rows = [(str(k), n, c, datetime(2024, 1, 1, 0, n), datetime(2024, 1, 2 - n % 2)) for k, cs in enumerate(cases) for n, c in enumerate(cs)]
    got = leads.project(spark.createDataFrame(rows, "canonical_key string, id long, category string, received_at timestamp, occurred_at timestamp")).collect()
    assert {r.canonical_key: (r.current_intent, r.priority, r.stage, r.activity_count) for r in got} == {str(k): fold(cs) for k, cs in enumerate(cases)}


def test_replays_are_dropped(spark):
    rows = spark.createDataFrame([("s", "1", 1, 5), ("s", "1", 2, 3), ("s", "2", 3, 1)], "source_system string, source_record_id string, id int, received_at int")
    assert sorted(r.id for r in leads.once(rows).collect()) == [2, 3]


def test_keyset_pages_walk_all_rows_both_ways(spark):
    rows = spark.createDataFrame([(i % 3, i) for i in range(20)], "v int, id int")
    order, seen, after = [("v", False), ("id", True)], [], None
    while True:
        page = [(r.v, r.id) for r in inventory.keyset_page(rows, order, after, 6).collect()]
        seen += page[:6]
        if len(page) <= 6:
            break
        after = page[5]
    assert seen == sorted(((i % 3, i) for i in range(20)), key=lambda r: (-r[0], r[1]))
    back = [(r.v, r.id) for r in inventory.keyset_page(rows, order, seen[10], 4, forward=False).collect()]
    assert back[:4] == seen[6:10][::-1]


def test_fuzzy_pairs_equal_all_pairs(spark):
    names = ["grand hall london", "the grand hall", "hall", "city art museum", "art museum", "museum of the city", "", None, "grand", "um", "a", "alls"]
    left = spark.createDataFrame(list(enumerate(names)), "id int, name string")
    got = {(r.left_id, r.right_id) for r in resolution.fuzzy_pairs(left, left, "id", "id", "name", "name").collect()}
    sets = [set((n or "").split()) for n in names]
    want = {(a, b) for a, x in enumerate(sets) for b, y in enumerate(sets) if x and y and (names[a] in names[b] or names[b] in names[a] or (len(x & y) >= 2 and len(x & y) / max(len(x), len(y)) >= 0.5))}
    assert got == want


def test_successor_chains(spark):
    moves = spark.createDataFrame([(1, 2), (2, 3), (4, 5), (5, 4)] + [(i, i + 1) for i in range(10, 20)], "place int, successor int")
    got = {r.start: (r.last, r.state) for r in resolution.successors(moves).collect()}
    assert got[1] == (3, "ENDED") and got[4][1] == "CYCLE" and got[10][1] == "LIMIT"


def test_ledger_rules(spark):
    before = spark.createDataFrame([(1, "a", None), (2, "b", 1), (3, "c", 1)], "id int, x string, y int")
    after = spark.createDataFrame([(1, "a", None), (2, "b", 2)], "id int, x string, y int")
    assert sorted((r.id, r.change) for r in ledgers.illegal_edits(before, after, "id", ["x", "y"]).collect()) == [(2, "EDITED"), (3, "DELETED")]
    assert one(spark, ledgers.backoff_hours(F.col("n"), 2, F.lit(None).cast("int")), n=3) == 16
    with pytest.raises(ValueError):
        catalogue.page(before, ["x"], "y", "id")


@pytest.mark.parametrize("cap", [4, 1000])
def test_a_batch_is_selected_in_order(spark, cap):
    rng = random.Random(6)
    rows = [(i, rng.choice(["h", f"h{i % 17}", None]), rng.choice(["i", f"i{i % 23}", None])) for i in range(80)]
    chain = [(100 + i, f"c{i // 2}", f"d{(i + 1) // 2}") for i in range(8)]
    for table in ([(1, "h1", "i1"), (2, "h2", "i1"), (3, "h2", "i2")], rows + chain):
        hosts, identities, want = set(), set(), []
        for i, h, d in table:
            if h not in hosts and d not in identities and len(want) < cap:
                hosts.add(h)
                identities.add(d)
                want.append(i)
        items = spark.createDataFrame(table, "n int, host string, identity string")
        assert [r.n for r in ledgers.select_batch(items, "n", "host", "identity", cap).collect()] == want


def test_refused_requests_use_up_no_cap(spark):
    rng = random.Random(7)
    rows = [("a", i, c) for i, c in enumerate([4, 4, 3, 4, 1])] + [(rng.choice(["b", "c", None]), i, rng.choice([1, 2, 3, 4, None])) for i in range(5, 90)]
    caps = [("VENUES", F.lit(1), 9), ("REQUESTS", F.col("cost"), 12)]
    got = ledgers.admit(spark.createDataFrame(rows, "day string, n int, cost int").repartition(3), ["day"], [F.asc("n")], caps)
    assert got.columns == ["day", "n", "cost", "decision"]
    totals, want = {}, []
    for day, n, cost in rows:
        venues, requests = totals.get(day, (0, 0))
        now = (venues + 1, requests + (cost or 0))
        decision = "VENUES" if now[0] > 9 else "REQUESTS" if now[1] > 12 else "ADMITTED"
        if decision == "ADMITTED":
            totals[day] = now
        want.append((n, decision))
    assert sorted((r.n, r.decision) for r in got.collect()) == want and want[4] == (4, "ADMITTED")


def test_site_signals_read_whole_texts(spark):
    """Words count wherever they stand in a page, and may straddle what would be the end of a part."""
    for before in (10, 3_997, 100_000):
        page = f"<title>t</title><p>{'x' * before} The festival presents: tickets, seating"
        assert one(spark, harvest.site_signals(F.col("h")), h=page) == ["FESTIVAL_OR_SERIES_LANGUAGE", "PROMOTER_LANGUAGE", "TICKETING_OR_MEDIA_LANGUAGE", "FACILITY_LANGUAGE", "FESTIVAL_PLACE_CONFLICT"]
