"""Small cases of lead actions and crawl judgements that the driver's tables do not show."""

from pyspark.sql import functions as F

from venuelake.operators import actions, crawling

CRAWL = "excluded boolean, conflict string, blocked array<string>, failure string, message string, status int, entry_is_site boolean, site_reachable boolean, documents long, identity_verified boolean, contact_accepted boolean, redirects long, failure_class string"
PLAIN = (False, None, None, None, None, None, None, None, 0, None, None, 0, None)


def crawl(**changed):
    names = [c.split()[0] for c in CRAWL.split(", ")]
    return tuple(changed.get(n, v) for n, v in zip(names, PLAIN, strict=True))


def test_dispositions_take_the_first_rule_that_holds(spark):
    cases = [
        (crawl(conflict="other house", failure="DNS_NXDOMAIN"), ("WRONG_PROPERTY_CONFLICT", "EVIDENCE_HELD")),
        (crawl(blocked=["REDIRECT_UNSAFE"]), ("INVALID_OR_UNSAFE_URL", "EVIDENCE_HELD")),
        (crawl(blocked=["REDIRECT_OTHER_HOST"]), ("REDIRECT_AUTHORITY_UNVERIFIED", "EVIDENCE_HELD")),
        (crawl(message="request timed out"), ("CONNECTION_TIMEOUT", "RETRYABLE")),
        (crawl(status=410, entry_is_site=False, site_reachable=True), ("LINKED_PAGE_HTTP_410", "EVIDENCE_HELD")),
        (crawl(status=410, entry_is_site=True, site_reachable=True), ("HTTP_410", "TERMINAL")),
        (crawl(status=418), ("HTTP_418", "EVIDENCE_HELD")),
        (crawl(status=200, documents=2), ("SITE_REACHABLE_UNVERIFIED", "EVIDENCE_HELD")),
        (crawl(status=200, documents=2, contact_accepted=False), ("NO_USABLE_CONTACT_EVIDENCE", "EVIDENCE_HELD")),
        (crawl(message="over the byte budget"), ("RETRIEVAL_LIMIT_EVIDENCE_INCOMPLETE", "EVIDENCE_HELD")),
        (crawl(failure_class="RETRYABLE"), ("TECHNICAL_FAILURE_UNCLASSIFIED", "RETRYABLE")),
        (crawl(), ("TECHNICAL_FAILURE_UNCLASSIFIED", "EVIDENCE_HELD")),
    ]
    rows = spark.createDataFrame([(n, *row) for n, (row, _) in enumerate(cases)], f"n int, {CRAWL}")
    got = {r.n: (r.code, r.category) for r in crawling.with_disposition(rows).collect()}
    assert got == {n: want for n, (_, want) in enumerate(cases)}


def test_a_plan_merges_candidates_of_a_page(spark):
    rows = [("s", "p", ["A"], 1, 5, 1), ("s", "p", ["B", "A"], 4, 2, 3), ("s", "q", [], 9, 1, 1), ("s", None, ["C"], 2, 3, 2)]
    found = crawling.merged_plan(spark.createDataFrame(rows, "site string, page string, dims array<string>, strength int, order int, tier int"), "site", "page", ["tier"])
    assert sorted((r.page or "", r.dims, r.strength, r.order, r.tier) for r in found.collect()) == [("", ["C"], 2, 3, 2), ("p", ["A", "B"], 4, 2, 3)]


def test_stages_follow_the_table_and_nothing_else(spark):
    rows = spark.createDataFrame([("proposal", "CONVERTED"), ("identified", "contacted"), ("lost", "nurture"), (None, "lost"), ("nurture", None), ("contacted", "demo")], "a string, b string")
    assert [r.v for r in rows.select(actions.may_follow(F.col("a"), F.col("b")).alias("v")).collect()] == [True, False, False, False, False, False]


def test_refused_actions_change_nothing(spark):
    lead = "id int, hold_reason string, stage string, lead_classification string, owner_id int, next_action string, follow_up_at timestamp, product_opportunity_id int"
    asked = "id int, action string, new_owner_id int, plan string, due_at timestamp, reason string, condition string"
    leads = spark.createDataFrame([(n, "held" if n == 2 else None, "NEW", "GENUINE_PROSPECT", None, None, None, None) for n in range(1, 5)], lead)
    batch = spark.createDataFrame([(1, "HOLD", None, None, None, " ", None), (2, "RELEASE_HOLD", None, None, None, "done", None), (3, "QUALIFY", None, None, None, None, None)], asked)
    got = {r.id: (r.action, r.error, r.hold_reason) for r in actions.acted(leads, batch, "id").collect()}
    assert got == {1: ("HOLD", "INCOMING_LEAD_HOLD_REASON_REQUIRED", None), 2: ("RELEASE_HOLD", None, None), 3: ("QUALIFY", "INCOMING_LEAD_OPPORTUNITY_INELIGIBLE", None), 4: (None, None, None)}
    assert actions.acted(leads.limit(0), batch, "id").count() == 0
