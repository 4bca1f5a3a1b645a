import random
from datetime import datetime, timedelta

import pytest

from venuelake.operators import budgets

SCHEMA = "provider string, tier string, at timestamp_ntz, id long, kind string, amount long, enabled boolean, target long"


def walked(events, default):
    """Budgets one event after another, written without the operator's classes."""
    out, state = [], {}
    for provider, tier, at, i, kind, amount, enabled, target in sorted((e for e in events if None not in e[:4]), key=lambda e: (e[0].lower(), e[1].upper(), e[2], e[3])):
        s = state.setdefault((provider.lower(), tier.upper()), {"default": default, "months": {}, "held": {}, "jobs": []})
        m = at.date().replace(day=1)
        b = s["months"].setdefault(m, {"limit": s["default"], "on": True, "used": 0, "kept": 0})
        left, job = max(0, b["limit"] - b["used"] - b["kept"]), None
        if kind == "SET_LIMIT" and amount is not None and amount >= 0:
            b |= {"limit": amount, "on": enabled is not False}
            s["default"], what = amount, "LIMIT_SET" if enabled is not False else "KILLED"
        elif kind == "RECONCILE" and amount is not None:
            h = s["held"].get(target)
            if not h:
                what = "RESERVATION_NOT_FOUND"
            else:
                m = h["month"]
                b = s["months"][m]
                what = "ALREADY_RECONCILED" if h["done"] else "NEGATIVE_ACTUAL" if amount < 0 else "ACTUAL_EXCEEDS_RESERVED" if amount > h["n"] else "EXCEEDS_MONTHLY_LIMIT" if b["used"] + amount > b["limit"] else None
                if what is None:
                    b["used"] += amount
                    b["kept"] -= h["n"]
                    h["done"], what = True, "CONSUMED" if amount else "RELEASED"
        elif kind == "ENQUEUE":
            s["jobs"].append(i)
            what = "QUEUED"
        elif kind in ("RESERVE", "CLAIM"):
            n = 1 if kind == "CLAIM" else amount
            if n is None or n <= 0:
                what = "INVALID_COUNT"
            elif not b["on"]:
                what = "BUDGET_DISABLED"
            elif left < n:
                what = "MONTHLY_LIMIT_EXCEEDED" if b["limit"] else "ZERO_BUDGET_LIMIT"
            elif kind == "CLAIM" and not s["jobs"]:
                what = "NO_ELIGIBLE_JOBS"
            else:
                b["kept"] += n
                s["held"][i] = {"month": m, "n": n, "done": False}
                what = "RESERVED"
                if kind == "CLAIM":
                    what, job = "CLAIMED", s["jobs"].pop(0)
        else:
            what = "INVALID"
        out.append((i, what, m, b["limit"], b["used"], b["kept"], max(0, b["limit"] - b["used"] - b["kept"]), job))
    return sorted(out)


@pytest.mark.parametrize("default", [0, 12])
def test_ledger_equals_a_walk_and_adds_up(spark, default):
    rng, events, asked = random.Random(default), [], [0]
    for i in range(900):
        kind = rng.choice(["RESERVE", "RESERVE", "RECONCILE", "RECONCILE", "ENQUEUE", "CLAIM", "CLAIM", "SET_LIMIT" if i % 5 == 0 else "RESERVE", "OTHER" if i % 50 == 0 else "CLAIM"])
        amount = {"SET_LIMIT": rng.choice([0, 40, 90, 90, -1, None]), "RESERVE": rng.choice([1, 2, 3, 0, None]), "RECONCILE": rng.choice([0, 1, 2, 9, -1, None])}.get(kind)
        at = datetime(2024, 1, 1) + timedelta(hours=i * 2.7, minutes=rng.randint(-300, 300))
        events.append((rng.choice(["Places", "PLACES", "Places", "search", None]), rng.choice(["pro", "PRO", "PRO", "basic"]), at, i, kind, amount, rng.choice([None, True, True, True, True, False]), rng.choice(asked[-5:])))
        if kind == "RESERVE":
            asked.append(i)
    got = budgets.ledger(spark.createDataFrame(events, SCHEMA).repartition(4), "provider", "tier", "at", "id", default_limit=default).collect()
    assert sorted(tuple(r) for r in got) == walked(events, default)
    for r in got:
        assert r.remaining == max(0, r.limit - r.consumed - r.reserved) and r.reserved >= 0
    outcomes = {r.outcome for r in got}
    assert {"LIMIT_SET", "KILLED", "RESERVED", "CONSUMED", "RELEASED", "CLAIMED", "QUEUED"} <= outcomes and len(outcomes) >= 12


def test_no_events(spark):
    assert budgets.ledger(spark.createDataFrame([], SCHEMA), "provider", "tier", "at", "id").collect() == []
