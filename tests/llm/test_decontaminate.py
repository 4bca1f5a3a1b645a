import hashlib
import random

import pytest

from venuelake.llm import decontaminate as d


def brute_words(text):
    out, word = [], ""
    for c in (text or "") + " ":
        c = c.lower() if "A" <= c <= "Z" else c
        if "a" <= c <= "z" or "0" <= c <= "9" or ord(c) > 0x7F:
            word += c
        elif word:
            out.append(word)
            word = ""
    return out


def brute(text, items):
    w, hit, found = brute_words(text), set(), set()
    for item_id, item in items:
        v = brute_words(item)
        m = min(10, len(v))
        wins = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if m else set()
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in wins:
                hit |= set(range(i, i + m))
                found.add(str(item_id))
    return len(w), len(hit), sorted(found)


def tables():
    rng = random.Random(1)
    vocabulary = [f"v{i}" for i in range(40)] + ["É", "straße", "İx"]
    items = [(i, " ".join(rng.choices(vocabulary, k=k))) for i, k in enumerate([30, 12, 10, 9, 4, 25, 11])]
    items += [(7, None), (8, ""), (9, "..."), (10, items[0][1]), (None, "v1, V2! v3 v4 v5 v6 v7 v8 v9 v10 v11")]
    texts = [None, "", "?!", "v1", "V1 v2 v3 v4 v5 v6 v7 v8 v9 v10 v11 tail", "İx ıi " * 20]
    for _ in range(60):
        w = rng.choices([*vocabulary, "other", "words"], k=rng.randint(0, 60))
        item = (rng.choice(items[:7])[1] or "").split()
        at, cut = rng.randint(0, len(w)), rng.randint(0, len(item))
        w[at:at] = [x.upper() if x.isascii() else x for x in (item[cut:] if rng.random() < 0.5 else item)]
        texts.append(rng.choice([" ", ", ", "\n", "-"]).join(w))
    texts.append("filler " * 30_000 + items[1][1])
    return items, texts


@pytest.mark.parametrize(("limits", "least"), [({"screen_longs": 1024}, 0), ({"screen_longs": 1}, 0), ({}, 9), ({"screen_longs": 2}, 10)])
def test_against_brute_force(spark, limits, least):
    items, texts = tables()
    items = [(i, t) for i, t in items if len((t or "").split()) >= least]
    docs = [(i, t, "clash", 1) for i, t in enumerate([*texts, texts[4]])]
    got = d.find_hits(spark.createDataFrame(docs, "doc_id long, text string, item string, w int"), spark.createDataFrame(items, "item_id long, text string"), **limits).collect()
    assert len(got) == len(docs)
    known = [(i, t) for i, t in items if i is not None]
    for r in got:
        n, hit, found = brute(docs[r.id][1], items)
        assert (r.n_words, r.n_hit) == (n, hit)
        assert r["items"] == [x for x in brute(docs[r.id][1], known)[2]]


def test_removal_of_documents_and_spans(spark):
    items = spark.createDataFrame([(1, "one two three four five six seven eight nine ten eleven")], "item_id long, text string")
    rows = [(1, "Clean, TEXT stays.", "k"), (2, "before ONE two, three four five six seven eight nine ten after", "k"), (None, None, "k"), (1, "Clean, TEXT stays.", "k")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = d.decontaminate(docs, items)
    assert kept.columns == docs.columns
    assert sorted(kept.collect(), key=str) == sorted([rows[0], rows[2], rows[3]], key=str)
    spans = {r.doc_id: r.text for r in d.decontaminate(docs, items, mode="spans").collect()}
    assert spans == {1: "Clean, TEXT stays.", 2: "before after", None: None}


def test_empty_tables_and_digest_of_no_items(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in d.find_hits(docs, none).collect()] == [(2, 0, [])]
    assert d.find_hits(docs.limit(0), spark.createDataFrame([(1, "a b")], "item_id long, text string")).collect() == []
    assert d.decontaminate(docs, none).collect() == [(1, "a b")]
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c44298fc1c14")


def test_no_python_in_the_plan(spark):
    items, texts = tables()
    hits = d.find_hits(spark.createDataFrame([(1, texts[6])], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert "Python" not in hits._jdf.queryExecution().toString()
