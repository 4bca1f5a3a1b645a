"""Stages of the pipeline over tables whose extra columns have the operators' own names."""

import pytest

from venuelake.llm import decontaminate, mixing, simhash

NAMES = "doc row fp hash id first component facts content copies h size source_size target taken spans w hit_id hit_h n_hit items p n_words __row __fp __hash __copies __copy __id __h __spans __w".split()
TEXTS = ["one two three four five six seven eight nine ten eleven", "quite other words stand in this text", None, "", "one two three four five six seven eight nine ten eleven"]


@pytest.fixture
def docs(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` int" for n in NAMES) + ", `a.b` string"
    return spark.createDataFrame([(i if i < 4 else None, t, "en", "s", 1, *[7] * len(NAMES), "dot") for i, t in enumerate(TEXTS)], schema)


def rows(frame, columns):
    assert frame.columns == columns
    got = frame.collect()
    assert all(r[n] == 7 for r in got for n in NAMES) and all(r["a.b"] == "dot" for r in got)
    return sorted(((r.doc_id, r.text) for r in got), key=str)


def test_deduplicate(docs):
    assert rows(simhash.deduplicate(docs), docs.columns) == sorted([(0, TEXTS[0]), (1, TEXTS[1]), (2, None)], key=str)


def test_mixed_documents(docs):
    got = rows(mixing.mixed_documents(docs), docs.columns)
    assert set(got) <= {(i if i < 4 else None, t) for i, t in enumerate(TEXTS)} and len(got) >= 3


@pytest.mark.parametrize("mode", ["documents", "spans"])
def test_decontaminate(spark, docs, mode):
    bench = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", 7)], "item_id long, text string, id int")
    got = rows(decontaminate.decontaminate(docs, bench, mode=mode), docs.columns)
    clean = [(1, TEXTS[1]), (2, None), (3, "")]
    assert got == sorted(clean if mode == "documents" else [*clean, (0, "eleven"), (None, "eleven")], key=str)


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    bench = spark.createDataFrame([], "item_id long, text string")
    for got in (simhash.deduplicate(none), mixing.mixed_documents(none), decontaminate.decontaminate(none, bench)):
        assert got.columns == docs.columns and got.count() == 0
