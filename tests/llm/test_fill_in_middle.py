import hashlib
import random
import re

import numpy as np
import pytest

from venuelake.llm import fill_in_middle as f

SCHEMA = "doc_id long, text string, n long, output string"


def brute(doc_id, text, unit=r"[^\n]*\n|[^\n]+", seed=7, fim=100, spm=50):
    text = text or ""
    units = re.findall(unit, text)
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= fim:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(4)
    pieces = ["a", "é", "𝄞", "\n", "\n\n", " ", "\t", "word", "<", "<P", "S>", " ", "\r\n", "\x00", "line of text\n"]
    made = ["".join(rng.choices(pieces, k=rng.randint(0, 40))) for _ in range(150)]
    return [None, "", "\n", "\n\n\n", "one line", "x" * 300_000 + "\n" + "y\n" * 50_000, "has <M> inside", "<P>", "ends with <", *made, made[3], made[3]]


@pytest.mark.parametrize(("unit", "pattern"), [("line", r"[^\n]*\n|[^\n]+"), ("word", r"[^\t\n\x0b\x0c\r ]*[\t\n\x0b\x0c\r ]+|[^\t\n\x0b\x0c\r ]+")])
def test_whole_operator_against_brute_force(spark, unit, pattern):
    rows = [(i, t, -1, "clash") for i, t in enumerate(texts())] + [(None, "null\nid\n", 1, None), (5, "same id,\nother text", 1, None)]
    made = f.fill_in_middle(spark.createDataFrame(rows, SCHEMA), unit=unit).withColumn("back", f.restore(f.F.col("output"), f.F.col("form")))
    got = sorted((tuple(r) for r in made.collect()), key=repr)
    want = sorted(((i, *brute(i, t, pattern), t or "") for i, t, *_ in rows), key=repr)
    assert got == want
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_shares_of_forms_and_seeds(spark):
    rows = [(i, "a\nb\nc\nd", 1, None) for i in range(2000)]
    docs = spark.createDataFrame(rows, SCHEMA)
    got = [r.form for r in f.fill_in_middle(docs, seed=11, fim_percent=60, spm_percent=25).collect()]
    assert got == [brute(i, t, seed=11, fim=60, spm=25)[1] for i, t, *_ in rows]
    assert 0.35 < got.count("plain") / 2000 < 0.45 and 0.12 < got.count("spm") / 2000 < 0.18
    assert {r.form for r in f.fill_in_middle(docs, fim_percent=0).collect()} == {"plain"}


def test_empty_table_and_unknown_unit(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert f.fill_in_middle(empty).collect() == []
    with pytest.raises(ValueError):
        f.fill_in_middle(empty, unit="page")


def test_no_shuffle(spark):
    plan = f.fill_in_middle(spark.createDataFrame([(1, "a", 1, None)], SCHEMA))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


@pytest.mark.parametrize(("text", "ends"), [("", []), ("\n", [1]), ("a\n\nb", [2, 3, 4]), ("a", [1])])
def test_ends_of_lines(text, ends):
    assert f.unit_ends(np.frombuffer(text.encode("utf-32-le"), "<u4")).tolist() == ends
