import random

import pytest

from venuelake.llm import mixing


def brute_targets(sizes, weights=(1, 2, 3)):
    """Shares by weight; what exceeds three times a source's size goes back to the others until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    full, total = set(), sum(sizes.values())
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        among = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * sizes[s] if s in full else left * weight[s] / among for s in names}
        above = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not above:
            return target
        full |= above


def documents():
    rng = random.Random(9)
    rows = []
    for i in range(1500):
        source = rng.choice(["big"] * 6 + ["b", "a", "Z", "é", None, "tiny"][: 6 if i % 40 == 0 else 5])
        n = min(4000, int(rng.lognormvariate(4, 1.2)))
        rows.append((i, " \t".join(["w"] * n), source, "x", 1))
    return [*rows, (5000, None, "a", "x", 1), (5001, "", "empty", "x", 1), (5002, " \n", None, "x", 1)]


SCHEMA = "doc_id long, text string, source string, target string, size int"


def check(rows, got, tolerance=0.02):
    sizes = {}
    words = {}
    for i, text, source, *_ in rows:
        words[i] = (len((text or "").split()), source)
        sizes[source] = sizes.get(source, 0) + words[i][0]
    target, taken = brute_targets(sizes), {}
    assert len(got) == len(rows)
    for r in got:
        n, source = words[r.doc_id]
        assert (r.size, r.source_size) == (n, sizes[source])
        assert r.target == pytest.approx(target[source], rel=1e-9)
        assert r.taken == r.copies * n and 0 <= r.copies <= 3
        taken[source] = taken.get(source, 0) + r.taken
    for source, t in target.items():
        assert abs(taken[source] - t) <= max(tolerance * t, 3), (source, taken[source], t)


@pytest.mark.parametrize("group_rows", [40, 50_000])
def test_targets_bounds_and_reruns(spark, group_rows):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    first = mixing.mix(df, group_rows=group_rows).collect()
    check(rows, first)
    again = mixing.mix(df.repartition(7), group_rows=group_rows).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again))


def test_one_source_at_its_bound_and_copies(spark):
    rows = [(1, "a b", "s", "x", 1), (2, "a b c d e f", "t", "x", 1), (3, "a", "u", "x", 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: r for r in mixing.mix(df).collect()}
    assert got[3].target == 3.0 and got[3].taken == 3
    mixed = mixing.mixed_documents(df)
    assert mixed.columns == df.columns
    counts = {i: 0 for i in got} | {r.doc_id: r["count"] for r in mixed.groupBy("doc_id").count().collect()}
    assert counts == {i: r.copies for i, r in got.items()}


@pytest.mark.parametrize("group_rows", [40, 50_000])
def test_copies_go_to_rows_where_ids_are_null_or_shared(spark, group_rows):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"n{i} " + text if text else None, source, f"row {i}", 1) for i, (_, text, source, *_) in enumerate(documents()[:600])]
    df = spark.createDataFrame(rows, SCHEMA)
    mixed = [tuple(r) for r in mixing.mixed_documents(df, group_rows=group_rows).collect()]
    assert sorted(map(repr, mixed)) == sorted(repr(tuple(r)) for r in mixing.mixed_documents(df.repartition(7), group_rows=group_rows).collect())
    assert set(mixed) <= set(rows) and max(mixed.count(r) for r in set(mixed)) <= 3
    n = lambda r: len((r[1] or "").split())
    sizes, taken = {}, {}
    for table, sums in ((rows, sizes), (mixed, taken)):
        for r in table:
            sums[r[2]] = sums.get(r[2], 0) + n(r)
    for source, target in brute_targets(sizes).items():
        assert abs(taken.get(source, 0) - target) <= max(0.02 * target, 3), source
    count = lambda got: sorted((r.doc_id or -1, r["sum(copies)"]) for r in got.groupBy("doc_id").sum("copies").collect() if r["sum(copies)"])
    whole = mixing.mixed_documents(df, group_rows=group_rows).selectExpr("doc_id", "1 AS copies")
    assert count(whole) == count(mixing.mix(df, group_rows=group_rows))


def test_empty_table_and_tables_without_words(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).collect() == []
    got = mixing.mix(spark.createDataFrame([(1, None, None, "x", 1), (None, "", "s", "x", 1)], SCHEMA)).collect()
    assert [(r.size, r.source_size, r.target, r.taken) for r in got] == [(0, 0, 0.0, 0)] * 2


def test_word_count(spark):
    text = "a b c d\x0be\x1cf  g"
    assert spark.createDataFrame([(text,), (None,), ("",)], "t string").select(mixing.word_count("t")).collect() == [(4,), (0,), (0,)]
