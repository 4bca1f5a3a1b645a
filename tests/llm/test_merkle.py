import hashlib
import random

import pytest
from pyspark.sql import functions as F

from venuelake.llm import merkle as m

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, leaf string, pos int"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row):
    doc_id, text, lang, source, n_chars, *_ = row
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def climbed(nodes, arity):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + arity]) for i in range(0, len(levels[-1]), arity)])
    return levels


def siblings(levels, at, arity):
    out = []
    for level in levels[:-1]:
        run = at // arity * arity
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + arity])))
        at //= arity
    return out


def brute(rows, arity):
    """A list of (leaf, subroot, root, proof), in no order."""
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(((r[0] is not None, r[0] or 0), leaf_of(r)))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = [climbed([leaf for _, leaf in sorted(groups[g])], arity) for g in names]
    crown = climbed([t[-1][0] for t in trees], arity)
    return [(leaf, t[-1][0], crown[-1][0], siblings(t, i, arity) + siblings(crown, k, arity)) for k, t in enumerate(trees) for i, leaf in enumerate(t[0])]


def documents(sizes, seed=2):
    rng = random.Random(seed)
    rows = [(rng.randint(0, 10_000), rng.choice([None, "", "-", "1:a", "text é"]), lang, rng.choice([None, "s", ""]), rng.choice([None, 5]), "clash", 1) for lang, n in sizes.items() for _ in range(n)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("arity", "levels"), [(2, 4), (2, 1), (3, 2), (2, 3)])
def test_whole_operator_against_brute_force(spark, arity, levels):
    rows = documents({"en": 301, "de": 64, "é": 17, "Z": 1, None: 5, "": 2})
    rows += [rows[0], rows[0], (None, "a", "en", None, 1, "x", 1), (None, None, None, None, None, None, None), (None, None, None, None, None, None, None)]
    found = m.manifest(spark.createDataFrame(rows, SCHEMA).repartition(5), arity=arity, levels=levels).withColumn("up", m.fold(F.col("leaf"), F.col("proof")))
    got = found.withColumn("digest", m.proof_digest(F.col("proof"))).collect()
    plain = [(r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got]
    assert sorted(plain) == sorted(brute(rows, arity))
    assert all(r.up == r.root for r in got)
    assert all(r.digest == h("".join(a + b for a, b in r.proof)) for r in got)
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in rows)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 2}, {"en": 16}, {"en": 17}, {f"l{i:03}": 1 for i in range(70)}])
def test_sizes_about_a_block_and_many_groups(spark, sizes):
    rows = documents(sizes)
    got = m.manifest(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.leaf, r.subroot, r.root, [tuple(s) for s in r.proof]) for r in got) == sorted(brute(rows, 2))


def test_a_changed_row_or_another_order_of_fields_is_found(spark):
    rows = documents({"en": 40, "de": 9})
    docs = spark.createDataFrame(rows, SCHEMA)
    claimed = m.row_digest([F.col("doc_id"), F.col("source"), F.col("lang"), F.col("n_chars") + 1, F.col("text")])
    found = m.manifest(docs, carried=claimed).withColumn("up", m.fold(F.col("carried"), F.col("proof")))
    for r in found.collect():
        assert (r.up == r.root) == (r.carried == r.leaf)
    assert found.filter("carried <> leaf").count() == sum(r[4] is not None for r in rows)
    other = m.manifest(docs, fields=("doc_id", "text", "lang")).first().root
    assert other != found.first().root
    again = m.manifest(docs.repartition(9)).first().root
    assert again == found.first().root


def test_empty_table(spark):
    got = m.manifest(spark.createDataFrame([], SCHEMA))
    assert got.collect() == [] and got.columns == ["doc_id", "carried", "leaf", "subroot", "root", "proof"]


def test_fields_are_told_apart(spark):
    row = spark.createDataFrame([(None, "", "-", "é", 12)], "a string, b string, c string, d string, e long")
    assert row.select(F.concat(*[m.field(F.col(c)) for c in "abcde"])).first()[0] == "-0:1:-2:é2:12"
