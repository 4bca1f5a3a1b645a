import pytest

from venuelake.llm import common, components


def test_spread_join_equals_a_plain_join(spark):
    left = spark.createDataFrame([(i, "hot" if i % 3 == 0 else f"k{i % 7}") for i in range(200)] + [(900, None)], "i int, k string")
    counts = left.groupBy("k").count().withColumnRenamed("count", "n").selectExpr("k", "n", "length(k) AS size")
    plain = sorted(tuple(r) for r in left.join(counts, "k").select("k", "i", "n", "size").collect())
    for above in (None, 50, 5, 0):
        got = common.spread_join(left, counts, ["k"], above=above).select("k", "i", "n", "size")
        assert sorted(tuple(r) for r in got.collect()) == plain
    assert common.hot_above(counts) == common.HOT_ROWS and common.hot_above(counts.limit(0)) == common.HOT_ROWS


def test_a_hot_star_keeps_its_component(spark, monkeypatch):
    monkeypatch.setattr(components, "HOT_ROWS", 20)
    links = [(0, i) for i in range(1, 120)] + [(i, i + 1000) for i in range(1, 40)] + [(5000, 5001)]
    got = {r.node: r.component for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(c == (5000 if n >= 5000 else 0) for n, c in got.items()) and len(got) == 120 + 39 + 2


def test_a_cluster_without_a_shared_folder_is_refused(spark):
    class Session:
        class conf:
            @staticmethod
            def get(key, default):
                return None

        class sparkContext:
            master = "spark://host:7077"

            @staticmethod
            def getCheckpointDir():
                return None

    with pytest.raises(RuntimeError):
        common.shared_folder(Session, "x")


@pytest.mark.parametrize(("text", "want"), [("ÀBC İ", "Àbc İ"), ("plain ABC", "plain abc"), (None, None)])
def test_only_ascii_letters_are_lower_cased(spark, text, want):
    frame = spark.createDataFrame([(text,)], "t string")
    assert frame.select(common.ascii_lower(frame.t).alias("t")).first().t == want
