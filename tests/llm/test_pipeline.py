import corpus_pipeline
from venuelake.llm import decontaminate, mixing, quality, simhash


def test_stages_name_the_operators_and_keep_the_columns(spark, tmp_path):
    words = [f"w{i}" for i in range(400)]
    text = lambda k: " ".join(words[(k * 37 + j * (k % 13 + 1)) % 400] for j in range(60)) + "."
    rows = [(i, text(i), "en", f"s{i % 4}", 1) for i in range(120)] + [(200, text(5), "en", "s1", 1), (201, text(5), "en", None, 1), (202, None, None, "s2", 0)]
    rows += [(300 + i, "$$$ !!! ### @@@ " * 20 + str(i), "en", "s0", 1) for i in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    labels = [(i, 1, 0) for i in range(120)] + [(300 + i, 0, 0) for i in range(60)]
    folder = str(tmp_path / "sf")
    docs.write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    spark.createDataFrame([(1, " ".join(text(7).split()[5:20]))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["reject_low_quality", "drop_near_copies", "drop_contaminated", "mix_sources", "encode_tokens"]
    now, bench = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/benchmark.parquet")
    ids = lambda d: sorted(r.doc_id for r in d.select("doc_id").collect())
    accepted = sorted(r.doc_id for r in quality.classify(now, spark.read.parquet(f"{folder}/labels.parquet")).filter("predicted = 1").collect())
    for number, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, now, folder)
        path = str(tmp_path / f"stage{number}")
        out.write.parquet(path)
        out = spark.read.parquet(path)
        if number == 0:
            assert ids(out) == accepted and not {i for i in ids(out) if 300 <= i < 360} and set(range(120)) - set(ids(out)) == set()
        if number == 1:
            assert ids(out) == sorted({r.component_id for r in simhash.near_duplicates(now).collect()}) and not {200, 201} & set(ids(out))
        if number == 2:
            hit = {r.id for r in decontaminate.find_hits(now, bench).filter("n_hit > 0").collect()}
            assert 7 in hit and ids(out) == sorted(set(ids(now)) - hit)
        if number == 3:
            want = {r.doc_id: r.copies for r in mixing.mix(now).collect()}
            assert ids(out) == sorted(i for i, n in want.items() for _ in range(n))
        if number == 4:
            assert ids(out) == ids(now) and out.columns == ["doc_id", "start", "n_tokens", "ids_crc32"]
        else:
            assert out.columns == docs.columns
        now = out
