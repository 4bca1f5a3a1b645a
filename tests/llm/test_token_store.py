import zlib

import numpy as np
import pytest

from venuelake.llm import range_coder, token_store


@pytest.mark.parametrize("n", [0, 1, 2, 63, 64, 65, 5000])
@pytest.mark.parametrize("top", [1, 3, 500, 65536])
def test_round_trip(n, top):
    ids = np.random.default_rng(n + top).integers(0, top, n)
    for block in (1, 64, 2048):
        assert (range_coder.decode(range_coder.encode(ids, block)) == ids).all()


def test_repetition_and_prediction_compress():
    ids = np.tile(np.random.default_rng(1).integers(0, 40_000, 50), 2000)
    assert len(range_coder.encode(ids)) < 0.15 * 2 * len(ids)


def test_damage_is_found():
    data = bytearray(range_coder.encode(np.arange(3000) % 700))
    for at in (0, 30, len(data) - 9):
        broken = bytearray(data)
        broken[at] ^= 0x55
        with pytest.raises((ValueError, zlib.error)):
            range_coder.decode(bytes(broken))
    for cut in (3, 40, len(data) - 2):
        with pytest.raises((ValueError, zlib.error)):
            range_coder.decode(bytes(data[:cut]))
    with pytest.raises(ValueError):
        range_coder.encode(np.array([70_000]))


def test_documents_come_back_in_order(spark, tmp_path):
    from tokenizers import Tokenizer

    texts = ["Hello  world\n\n", "", None, "Tab\tand no-break space", "I'll é ΣΑΣ <|endoftext|> x<|endoftext|>y", "a " * 5000, "数字123", "same", "same"]
    rows = [(7 * i % 11, t) for i, t in enumerate(texts[:-1])] + [(7 * 7 % 11, "same"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "3 AS start", "'x' AS id")
    json = token_store.default_tokenizer()
    tokenizer = Tokenizer.from_str(json)
    path = str(tmp_path / "tokens")
    got = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_store.encode_documents(docs, json, path).collect()]
    want, at = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(got, key=lambda r: r[1]) == want
    assert token_store.encode_documents(docs.limit(0), json).count() == 0


def test_segments_are_split_and_counted(spark, tmp_path):
    docs = spark.createDataFrame([(i, "word " * (i % 7)) for i in range(50)], "doc_id long, text string")
    json = token_store.default_tokenizer()
    token_store.write_tokens(docs, str(tmp_path / "t"), json, segment_ids=20)
    assert spark.read.parquet(str(tmp_path / "t")).count() > 5
    found = token_store.encode_documents(docs, json, str(tmp_path / "u")).orderBy("start").collect()
    assert [r.doc_id for r in found] == list(range(50)) and [r.n_tokens for r in found] == [i % 7 + 1 for i in range(50)]


def test_a_tokenizer_that_joins_across_white_space_is_used_whole():
    import pyarrow as pa
    from tokenizers import Tokenizer, models, pre_tokenizers

    tokenizer = Tokenizer(models.WordLevel({"a b": 0, "a": 1, "b": 2, "?": 3}, unk_token="?"))
    tokenizer.pre_tokenizer = pre_tokenizers.Split("\n", "removed")
    mine = token_store.WordTokenizer(tokenizer.to_str())
    texts = ["a b\na", "b", None, "a b"]
    assert [x.tolist() for x in mine.ids(pa.array(texts))] == [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert not mine.by_words and token_store.WordTokenizer(token_store.default_tokenizer()).by_words
