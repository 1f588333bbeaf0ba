import hashlib

import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st

from sparkloom.llm import queries, sentencepiece_bpe as S

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = sentencepiece.SentencePieceProcessor(model_file=PATH)
PARTS = ["a", "the ", "ing", "  ", " ", "\n", "\t", "é", "漢字", "😀", "▁", "<s>", "\x00", "1", "====", "\r\n", "कि", "aaaaaaa"]


def same(text):
    ids = S.model(PATH).encode(text).tolist()
    assert ids == LIBRARY.encode(text)
    assert S.model(PATH).decode(ids) == LIBRARY.decode(ids)


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=60), st.lists(st.sampled_from(PARTS), max_size=40).map("".join)))
def test_any_text(text):
    same(text)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999)), max_size=12))
def test_any_codes(ids):
    assert S.model(PATH).decode(ids) == LIBRARY.decode(ids)


@pytest.mark.parametrize("n", range(70))
def test_runs_of_spaces(n):
    same(" " * n + "word" + " " * n)


def test_long_text_without_spaces():
    same("abcdefghij" * 5000)


def test_query_equals_the_library(spark, small):
    docs = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries.op2_sentencepiece(spark, small).collect():
        ids = LIBRARY.encode(docs[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_nulls_and_empty_tables(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(1, None), (2, ""), (3, "hi")], "k int, ids string")
    coded = df.select("k", S.encode(F.col("ids"), PATH).alias("ids")).withColumn("text", S.decode(F.col("ids"), PATH))
    assert [(list(r["ids"]), r["text"]) for r in coded.orderBy("k").collect()] == [([], ""), ([], ""), (LIBRARY.encode("hi"), "hi")]
    assert df.limit(0).select(S.encode(F.col("ids"), PATH)).count() == 0


def test_models_with_other_settings_are_refused():
    import public_tokenizers

    with open(public_tokenizers.path("piece_bpe_32k.model"), "rb") as f:
        raw = f.read()
    S.check_settings(raw)
    field = lambda k, body: bytes([k << 3 | 2, len(body)]) + body
    for more, what in ((field(3, b"\x18\x00"), "no space"), (field(2, b"\x18\x01"), "model type"), (field(1, b"\x0a\x01a\x18\x04"), "user-defined"), (field(3, b"\x12\x01x"), "normalisation")):
        with pytest.raises(ValueError, match=what):
            S.check_settings(raw + more)
