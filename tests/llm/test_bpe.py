from __future__ import annotations

import random

import pytest

from curatrix.llm import bpe
from curatrix.llm.chat import tokenizer

from .conftest import documents

PARTS = ["the ", "it's", "\n\n", "   ", "1234567", "naïve", "日本語", "🙂", "aaaaaaaaaaaaaaaaaaaaaaaa", " don't", "\t", "!?!?", "x", " \n "]


def _text(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return "".join(rng.choice(PARTS) for _ in range(n))


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (200, 60)])
def test_chunks_give_the_tokens_of_the_whole_text(spark, chunk, overlap):
    texts = [_text(s, 40 + 25 * s) for s in range(24)] + ["a" * 700, " " * 500, "é" * 300, "word " * 200]
    got = {r["doc_id"]: r["tokens"] for r in bpe.encode(documents(spark, texts), chunk, overlap).collect()}
    enc = tokenizer()
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i] == enc.encode_ordinary(t), (i, t[:60])


def test_long_texts_are_cut_and_stitched(spark):
    docs = documents(spark, [_text(3, 2000)]).selectExpr("doc_id as key", "text")
    from curatrix.llm import common

    common.tune(spark)
    got = bpe.pieces(docs, 512, 64, bpe.default_pattern()).orderBy("group").collect()
    assert len(got) > 5 and "".join(r["text"] for r in got) == _text(3, 2000)


def test_round_trip(spark, tiny):
    docs = spark.read.parquet(f"{tiny}/documents.parquet")
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(docs, 4000, 256)).collect()}
    enc = tokenizer()
    for r in docs.collect():
        assert got[r["doc_id"]]["decoded"] == r["text"]
        assert got[r["doc_id"]]["tokens"] == enc.encode_ordinary(r["text"])
        assert got[r["doc_id"]]["n_tokens"] == len(got[r["doc_id"]]["tokens"])


def test_odd_rows(odd, none):
    got = bpe.decode(bpe.encode(odd, 1000, 100)).collect()
    want = sorted((r["text"] for r in odd.collect()), key=repr)
    assert sorted((r["decoded"] for r in got), key=repr) == want
    assert all((r["tokens"] is None) == (r["decoded"] is None) for r in got)
    assert {r["n_tokens"] for r in got if r["doc_id"] in (1, 2)} == {0}
    assert bpe.encode(none).count() == 0


def test_query_decodes_the_whole_table(spark, tiny):
    want = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{tiny}/documents.parquet").collect()}
    got = bpe.query(spark, tiny).collect()
    assert {r["doc_id"]: r["decoded"] for r in got} == want and len(got) == len(want)
    assert all(r["same"] for r in got)
