import os

import pytest
from pyspark.sql import functions as F

from vellum.llm import tokens

pytestmark = pytest.mark.skipif(not os.path.exists(tokens.DEFAULT_TOKENIZER), reason="no vocabulary here")

TEXTS = [
    None, "", " ", "\n\n  \t x", "Hello world, it's we've I'LL don't", "a b　c d\x85e\x1cf", "naïve café é ﬁ ™ 𝔘 ﷺ", "中文文本,没有空格。日本語テスト", "<|endoftext|> <|startoftext|>",
    "👩‍👩‍👧 🧿 🖼️ 🇦🇶", "x" * 5000, "word " * 20000, "tab\tsep\r\nline\r end   ", "3.14 ½ Ⅷ ² ١٢", "​﻿ zero‍width", "'s 't''ll", "\x00\x07 control", "สวัสดี שלום ع",
    "a\u0870b \U00010570\U00010571 x\U0001df25 \U00031350字 5\U00011f51",
]


def docs(spark):
    rows = [(i, t, "x", [1], i) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", [1], 0), (4, TEXTS[4], "x", [1], 0), (4, TEXTS[4], "x", [1], 0)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, word string, ids array<int>, _part int")


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.DEFAULT_TOKENIZER)
    tok.encode_special_tokens = True
    return lambda text: tok.encode(text or "", add_special_tokens=False).ids


@pytest.mark.parametrize("chars", [4_000_000, 2000])
def test_ids_equal_the_tokenizers_own(spark, scratch, reference, chars):
    out = tokens.encode_documents(docs(spark), scratch, block_chars=chars).collect()
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["ids"]) for r in out) == sorted((i is None, i or 0, reference(t)) for i, t, *_ in docs(spark).collect())
    assert next(r["ids"] for r in out if r["doc_id"] == 0) == [] == next(r["ids"] for r in out if r["doc_id"] == 1)


def test_counts_and_kept_columns(spark, scratch, reference):
    out = tokens.encode_documents(docs(spark), scratch, keep=("doc_id", "ids"), counts_only=True)
    assert out.columns == ["doc_id", "ids", "n_tokens"]
    assert sorted(r["n_tokens"] for r in out.collect()) == sorted(len(reference(r["text"])) for r in docs(spark).collect())


def test_decoding_gives_the_texts_back(spark, scratch):
    plain = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    back = {r["doc_id"]: r["text"] for r in tokens.decode_documents(tokens.encode_documents(plain, scratch)).collect()}
    assert back == {i: t or "" for i, t in enumerate(TEXTS)}


def test_words_lose_nothing(spark):
    df = spark.createDataFrame([(t,) for t in TEXTS if t], "text string")
    assert df.where(F.concat_ws("", tokens.words_of(F.col("text"))) != F.col("text")).count() == 0


def test_empty_table(spark, scratch):
    none = docs(spark).where("false")
    assert tokens.encode_documents(none, scratch).count() == 0
    assert tokens.decode_documents(tokens.encode_documents(none, scratch)).count() == 0
