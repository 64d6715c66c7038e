import base64
import random

import pytest
import tiktoken
from tokenizers import Tokenizer

from lodestone.llm import encoding as E

public = pytest.importorskip("public_tokenizers")

TEXTS = [None, "", " ", "\n\n  x", "<|endoftext|> plain", "I'll they've 'S", "aaaaaaaaaaaaaaaaa", "日本語テスト。", "👨‍🔧 é \xa0  b", "x" * 20000, "a\x1c\x1db \x85c", "ﬁ ｆｕｌｌ 𝐛𝐨𝐥𝐝", "0123456789 12,5%", "﻿​"]


@pytest.fixture(scope="module")
def libraries():
    fast = Tokenizer.from_file(public.path("byte_bpe_50k.json"))
    fast.encode_special_tokens = True
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return fast, tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_equals_both_libraries(spark, libraries):
    fast, ranked = libraries
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(r.doc_id + 1000, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    rng = random.Random(1)
    rows += [(5000 + i, "".join(rng.choice("ab 'sétи日\n\t1.-_") for _ in range(rng.randint(0, 60)))) for i in range(400)]
    df = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, ids string").repartition(5)
    got = {r.doc_id: r.ids for r in E.encoded(df).collect()}
    assert len(got) == len(rows)
    for key, text in rows:
        assert got[key] == ranked.encode_ordinary(text or "") == fast.encode(text or "", add_special_tokens=False).ids


def test_memory_limit_and_repeated_rows(spark, monkeypatch):
    index = E.PairIndex(E.load_merges())
    monkeypatch.setattr(E, "MEMORY_WORDS", 2)
    first = E.encode_texts(["one two three", None, "one"], index)
    again = E.encode_texts(["one two three", None, "one"], index)
    assert [x.tolist() for x in first] == [x.tolist() for x in again]
    df = spark.createDataFrame([(1, "a b"), (1, "a b")], "doc_id long, text string")
    assert E.encoded(df).count() == 2


def test_counts_of_repeated_and_keyless_rows(spark):
    rows = [(1, "a b", "s"), (1, "a b", "s"), (None, "a b", "s"), (2, None, "s"), (3, "", None), (4, "x", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.source: (r.documents, r.without_tokens, r.tokens) for r in E.token_counts(df).collect()}
    assert got == {"s": (4, 1, 6), None: (2, 1, 1)}


def test_decoding_gives_the_texts_back(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.text for r in E.decoded(E.encoded(df)).collect()}
    assert got == {i: t or "" for i, t in enumerate(TEXTS)}
    assert [tuple(r) for r in E.decoded(spark.createDataFrame([(1, None), (2, [])], "doc_id long, ids array<int>")).collect()] == [(1, None), (2, "")]
