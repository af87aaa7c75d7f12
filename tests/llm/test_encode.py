import base64
import os

import numpy as np
import pytest

from sitequarry.llm import encode as E

pytestmark = pytest.mark.skipif(not os.path.exists(E.VOCABULARY), reason="no vocabulary files here")


def reference(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return [x.ids for x in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_lexicon_finds_what_it_holds():
    words = {w.encode(): [i, i + 1][: 1 + i % 2] for i, w in enumerate(["a", "ab", "abc", "bc", "层", "层板", " the", " then"])}
    lex = E.compile_lexicon(words)
    order = sorted(words)
    probe = order + [b"", b"b", b"abcd", b"zz"]
    data, at = np.frombuffer(b"".join(probe), np.uint8), np.cumsum([0, *map(len, probe)])
    got = E.find_words(lex, data, at[:-1], at[1:])
    assert got.tolist() == list(range(len(order))) + [-1] * 4
    assert [lex["ids"][lex["start"][i] : lex["start"][i + 1]].tolist() for i in range(len(order))] == [words[w] for w in order]
    # suffixes are shared: fewer transitions than letters
    assert len(E.compile_lexicon({b"xing": [1], b"ying": [2], b"zing": [3]})["arc"]) == 6


@pytest.mark.parametrize("size", [1, 50_000])
def test_odd_texts(spark, size):
    texts = ["a​b    c　\x1c d\x85e  \n\n  x", "'s 'S don't I'LL ''ll", "١٢ ²⅕ 😀👨‍👩", "<|endoftext|> x", "�﻿ a", None, "", " ", "é" * 3000, "same", "same", "long " * 20_000]
    df = spark.createDataFrame([(i, x, 1) for i, x in enumerate(texts)], "doc_id long, text string, ids int")
    got = {r.doc_id: list(r.ids) for r in E.encode(df, lexicon_words=size).collect()}
    assert [got[i] for i in range(len(texts))] == reference(texts)


def test_round_trip(spark):
    import tiktoken

    with open(E.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("own", pat_str=r".", mergeable_ranks=ranks, special_tokens={})
    text = "第3层 KL-7(1) façade\r\n\t– Φ28 тест"
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert enc.decode(E.encode(df).first().ids) == text
    assert E.encode(spark.createDataFrame([], "doc_id long, text string")).count() == 0
