"""Byte-pair coding against the tokenizers library, and exact round trips."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tenderlake.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
SIGNS = "ab  \n\t'stré_²½Ⅷ中文́​\x1c\x85　👍<|endoftext|>019"


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids(encoder, text):
    return np.frombuffer(encoder.encode(text), "<u4").tolist()


def same(encoder, library, text):
    want = library.encode(text, add_special_tokens=False).ids
    return ids(encoder, text) == want


def test_random_texts(vocabulary, library):
    draw, encoder = random.Random(1), bpe.Encoder(vocabulary)
    for size in range(600):
        assert same(encoder, library, "".join(draw.choice(SIGNS) for _ in range(size % 60)))


def test_random_code_points(vocabulary, library):
    draw, encoder = random.Random(2), bpe.Encoder(vocabulary)
    for _ in range(300):
        ranges = [(0x20, 0x3000), (0xA000, 0xD000), (0x1F000, 0x1FA00)]
        text = "".join(chr(draw.randrange(*draw.choice(ranges))) for _ in range(40))
        assert same(encoder, library, text)


def test_special_tokens(vocabulary, library):
    encoder = bpe.Encoder(vocabulary)
    for text in ("<|endoftext|>", "a <|endoftext|> b<|endoftext|>", "<|endoftext", "x\n <|endoftext|>\n y"):
        assert same(encoder, library, text)


def test_lookahead_keeps_long_pieces_exact(vocabulary, library, monkeypatch):
    monkeypatch.setattr(bpe, "STEP_BYTES", 1)
    draw, encoder = random.Random(3), bpe.Encoder(vocabulary)
    for size in range(1, 9):
        parts = ["a", "b", "the", "ing", "er", "aa", "x", "é"][:size]
        assert same(encoder, library, "".join(draw.choice(parts) for _ in range(3000)))


def test_lookahead_of_small_lists():
    assert bpe.sufficient_lookahead([]) == 0
    assert bpe.sufficient_lookahead([(b"a", b"b")]) == 1
    # (b, c) takes b, which frees a of (a, b), which frees x of (x, a).
    assert bpe.sufficient_lookahead([(b"b", b"c"), (b"a", b"b"), (b"x", b"a")]) == 3


def test_both_merge_ways_agree(vocabulary):
    draw, encoder = random.Random(4), bpe.Encoder(vocabulary)
    for _ in range(300):
        data = "".join(draw.choice("theinga e") for _ in range(40)).encode()
        short = encoder.merge_short(data)
        assert short == encoder.merge(data + b"\n" * 60)[: len(short)] or b"".join(short) == data


def test_table_with_odd_rows(spark, library):
    rows = [(1, "plain text", 5), (2, None, 6), (3, "", 7), (4, "né" * 400_000, 8), (1, "plain text", 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    out = bpe.decode(bpe.encode(df, PATH), PATH).collect()
    assert sorted(r["doc_id"] for r in out) == [1, 1, 2, 3, 4]
    for r in out:
        assert r["decoded"] == (r["text"] or "")
        assert np.frombuffer(r["ids"], "<u4").tolist() == library.encode(r["text"] or "", add_special_tokens=False).ids
    assert bpe.encode(df.limit(0), PATH).collect() == []


def test_broken_bytes_decode_as_the_library_does(vocabulary, library):
    draw = random.Random(5)
    for _ in range(200):
        row = [draw.randrange(256) for _ in range(12)]
        packed = np.array(row, "<u4").tobytes()
        assert bpe.decode_ids(packed, vocabulary.pieces) == library.decode(row, skip_special_tokens=False)


def test_query_equals_the_library(spark, library):
    import hashlib

    from tenderlake.llm.queries import op3_bpe

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op3_bpe(spark, folder).collect():
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert r["n_tokens"] == len(want)
        assert r["ids_sha256"] == hashlib.sha256(np.array(want, "<u4").tobytes()).hexdigest()
        text = library.decode(want, skip_special_tokens=False)
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()


def test_one_pass_gives_ids_and_their_text(spark, library):
    """Both columns come from one Python worker, which holds the vocabulary once."""
    rows = [(1, "plain text", 5), (2, None, 6), (3, "", 7), (4, "né" * 400_000, 8), (5, "<|endoftext|> a\ud7ffb \U0001f600", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")
    found = bpe.encode_decode(df, PATH)
    assert found._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    apart = bpe.decode(bpe.encode(df, PATH), PATH)
    assert found.columns == apart.columns
    assert found.orderBy("doc_id").collect() == apart.orderBy("doc_id").collect()
