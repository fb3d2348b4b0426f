"""Packing: ids against the library, places without gaps, bounds against exhaustive packings."""

import random
import zlib
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tenderlake.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def ids_of(library, text, end=0):
    return [*library.encode(text or "", add_special_tokens=False).ids, end]


def test_ids_are_the_librarys(library):
    with open(PATH, encoding="utf-8") as file:
        words = packing.Words(file.read())
    draw = random.Random(3)
    signs = ["a", "B", "é", "İ", "ß", "Σ", "'s", "'LL", "1", "²", "½", "_", "-", "..", "\xad", "\xa0", "\x85", "\x1c",
             "\x00", "́", "é", "字", "ｱ", "\U0001f600", "<|endoftext|>", "<|", "ª", "ʰ", " ", "\n", "Å"]
    for _ in range(3000):
        text = "".join(draw.choice(signs) for _ in range(draw.randrange(1, 9)))
        own = b"".join(map(words.__getitem__, text.encode().split()))
        assert np.frombuffer(own, "<u4").tolist() == ids_of(library, text)[:-1], repr(text)


def test_known_words_are_forgotten_in_generations(monkeypatch):
    monkeypatch.setattr(packing, "CACHE_WORDS", 3)
    with open(PATH, encoding="utf-8") as file:
        words = packing.Words(file.read())
    for word in [b"one", b"two", b"three", b"four", b"one", b"five", b"six", b"x" * 500]:
        assert words[word] == words.ids(word)
        assert len(words) <= 3 and len(words.before) <= 3


def check_places(rows, capacity):
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by_sequence)


def test_pieces_and_packing(spark, library):
    long = " ".join(f"word{i % 77}" for i in range(3000))
    rows = [(1, None), (2, ""), (3, "some words"), (3, "some words"), (None, "no id"), (4, long), (5, "a" * 9000)]
    df = spark.createDataFrame([(d, t, 1, 2) for d, t in rows], "doc_id long, text string, piece int, sequence_id int")
    found = packing.pack(packing.pieces(df, PATH)).collect()
    check_places(found, packing.CAPACITY)
    for doc, text in rows:
        ids = ids_of(library, text)
        own = [r for r in found if r["doc_id"] == doc]
        repeats = sum(d == doc for d, _ in rows)
        starts = sorted((r["piece"], r["start"], r["length"], bytes(r["ids"])) for r in own)[::repeats]
        assert [s for _, s, _, _ in starts] == list(range(0, len(ids), packing.CAPACITY))
        assert np.frombuffer(b"".join(s[-1] for s in starts), "<u4").tolist() == ids
        assert [p for p, *_ in starts] == list(range(len(starts)))
    assert packing.pack(packing.pieces(df.limit(0), PATH)).collect() == []


def test_lengths_that_cannot_be_packed(spark):
    df = spark.createDataFrame([(None,), (0,), (-3,), (9,), (8,), (5,), (3,), (8,)], "length int")
    rows = packing.pack(df, capacity=8).collect()
    assert all((r["sequence_id"] is None) == (r["offset"] is None) == (r["length"] not in range(1, 9)) for r in rows)
    assert check_places([r for r in rows if r["sequence_id"] is not None], 8) == 3
    assert packing.pack(spark.createDataFrame([(8,), (8,)], "length int"), capacity=8).count() == 2


def fewest(lengths, capacity):
    """Fewest sequences, by trying everything."""

    @lru_cache(None)
    def place(rest, spaces):
        if not rest:
            return 0
        best = 1 + place(rest[1:], tuple(sorted((*spaces, capacity - rest[0]))))
        for i, space in enumerate(spaces):
            if space >= rest[0] and space not in spaces[:i]:
                best = min(best, place(rest[1:], tuple(sorted((*spaces[:i], space - rest[0], *spaces[i + 1 :])))))
        return best

    return place(tuple(sorted(lengths, reverse=True)), ())


def test_bounds_hold():
    draw = random.Random(9)
    tight = 0
    for _ in range(150):
        capacity = draw.choice([10, 13, 24])
        lengths = [draw.randint(1, capacity) for _ in range(draw.randint(1, 8))]
        bound = packing.lower_bound(np.bincount(lengths, minlength=capacity + 1), capacity)
        best = fewest(lengths, capacity)
        assert bound <= best
        tight += bound == best
        sequence, place, fill = packing.best_fit(np.array(lengths), capacity)
        assert len(fill) >= best and fill.sum() == sum(lengths)
        sequence, place, fill = packing.fullest(np.array(lengths), capacity)
        assert len(fill) >= best and fill.sum() == sum(lengths) and fill.max() <= capacity
        assert np.bincount(sequence, lengths).tolist() == fill.tolist()
    assert tight > 130


def test_partitions_exchange_what_does_not_fit(spark):
    # Pairs of 5 and 7 fill 12: many small partitions leave some without a partner, rounds bring them together.
    draw = random.Random(2)
    lengths = [5, 7] * 400
    draw.shuffle(lengths)
    df = spark.createDataFrame([(x,) for x in lengths], "length int")
    once = sum(
        len(packing.best_fit(np.array(lengths[i : i + 20]), 12)[2]) for i in range(0, len(lengths), 20)
    )
    used = check_places(packing.pack(df, capacity=12, per_partition=20).collect(), 12)
    assert 400 <= used < once and used <= 405


def test_query(spark, library):
    folder = "/root/testdata/sf0.001"
    rows = queries.op12_packing(spark, folder).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    used = check_places(rows, packing.CAPACITY)
    total = 0
    for r in rows:
        ids = ids_of(library, texts[r["doc_id"]])[r["start"] : r["start"] + packing.CAPACITY]
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes()) and r["length"] == len(ids)
        assert r["start"] == r["piece"] * packing.CAPACITY
        total += len(ids)
    assert sum(len(ids_of(library, t)) for t in texts.values()) == total
    counts = np.bincount([r["length"] for r in rows], minlength=packing.CAPACITY + 1)
    assert used <= packing.lower_bound(counts, packing.CAPACITY) + 1
