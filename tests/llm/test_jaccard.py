"""The n-gram join against brute force."""

import random
import re
from pathlib import Path

import pytest

from tenderlake.llm import jaccard
from tenderlake.session import run_folder


def word_sets(texts, words):
    out = {}
    for doc, text in texts.items():
        lowered = (text or "").translate(str.maketrans(jaccard.UPPER, jaccard.LOWER))
        found = re.findall(r"[^\x20\x09-\x0D]+", lowered)
        grams = [tuple(found[i : i + words]) for i in range(len(found) - words + 1)] or ([tuple(found)] if found else [])
        out[doc] = frozenset(grams)
    return out


def brute(texts, words=3, percent=90):
    sets = word_sets(texts, words)
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    docs = sorted(sets)
    for i, a in enumerate(docs):
        for b in docs[i + 1 :]:
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(sets[d]), root(d)) for d in docs}


def near_copies(seed, count=150, length=60, edits=3):
    draw = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    base = [draw.choice(words) for _ in range(length)]
    texts = {}
    for doc in range(count):
        own = list(base) if doc % 3 else [draw.choice(words) for _ in range(length)]
        for _ in range(draw.randint(0, edits)):
            own[draw.randrange(length)] = f"x{draw.randrange(40)}"
        texts[doc] = " ".join(own)
    return texts


def run(spark, texts, words=3, percent=90):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    rows = jaccard.jaccard_components(df, words=words, percent=percent).collect()
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize("seed", [1, 2])
def test_near_copies(spark, seed):
    texts = near_copies(seed)
    assert run(spark, texts) == brute(texts)


def test_combinations_of_frequent_tokens(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FREQUENT_ABOVE", 3)
    texts = near_copies(3)
    assert run(spark, texts) == brute(texts)
    monkeypatch.setattr(jaccard, "COMBINED_SIZE", 55)  # sets on both sides of the limit
    assert run(spark, texts) == brute(texts)


def test_other_shingles_and_threshold(spark):
    texts = near_copies(4, edits=8)
    assert run(spark, texts, 5, 80) == brute(texts, 5, 80)


def test_odd_texts(spark):
    texts = {
        1: None, 2: "", 3: " \t\n", 4: "One two", 5: "one  TWO", 6: "one", 7: "É x y", 8: "é x y",
        9: "a b c", 10: "a b c", -5: "A B C", 11: "word " * 50_000, 12: "word " * 3,
    }
    assert run(spark, texts) == brute(texts)


def test_repeated_rows_missing_ids_and_other_columns(spark):
    rows = [(7, "a b c d", 1), (7, "a b c d", 1), (None, "a b c d", 2), (9, "a b c d", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    found = sorted(map(tuple, jaccard.jaccard_components(df).collect()), key=str)
    assert found == sorted([(7, 2, 7), (7, 2, 7), (None, 2, None), (9, 2, 7)], key=str)
    assert jaccard.jaccard_components(df.limit(0)).collect() == []


def test_long_chain_of_links(spark):
    links = spark.range(1, 400).selectExpr("id as u", "id - 1 as v")
    rows = jaccard.components(links).collect()
    assert len(rows) == 400 and {r["component"] for r in rows} == {0}


def test_query_equals_brute_force(spark):
    from tenderlake.llm.queries import op6_ngram_jaccard_join

    folder = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{folder}/documents.parquet").collect()
    rows = op6_ngram_jaccard_join(spark, folder).collect()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}
    assert got == brute({r["doc_id"]: r["text"] for r in docs})


def test_entries_carry_one_key(spark):
    """An index entry is 32 bytes: of a set's two keys only one goes through the shuffle of the entries."""
    rows = [(i, [i, i + 1, i + 2], 3, i, -i) for i in range(4)]
    sets = spark.createDataFrame(rows, "id long, hashes array<long>, n int, k1 long, k2 long")
    entries = jaccard.index_entries(sets, 60)
    assert sum(f.dataType.simpleString() == "bigint" for f in entries.schema) == 3 and len(entries.columns) == 5
    assert {r["k1"] for r in entries.collect()} == {0, 1, 2, 3}
    lists = jaccard.with_first(entries)
    assert not {c for c in lists.columns if "k2" in c} and lists.count() == 3


def test_sets_and_lists_are_deleted(spark):
    texts = near_copies(7)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    folder = Path(run_folder(spark))
    before = set(folder.iterdir())
    found = jaccard.jaccard_components(df)
    left = [spark.read.parquet(str(p)).columns for p in set(folder.iterdir()) - before]
    assert sorted(left) == [["id", "n", "k1", "k2"], ["k1", "k2", "component"]]
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found.collect()} == brute(texts)
