"""The mixture: every row once, deadlines kept, less than one block from the weights."""

import random
from collections import Counter, defaultdict

from tenderlake.llm import mixing

SCHEMA = "doc_id long, text string, source string, slot string"


def rows_of(count=600):
    draw = random.Random(1)
    sources = ["hot"] * 6 + ["b", "c", None, ""]
    return [(i, "x" * draw.randint(0, 90), draw.choice(sources), "kept?") for i in range(count)]


def test_windows_and_lag(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    rows = mixing.mix(df, block_size=200, period=20).collect()
    assert sorted(r["doc_id"] for r in rows) == list(range(600))
    assert all(r["release"] <= r["slot"] < r["deadline"] for r in rows)
    blocks = {(r["source"] or "", r["block"]): r["slot"] for r in rows}
    assert len(set(blocks.values())) == len(blocks)


def test_less_than_one_block_from_the_share(spark):
    totals = spark.createDataFrame([("a", 900), ("b", 100), ("c", 49), ("d", 0)], "name string, size long")
    slots = sorted(mixing.pattern(mixing.quotas(totals, {"a": 0.5, "b": 0.3, "c": 0.2}, 37)).collect(), key=lambda r: r["slot"])
    period = slots[0]["m"]
    assert [r["slot"] for r in slots] == list(range(period))
    done = Counter()
    for r in slots:
        assert r["j"] == done[r["name"]]
        done[r["name"]] += 1
        for other in slots:
            assert abs(done[other["name"]] - other["n"] * (r["slot"] + 1) / period) < 1


def test_starts_add_up_per_source(spark):
    df = spark.createDataFrame(rows_of(), SCHEMA)
    by_source = defaultdict(list)
    for r in mixing.mix(df, block_size=200, period=20).collect():
        by_source[r["source"] or ""].append((r["start"], len(r["text"])))
    for rows in by_source.values():
        at = 0
        for start, size in sorted(rows):
            assert start == at
            at += size


def test_repeated_rows_missing_values_and_empty_table(spark):
    rows = [(1, "aa", "s", ""), (1, "aa", "s", ""), (None, None, None, None), (2, "", "t", "")]
    df = spark.createDataFrame(rows, SCHEMA)
    assert len(mixing.mix(df).collect()) == 4
    assert mixing.mix(df.limit(0)).collect() == []


def test_rows_and_files_in_order(spark, tmp_path):
    df = spark.createDataFrame(rows_of(), SCHEMA).drop("slot")
    mixed = mixing.mix(df, block_size=200, period=20)
    want = [r["doc_id"] for r in mixed.orderBy("slot", "start", "doc_id").collect()]
    ordered = mixing.in_mixture_order(mixed, df.columns, 5)
    starts = [(r["slot"], r["start"], r["doc_id"]) for r in mixed.collect()]
    assert [r["doc_id"] for r in ordered.collect()] == want == [d for _, _, d in sorted(starts)]
