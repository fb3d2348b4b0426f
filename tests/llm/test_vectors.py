"""Vector searches against brute force."""

import math

import numpy as np
import pytest

from tenderlake.llm import neighbours, topk

SCHEMA = "vec_id long, embedding array<float>, score string"
NAN = float("nan")


def rows_of(count=1500, dims=12, seed=2):
    draw = np.random.RandomState(seed)
    centres = draw.randn(8, dims)
    return [(i, (centres[i % 8] + 0.4 * draw.randn(dims)).astype(np.float32).tolist(), "") for i in range(count)]


ODD = [(2000, None, ""), (2100, [0.0] * 12, ""), (2200, [None] * 12, ""), (2300, [NAN] * 12, ""), (None, [1.0] * 12, "")]


def best(rows, score, every=100, k=10):
    out = {}
    for query, q, *_ in rows:
        if query % every == 0:
            found = sorted((score(q, v), i) for i, v, *_ in rows if i != query)[:k]
            out[query] = found
    return out


def product(q, v):
    return -sum(math.floor(1024 * a) * math.floor(1024 * b) for a, b in zip(q, v, strict=False))


def by_query(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r)
        assert r["rank"] == len(out[r["query_id"]])
    return out


@pytest.mark.parametrize("block", [8192, 200])
def test_products_are_exact(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "ROWS_PER_BLOCK", block)
    monkeypatch.setattr(topk, "QUERIES_PER_BLOCK", 4)
    rows = rows_of()
    rows += [(i, rows[0][1], "") for i in range(1600, 1640)]  # ties
    df = spark.createDataFrame(rows + rows[:3] + ODD, SCHEMA)
    got = by_query(topk.top_products(df).collect())
    zero = (2100, [0.0] * 12, "")
    want = best([*rows, zero], product)
    assert {q: [(-r["score"], r["vec_id"]) for r in found] for q, found in got.items()} == want


def test_products_beyond_doubles(spark):
    big = float(2**40)
    rows = [(0, [big, 1.0], ""), (1, [big, 3.0], ""), (2, [big, 2.0], ""), (100, [-big], "")]
    got = by_query(topk.top_products(spark.createDataFrame(rows, SCHEMA)).collect())
    assert [r["vec_id"] for r in got[0]] == [1, 2, 100]
    assert got[0][0]["score"] == 2**63 - 1 and got[0][2]["score"] == -(2**63)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame(rows_of(3), SCHEMA)
    for search in (topk.top_products, neighbours.nearest_neighbours):
        assert [len(v) for v in by_query(search(df).collect()).values()] == [2]
        assert search(df.limit(0)).collect() == []
        assert search(df.where("vec_id = 1")).collect() == []


def test_neighbours_recall_and_distances(spark):
    rows = rows_of()
    rows += [(i, rows[0][1], "") for i in range(1600, 1640)]  # copies of a query
    odd_length = (2500, [1.0, 2.0], "")
    df = spark.createDataFrame([*rows, *rows[:3], *ODD, odd_length], SCHEMA)
    got = by_query(neighbours.nearest_neighbours(df).collect())
    want = best(rows, lambda q, v: math.dist(q, v))
    assert set(got) == set(want)
    vectors = {i: v for i, v, _ in rows}
    hits = 0
    for query, found in got.items():
        assert len(found) == 10 and len({r["vec_id"] for r in found}) == 10
        for r in found:
            assert r["score"] == pytest.approx(math.dist(vectors[query], vectors[r["vec_id"]]), abs=1e-12)
        assert [(r["score"], r["vec_id"]) for r in found] == sorted((r["score"], r["vec_id"]) for r in found)
        hits += len({r["vec_id"] for r in found} & {i for _, i in want[query]})
    assert hits >= 0.9 * 10 * len(want)
    assert [r["vec_id"] for r in got[0]] == list(range(1600, 1610))


def test_chunks_of_a_hot_list(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "ROWS_PER_CHUNK", 50)
    monkeypatch.setattr(neighbours, "QUERIES_PER_CHUNK", 2)
    rows = [(i, [1.0, 2.0], "") for i in range(400)]
    got = by_query(neighbours.nearest_neighbours(spark.createDataFrame(rows, SCHEMA)).collect())
    assert {q: [r["vec_id"] for r in v] for q, v in got.items()} == {
        q: [i for i in range(11) if i != q][:10] for q in (0, 100, 200, 300)
    }


def test_lists_are_balanced():
    points = np.random.RandomState(0).randn(1000, 5)
    sizes = [len(p) for p in neighbours.halves(points, 64)]
    assert sum(sizes) == 1000 and max(sizes) <= 64 and min(sizes) >= 31
    assert len(neighbours.halves(np.ones((300, 3)), 64)) == 8


def test_graph_search_finds_the_nearest():
    draw = np.random.RandomState(1)
    index = neighbours.Index(draw.randn(4000, 6))
    x = draw.randn(100, 6)
    places, _ = index.nearest(x, 16)
    true = neighbours.squared(x, index.centroids).argmin(1)
    assert (places[:, 0] == true).mean() > 0.95


@pytest.mark.parametrize("name", ["op2_neighbours", "op5_topk"])
def test_queries_against_brute_force(spark, name):
    from tenderlake.llm.queries import QUERIES

    folder = "/root/testdata/sf0.001"
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    got = by_query(QUERIES[name](spark, folder).collect())
    want = best(rows, product if name == "op5_topk" else (lambda q, v: math.dist(q, v)))
    assert set(got) == set(want)
    hits = sum(len({r["vec_id"] for r in got[q]} & {i for _, i in want[q]}) for q in want)
    assert hits >= (1.0 if name == "op5_topk" else 0.9) * sum(map(len, want.values()))
