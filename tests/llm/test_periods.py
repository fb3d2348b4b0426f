"""Runs of words against brute force."""

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from tenderlake.llm import periods, queries


def runs(words, least=24, repeats=3):
    """(start, length, period) of each stretch with a smallest period that nothing continues."""
    n, out = len(words), set()
    for q in range(1, n // repeats + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            own = words[i : j + q]
            long_enough = len(own) >= max(least, repeats * q)
            if j > i and long_enough and not any(own[p:] == own[:-p] for p in range(1, q)):
                out.add((i, len(own), q))
            i = j + 1
    return sorted(out)


def texts(seed, count):
    draw = random.Random(seed)
    out = []
    for _ in range(count):
        words, size = [], draw.choice([0, 5, 60, 200, 300])
        while len(words) < size:
            kind = draw.random()
            if kind < 0.3:
                words.append(draw.choice("abcdefgh"))
            elif kind < 0.6:
                letters = "ab" if draw.random() < 0.7 else "abcdefgh"
                part = [draw.choice(letters) for _ in range(draw.choice([1, 2, 3, 5, 8, 9, 13, 17, 31, 33, 40]))]
                words += (part * 200)[: draw.randrange(1, 150)]
            else:
                words += [str(draw.randrange(50)) for _ in range(draw.randrange(5))]
        out.append([w.encode() for w in words])
    return out


@pytest.mark.parametrize(("least", "repeats"), [(24, 3), (6, 3), (10, 4), (1, 3)])
def test_runs_of_many_texts_at_once(least, repeats):
    for seed in range(60):
        some = texts(seed, 1 + seed % 4)
        first = np.cumsum([0, *map(len, some)])
        found = [[] for _ in some]
        for text, start, length, period in periods.runs_of(*periods.numbered(some), least, repeats).tolist():
            found[text].append((start - first[text], length, period))
        assert found == [runs(words, least, repeats) for words in some]


def test_long_runs():
    part = [b"%d" % i for i in range(1000)]
    words = part * 50 + part[:77]
    assert periods.runs_of(*periods.numbered([[b"x"], words, [b"y"]])).tolist() == [[1, 1, 50_077, 1000]]
    assert periods.runs_of(*periods.numbered([[b"same"] * 100_000])).tolist() == [[0, 0, 100_000, 1]]


def expected(doc_id, text):
    words = [w for w in (text or "").encode().split()]
    crc = zlib.crc32(str(doc_id).encode()) if doc_id is not None else None
    if crc is not None and crc % 10 == 0 and words:
        g, n = crc // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
    found = runs(words)
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    kept = b" ".join(w for i, w in enumerate(words) if i not in gone)
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(found), *row, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


def test_query_against_brute_force(spark, tmp_path):
    rows = [(i, b" ".join(words).decode()) for i, words in enumerate(texts(7, 150))]
    rows += [(500, None), (501, ""), (502, " \n "), (None, "a " * 30), (503, "é  字\x1c é"), (504, "a " * 30), (504, "a " * 30)]
    df = spark.createDataFrame([(d, t, 1, "x") for d, t in rows], "doc_id long, text string, runs int, crc string")
    df.write.parquet(str(tmp_path / "documents.parquet"))
    found = [tuple(r) for r in queries.op13_periods(spark, str(tmp_path)).collect()]
    key = lambda r: tuple(map(str, r))
    assert sorted(found, key=key) == sorted(((d, *expected(d, t)) for d, t in rows), key=key)
    assert any(r[1] for r in found) and len({r[4] for r in found}) > 5


def test_query_on_the_given_table(spark):
    folder = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{folder}/documents.parquet").collect()
    found = {r["doc_id"]: tuple(r)[1:] for r in queries.op13_periods(spark, folder).collect()}
    short = [r for r in rows if len((r["text"] or "").split()) < 400]
    assert len(found) == len(rows) and len(short) > 50
    for r in short:
        assert found[r["doc_id"]] == expected(r["doc_id"], r["text"])


def test_empty_table_and_old_columns(spark):
    df = spark.createDataFrame([(1, "a " * 30, 5)], "doc_id long, text string, runs int")
    (row,) = periods.find_runs(df).collect()
    assert row["collapsed"] == "a" and row["n_words"] == 30 and [tuple(r) for r in row["runs"]] == [(0, 30, 1)]
    assert periods.find_runs(df.limit(0)).collect() == []
