"""Tables by manifests: all of an append or nothing, merges, claims."""

import pytest
from pyspark.sql import functions as F

from tenderlake.sources import tables
from tenderlake.sources.claims import Claims
from tenderlake.sources.results import append_new
from tenderlake.sources.tables import LogTable


def rows(spark, start, stop, scrapers=3):
    return spark.range(start, stop).select(
        F.concat(F.lit("s"), F.col("id") % scrapers).alias("scraper"), F.col("id").cast("string").alias("_hash")
    )


def table(spark, tmp_path):
    return LogTable(spark, str(tmp_path / "t"), rows(spark, 0, 1).schema)


def test_an_append_that_ends_early_is_not_seen(spark, tmp_path, monkeypatch):
    own, path = table(spark, tmp_path), str(tmp_path / "t")
    append_new(rows(spark, 0, 10), path)
    with monkeypatch.context() as broken:
        broken.setattr(LogTable, "_commit", lambda *_: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError):
            append_new(rows(spark, 0, 20), path)
    assert own.read().count() == 10 and len(list((tmp_path / "t" / "data").iterdir())) == 2
    append_new(rows(spark, 0, 20), path)
    append_new(rows(spark, 0, 20), path)
    assert sorted(int(r[0]) for r in own.read().select("_hash").collect()) == list(range(20))


def test_a_manifest_that_was_never_finished_counts_for_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "UNFINISHED_SECONDS", 0.2)
    own = table(spark, tmp_path)
    own.append(lambda _: rows(spark, 0, 5))
    (tmp_path / "t" / "manifests" / f"{2:012d}.json").write_text('{"parts"')
    assert own.read().count() == 5
    own.append(lambda _: rows(spark, 5, 9))
    assert own.read().count() == 9 and own.state()[0] >= 3


def test_the_second_of_two_writers_starts_anew(spark, tmp_path):
    one, other = table(spark, tmp_path), table(spark, tmp_path)
    seen = []

    def make(stored):
        seen.append(stored.count())
        if len(seen) == 1:
            other.append(lambda _: rows(spark, 0, 4))
        return rows(spark, 4, 6)

    assert one.append(make)
    assert seen == [0, 4] and one.read().count() == 6


def test_batches_count_once_and_parts_stay_few(spark, tmp_path, monkeypatch):
    own = table(spark, tmp_path)
    most = []
    for number in range(20):
        for _ in range(2):
            own.append(lambda _, n=number: rows(spark, 10 * n, 10 * n + 10), f"run/{number}")
        parts = own.state()[1]["parts"]
        most.append(len(parts))
    assert own.read().count() == 200 and max(most) <= tables.MOST_DELTAS + 1
    assert sum(p["rows"] for p in parts) == 200
    # Replaced parts go once no manifest that is kept names them.
    assert len(list((tmp_path / "t" / "data").iterdir())) <= 2 * tables.MOST_DELTAS
    monkeypatch.setattr(tables, "ROWS_PER_BUCKET", 50)
    own.append(lambda _: rows(spark, 200, 500, 20))
    assert own.read().count() == 500
    (base,) = own.state()[1]["parts"]
    assert base["buckets"] == 16 and own.read().count() == 500
    few = tables.pruned(own.read(), rows(spark, 0, 1).limit(1))
    assert few.columns == ["scraper", "_hash"]
    files = lambda df: df.select(F.input_file_name()).distinct().count()
    assert files(few) == 1 < files(own.read())
    assert few.filter("scraper = 's0'").count() == own.read().filter("scraper = 's0'").count()


def test_nothing_appended(spark, tmp_path):
    own = table(spark, tmp_path)
    assert own.read().count() == 0
    own.append(lambda _: rows(spark, 0, 0))
    assert own.read().count() == 0 and own.append(lambda _: rows(spark, 0, 3))


def test_claims(spark, tmp_path):
    at = lambda hour: F.lit(f"2024-01-01 {hour:02d}:00:00").cast("timestamp_ntz")
    claims = Claims(spark, str(tmp_path / "claims"))
    ids = lambda *names: spark.createDataFrame([(n,) for n in names], "id string")
    got = lambda df: sorted(r.id for r in df.collect())
    assert got(claims.claim(ids("a", "b", "7", None, "a"), "one", at(6), 3600)) == ["a", "b"]
    assert got(claims.claim(ids("b", "c"), "two", at(6), 3600)) == ["c"]
    assert got(claims.claim(ids("a"), "one", at(6), 7200)) == ["a"]  # asking again prolongs
    assert got(claims.claim(ids("a", "b"), "three", at(7), 3600)) == ["b"]  # the term of b is over
    claims.release("one")
    assert sorted((r.scraper, r.run) for r in claims.live(at(6)).collect()) == [("b", "three")]
    assert got(claims.claim(ids("a"), "four", at(7))) == ["a"]
