"""The pipeline's stages, each on its own input and all together."""

import re
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from tenderlake.session import run_folder
from tests.llm.test_jaccard import brute
from tests.llm.test_pii import brute as personal_data

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")


@pytest.fixture(scope="module")
def odd(spark, docs):
    rows = [(None, None, None, None, None), (9001, "", "en", None, 0), (9001, "", "en", None, 0), (9002, None, None, "", 3)]
    return docs.union(spark.createDataFrame(rows, docs.schema))


def test_stages_keep_the_columns_of_documents(spark, odd):
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, odd, FOLDER).columns == odd.columns
        assert stage(spark, odd.limit(0), FOLDER).collect() == []


def test_quality_keeps_what_it_does_not_reject(spark, docs):
    kept = {r["doc_id"] for r in corpus_pipeline.good_quality(spark, docs, FOLDER).collect()}
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{FOLDER}/labels.parquet").collect()}
    right = [(d in kept) == bool(q) for d, q in labels.items()]
    assert sum(right) / len(right) > 0.9


def test_one_of_each_group_stays(spark, odd):
    rows = odd.where("doc_id is not null").dropDuplicates().collect()
    want = {d for d, (_, c) in brute({r["doc_id"]: r["text"] for r in rows}, 5, 80).items() if d == c}
    kept = [r["doc_id"] for r in corpus_pipeline.one_of_each(spark, odd, FOLDER).collect()]
    assert sorted(d for d in kept if d is not None) == sorted(want) and kept.count(None) == 1


def test_texts_that_share_an_id_are_judged_each(spark, docs):
    long = " ".join(f"w{i}" for i in range(60))
    other = " ".join(f"v{i}" for i in range(60))
    rows = [(3, long), (5, long + " end"), (5, other), (5, other), (5, None), (6, other + " end"), (7, "alone")]
    df = spark.createDataFrame([(d, t, "en", None, 0) for d, t in rows], docs.schema)
    kept = sorted((r["doc_id"], r["text"] or "") for r in corpus_pipeline.one_of_each(spark, df, FOLDER).collect())
    # Of the two rows named 5 that are near copies of others, each stands for its own group.
    assert kept == sorted([(5, ""), (5, long + " end"), (5, other), (7, "alone")])


def test_no_personal_data_is_left(spark, odd):
    rows = corpus_pipeline.without_personal_data(spark, odd, FOLDER).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert not personal_data(r["text"])
        assert r["text"] is None or r["n_chars"] == len(r["text"])


def test_mixture_keeps_every_row(spark, odd):
    key = lambda r: str(r["doc_id"])
    mixed = corpus_pipeline.in_mixture(spark, odd, FOLDER).collect()
    assert sorted(mixed, key=key) == sorted(odd.collect(), key=key)


def test_whole_run(spark, docs):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and all(r["round_trip"] for r in rows)
    assert len({r["doc_id"] for r in rows}) == len(rows)
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.TOKENIZER))
    for r in rows[:20]:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        text = library.decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids) and not re.search(r"[a-z]@[a-z]", text)


def test_only_the_last_stage_is_left(spark, docs):
    folder = Path(run_folder(spark))
    before = set(folder.iterdir())
    tokens = corpus_pipeline.run(spark, FOLDER)
    left = [p.name for p in set(folder.iterdir()) - before]
    assert len(left) == 1 and left[0].startswith("stage-mixing")
    assert tokens.count() == spark.read.parquet(str(folder / left[0])).count() > 0
