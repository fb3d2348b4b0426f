"""Quality and toxicity: accuracy on held-out rows, and rows of every odd kind."""

import random

import pytest

from tenderlake.llm import quality, toxicity

SCHEMA = "doc_id long, text string, lang string, score string"


def corpus(kind: str, count: int = 400) -> tuple[list, list]:
    draw = random.Random(7)
    words = ["".join(draw.choice("aeioulnrst") for _ in range(draw.randint(2, 8))) for _ in range(300)]
    documents, labels = [], []
    for i in range(count):
        sentences = [" ".join(draw.choice(words) for _ in range(9)).capitalize() for _ in range(6)]
        bad = i % 3 == 0
        if bad and kind == "quality":
            sentences = [s.replace(" ", "$$$ ").upper() for s in sentences]
        if bad and kind == "toxic":
            sentences[draw.randrange(6)] += draw.choice([" grobnik", " vilnost", " grobnikal"])
        documents.append((i, ". ".join(sentences) + ".", "en", "kept"))
        labels.append((i, int(bad) if kind == "toxic" else int(not bad)))
    return documents, labels


@pytest.fixture(scope="module", params=["quality", "toxic"])
def case(request, spark):
    documents, labels = corpus(request.param)
    documents += [(-1, None, None, None), (-2, "", "", ""), (-3, "x" * 300_000, "", ""), (None, "word", "", "")]
    documents += documents[:2]
    module = quality if request.param == "quality" else toxicity
    tables = (
        spark.createDataFrame(documents, SCHEMA),
        spark.createDataFrame([*labels, *labels[:9], (None, 1), (5000, None)], f"doc_id long, {request.param} int"),
    )
    return module, tables, dict(labels), module.classify(*tables).collect()


def test_held_out_accuracy(case):
    module, _, labels, rows = case
    held = [r for r in rows if r["held_out"]]
    assert len(held) > 40
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in held if r["doc_id"] in labels)
    assert right / sum(r["doc_id"] in labels for r in held) > 0.95


def test_every_row_has_one_score(case):
    _, (documents, _), _, rows = case
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in documents.collect())
    assert all(0 <= r["score"] <= 1 for r in rows)
    by_id = {}
    for r in rows:
        assert by_id.setdefault(r["doc_id"], r["score"]) == r["score"]
    assert by_id[-1] == by_id[-2]
    assert not [r for r in rows if r["doc_id"] is None and r["held_out"]]


def test_fold_follows_the_id(case):
    import zlib

    module, _, _, rows = case
    for r in rows:
        if r["doc_id"] is not None:
            fold = zlib.crc32(str(r["doc_id"]).encode()) % module.FOLDS == module.HELD_OUT
            assert r["held_out"] == fold


def test_no_labels_and_empty_tables(spark, case):
    module, (documents, labels), _, _ = case
    rows = module.classify(documents.limit(3), labels.limit(0)).collect()
    assert len(rows) == 3 and len({r["score"] for r in rows}) == 1
    assert module.classify(documents.limit(0), labels.limit(0)).collect() == []


def test_offending_sentences_are_found(spark):
    documents, labels = corpus("toxic")
    docs = spark.createDataFrame(documents, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    text = "Aa lo ri. Grobnikus ta no. Sa le."
    (row,) = toxicity.score(spark.createDataFrame([(text, 1)], "text string, score int"), model).collect()
    assert [text[s["start"] : s["end"]] for s in row["sentences"]] == [" Grobnikus ta no."]
    assert row["score"] > 0.5


def test_noisy_or_gradient_separates_bags():
    import numpy as np

    ids, sentence, document = np.array([0, 1, 1, 0]), np.array([0, 1, 2, 3]), np.array([0, 0, 1, 2])
    y = np.array([1.0, 0.0, 1.0])
    weights, bias, leak = toxicity.train(ids, sentence, document, y, 2)
    assert weights[0] > 2 and weights[1] < 0 and bias < 0 and 0 < leak < 0.5


def test_very_long_text_is_read_whole(spark):
    documents, labels = corpus("toxic")
    docs = spark.createDataFrame(documents, SCHEMA)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    text = "lo ri. " * 200_000 + "grobnik."
    assert model.judge(text, toxicity.Weights(model.weights))[0] > 0.5
    assert sum(len(p) for p in quality.find_all(quality.TOKEN, text)) == 600_002


def test_words_far_into_a_long_document_are_learned(spark):
    documents, labels = corpus("toxic", 150)
    documents = [(i, "lo ri. " * 1100 + text, lang, score) for i, text, lang, score in documents]
    docs, marks = spark.createDataFrame(documents, SCHEMA), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.fit(docs, marks)
    judge = lambda text: model.judge(text, toxicity.Weights(model.weights))[0]
    assert judge("Aa lo ri. Grobnik ta no.") > 0.5 > judge("Aa lo ri. Ta no.")


def test_bags_hold_every_sentence_and_tasks_give_the_same_slope(spark):
    import numpy as np

    rows = [(i, "no word. " * (i * 300) + "bad one! fine bad. x", i % 2) for i in range(12)] + [(12, "", 0)]
    training = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(3)
    bags = toxicity.bags_of(training, ["bad", "fine"])
    found = {r["doc_id"]: r for r in bags.collect()}
    assert all(found[i]["plain"] == i * 300 + 1 and found[i]["count"] == 2 for i in range(12))
    assert list(found[3]["ids"]) == [0, 0, 1] and list(found[3]["owners"]) == [0, 1, 1] and found[12]["plain"] == 0
    theta = np.array([1.5, -0.5, -6.0, -2.0])
    ids, sentence, document, y, plain = toxicity.unpacked(bags.toArrow())
    whole = toxicity.slope(theta, ids, sentence, document, y, plain, 13)
    assert np.allclose(toxicity.slope_in_tasks(theta, bags, 13), whole)
    listed = np.concatenate([document, np.repeat(np.arange(len(y)), plain.astype(int))])
    assert np.allclose(toxicity.slope(theta, ids, sentence, listed, y, np.zeros(len(y)), 13), whole)
