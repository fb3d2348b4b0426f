"""Personal data: base spans against Python's patterns, added spans, redaction."""

import hashlib
import re

from tenderlake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ODD = [
    "a@b.cd_x@e.f 1.2.3.4.5.6.7.8 1.2.3.999.4.5.6.7", "x@y.z@w.v a.b@c", "0001.2.3.256 +12345678+123456789",
    "5 4111111111111111", "4111 1111 1111 1111-1", "4111 1111 1111 1111", "12--4111111111111111", "é@b.co ü+49 (30) 1234567",
    "+1 (017) 555-7713 4536784127813050", "", None, "1.2.3.4@a.b 00004111111111111111", "+1(((((((((2", "a" * 20_000 + "@b.c",
    "1" * 20_000, "@" * 500, "4111111111111111 " * 40,
]


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(part) <= 255 for part in value.split("."))
    if kind == "phone":
        return 9 <= len(digits) <= 15
    if kind == "card":
        total = sum(sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(reversed(digits)))
        return 13 <= len(digits) <= 19 and total % 10 == 0
    return True


def brute(text):
    return [
        (kind, m.start(), m.end())
        for kind, pattern in PATTERNS.items()
        for m in re.finditer(pattern, text or "")
        if valid(kind, m.group())
    ]


def table(spark, texts):
    return spark.createDataFrame([(i, t, 0) for i, t in enumerate(texts)], "doc_id long, text string, spans int")


def test_base_spans_of_odd_texts(spark):
    for r in pii.find_personal_data(table(spark, [*ODD, ODD[0]])).collect():
        assert [(s["kind"], s["start"], s["end"]) for s in r["spans"] if s["base"]] == brute(r["text"])


def test_spans_that_the_trees_add(spark):
    cards = [f"pay 41111111111111{a}{b} now" for a in range(10) for b in range(10)]
    rows = pii.find_personal_data(table(spark, cards * 3 + ["call +1 (269) 555-3296 4524132264652876 and"])).collect()
    added = [r["text"][s["start"] : s["end"]] for r in rows for s in r["spans"] if not s["base"]]
    assert "4524132264652876" in added
    assert all(valid("card", a) for a in added)


def test_clean_texts_stay_clean(spark):
    texts = ["Plain words only.", "Version 3.4 of 2024, page 12-15", "at (noon) we meet"] + ["mail me@a.bc"] * 30
    for r in pii.find_personal_data(table(spark, texts)).collect():
        assert [s for s in r["spans"] if not s["base"]] == []


def test_redaction(spark):
    texts = ["é me@a.bc, 10.0.0.1!", "+1 (269) 555-3296 and 4524132264652876", None, "nothing"]
    rows = pii.redact(pii.find_personal_data(table(spark, texts))).orderBy("doc_id").collect()
    assert rows[0]["text"] == "é [EMAIL], [IP]!"
    assert not re.search("[0-9]{9}", rows[1]["text"])
    assert [rows[2]["text"], rows[3]["text"]] == [None, "nothing"]


def test_empty_table(spark):
    assert pii.find_personal_data(table(spark, ["x"]).limit(0)).collect() == []


def test_boosted_trees_learn_and_calibrate():
    blank = dict.fromkeys(pii.FEATURES, 0)
    cells = [
        {**blank, "kind": 2, "sum_ok": ok, "before": b, "ones": 90 if ok else 0, "zeros": 0 if ok else 90}
        for ok in (0, 1)
        for b in (0, 1, 2)
    ]
    model = pii.fit(cells)
    assert 2 in model.thresholds and len(model.trees) == 40
    assert pii.fit([]).thresholds == {}


def test_query_equals_brute_force(spark):
    from tenderlake.llm.queries import op9_pii

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    for r in op9_pii(spark, folder).collect():
        spans = brute(texts[r["doc_id"]])
        for kind in pii.KINDS:
            assert r[f"n_{kind}"] == sum(k == kind for k, _, _ in spans)
        joined = ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
        assert r["base_sha256"] == hashlib.sha256(joined.encode()).hexdigest()
        assert set(filter(None, joined.split(","))) <= set(r["spans"].split(","))
