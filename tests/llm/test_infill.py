"""Fill-in-the-middle against cuts of plain lists of units."""

import hashlib
import random
import re

import pytest
import zstandard

from tenderlake.llm import infill

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plainly(doc_id, text, rate=50, spm_rate=80):
    text = text or ""
    units = UNIT.findall(text)
    n = len(units)
    h = sha(f"42:{'' if doc_id is None else doc_id}")
    h1, h2, h3, h4 = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    if not n or re.search("<[PSM]>", text) or h3 % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < spm_rate:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def texts():
    draw = random.Random(4)
    signs = ["word", " ", "\n\t", "é", "字", "\U0001f600", "<", "P>", " ", "\x1c"]
    rows = [(i, "".join(draw.choice(signs) for _ in range(draw.randrange(60)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (None, "no id here"), (203, "a <M> b")]
    rows += [(i, " ".join(["long"] * 30_000) + " ") for i in range(300, 306)] + [(310, "x" * 50_000)]
    return rows + rows[:5]


@pytest.mark.parametrize("frame_chars", [5, infill.FRAME_CHARS])
def test_outputs(spark, frame_chars):
    rows = [r for r in texts() if frame_chars > 5 or len(r[1] or "") < 1000]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, output string, n int")
    found = infill.fill_in_middle(df, frame_chars=frame_chars).collect()
    have = sorted((str(r["doc_id"]), r["n"], r["form"], str(r["prefix_chars"]), str(r["middle_chars"]), r["output_sha256"]) for r in found)
    want = []
    for doc_id, text in rows:
        n, form, prefix, middle, output = plainly(doc_id, text)
        want.append((str(doc_id), n, form, str(prefix), str(middle), sha(output)))
    assert have == sorted(want)
    assert {r["form"] for r in found} == {"plain", "psm", "spm"}
    original = {doc_id: sha(text or "") for doc_id, text in rows}
    for r in found:
        assert r["restored_sha256"] == original[r["doc_id"]]
        with zstandard.ZstdDecompressor().stream_reader(bytes(r["output"]), read_across_frames=True) as reader:
            assert hashlib.sha256(reader.read()).hexdigest() == r["output_sha256"]


def test_a_cut_opens_its_own_frame_only():
    text = "".join(f"word{i} " for i in range(20_000))
    frames, units, chars = infill.frames_of(text, 1000)
    stored = infill.Frames(frames, units, chars)
    stream, prefix, middle = infill.arranged(stored, "spm", 5_000, 12_345)
    assert len(frames) > 100 and len(stored.opened) == 2
    assert prefix == len("".join(UNIT.findall(text)[:5_000]))
    assert b"".join(infill.restored(stream, "spm")).decode() == text
    whole = [f for f in frames if f in stream]
    assert len(whole) >= len(frames) - 2


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert infill.fill_in_middle(df).collect() == []
