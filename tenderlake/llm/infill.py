"""Fill-in-the-middle over seekable compressed frames.

A text is stored as independent zstandard frames of at most ``FRAME_CHARS`` code points. Beside each frame stand
two running counts: the units (a word with the white space before it, or the white space at the end) that end up
to there, and the code points. A cut after c units is found by a search in the counts: only the frame in which
that unit ends is decompressed. The output puts the frames into their new order as they are; the two frames with
a cut are split, and sentinels are frames of their own. Frames of zstandard set one after the other are a
zstandard stream, so the output can be read by any reader, and digests read it piece by piece: a long text is
never whole again, neither when it is cut nor when it is checked.

Which texts change, where they are cut and in which order they come follows from a hash of the id alone, so a
repeated run, or a task run again elsewhere, gives the same.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, LongType, StringType, StructField

from tenderlake.llm.common import add_columns, free_name

FRAME_CHARS = 16_384
READ_BYTES = 65_536
LEVEL = 3
SEED, RATE, SPM_RATE = 42, 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
PLAIN, PSM, SPM = "plain", "psm", "spm"


def white(part: str) -> np.ndarray:
    """Which code points are white space: space, and tab to carriage return."""
    if part.isascii():
        codes = np.frombuffer(part.encode(), np.uint8)
    else:
        codes = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), "<u4")
    return (codes == 0x20) | ((codes >= 0x09) & (codes <= 0x0D))


def frames_of(text: str, size: int = FRAME_CHARS) -> tuple[list[bytes], list[int], list[int]]:
    """Frames of a text, and the units and the code points that end up to each frame's end."""
    machine = zstandard.ZstdCompressor(level=LEVEL)
    frames, units, chars, count = [], [], [], 0
    for at in range(0, len(text), size):
        part = text[at : at + size]
        blank, after = white(part), white(text[at + size : at + size + 1])
        count += int(np.count_nonzero(~blank[:-1] & blank[1:]))
        # The frame's last place ends a unit if white space follows a word, or nothing follows.
        count += bool(not blank[-1] and after[0]) if len(after) else 1
        frames.append(machine.compress(part.encode("utf-8", "surrogatepass")))
        units.append(count)
        chars.append(at + len(part))
    return frames, units, chars


class Frames:
    """Stored frames of one text, cut and put in order without decompressing more than the frames with a cut."""

    def __init__(self, frames: list[bytes], units: list[int], chars: list[int]):
        self.frames, self.units, self.chars = frames, units, chars
        self.opened: dict[int, str] = {}

    def open(self, frame: int) -> str:
        if frame not in self.opened:
            data = zstandard.ZstdDecompressor().decompress(self.frames[frame])
            self.opened[frame] = data.decode("utf-8", "surrogatepass")
        return self.opened[frame]

    def seek(self, count: int) -> tuple[int, int]:
        """The frame, and the code points into it, at which unit number ``count`` ends; (0, 0) for none."""
        if not count:
            return 0, 0
        frame = bisect_left(self.units, count)
        blank = white(self.open(frame))
        ends = np.flatnonzero(~blank[:-1] & blank[1:]) + 1
        nth = count - (self.units[frame - 1] if frame else 0) - 1
        return frame, int(ends[nth]) if nth < len(ends) else len(blank)

    def place(self, cut: tuple[int, int]) -> int:
        """Code points before a cut."""
        return (self.chars[cut[0] - 1] if cut[0] else 0) + cut[1]

    def between(self, start: tuple[int, int], stop: tuple[int, int]) -> Iterator[bytes]:
        """Frames of the text between two cuts: whole ones as they are, the outer ones cut."""
        for frame in range(start[0], min(stop[0] + 1, len(self.frames))):
            low = start[1] if frame == start[0] else 0
            high = stop[1] if frame == stop[0] else None
            if not low and high is None:
                yield self.frames[frame]
            elif part := self.open(frame)[low:high]:
                yield compressed(part)


def compressed(part: str) -> bytes:
    return zstandard.ZstdCompressor(level=LEVEL).compress(part.encode("utf-8", "surrogatepass"))


def arranged(stored: Frames, form: str, first: int, second: int) -> tuple[bytes, int, int]:
    """The output as a zstandard stream, and the code points of prefix and middle."""
    if form == PLAIN:
        return b"".join(stored.frames), 0, 0
    start, end = (0, 0), (len(stored.frames), 0)
    a, b = stored.seek(first), stored.seek(second)
    prefix, middle, suffix = stored.between(start, a), stored.between(a, b), stored.between(b, end)
    parts = [(PREFIX, prefix), (SUFFIX, suffix)] if form == PSM else [(SUFFIX, suffix), (PREFIX, prefix)]
    out = []
    for sign, frames in [*parts, (MIDDLE, middle)]:
        out.append(compressed(sign))
        out += frames
    return b"".join(out), stored.place(a), stored.place(b) - stored.place(a)


def read(stream: bytes, start: int = 0, stop: int | None = None) -> Iterator[bytes]:
    """The bytes of a stream from ``start`` up to ``stop``, in small pieces."""
    if not stream:
        return
    at = 0
    with zstandard.ZstdDecompressor().stream_reader(stream, read_across_frames=True) as reader:
        while (stop is None or at < stop) and (piece := reader.read(READ_BYTES)):
            part = piece[max(0, start - at) : None if stop is None else stop - at]
            at += len(piece)
            if part:
                yield part


def find(stream: bytes, sign: bytes, start: int) -> int:
    """Where ``sign`` first stands in a stream from ``start`` on."""
    at, carried = start, b""
    for piece in read(stream, start):
        window = carried + piece
        if (found := window.find(sign)) >= 0:
            return at - len(carried) + found
        at += len(piece)
        carried = window[-(len(sign) - 1) :]
    raise ValueError(f"no {sign.decode()} in the output")


def restored(stream: bytes, form: str) -> Iterator[bytes]:
    """The original text from output and form. No sentinel stands in the text, so each is found where it was put."""
    if form == PLAIN:
        yield from read(stream)
        return
    signs = [PREFIX, SUFFIX, MIDDLE] if form == PSM else [SUFFIX, PREFIX, MIDDLE]
    starts, at = {}, 0
    for sign in map(str.encode, signs):
        starts[sign.decode()] = at = find(stream, sign, at)
        at += len(sign)
    ends = dict(zip(signs, [*(starts[s] for s in signs[1:]), None], strict=True))
    for sign in (PREFIX, MIDDLE, SUFFIX):
        yield from read(stream, starts[sign] + len(sign), ends[sign])


def digest(pieces: Iterator[bytes]) -> str:
    state = hashlib.sha256()
    for piece in pieces:
        state.update(piece)
    return state.hexdigest()


def store_frames(df: DataFrame, text: str = "text", *, frame_chars: int = FRAME_CHARS) -> DataFrame:
    """Replace ``text`` by ``frames``, ``frame_units`` and ``frame_chars`` (running counts), ``n`` (its units) and
    ``has_sentinel``. NULL counts as empty; an empty text has no frames. Columns of these names are replaced."""

    def prepare():
        def store(texts: list) -> list[list]:
            rows = [frames_of(t or "", frame_chars) for t in texts]
            marked = [any(s in t for s in (PREFIX, SUFFIX, MIDDLE)) if t else False for t in texts]
            return [*([r[i] for r in rows] for i in range(3)), [r[1][-1] if r[1] else 0 for r in rows], marked]

        return store

    fields = [
        StructField("frames", ArrayType(BinaryType())),
        StructField("frame_units", ArrayType(LongType())),
        StructField("frame_chars", ArrayType(LongType())),
        StructField("n", LongType()),
        StructField("has_sentinel", BooleanType()),
    ]
    return add_columns(df, text, fields, prepare).drop(text)


def choices(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four whole numbers drawn from an id; a NULL id counts as empty text."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(hashed, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", seed: int = SEED, rate: int = RATE,
    spm_rate: int = SPM_RATE, frame_chars: int = FRAME_CHARS,
) -> DataFrame:
    """Per row the id, ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output`` (the new text as a
    zstandard stream of frames), and ``output_sha256`` and ``restored_sha256`` of output and rebuilt text.

    ``rate`` of 100 texts change, ``spm_rate`` of 100 of these with the suffix first. NULL texts count as empty;
    empty texts and those that hold a sentinel stay plain, with NULL for the two lengths. Rows with equal id and
    text give equal rows each; an empty table stays empty; other columns are not read, so their names may clash.
    """
    key, content = free_name(df, "row_id", "row_text")
    stored = store_frames(df.select(F.col(doc_id).alias(key), F.col(text).alias(content)), content, frame_chars=frame_chars)
    h1, h2, h3, h4 = choices(F.col(key), seed)
    over = F.col("n") + 1
    form = (
        F.when((F.col("n") == 0) | F.col("has_sentinel") | (h3 % 100 >= rate), PLAIN)
        .when(h4 % 100 < spm_rate, SPM)
        .otherwise(PSM)
    )
    chosen = stored.withColumns(
        {"form": form, "first_cut": F.least(h1 % over, h2 % over), "second_cut": F.greatest(h1 % over, h2 % over)}
    )

    def prepare():
        def arrange(*columns: list) -> list[list]:
            out: list[list] = [[], [], [], [], []]
            for frames, units, chars, form, first, second in zip(*columns, strict=True):
                stream, prefix, middle = arranged(Frames(frames, units, chars), form, first, second)
                changed = form != PLAIN
                hashed = digest(read(stream))
                again = digest(restored(stream, form)) if changed else hashed
                values = (stream, prefix if changed else None, middle if changed else None, hashed, again)
                for column, value in zip(out, values, strict=True):
                    column.append(value)
            return out

        return arrange

    fields = [
        StructField("output", BinaryType()),
        StructField("prefix_chars", LongType()),
        StructField("middle_chars", LongType()),
        StructField("output_sha256", StringType()),
        StructField("restored_sha256", StringType()),
    ]
    sources = ["frames", "frame_units", "frame_chars", "form", "first_cut", "second_cut"]
    made = add_columns(chosen, sources, fields, prepare)
    return made.select(
        F.col(key).alias(doc_id), "n", "form", "prefix_chars", "middle_chars", "output", "output_sha256", "restored_sha256"
    )


# Cuts of the same texts by lists of units.
ORACLE_SQL = r"""
WITH t AS (
    SELECT doc_id, coalesce(text, '') AS text,
           regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units,
           sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
    FROM documents
), drawn AS (
    SELECT *, len(units)::BIGINT AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2,
           ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4
    FROM t
), parts AS (
    SELECT *, array_to_string(units[1:least(h1 % (n + 1), h2 % (n + 1))], '') AS p,
           array_to_string(units[least(h1 % (n + 1), h2 % (n + 1)) + 1:greatest(h1 % (n + 1), h2 % (n + 1))], '') AS m,
           array_to_string(units[greatest(h1 % (n + 1), h2 % (n + 1)) + 1:], '') AS s,
           CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50
                THEN 'plain' WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
    FROM drawn
)
SELECT doc_id, n, form,
       CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text
                        WHEN 'psm' THEN concat('<P>', p, '<S>', s, '<M>', m)
                        ELSE concat('<S>', s, '<P>', p, '<M>', m) END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM parts
"""
