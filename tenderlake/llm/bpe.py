"""Byte-pair encoding as a streaming transducer with bounded lookahead, and incremental decoding.

A merge list decides how far text on the right can still change tokens on the left. Compare the merge
process on a text with the process on the same text continued: both agree up to the end of the shorter
one, until a merge (a, b) takes the last agreed token a into the continuation. From then on they agree
only up to where a began. The next such merge (a', b') has a higher rank, and its right part begins with
a. So the agreed end moves left along a chain of merges of rising rank, each paying the length of its left
part; the costliest chain is the sufficient lookahead (``sufficient_lookahead``). A token that ends at
least that many bytes before the end of what was read is final and is emitted; and as no merge ever
crosses a final boundary, encoding goes on from there without anything on its left. One window of
lookahead plus a fixed step is all that is held, however long a piece of text without white space is.

Texts are cut into pieces by the vocabulary's pattern first, and special tokens stand for themselves.
"""

from __future__ import annotations

import codecs
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import BinaryType, StringType, StructField

from tenderlake.llm.common import add_columns

CACHE_WORDS = 400_000
STEP_BYTES = 4096
SHORT_BYTES = 48
WHOLE_TEXT = 1_000_000
PIECES_AT_ONCE = 65_536

# Fixed: white space as Unicode defines it.
WHITE = "".join(map(chr, [*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 bytes stand for
    themselves, the others take the code points from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranges(points: list[int]) -> str:
    out, start = [], None
    for i, p in enumerate(points):
        start = p if start is None else start
        if i + 1 == len(points) or points[i + 1] != p + 1:
            out.append(f"{re.escape(chr(start))}-{re.escape(chr(p))}")
            start = None
    return "".join(out)


def piece_pattern(limit: int = sys.maxunicode + 1) -> str:
    """The byte-level pattern, for Python's ``re``: contractions, letters, numbers, other signs, white space.

    Each class is spelled out as ranges of code points below ``limit``. Up to 65,536 ``re`` turns a class
    into one table lookup, so texts without higher code points get a pattern of their own.
    """
    white = {ord(c) for c in WHITE}
    points: dict[str, list[int]] = {"L": [], "N": [], "": []}
    for p in range(limit):
        kind = unicodedata.category(chr(p))[0]
        if p not in white:
            points[kind if kind in "LN" else ""].append(p)
    letter, number, sign = (_ranges(points[kind]) for kind in ("L", "N", ""))
    space = re.escape(WHITE)
    return (
        rf" ?[{letter}]+|'s|'t|'re|'ve|'m|'ll|'d"
        rf"| ?[{number}]+| ?[{sign}]+|[{space}]+(?![^{space}])|[{space}]+"
    )


def sufficient_lookahead(merges: list[tuple[bytes, bytes]]) -> int:
    """Bytes of continuation after which no token further left can change (see the module's text)."""
    longest: dict[bytes, int] = {}
    most = 0
    for left, right in reversed(merges):
        chain = len(left) + longest.get(left, 0)
        most = max(most, chain)
        for end in range(1, len(right) + 1):
            if longest.get(right[:end], 0) < chain:
                longest[right[:end]] = chain
    return most


class Vocabulary:
    """Merges, ids and special tokens of a byte-level BPE file; its size is that of the file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        as_bytes = lambda text: bytes(letters[c] for c in text)
        merges = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.ids = {as_bytes(text): i for text, i in spec["model"]["vocab"].items()}
        pairs = [(as_bytes(a), as_bytes(b)) for a, b in merges]
        self.ranks = {pair: i for i, pair in enumerate(pairs)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.lookahead = sufficient_lookahead(pairs)
        self.longest = max(map(len, self.ids))
        self.pattern, self.low_pattern = piece_pattern(), piece_pattern(0x10000)
        pieces = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.pieces = [pieces.get(i, b"") for i in range(max(pieces) + 1)]


class Encoder:
    """Texts to packed ids (unsigned, 32 bits, little endian). Holds one window and a bounded cache."""

    def __init__(self, vocabulary: Vocabulary):
        self.ranks, self.ids = vocabulary.ranks, vocabulary.ids
        self.lookahead, self.longest = vocabulary.lookahead, vocabulary.longest
        self.find, self.find_low = re.compile(vocabulary.pattern), re.compile(vocabulary.low_pattern)
        self.special = {t: array("I", [i]).tobytes() for t, i in vocabulary.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        encoder = self

        class Cache(dict):
            def __missing__(self, piece: str) -> bytes:
                data = piece.encode("utf-8", "replace")
                if len(data) <= SHORT_BYTES:
                    packed = array("I", map(encoder.ids.__getitem__, encoder.merge_short(data))).tobytes()
                    if len(self) >= CACHE_WORDS:
                        self.clear()
                    self[piece] = packed
                    return packed
                return b"".join(encoder.stream(data))

        self.cache = Cache()

    def merge(self, data: bytes) -> list[bytes]:
        """Tokens of ``data``: always the merge of lowest rank, leftmost first."""
        if len(data) <= SHORT_BYTES:
            return self.merge_short(data)
        parts: list[bytes | None] = [data[i : i + 1] for i in range(len(data))]
        size, ranks = len(parts), self.ranks
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        heap = [(r, i) for i in range(size - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapify(heap)
        while heap:
            rank, i = heappop(heap)
            j = after[i] if parts[i] is not None else size
            if j >= size or ranks.get((parts[i], parts[j])) != rank:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = k = after[j]
            if k < size:
                before[k] = i
                if (r := ranks.get((parts[i], parts[k]))) is not None:
                    heappush(heap, (r, i))
            if (h := before[i]) >= 0 and (r := ranks.get((parts[h], parts[i]))) is not None:
                heappush(heap, (r, h))
        return [p for p in parts if p is not None]

    def merge_short(self, data: bytes) -> list[bytes]:
        """The same for a word, where looking through all pairs again costs less than a heap."""
        parts = [data[i : i + 1] for i in range(len(data))]
        get, none = self.ranks.get, len(self.ranks)
        ranks = [get(pair, none) for pair in zip(parts, parts[1:])]  # noqa: B905
        while ranks and (best := min(ranks)) < none:
            at = ranks.index(best)
            parts[at] += parts.pop(at + 1)
            del ranks[at]
            if at:
                ranks[at - 1] = get((parts[at - 1], parts[at]), none)
            if at < len(ranks):
                ranks[at] = get((parts[at], parts[at + 1]), none)
        return parts

    def stream(self, data: bytes) -> Iterator[bytes]:
        """Packed ids of one piece, emitted as soon as they are final."""
        window = self.lookahead + self.longest + STEP_BYTES
        at = 0
        while at < len(data):
            end = min(len(data), at + window)
            final = end if end == len(data) else end - self.lookahead
            out = array("I")
            for token in self.merge(data[at:end]):
                if at + len(token) > final:
                    break
                out.append(self.ids[token])
                at += len(token)
            yield out.tobytes()

    def encode(self, text: str | None) -> bytes:
        text, out = text or "", []
        low = len(text.encode("utf-16-le", "replace")) == 2 * len(text)
        find = self.find_low if low else self.find
        for part in self.split.split(text):
            if part in self.special:
                out.append(self.special[part])
            elif len(part) <= WHOLE_TEXT:
                out.append(b"".join(map(self.cache.__getitem__, find.findall(part))))
            else:
                found = find.finditer(part)
                while pieces := [m.group() for m in islice(found, PIECES_AT_ONCE)]:
                    out.append(b"".join(map(self.cache.__getitem__, pieces)))
        packed = b"".join(out)
        return packed if sys.byteorder == "little" else np.frombuffer(packed, "=u4").astype("<u4").tobytes()


def decode_ids(packed: bytes | None, pieces: list[bytes]) -> str:
    """Text of packed ids. Bytes pass an incremental UTF-8 machine; broken ones come out as U+FFFD."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    ids = np.frombuffer(packed or b"", "<u4")
    out = []
    for start in range(0, len(ids), PIECES_AT_ONCE):
        part = ids[start : start + PIECES_AT_ONCE].tolist()
        out.append(machine.decode(b"".join(map(pieces.__getitem__, part))))
    out.append(machine.decode(b"", True))
    return "".join(out)


def encode(df: DataFrame, path: str, text: str = "text", out: str = "ids") -> DataFrame:
    """Add ``out``: the token ids of ``text`` by the vocabulary at ``path``, four bytes each.

    NULL and empty texts give no ids. Repeated rows are encoded each; an existing column ``out`` is
    replaced; an empty table stays empty. The vocabulary is read by the driver and broadcast: its size is
    the file's, whatever the data.
    """
    shared = _share(df.sparkSession, path)

    def prepare():
        encoder = Encoder(shared.value)
        return lambda texts: [[encoder.encode(t) for t in texts]]

    return add_columns(df, text, [StructField(out, BinaryType())], prepare)


def decode(df: DataFrame, path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Add ``out``: the text of packed ``ids``. NULL or empty ids give the empty text; special tokens stay."""
    shared = _share(df.sparkSession, path)

    def prepare():
        pieces = shared.value.pieces
        return lambda rows: [[decode_ids(row, pieces) for row in rows]]

    return add_columns(df, ids, [StructField(out, StringType())], prepare)


def encode_decode(
    df: DataFrame, path: str, text: str = "text", ids: str = "ids", out: str = "decoded"
) -> DataFrame:
    """``encode`` and ``decode`` in one pass: adds ``ids`` and ``out``, the text of those ids.

    One after the other they run in a Python worker each, at the same time, and both hold the vocabulary.
    """
    shared = _share(df.sparkSession, path)

    def prepare():
        encoder, pieces = Encoder(shared.value), shared.value.pieces

        def work(texts: list) -> list[list]:
            packed = [encoder.encode(t) for t in texts]
            return [packed, [decode_ids(row, pieces) for row in packed]]

        return work

    return add_columns(df, text, [StructField(ids, BinaryType()), StructField(out, StringType())], prepare)


_SHARED: dict = {}


def _share(spark: SparkSession, path: str):
    key = (spark.sparkContext.applicationId, path)
    if key not in _SHARED:
        _SHARED[key] = spark.sparkContext.broadcast(Vocabulary(path))
    return _SHARED[key]
