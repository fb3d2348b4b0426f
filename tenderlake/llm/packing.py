"""Best-fit packing with certified bin counts, and repacking where the certificate is missing.

Pieces are dealt by hash into partitions of bounded size, and each partition packs its own by best-fit
decreasing: the longest piece first, each into the fullest sequence that still takes it. Dual-feasible functions
then give a lower bound on the sequences that any packing of these pieces needs. A partition that meets its
bound is certified: no packing of its pieces is better. The others also try to fill one sequence after the other as
well as sums of lengths can (``fullest``). Partitions with a gap give back all their sequences that are not full,
certified ones only the loose ones and the emptiest (the bound of all pieces together can be lower than the sum
of the partitions' bounds). What was given back is dealt anew, so that partitions exchange
pieces, and packed again; that goes on until the whole meets its bound or a round saves nothing.

Pieces of the full length need no partner and are never moved. The rounds move row numbers and lengths, not
pieces; the bound of the whole needs one number per length.
"""

from __future__ import annotations

import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
import tokenizers
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructType
from tokenizers import Tokenizer

from tenderlake.llm.bpe import byte_letters
from tenderlake.llm.common import cut, free_name, slices

CAPACITY = 2048
END = 0
PIECES_PER_PARTITION = 20_000
TRIED = 128
# Certified partitions give back sequences with more than this part of their space left.
LOOSE = 8
CACHE_WORDS = 250_000
CACHED_BYTES = 64
# Fixed: composition changes no character below the combining marks. Control characters and the other white space
# among them are left to the library.
LATIN_END = 0x300
LATIN = re.compile("[!-~\xa1-\u02ff]+").fullmatch
# Bits of a sequence number that count the sequences of a partition, and the partitions of a round.
SEQUENCE_BITS, PARTITION_BITS = 24, 28


class Words(dict):
    """Packed ids of white-space separated words: what the library gives for them. Remembers a bounded number.

    The vocabulary's rules never join what ASCII white space parts, so a text's ids are those of its words. For
    words of the Latin blocks, which composition leaves alone, the rules' steps (small letters, the pattern,
    bytes as letters) are done here and the library only merges; it does all of it for other words.
    """

    def __init__(self, rules: str):
        super().__init__()
        self.library = Tokenizer.from_str(rules)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        kinds: dict[str, list[str]] = {"L": [], "N": []}
        for letter in map(chr, range(LATIN_END)):
            kinds.get(unicodedata.category(letter)[0], []).append(re.escape(letter))
        letters, numbers = map("".join, kinds.values())
        self.split = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{letters}{numbers}]+").findall
        self.letters = {byte: letter for letter, byte in byte_letters().items()}
        self.before: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        if "<|" in text or not (text.isascii() and text.isprintable() or LATIN(text)):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        small = text.lower() if text.isascii() else "".join(map(str.lower, text))
        parts = [small] if small.isascii() and small.isalpha() else self.split(small)
        return b"".join(map(self.part, parts))

    def part(self, part: str) -> bytes:
        packed = self.parts.get(part)
        if packed is None:
            shown = part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)
            packed = array("I", [token.id for token in self.model.tokenize(shown)])
            packed = packed.tobytes() if sys.byteorder == "little" else np.array(packed, "<u4").tobytes()
            if len(part) <= CACHED_BYTES:
                if len(self.parts) >= CACHE_WORDS:
                    self.parts = {}
                self.parts[part] = packed
        return packed

    def __missing__(self, word: bytes) -> bytes:
        # Words of the last full generation that come again move into this one; the others go.
        packed = self.before.get(word)
        packed = self.ids(word) if packed is None else packed
        if len(word) <= CACHED_BYTES:
            if len(self) >= CACHE_WORDS:
                self.before = dict(self)
                self.clear()
            self[word] = packed
        return packed


def words_of(rules: str) -> Words:
    """The words of this worker process, which outlive a task: its next ones find them known. They are kept beside
    the library, as functions sent to workers bring their own module with them."""
    kept = vars(tokenizers).setdefault("_known_words", {})
    if rules not in kept:
        kept.clear()
        kept[rules] = Words(rules)
    return kept[rules]


def pieces(
    df: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END
) -> DataFrame:
    """(id, ``piece``, ``start``, ``length``, ``ids``): each document's token ids and ``end``, in pieces.

    Only documents above ``capacity`` ids are cut; their last piece may be shorter. ``ids`` are four bytes each,
    little endian. NULL texts count as empty, which is the end id alone. Repeated rows give their pieces each;
    an empty table gives none; other columns are not read.
    """
    key, content = free_name(df, "row_id", "row_text")
    ending = np.array([end], "<u4").tobytes()
    names = [doc_id, "piece", "start", "length", "ids"]
    with open(path, encoding="utf-8") as file:
        rules = df.sparkSession.sparkContext.broadcast(file.read())  # as large as the file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = words_of(rules.value)
        for batch in slices(batches, 1):
            rows: list[int] = []
            parts: list[bytes] = []
            numbers: list[int] = []
            for row, text in enumerate(batch.column(1).to_pylist()):
                ids = b"".join(map(words.__getitem__, (text or "").encode("utf-8", "replace").split())) + ending
                for number, at in enumerate(range(0, len(ids), 4 * capacity)):
                    rows.append(row)
                    numbers.append(number)
                    parts.append(ids[at : at + 4 * capacity])
            number = np.array(numbers, np.int32)
            lengths = np.fromiter(map(len, parts), np.int64, len(parts)) // 4
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(number), pa.array(number.astype(np.int64) * capacity),
                 pa.array(lengths), pa.array(parts, pa.binary())],
                names=names,
            )

    chosen = df.select(F.col(doc_id).alias(key), F.col(text).alias(content))
    schema = StructType([df.select(doc_id).schema[0]])
    for name, kind in zip(names[1:], (IntegerType(), LongType(), LongType(), BinaryType()), strict=True):
        schema = schema.add(name, kind)
    return chosen.mapInArrow(run, schema)


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """Sequences that no packing can do with less of, for ``counts[x]`` pieces of length x.

    A dual-feasible function maps lengths so that those of any one sequence still sum to at most one; so the
    sum over all pieces bounds the number of sequences. Three families, all in whole numbers: long pieces
    rounded up to a sequence and short ones dropped (for each border between them, the border 0 being the plain
    sum), multiples of k + 1 rounded down, and long pieces counted by how many of a size stay out beside them.
    """
    n = np.asarray(counts, dtype=object)
    sizes = [x for x in range(1, capacity + 1) if n[x]]
    if not sizes:
        return 0
    x = np.array(sizes, np.int64)
    n = np.array([int(n[s]) for s in sizes], np.float64)  # exact below 2**53
    borders = np.arange(0, capacity // 2 + 1)[:, None]
    first = np.where(x > capacity - borders, capacity, np.where(x >= borders, x, 0)) @ n / capacity
    k = np.arange(1, 101)[:, None]
    whole = (k + 1) * x % capacity == 0
    second = (np.where(whole, x * k, (k + 1) * x // capacity * capacity) @ n)[:, None] / (k * capacity)
    size = np.arange(1, capacity // 2 + 1)[:, None]
    fit = capacity // size
    third = (np.where(2 * x > capacity, fit - (capacity - x) // size, np.where(x >= size, 1, 0)) @ n)[:, None] / fit
    best = max(float(first.max()), float(second.max()), float(third.max()))
    return int(np.ceil(best - 1e-9 * max(1.0, best)))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sequence and place of each piece, longest pieces first, and how full each sequence is.

    Open sequences are kept by the space they have left; one bit per space tells the least that suffices.
    """
    order = np.argsort(-lengths, kind="stable")
    by_space: list[list[int]] = [[] for _ in range(capacity + 1)]
    left: list[int] = []
    open_spaces = 0
    sequence, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i, length in zip(order.tolist(), lengths[order].tolist(), strict=True):
        enough = open_spaces >> length
        if enough:
            space = length + (enough & -enough).bit_length() - 1
            stack = by_space[space]
            own = stack.pop()
            if not stack:
                open_spaces ^= 1 << space
        else:
            own, space = len(left), capacity
            left.append(capacity)
        sequence[i], place[i] = own, capacity - space
        left[own] = space = space - length
        if space:
            if not by_space[space]:
                open_spaces |= 1 << space
            by_space[space].append(own)
    return sequence, place, capacity - np.array(left, np.int64)


def fullest(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """As ``best_fit``, one sequence after the other: the longest piece left and what fills it up best.

    Sums that the other pieces can make are bits of a number, so a piece adds all its sums in one step; of very
    many pieces the longest and the shortest that fit are tried. Slower, and tried only where a bound is missed.
    """
    waiting: dict[int, list[int]] = {}
    for i in np.argsort(-lengths, kind="stable").tolist():
        waiting.setdefault(int(lengths[i]), []).append(i)
    sequence, place = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    fill: list[int] = []
    while waiting:
        sizes = list(waiting)  # longest first
        space = capacity - sizes[0]
        others = [x for x in sizes if x <= space for _ in waiting[x][x == sizes[0] :][: space // x]]
        if len(others) > 2 * TRIED:
            others = others[:TRIED] + others[-TRIED:]
        sums, steps, within = 1, [], (1 << (space + 1)) - 1
        for x in others:
            steps.append(sums)
            sums |= (sums << x) & within
        rest, chosen = sums.bit_length() - 1, [sizes[0]]
        for x, before in zip(reversed(others), reversed(steps), strict=True):
            if not before >> rest & 1:
                chosen.append(x)
                rest -= x
        at = 0
        for x in chosen:
            i = waiting[x].pop()
            if not waiting[x]:
                del waiting[x]
            sequence[i], place[i] = len(fill), at
            at += x
        fill.append(at)
    return sequence, place, np.array(fill, np.int64)


def _round(waiting: DataFrame, number: int, parts: int, capacity: int) -> DataFrame:
    """One packing of the waiting (row, size), stored: with ``sequence_id``, ``offset``, and whether it stays."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("row", ignore_index=True)  # the same whatever order rows arrive in
        sizes = group["size"].to_numpy()
        sequence, place, fill = best_fit(sizes, capacity)
        bound = lower_bound(np.bincount(sizes, minlength=capacity + 1), capacity)
        if len(fill) > bound:
            sequence, place, fill = min((sequence, place, fill), fullest(sizes, capacity), key=lambda found: len(found[2]))
        back = fill < (capacity - capacity // LOOSE if len(fill) == bound else capacity)
        back |= (fill < capacity) & (np.arange(len(fill)) == fill.argmin())
        part = int(group["part"].iloc[0])
        base = (number << (SEQUENCE_BITS + PARTITION_BITS)) | (part << SEQUENCE_BITS)
        return pd.DataFrame(
            {"row": group["row"], "size": sizes, "sequence_id": base + sequence, "offset": place, "back": back[sequence]}
        )

    dealt = waiting.withColumn("part", F.pmod(F.xxhash64(F.lit(number), "row"), F.lit(parts)).cast("int"))
    schema = "row long, size int, sequence_id long, offset long, back boolean"
    return cut(dealt.groupBy("part").applyInPandas(run, schema))


def pack(
    df: DataFrame, *, length: str = "length", capacity: int = CAPACITY, per_partition: int = PIECES_PER_PARTITION
) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to every row: its place in as few sequences of ``capacity`` as found.

    Places in a sequence leave no gap from 0 on. A row whose length is NULL, below 1 or above ``capacity`` gets
    NULL for both. Rows are packed each, repeated or not; an empty table stays empty; columns of the two names
    are replaced. Full sequences have negative numbers, the others numbers from 0.
    """
    row, size = free_name(df, "row", "size")
    kept = [c for c in df.columns if c.lower() not in ("sequence_id", "offset")]
    stored = cut(df.select(*kept, F.monotonically_increasing_id().alias(row)))
    fits = F.col(length).between(1, capacity - 1)
    waiting = stored.where(fits).select(F.col(row).alias("row"), F.col(length).cast("int").alias("size"))
    totals = np.zeros(capacity + 1, np.int64)
    for r in waiting.groupBy("size").count().collect():  # one row per length
        totals[r["size"]] = r["count"]
    least = lower_bound(totals, capacity)

    placed: list[DataFrame] = []
    pieces_left, before = int(totals.sum()), None
    for number in count():
        if not pieces_left:
            break
        packed = _round(waiting, number, max(1, -(-pieces_left // per_partition)), capacity)
        sequences = lambda rows: rows.select("sequence_id").distinct().count()
        used = packed.groupBy("back").agg(F.countDistinct("sequence_id").alias("n"), F.count("*").alias("rows")).collect()
        stay = sum(r["n"] for r in used if not r["back"])
        back = sum(r["n"] for r in used if r["back"])
        if before is not None and stay + back >= before[0]:
            placed.append(before[1])  # this round saved nothing: the last one's sequences stand
            break
        least -= stay
        again = packed.where("back")
        if not back or back <= least or pieces_left <= per_partition:
            placed.append(packed)
            break
        placed.append(packed.where("not back"))
        waiting, pieces_left, before = again.select("row", "size"), sum(r["rows"] for r in used if r["back"]), (back, again)

    full = F.when(F.col(length) == capacity, -F.col(row) - 1)
    if not placed:
        return stored.select(*kept, full.alias("sequence_id"), F.when(full.isNotNull(), F.lit(0).cast("long")).alias("offset"))
    places = placed[0]
    for more in placed[1:]:
        places = places.union(more)
    places = places.select(F.col("row").alias(row), F.col("sequence_id").alias("own_"), F.col("offset").alias("place_"))
    return stored.join(places, row, "left").select(
        *kept,
        F.coalesce(full, "own_").alias("sequence_id"),
        F.when(full.isNotNull(), F.lit(0).cast("long")).otherwise(F.col("place_")).alias("offset"),
    )
