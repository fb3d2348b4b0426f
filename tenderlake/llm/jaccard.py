"""Exact n-gram Jaccard join and its connected components, by token-combination prefixes.

A document's tokens are its distinct word n-grams, as 64-bit hashes. Documents with equal sets form one
class at once, so copies never meet each other. Between classes:

* All sets share one order of tokens: rare ones by hash, then frequent ones by how frequent they are. Two
  sets that reach the threshold share a token among their first p, where p follows from the set's size, and
  share k tokens among their first p + k - 1. So if the first shared token is rare, both index it alone; if
  it is frequent, so are all after it, and both index the same *combination* of k frequent tokens from the
  extended prefix. Rare tokens are indexed alone, frequent ones only in combinations, and no pair is lost.
  Which tokens count as frequent is free, as long as all sets agree: it is a bounded list of the most
  frequent ones, from counts over all documents in which each task leaves out what it saw only once.
  In sets above ``COMBINED_SIZE``, whose prefixes would make too many combinations, frequent tokens are
  indexed alone as well; sets near that size do both, so every pair has a form in common.
* Round one verifies each member of an index list against the list's first member only: as many pairs as
  list entries, found by one pass over sorted lists. That already joins most of a group of near copies.
* Round two compares members of one list that round one left in different components, where a sketch of a few
  bytes that they carry allows it. Pairs inside a component need no further look, so a group's pairs are never
  all made.

Sizes, positions and sketches bound the overlap before a pair's whole sets are brought together.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenderlake.llm.common import cut, passing, small_batches

FREQUENT_ABOVE = 32
FREQUENT_TOKENS = 1 << 18
COMBINED = 2
COMBINED_SIZE = 512
SEEN_BITS = 26
MOST_BROADCAST = 500_000
TOKENS_AT_ONCE = 100_000
ENTRIES_AT_ONCE = 10_000
SEEN_SETS = 500_000
FILTER_WORDS = 1 << 16
SKETCH_WIDTHS = (8, 18)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shingle_hashes(text: Column, words: int) -> Column:
    """Sorted distinct hashes of the ``words``-grams of a text; of all its words if there are fewer."""
    lowered = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    found = F.regexp_extract_all(lowered, F.lit(r"([^\x20\x09-\x0D]+)"), F.lit(1))

    def grams(w: Column) -> Column:
        gram = lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(words)))
        return (
            F.when(F.size(w) >= words, F.transform(F.sequence(F.lit(0), F.size(w) - words), gram))
            .when(F.size(w) > 0, F.array(F.xxhash64(w)))
            .otherwise(F.array().cast("array<bigint>"))
        )

    # A one-element transform binds the words, so they are cut once.
    return F.sort_array(F.array_distinct(F.get(F.transform(F.array(found), grams), 0)))


def _needed(percent: int, n1: Column, n2: Column, overlap: Column) -> Column:
    return 100 * overlap >= percent * (n1 + n2 - overlap)


def by_tokens(batches: Iterable[pa.RecordBatch], place: int) -> Iterator[pa.RecordBatch]:
    """The batches cut so that the lists of column ``place`` hold about ``TOKENS_AT_ONCE`` values in each."""
    for batch in batches:
        ends = np.cumsum(batch.column(place).value_lengths().to_numpy(), dtype=np.int64)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + TOKENS_AT_ONCE, "right")))
            yield batch.slice(start, stop - start)
            start = stop


def frequent_tokens(sets: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """At most ``FREQUENT_TOKENS`` tokens above ``FREQUENT_ABOVE`` documents, sorted, with their counts.

    A task passes over the first document of each token it meets: a bit set of fixed size tells which hashes have
    been there. Two tokens on one bit only bring a count too many to the exact sum.
    """

    def repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met = np.zeros(1 << (SEEN_BITS - 3), np.uint8)
        for batch in by_tokens(batches, 0):
            tokens, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            spot = tokens & ((1 << SEEN_BITS) - 1)
            byte, bit = spot >> 3, np.left_shift(1, spot & 7).astype(np.uint8)
            often = (n > 1) | ((met[byte] & bit) > 0)
            np.bitwise_or.at(met, byte, bit)
            yield pa.RecordBatch.from_arrays(
                [pa.array(tokens[often]), pa.array(n[often].astype(np.int64))], names=["token", "n"]
            )

    rows = (
        sets.select("hashes")
        .mapInArrow(repeated, "token long, n long")
        .groupBy("token")
        .agg(F.sum("n").alias("n"))
        .where(F.col("n") > FREQUENT_ABOVE)
        .orderBy(F.desc("n"), "token")
        .limit(FREQUENT_TOKENS)
        .collect()
    )
    rows = sorted((r["token"], r["n"]) for r in rows)
    return np.array([t for t, _ in rows], np.int64), np.array([n for _, n in rows], np.int64)


def mixed(*tokens: int) -> int:
    """A signature of several tokens, as a signed 64-bit number."""
    value = 0x9E3779B97F4A7C15
    for token in tokens:
        value = ((value ^ (token & (2**64 - 1))) * 0xD6E8FEB86659FD93) & (2**64 - 1)
        value ^= value >> 32
    return value - 2**64 if value >= 2**63 else value


def index_entries(sets: DataFrame, percent: int) -> DataFrame:
    """Index entries (sig, pos, k1, n, id) of the prefixes of all sets.

    Entries are most of what is shuffled, so a set goes by the first of its keys and its size. A pair whose first shared entry is at ``pos`` overlaps in at most min(n - pos) of both. A task leaves
    out copies of sets it has just indexed for a smaller id.
    """
    tokens, counts = frequent_tokens(sets)
    shared = sets.sparkSession.sparkContext.broadcast((tokens, counts))

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, counts = shared.value
        seen: dict[tuple[int, int], int] = {}
        for batch in by_tokens(batches, 3):
            ids, k1s, k2s = (batch.column(i).to_numpy() for i in range(3))
            lists = batch.column(3)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(lists.value_lengths().to_numpy())
            at = np.searchsorted(tokens, flat) if len(tokens) else np.zeros(len(flat), np.int64)
            at = np.minimum(at, max(len(tokens) - 1, 0))
            often = tokens[at] == flat if len(tokens) else np.zeros(len(flat), bool)
            out: list[list] = [[], [], [], [], []]
            for row, end in enumerate(ends):
                start = ends[row - 1] if row else 0
                n, key, doc = int(end - start), (int(k1s[row]), int(k2s[row])), int(ids[row])
                least = -(-percent * n // 100)
                if not n or (least == n and 100 * n // percent == n) or seen.get(key, doc + 1) <= doc:
                    continue
                if len(seen) >= SEEN_SETS:
                    seen.clear()
                seen[key] = doc
                p = n - least + 1
                hashes, mask = flat[start:end], often[start:end]
                rare = hashes[~mask][:p]
                signatures = list(zip(rare.tolist(), range(len(rare)), strict=True))
                if len(rare) < p:
                    where = np.flatnonzero(mask)
                    where = where[np.lexsort((hashes[where], counts[at[start:end][where]]))]
                    extended = hashes[where].tolist()[: p + COMBINED - 1 - len(rare)]
                    if least <= COMBINED_SIZE:
                        spots = enumerate(extended, len(rare))
                        for chosen in combinations(spots, COMBINED):
                            if chosen[0][0] < p:
                                sig = mixed(COMBINED, *(t for _, t in chosen))
                                signatures.append((sig, chosen[-1][0] - COMBINED + 1))
                    if 100 * n // percent > COMBINED_SIZE:
                        alone = extended[: p - len(rare)]
                        signatures += [(mixed(1, t), len(rare) + i) for i, t in enumerate(alone)]
                for column, values in zip(
                    out, ([s for s, _ in signatures], [i for _, i in signatures]), strict=False
                ):
                    column += values
                for column, value in zip(out[2:], (key[0], n, doc), strict=True):
                    column += [value] * len(signatures)
                if len(out[0]) >= ENTRIES_AT_ONCE:
                    yield _batch(out)
                    out = [[], [], [], [], []]
            yield _batch(out)

    def _batch(out: list[list]) -> pa.RecordBatch:
        kinds = (np.int64, np.int32, np.int64, np.int32, np.int64)
        names = ["sig", "pos", "k1", "n", "id"]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.array(c, t)) for c, t in zip(out, kinds, strict=True)], names=names
        )

    return sets.select("id", "k1", "k2", "hashes").mapInArrow(
        entries, "sig long, pos int, k1 long, n int, id long"
    )


def with_first(entries: DataFrame) -> DataFrame:
    """Entries of each list beside the list's first entry (columns with ``f_``), without the first itself.

    One pass over sorted lists that carries the first entry along, so a list of any length takes constant
    memory. Copies of one set follow each other and are passed over.
    """
    names = ["sig", "pos", "k1", "n", "id"]

    def attach(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(i).to_numpy() for i in range(5)]
            sig = columns[0]
            change = np.ones(len(sig), bool)
            change[1:] = sig[1:] != sig[:-1]
            same = np.zeros(len(sig), bool)
            same[1:] = ~change[1:]
            for c in columns[2:4]:
                same[1:] &= c[1:] == c[:-1]
            if last is not None and last[0] == sig[0]:
                change[0] = False
                same[0] = last[2] == columns[2][0] and last[3] == columns[3][0]
            lead = np.maximum.accumulate(np.where(change, np.arange(len(sig)), -1))
            leads = [np.where(lead >= 0, c[lead], first[i] if first else c[0]) for i, c in enumerate(columns)]
            keep = ~change & ~same
            arrays = [pa.array(c[keep]) for c in columns] + [
                pa.array(f[keep].astype(c.dtype)) for f, c in zip(leads[1:], columns[1:], strict=True)
            ]
            yield pa.RecordBatch.from_arrays(arrays, names=names + [f"f_{n}" for n in names[1:]])
            first, last = [f[-1] for f in leads], [c[-1] for c in columns]

    return (
        entries.repartition("sig")
        .sortWithinPartitions("sig", "pos", "k1", "n", "id")
        .mapInArrow(
            attach,
            "sig long, pos int, k1 long, n int, id long, f_pos int, f_k1 long, f_n int, f_id long",
        )
    )


def _named(pairs: DataFrame, sets: DataFrame, column: str) -> DataFrame:
    """``column`` of the documents that pairs name (each set's smallest id), and of a few others.

    Sets that no pair names are passed over where they are read, by a bit set of ``FILTER_WORDS`` words: it
    lets some others through, never stops a needed one, and has the same size however many pairs there are.
    """
    word = F.pmod(F.shiftrightunsigned("k1", 6), F.lit(FILTER_WORDS))
    bit = F.expr("shiftleft(1L, cast(k1 & 63 as int))")
    sides = pairs.select(F.col("a_k1").alias("k1")).union(pairs.select(F.col("b_k1").alias("k1")))
    bits = sides.groupBy(word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    return cut(
        sets.withColumn("word", word)
        .join(F.broadcast(bits), "word")  # FILTER_WORDS rows of two numbers at most
        .where(F.col("bits").bitwiseAND(bit) != 0)
        .select("id", "k1", column)
    )


def _beside(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """Pairs with ``column`` of both sides, as ``a`` and ``b``. Repeated rows of a document repeat its pairs."""
    for side in ("a", "b"):
        keys = [f"{side}_{name}" for name in ("id", "k1")]
        names = [F.col(key[2:]).alias(key) for key in keys]
        pairs = pairs.join(table.select(*names, F.col(column).alias(side)), keys)
    return pairs


def with_sketch(sets: DataFrame) -> DataFrame:
    """Add ``sketch``: of each of 2^w classes of tokens, whether their number in the set is odd.

    Sketches of two sets differ in no more bits than the sets have tokens that are not shared. A sketch has
    as many bits as the set has tokens, rounded up, so it tells apart large sets as well as small ones; one
    of twice the width folds into the narrower by exclusive or of its halves.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_tokens(batches, 2):
            lists = batch.column(2)
            sizes = lists.value_lengths().to_numpy()
            rows = np.repeat(np.arange(batch.num_rows), sizes)
            tokens = lists.flatten().to_numpy(zero_copy_only=False)
            bits = 1 << np.clip(np.ceil(np.log2(np.maximum(sizes, 1))), *SKETCH_WIDTHS).astype(int)
            starts = np.concatenate([[0], np.cumsum(bits)])
            odd = np.bincount(starts[rows] + tokens % bits[rows], minlength=starts[-1]).astype(np.uint8) & 1
            sketch = pa.ListArray.from_arrays(
                (starts // 64).astype(np.int32), np.packbits(odd, bitorder="little").view("<i8")
            )
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:2], sketch], names=["id", "k1", "sketch"]
            )

    return sets.select("id", "k1", "hashes").mapInArrow(add, "id long, k1 long, sketch array<long>")


def _bits_apart(a: str, b: str) -> Column:
    """Bits in which two sketches differ, at the narrower one's width (widths of such pairs differ by two at most)."""
    fold = lambda x, y: (
        f"if(size({x}) <= size({y}), {x}, zip_with(slice({x}, 1, size({y})),"
        f" slice({x}, size({y}) + 1, size({y})), (p, q) -> p ^ q))"
    )
    return F.expr(
        f"aggregate(zip_with({fold(a, b)}, {fold(b, a)}, (x, y) -> bit_count(x ^ y)), 0, (s, x) -> s + x)"
    )


def verified(pairs: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int, forest_first: bool) -> DataFrame:
    """Links (u, v) by id among pairs (a_k1, a_id, a_n, b_...) that span all that reach the threshold.

    A pair whose sketches differ in more bits than sets of these sizes may differ in tokens goes first. With
    ``forest_first``, of the others each set's pair with its smallest partner has its whole sets brought
    together, and then only the pairs whose sides these links have not already joined to one set.
    """
    pairs = cut(pairs)
    apart = _bits_apart("a", "b")
    close = (
        _beside(pairs, _named(pairs, sketches, "sketch"), "sketch")
        .where((100 + percent) * apart <= (100 - percent) * (F.col("a_n") + F.col("b_n")))
        .select(pairs.columns)
    )
    if not forest_first:
        return _whole(cut(close), sets, percent)
    close = cut(close)
    a_side = [c for c in pairs.columns if c[0] == "a"]
    b_side = [c for c in pairs.columns if c[0] == "b"]
    forest = close.groupBy(*b_side).agg(F.min(F.struct("a_id", *(c for c in a_side if c != "a_id"))).alias("a"))
    links = _whole(cut(forest.select("a.*", *b_side)), sets, percent)
    hub = cut(links.groupBy(F.greatest("u", "v").alias("id")).agg(F.min(F.least("u", "v")).alias("hub")))
    side = lambda name: hub.select(F.col("id").alias(f"{name}_id"), F.col("hub").alias(f"{name}_hub"))
    rest = (
        close.join(side("a"), "a_id", "left")
        .join(side("b"), "b_id", "left")
        .where("coalesce(a_hub, a_id) <> coalesce(b_hub, b_id)")
    )
    return links.union(_whole(cut(rest.select(pairs.columns)), sets, percent))


def _whole(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The (stored) pairs whose whole sets reach the threshold, as ids (u, v), stored."""
    overlap = F.size(F.array_intersect("a", "b"))
    with passing(pairs.sparkSession) as keep:
        return keep(
            _beside(pairs, _named(pairs, sets, "hashes"), "hashes")
            .where(_needed(percent, F.col("a_n"), F.col("b_n"), overlap))
            .select(F.col("a_id").alias("u"), F.col("b_id").alias("v"))
        )


def components(links: DataFrame) -> DataFrame:
    """(id, component) of every node of the links (u, v): the smallest id it is connected to.

    Alternating stars: each node hands its larger neighbours, then its smaller ones, to the smallest node
    it knows. Rounds grow with the logarithm of the graph; each is a table in the shared folder. Neighbours
    meet their minimum by a join, so a node with very many of them is no single task's work.
    """
    edges = cut(
        links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    )
    count = [F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))]
    mark = edges.agg(*count).first()
    while mark[0]:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy(F.col("u").alias("w")).agg(F.least(F.min("v"), F.min("u")).alias("m"))
        large = cut(
            both.join(low, both.u == low.w)
            .where("v > u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .where("u <> v")
            .distinct()
        )
        low = large.groupBy(F.col("u").alias("w")).agg(F.min("v").alias("m"))
        joined = large.join(low, large.u == low.w)
        small = joined.select(F.col("v").alias("u"), F.col("m").alias("v")).union(
            joined.select("u", F.col("m").alias("v"))
        )
        edges = cut(small.where("u <> v").distinct())
        state = edges.agg(*count).first()
        if state == mark:
            break
        mark = state
    roots = edges.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct()
    return edges.select(F.col("u").alias("id"), F.col("v").alias("component")).union(roots)


def _pairs(rows: DataFrame, a: str, b: str, percent: int) -> DataFrame:
    """Distinct pairs of sides ``a`` and ``b`` whose sizes and positions allow the threshold."""
    side = lambda p, n: F.col(f"{p}{n}")
    most = F.least(*(side(p, "n") - side(p, "pos") for p in (a, b)))
    sizes = 100 * F.least(*(side(p, "n") for p in (a, b))) >= percent * F.greatest(
        *(side(p, "n") for p in (a, b))
    )
    flip = F.struct(side(a, "k1"), side(a, "n")) > F.struct(side(b, "k1"), side(b, "n"))
    columns = [
        F.when(flip, side(q, n)).otherwise(side(p, n)).alias(f"{name}_{n}")
        for name, p, q in (("a", a, b), ("b", b, a))
        for n in ("k1", "id", "n")
    ]
    kept = rows.where(sizes & _needed(percent, side(a, "n"), side(b, "n"), most)).select(*columns)
    return kept.groupBy("a_k1", "a_n", "b_k1", "b_n").agg(F.min("a_id").alias("a_id"), F.min("b_id").alias("b_id"))


MEMBER = ("sig", "pos", "k1", "n", "id")
FOLDED = ("sketch_0", "sketch_1", "sketch_2", "sketch_3")


def _open_members(rows: DataFrame, near: DataFrame) -> DataFrame:
    """Entries of the lists that hold more than one component, with ``component``, stored."""
    few = near.count() <= MOST_BROADCAST
    known = rows.select(*MEMBER).join(F.broadcast(near) if few else near, "id", "left").withColumn("component", F.coalesce("component", "id"))
    lists = known.groupBy("sig").agg(F.min("component").alias("x"), F.max("component").alias("y")).where("x <> y")
    return cut(known.join(lists.select("sig"), "sig").select(*MEMBER, "component"))


def _merged(near: DataFrame, links: DataFrame) -> DataFrame:
    """(id, component) after links (u, v) between components; what they join are components, so only these are."""
    named = links
    for end in ("u", "v"):
        name = near.select(F.col("id").alias(end), F.col("component").alias(f"{end}_c"))
        named = named.join(name, end, "left")
    joined = components(named.select(F.coalesce("u_c", "u").alias("u"), F.coalesce("v_c", "v").alias("v")))
    last = cut(joined.select(F.col("id").alias("component"), F.col("component").alias("final")))
    moved = near.join(last, "component", "left").select("id", F.coalesce("final", "component").alias("component"))
    alone_before = last.join(near.select(F.col("id").alias("component")), "component", "left_anti")
    return cut(moved.union(alone_before.select("component", "final")))


def _folded(sketches: DataFrame) -> DataFrame:
    """(id, k1) with the sketch at its least width, as ``FOLDED`` numbers."""
    words = (1 << SKETCH_WIDTHS[0]) // 64
    parts = (
        F.first(F.expr(f"aggregate(filter(sketch, (x, i) -> i % {words} = {j}), 0L, (a, x) -> a ^ x)")).alias(name)
        for j, name in enumerate(FOLDED)
    )
    return sketches.groupBy("id", "k1").agg(*parts)


def _joined_across_lists(
    lists: DataFrame, near: DataFrame, sets: DataFrame, sketches: DataFrame, percent: int
) -> DataFrame:
    """(id, component) once the lists' members that round one left in different components are compared too.

    Members carry the narrow sketch, so the join itself gives only pairs that sizes, positions and sketch allow.
    """
    members = cut(_open_members(lists, near).join(_folded(sketches), ["id", "k1"]))
    left = members.select("sig", *(F.col(c).alias(f"l_{c}") for c in members.columns if c != "sig"))
    right = members.select("sig", *(F.col(c).alias(f"r_{c}") for c in members.columns if c != "sig"))
    bits = " + ".join(f"bit_count(l_{name} ^ r_{name})" for name in FOLDED)
    apart = left.join(right, "sig").where(
        "l_component < r_component"
        f" and 100 * least(l_n, r_n) >= {percent} * greatest(l_n, r_n)"
        f" and (100 + {percent}) * least(l_n - l_pos, r_n - r_pos) >= {percent} * (l_n + r_n)"
        f" and (100 + {percent}) * ({bits}) <= (100 - {percent}) * (l_n + r_n)"
    )
    return _merged(near, verified(_pairs(apart, "l_", "r_", percent), sets, sketches, percent, False))


def jaccard_components(
    df: DataFrame, *, doc_id: str = "doc_id", text: str = "text", words: int = 3, percent: int = 90
) -> DataFrame:
    """One row per row of ``df``: id, ``n_shingles`` and ``component_id``.

    Two documents link when 100 * overlap >= percent * union of their sets of ``words``-grams (lower-cased
    A-Z, words without white space; the whole sequence if there are fewer words). ``component_id`` is the
    smallest id reachable by links. NULL, empty and blank texts have empty sets and link with nothing.
    Repeated rows give a row each. A row without id links with nothing and has no component. Rows that
    share an id but not a text keep their own set size, and their links count as those of one document.
    """
    # Sets and lists take more room than the stored texts: they go as soon as each row's class is known.
    with passing(df.sparkSession) as keep:
        sets = cut(
            df.select(F.col(doc_id).cast("long").alias("id"), shingle_hashes(F.col(text), words).alias("hashes"))
            .withColumn("n", F.size("hashes"))
            .withColumn("k1", F.xxhash64("hashes"))
            .withColumn("k2", F.xxhash64(F.lit(words), "hashes"))
        )
        usable = sets.where("n > 0 and id is not null")

        with small_batches(df.sparkSession):
            sketches = cut(with_sketch(usable))
            entries = index_entries(usable, percent)
            lists = cut(with_first(entries))
        first = verified(_pairs(lists, "", "f_", percent), usable, sketches, percent, True)
        near = cut(components(first))

        linked = _joined_across_lists(lists, near, usable, sketches, percent)

        classes = usable.groupBy("k1", "k2").agg(F.min("id").alias("id"), F.count("*").alias("rows"))
        roots = keep(
            classes.join(linked, "id", "left")
            .where("rows > 1 or component is not null")
            .select("k1", "k2", F.coalesce("component", "id").alias("component"))
        )
        rows = keep(sets.select("id", "n", "k1", "k2"))
    alone = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return (
        rows.withColumn("c1", F.when(F.col("n") > 0, F.col("k1")))
        .join(roots.select(F.col("k1").alias("c1"), "k2", "component"), ["c1", "k2"], "left")
        .select(F.col("id").alias(doc_id), F.col("n").cast("long").alias("n_shingles"), alone.alias("component_id"))
    )
