"""Maximal periodic runs of words, by a dictionary of basic factors.

The dictionary names the factors of 1, 2, 4, ... words of a text: two have one name exactly if they are equal. The
names of one length follow from pairs of names of half the length, so no text is compared. A factor that stands
only once in its text can be part of no run, nor can any longer one around it: it drops out, and most places of
ordinary text do so within three lengths.

In a run of period q, a factor of m >= q words stands again exactly q words later, and not before: two places
nearer to each other would give the run a smaller period. So per length m, the distance to a factor's next
occurrence, if it is within m (within twice m / 2), proposes a period; at places one after the other with one
distance the occurrences form arithmetic progressions, one per run. The first length that matters is the largest
power of two that fits into the shortest run with its period, ``LEAST`` words; from there on each length serves
the periods above half of it. Each progression is extended to both sides by names of shrinking lengths, and what
two lengths have found is kept once.

Texts of one slice of an Arrow batch are worked on together, in numpy: their words follow each other with the
text's number in the names, so no factor reaches into the next text.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tenderlake.llm.common import add_columns

LEAST = 24
REPEATS = 3
RUN = StructType([StructField(name, LongType()) for name in ("start", "length", "period")])


def named(codes: np.ndarray) -> np.ndarray:
    """Numbers from 0 that are equal where the codes are."""
    return np.unique(codes, return_inverse=True)[1].astype(np.int64)


class Dictionary:
    """Names of the basic factors of several texts, length by length.

    ``texts`` has the text's number at each place. A level holds the places, in order, whose factor stands twice in
    its text at least, and the names; any other factor equals none.
    """

    def __init__(self, words: np.ndarray, texts: np.ndarray):
        self.size = len(words)
        names = named(texts * (int(words.max(initial=0)) + 1) + words)
        self.levels = [self._repeated(np.arange(self.size), names)]

    @staticmethod
    def _repeated(places: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        often = np.bincount(names, minlength=1)[names] > 1
        return places[often], names[often]

    def longer(self) -> bool:
        """Add the next length; False if no factor of that length stands twice in a text."""
        (places, names), half = self.levels[-1], 1 << (len(self.levels) - 1)
        at_place = np.full(self.size + half, -1, np.int64)
        at_place[places] = names
        after = at_place[places + half]
        both = after >= 0
        pairs = names[both] * (int(names.max(initial=0)) + 1) + after[both]
        level = self._repeated(places[both], named(pairs))
        if len(level[0]):
            self.levels.append(level)
        return len(level[0]) > 0

    def _equal(self, level: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether the factors of a level at ``a`` and ``b`` are equal; False for places outside all texts."""
        places, names = self.levels[level]
        found = []
        for at in (a, b):
            spot = np.minimum(np.searchsorted(places, at), len(places) - 1)
            found.append(np.where(places[spot] == at, names[spot], -1))
        return (found[0] == found[1]) & (found[0] >= 0)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from places ``a`` and ``b`` on are equal. No factor longer than the last level's stands
        twice, so each length is asked for once."""
        equal = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            equal += self._equal(k, a + equal, b + equal).astype(np.int64) << k
        return equal

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words before places ``a`` and ``b`` are equal."""
        equal = np.zeros(len(a), np.int64)
        for k in reversed(range(len(self.levels))):
            step = equal + (1 << k)
            equal += self._equal(k, a - step, b - step).astype(np.int64) << k
        return equal


def progressions(
    places: np.ndarray, names: np.ndarray, low: int, high: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First place, last place and distance of places in a row whose name comes next after the same distance, which
    is above ``low`` and at most ``high``."""
    places = places[np.argsort(names, kind="stable")]
    names = np.sort(names, kind="stable")
    gaps = places[1:] - places[:-1]
    near = (names[1:] == names[:-1]) & (gaps > low) & (gaps <= high)
    at, distance = places[:-1][near], gaps[near]
    order = np.argsort(at)
    at, distance = at[order], distance[order]
    if not len(at):
        return at, at, distance
    breaks = np.flatnonzero((at[1:] != at[:-1] + 1) | (distance[1:] != distance[:-1])) + 1
    first = np.concatenate([[0], breaks])
    last = np.concatenate([breaks, [len(at)]]) - 1
    return at[first], at[last], distance[first]


def runs_of(words: np.ndarray, texts: np.ndarray, least: int = LEAST, repeats: int = REPEATS) -> np.ndarray:
    """Rows (text, start, length, period) of all runs: start counts from the first of all words.

    A run has ``repeats`` times its smallest period and ``least`` words at least, and no neighbour continues it.
    """
    if repeats < 3:
        raise ValueError("the lengths used here find runs of three periods or more")
    shortest = 1
    # Every run has two factors of this length, a period of at most this length apart.
    while 4 * shortest <= least:
        shortest *= 2
    dictionary = Dictionary(words, texts)
    found, length = [], 1
    while True:
        if length >= shortest:
            low = 0 if length == shortest else length // 2
            first, last, period = progressions(*dictionary.levels[-1], low, length)
            if len(first):
                found.append((first, last + length + period, period))
        if not dictionary.longer():
            break
        length *= 2
    if not found:
        return np.zeros((0, 4), np.int64)
    start, end, period = (np.concatenate(column) for column in zip(*found, strict=True))
    end += dictionary.ahead(end - period, end)
    start -= dictionary.behind(start, start + period)
    kept = end - start >= np.maximum(least, repeats * period)
    rows = np.stack([texts[start], start, end - start, period], axis=1)[kept]
    return np.unique(rows, axis=0)


def numbered(texts: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """A number per different word, and the text's number, of all words of all texts."""
    known: dict[bytes, int] = {}
    size = sum(map(len, texts))
    words = np.fromiter((known.setdefault(w, len(known)) for w in chain.from_iterable(texts)), np.int64, size)
    return words, np.repeat(np.arange(len(texts)), list(map(len, texts)))


def find_runs(
    df: DataFrame, *, text: str = "text", runs: str = "runs", collapsed: str = "collapsed", n_words: str = "n_words",
    least: int = LEAST, repeats: int = REPEATS, also: list[str] | None = None,
    rewrite: Callable[..., list[bytes]] | None = None,
) -> DataFrame:
    """Add ``n_words``, ``runs`` (start, length, period, by start and then period) and ``collapsed``: the words that
    no run repeats, joined by one space. A word is repeated if a run holds it after the run's first period.

    Words are what stands between ASCII white space. NULL and empty texts have no words and no runs. Repeated rows
    get equal results; an empty table stays empty; existing columns of the three names are replaced. ``rewrite``
    may change a text's words beforehand, given also the columns named in ``also``.
    """

    def prepare():
        def judge(contents: list, *others: list) -> list[list]:
            texts = [(t or "").encode("utf-8", "surrogatepass").split() for t in contents]
            if rewrite:
                texts = [rewrite(words, *values) for words, *values in zip(texts, *others, strict=True)]
            words, owner = numbered(texts)
            rows = runs_of(words, owner, least, repeats)
            first = np.concatenate([[0], np.cumsum(list(map(len, texts)), dtype=np.int64)])
            inner = np.zeros(len(words) + 1, np.int64)
            np.add.at(inner, rows[:, 1] + rows[:, 3], 1)
            np.add.at(inner, rows[:, 1] + rows[:, 2], -1)
            gone = np.cumsum(inner)[:-1] > 0
            by_text: list[list[dict]] = [[] for _ in texts]
            for owner_, start, length, period in rows.tolist():
                by_text[owner_].append({"start": start - int(first[owner_]), "length": length, "period": period})
            whole = []
            for i, words_ in enumerate(texts):
                if by_text[i]:
                    drop = gone[first[i] : first[i + 1]].tolist()
                    words_ = [w for w, out in zip(words_, drop, strict=True) if not out]
                whole.append(b" ".join(words_).decode("utf-8", "surrogatepass"))
            return [list(map(len, texts)), by_text, whole]

        return judge

    fields = [
        StructField(n_words, LongType()), StructField(runs, ArrayType(RUN)), StructField(collapsed, StringType())
    ]
    return add_columns(df, [text, *(also or [])], fields, prepare)


def steepest(runs: Column) -> Column:
    """The run of the greatest length by period; of equal ones the first to start, then the smaller period."""
    better = lambda a, b: (
        b.isNull()
        | (a.length * b.period > b.length * a.period)
        | ((a.length * b.period == b.length * a.period) & (F.struct(a.start, a.period) < F.struct(b.start, b.period)))
    )
    none = F.lit(None).cast(RUN)
    return F.aggregate(runs, none, lambda best, run: F.when(better(run, best), run).otherwise(best))
