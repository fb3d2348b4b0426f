"""Exact top-k inner products by Fagin's threshold algorithm over sorted per-dimension lists.

Rows are dealt by hash into blocks of bounded size. A block sorts each dimension once. A query walks the
lists of all its dimensions at once, from the largest values down where its own value is positive and from
the smallest up where it is negative, and scores every row it meets. No row it has not met can score more
than the sum of its values times the values it has reached; once its k-th best score is above that bound, the
block is done. The first block of rows gives each query a k-th score that is a bound for all other blocks, so
these can stop before they have found k rows of their own, or before the first step.

Scores are whole numbers and exact. The best of the blocks' answers are the best of the table.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import cut
from tenderlake.llm.vectors import block_of, copies_to, usable_vectors

ROWS_PER_BLOCK = 8192
QUERIES_PER_BLOCK = 4096
QUERIES_PER_FIRST = 256
FIRST_DEPTH = 16
EXACT = 2**53
LONG = 2**63 - 1


class Block:
    """Rows of one block with a sorted list per dimension. Shorter vectors count as padded with zeros."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray], width: int):
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.rows = np.zeros((len(ids), width), np.int64)
        for row, i in zip(self.rows, order, strict=True):
            row[: len(vectors[i])] = vectors[i]
        self.top = float(np.abs(self.rows.astype(np.float64)).max(initial=0))
        # One list per dimension and direction, made once: searches only look at pieces of them.
        self.rising = np.ascontiguousarray(np.argsort(self.rows, axis=0, kind="stable").T.astype(np.int32))
        self.falling = np.ascontiguousarray(self.rising[:, ::-1])
        self.values = self.rows.astype(np.float64)

    def search(self, query: np.ndarray, own: int, k: int, floor: int | None) -> list[tuple[int, int]]:
        """The block's best (score, id) for a query, at most ``k``, that may be among the best overall."""
        dims = np.flatnonzero(query)
        count = len(self.ids)
        # Doubles hold these sums exactly, or else Python's integers do.
        small = self.top * np.abs(query.astype(np.float64)).sum() < EXACT
        kind = np.float64 if small else object
        weights = query.astype(kind)
        rises, falls = np.flatnonzero(query < 0), np.flatnonzero(query > 0)
        table = self.values if small else self.rows
        seen = np.zeros(count, bool)
        seen[self.ids == own] = True
        best: list[tuple[int, int]] = []
        low, high = 0, min(FIRST_DEPTH, count)
        while low < count:
            bound = 0
            for lists, of in ((self.rising, rises), (self.falling, falls)):
                if len(of):
                    bound += (table[lists[of, low], of].astype(kind, copy=False) * weights[of]).sum()
            kth = max([*(best[k - 1 :][:1] and [best[k - 1][0]]), *([] if floor is None else [floor])], default=None)
            if kth is not None and kth > bound:
                break
            met = np.zeros(count, bool)
            met[self.rising[rises, low:high].ravel()] = True
            met[self.falling[falls, low:high].ravel()] = True
            if not len(dims):  # every row scores nothing
                met[:] = True
            new = np.flatnonzero(met & ~seen)
            seen |= met
            if small and 8 * len(new) > count:  # picking many rows out costs more than scoring all
                scores = (table @ weights)[new]
            else:
                scores = table[new].astype(kind, copy=False) @ weights
            if len(best) == k:
                keep = scores >= best[-1][0]
                new, scores = new[keep], scores[keep]
            if len(new) > k:
                cutoff = np.partition(scores, len(scores) - k)[len(scores) - k] if small else sorted(scores)[-k]
                keep = scores >= cutoff
                new, scores = new[keep], scores[keep]
            best = sorted(
                [*best, *((int(s), int(i)) for s, i in zip(scores, self.ids[new], strict=True))],
                key=lambda x: (-x[0], x[1]),
            )[:k]
            if seen.all():
                break
            low, high = high, min(count, 2 * high)
        return best


def top_products(
    df: DataFrame, *, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding", scale: int = 1024
) -> DataFrame:
    """The ``k`` rows of highest integer inner product for each query, a row whose id ``every`` divides.

    Components count as floor(``scale`` * x). Returns query_id, rank (from 1), vec_id and score; ties go to
    the smaller id; the query's own row is no candidate. Vectors that are NULL or hold NULL or non-finite
    components take no part; zero and empty vectors do. Repeated ids count once. Scores beyond 64 bits
    come out as the nearest 64-bit number. An empty table, or one without queries, gives no rows.
    """
    whole = F.transform(F.col("v"), lambda x: F.floor(F.lit(float(scale)) * x).cast("long"))
    rows = cut(usable_vectors(df, vec_id, embedding, zero=True).select("id", whole.alias("v")))
    queries = rows.where(F.col("id") % every == 0)
    size = rows.agg(F.count("*"), F.max(F.size("v")), F.count_if(F.col("id") % every == 0)).first()
    width = size[1] or 0
    row_blocks = max(1, -(-size[0] // ROWS_PER_BLOCK))
    query_blocks = max(1, -(-size[2] // QUERIES_PER_BLOCK))

    def search(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple[int, int, int]] = []
        if len(left) and len(right):
            block = Block(left["id"].to_numpy(), left["v"].tolist(), width)
            for own, v, floor in zip(right["id"], right["v"], right["floor"], strict=True):
                query = np.zeros(width, np.int64)
                query[: len(v)] = v
                found = block.search(query, int(own), k, None if floor is None or pd.isna(floor) else int(floor))
                out += [(own, i, min(max(s, -LONG - 1), LONG)) for s, i in found]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"]).astype("int64")

    dealt = rows.withColumn("block", block_of("id", row_blocks, 1))

    def run(part: DataFrame, asked: DataFrame, first: bool) -> DataFrame:
        # One block only meets the first search: smaller groups of queries give it enough tasks.
        groups = max(1, -(-size[2] // min(QUERIES_PER_FIRST, QUERIES_PER_BLOCK))) if first else query_blocks
        blocks = F.lit(0) if first else copies_to(row_blocks, 1)
        left = part.withColumn("q", copies_to(groups))
        right = asked.withColumn("q", block_of("id", groups, 2)).withColumn("block", blocks)
        return (
            left.groupBy("block", "q")
            .cogroup(right.groupBy("block", "q"))
            .applyInPandas(lambda a, b: search(a, b), "query_id long, vec_id long, score long")
        )

    # The k-th score of the first block, as text: a nullable whole number keeps all its digits that way.
    found = cut(run(dealt.where("block = 0"), queries.withColumn("floor", F.lit(None).cast("string")), True))
    kth = found.groupBy(F.col("query_id").alias("id")).agg(
        F.when(F.count("*") >= k, F.min("score")).cast("string").alias("floor")
    )
    if row_blocks > 1:
        asked = cut(queries.join(kth, "id", "left").select("id", "v", "floor"))
        found = found.union(run(dealt.where("block > 0"), asked, False))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )


ORACLE_SQL = """
WITH e AS (
    SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
    SELECT q.vec_id AS query_id, c.vec_id,
           list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i]))::BIGINT AS score
    FROM e AS q JOIN e AS c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id
)
SELECT query_id, rank, vec_id, score FROM (
    SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
) WHERE rank <= 10
"""
