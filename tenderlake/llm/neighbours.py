"""Approximate nearest neighbours in balanced posting lists.

A bounded sample (``SAMPLE`` vectors) is halved again and again, each time across the direction in which it
spreads most, until a part holds ``LEAF`` vectors; the means of the parts are the centroids. Halves are
equal, so the lists are balanced. The centroids, at most SAMPLE / LEAF * 2 of them, are searched by a graph
in memory that links each with its nearest and with a few distant ones. Every vector is put into the list of
its nearest centroid; one near a boundary also goes into up to three others almost as near. A query opens the lists whose centroid is at most (1 + ratio)
times as far as its nearest one; the ratio is the smallest that reaches ``RECALL`` on the sample.

Lists are searched by exact distance. However many vectors one list gets (a hot region, thousands of
copies), it is cut into chunks of bounded size, and so are the queries that open it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenderlake.llm.common import cut, sampled
from tenderlake.llm.vectors import block_of, copies_to, usable_vectors

SAMPLE = 16_384
LEAF = 64
LINKS = 16
FAR_LINKS = 4
REPLICAS = 4
NEAR = 0.1
RECALL = 0.97
RATIOS = (*(i / 100 for i in range(1, 40)), *(i / 10 for i in range(4, 20)), 1e9)
ROWS_PER_CHUNK = 4096
QUERIES_PER_CHUNK = 1024


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.maximum((a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * a @ b.T, 0)


def halves(points: np.ndarray, leaf: int = LEAF) -> list[np.ndarray]:
    """Equal parts of at most ``leaf`` points, as arrays of places."""
    parts, todo = [], [np.arange(len(points))]
    while todo:
        part = todo.pop()
        if len(part) <= leaf:
            parts.append(part)
            continue
        x = points[part] - points[part].mean(0)
        direction = x[np.argmax((x * x).sum(1))]
        for _ in range(8):  # power iteration towards the widest direction
            direction = x.T @ (x @ direction)
            direction /= np.linalg.norm(direction) or 1.0
        order = np.argsort(x @ direction, kind="stable")
        todo += [part[order[: len(part) // 2]], part[order[len(part) // 2 :]]]
    return parts


class Index:
    """Centroids, their graph, and the ratio up to which a query opens lists."""

    def __init__(self, sample: np.ndarray, k: int = 10):
        parts = halves(sample) if len(sample) else []
        self.centroids = np.unique(np.array([sample[p].mean(0) for p in parts]), axis=0) if parts else np.zeros((0, 0))
        count = len(self.centroids)
        links = min(LINKS, max(count - 1, 0))
        draw = np.random.RandomState(3)
        gaps = squared(self.centroids, self.centroids) if count else np.zeros((0, 0))
        near = np.argsort(gaps, axis=1, kind="stable")[:, 1 : links + 1]
        far = draw.randint(0, max(count, 1), (count, FAR_LINKS))
        self.graph = np.concatenate([near, far], 1) if count else np.zeros((0, 0), int)
        self.starts = draw.choice(count, min(8, count), replace=False) if count else np.zeros(0, int)
        self.ratio = self._fit_ratio(sample, k) if count > 1 else RATIOS[-1]

    def nearest(self, x: np.ndarray, beam: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and squared distances of about the ``beam`` nearest centroids, by best-first graph search.

        All rows of ``x`` move together: each step opens the nearest unopened centroid of each row's beam.
        """
        rows, count = len(x), len(self.centroids)
        beam = min(beam, count)
        known = np.full((rows, count), np.inf)
        opened = np.zeros((rows, count), bool)
        every = np.arange(rows)
        norm = (x * x).sum(1)
        sizes = (self.centroids * self.centroids).sum(1)

        def look(at: np.ndarray, who: np.ndarray) -> None:
            gaps = sizes[at] + norm[who][:, None] - 2 * np.einsum("rd,rld->rl", x[who], self.centroids[at])
            known[who[:, None], at] = np.maximum(gaps, 0)

        look(np.broadcast_to(self.starts, (rows, len(self.starts))), every)
        active = every
        while len(active):
            beam_edge = np.partition(known[active], beam - 1, axis=1)[:, beam - 1]
            waiting = np.where(opened[active], np.inf, known[active])
            pick = waiting.argmin(1)
            gap = waiting[np.arange(len(active)), pick]
            go = np.isfinite(gap) & (gap <= beam_edge)
            active, pick = active[go], pick[go]
            if len(active):
                opened[active, pick] = True
                look(self.graph[pick], active)
        order = np.argsort(known, axis=1, kind="stable")[:, :beam]
        return order, np.take_along_axis(known, order, 1)

    def lists_of(self, x: np.ndarray) -> np.ndarray:
        """Up to ``REPLICAS`` lists per row (-1 where fewer)."""
        places, gaps = self.nearest(x, 2 * LINKS)
        out = np.full((len(x), REPLICAS), -1)
        out[:, 0] = places[:, 0]
        filled = np.ones(len(x), int)
        limit = (1 + NEAR) ** 2 * gaps[:, 0]
        for step in range(1, min(places.shape[1], REPLICAS)):
            c, gap = places[:, step], gaps[:, step]
            good = (gap <= limit) & np.isfinite(gap) & (filled < REPLICAS)
            out[good, filled[good]] = c[good]
            filled += good
        return out

    def opened_by(self, x: np.ndarray, sizes: np.ndarray, least: int) -> list[np.ndarray]:
        """Lists each query opens: by distance ratio, and on until they hold ``least`` entries."""
        places, gaps = self.nearest(x, len(self.centroids))
        out = []
        for row, gap in zip(places, gaps, strict=True):
            reach = np.isfinite(gap)
            row, gap = row[reach], gap[reach]
            count = int((gap <= (1 + self.ratio) ** 2 * gap[0]).sum())
            enough = np.flatnonzero(np.cumsum(sizes[row]) >= least)
            out.append(row[: max(count, int(enough[0]) + 1 if len(enough) else len(row))])
        return out

    def _fit_ratio(self, sample: np.ndarray, k: int) -> float:
        """The smallest ratio of ``RATIOS`` with which the sample's own neighbours are found."""
        asked = sample[:: max(1, len(sample) // 256)]
        gaps = squared(asked, sample)
        want = np.argsort(gaps, axis=1, kind="stable")[:, 1 : k + 1]
        lists = self.lists_of(sample)
        places, near = self.nearest(asked, len(self.centroids))
        for ratio in RATIOS:
            hits = 0
            for i in range(len(asked)):
                limit = (1 + ratio) ** 2 * near[i, 0]
                hits += np.isin(lists[want[i]], places[i][near[i] <= limit]).any(1).sum()
            if hits >= RECALL * want.size:
                return ratio
        return RATIOS[-1]


def nearest_neighbours(
    df: DataFrame, *, k: int = 10, every: int = 100, vec_id: str = "vec_id", embedding: str = "embedding"
) -> DataFrame:
    """The ``k`` nearest rows found for each query, a row whose id ``every`` divides.

    Returns query_id, rank (from 1), vec_id and score, the Euclidean distance of the original vectors in
    double precision; ties go to the smaller id; the query's own row is no candidate. Vectors that are NULL,
    zero, or hold NULL or non-finite components take no part, nor do those of another length than most
    (the shorter if two are as common). Repeated ids count once. An empty table gives no rows.
    """
    rows = cut(usable_vectors(df, vec_id, embedding, zero=False).withColumn("d", F.size("v")))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    rows = rows.where(F.col("d") == (sizes["d"] if sizes else 0)).select("id", "v")
    # A bounded sample, the same whatever the partitioning.
    chosen = sampled(rows, F.col("id"), SAMPLE).collect()
    index = Index(np.array([r["v"] for r in sorted(chosen)]), k)
    if not len(index.centroids):
        return rows.selectExpr("id as query_id", "1 as rank", "id as vec_id", "0D as score").where("false")
    shared = df.sparkSession.sparkContext.broadcast(index)

    def stacked(batch: pa.RecordBatch) -> np.ndarray:
        return batch.column(1).flatten().to_numpy().reshape(batch.num_rows, -1)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1024):
                part = batch.slice(start, 1024)
                lists = shared.value.lists_of(stacked(part))
                row, slot = np.nonzero(lists >= 0)
                took = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists[row, slot].astype(np.int32)), *took.columns], names=["list", "id", "v"]
                )

    schema = "list int, id long, v array<double>"
    posted = cut(rows.mapInArrow(post, schema))
    # One row per list: as many as centroids, which the sample bounds.
    counts = posted.groupBy("list").agg(F.count("*").alias("rows"))
    sizes = np.zeros(len(index.centroids), np.int64)
    for r in counts.collect():
        sizes[r["list"]] = r["rows"]

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                opened = shared.value.opened_by(stacked(part), sizes, REPLICAS * (k + 1))
                row = np.repeat(np.arange(part.num_rows), [len(o) for o in opened])
                lists = np.concatenate(opened) if opened else np.zeros(0)
                took = part.take(pa.array(row))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(lists.astype(np.int32)), *took.columns], names=["list", "id", "v"]
                )

    asked = cut(rows.where(F.col("id") % every == 0).mapInArrow(ask, schema))
    asks = asked.groupBy("list").agg(F.count("*").alias("asks"))
    chunks = F.broadcast(  # one row per list
        cut(counts.join(asks, "list")).select(
            "list",
            F.ceil(F.col("rows") / ROWS_PER_CHUNK).cast("int").alias("rc"),
            F.ceil(F.col("asks") / QUERIES_PER_CHUNK).cast("int").alias("qc"),
        )
    )
    keys = ["list", "r", "q"]
    left = posted.join(chunks, "list").select(
        "list", "id", "v", block_of("id", F.col("rc"), 1).alias("r"), copies_to(F.col("qc")).alias("q")
    )
    right = asked.join(chunks, "list").select(
        "list", "id", "v", block_of("id", F.col("qc"), 2).alias("q"), copies_to(F.col("rc")).alias("r")
    )

    def search(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [[], [], []]
        if len(a) and len(b):
            ids, vectors, queries = a["id"].to_numpy(), np.stack(a["v"]), np.stack(b["v"])
            gaps = squared(queries, vectors)
            slack = 1e-9 * ((queries * queries).sum(1) + (vectors * vectors).sum(1).max())
            for own, query, gap, more in zip(b["id"], queries, gaps, slack, strict=True):
                gap[ids == own] = np.inf
                edge = np.partition(gap, min(k, len(gap)) - 1)[min(k, len(gap)) - 1]
                near = np.flatnonzero((gap <= edge + more) & (ids != own))
                exact = np.sqrt(((vectors[near] - query) ** 2).sum(1))
                best = near[np.lexsort((ids[near], exact))[:k]]
                out[0] += [own] * len(best)
                out[1] += ids[best].tolist()
                out[2] += np.sqrt(((vectors[best] - query) ** 2).sum(1)).tolist()
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), out, strict=True)))

    found = (
        left.groupBy(*keys)
        .cogroup(right.groupBy(*keys))
        .applyInPandas(lambda a, b: search(a, b), "query_id long, vec_id long, score double")
    )
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return (
        found.groupBy("query_id", "vec_id")
        .agg(F.min("score").alias("score"))
        .withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
