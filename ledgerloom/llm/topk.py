"""Exact top-k by inner product with a dual-tree search over cover trees.

A bounded sample of vectors gives the centres of balls; every row belongs to the ball of its
nearest centre, and a ball of more than a block is dealt into several.  The kth best score of a
query among the sample is a floor of its kth best of all, so a query goes only to those balls
whose bound <q, centre> + |q| radius reaches its floor: the others are dropped before any vector
is shuffled.  Queries and candidates that meet get a cover tree each: a node has a centre, a
covering radius and children whose centres cover it at half the scale, down to leaves.  The
search walks pairs of nodes, best bound first, and prunes a pair when

    <q, c> + |q| r_c + |c| r_q + r_q r_c  <  the worst kth score of the query node

since no pair below it can then score enough.  Leaves are scored by one matrix product.  The k
best of each block are merged by a window.  Equal vectors are searched once, with their ids.

Vectors without any structure (spread evenly over a sphere of many dimensions) can't be pruned by
any bound of this kind; then every query block meets every candidate block, and work grows with
the number of queries times that of candidates.

Defined results: vectors that are null or hold null or non-finite components, and null ids, take
no part; vectors of another length than the query's aren't its candidates, and vectors without
components score 0 with each other; repeated rows count as rows of their own, and a query whose id
is repeated gets the best of all pairs of its rows; equal scores go to the smaller id; an empty table gives an empty result; other columns are ignored.  Scores are exact
for |component| up to about 2 ** 20.
"""

from __future__ import annotations

import heapq
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import lists_of, stored

#: points of a leaf: parted further above the first, and above the second whatever the gain
LEAF, MOST = 64, 2048
#: numbers in a block of vectors; it bounds the memory of a group
BLOCK_NUMBERS = 1 << 20
#: sampled vectors (about, and at most twice as many), and balls
SAMPLE, PIVOTS = 2048, 1024


class Node:
    __slots__ = ("centre", "norm", "radius", "rows", "children", "worst")

    def __init__(self, centre, radius, rows, children):
        self.centre, self.radius, self.rows, self.children = centre, radius, rows, children
        self.norm = float(np.sqrt(centre @ centre))
        self.worst = -math.inf


def cover_tree(points: np.ndarray, leaf: int = LEAF, most: int = MOST) -> Node:
    """A cover tree of points, built top down.

    At each level centres are picked so that they are over a scale apart and every point is
    within the scale of its centre; the scale halves from level to level.  Up to `most` points
    whose parts would be about as wide as the whole stay one leaf, as no bound could part them.
    """

    def build(rows: np.ndarray, centre: np.ndarray, away: np.ndarray) -> Node:
        radius = float(away.max())
        if len(rows) <= leaf or radius == 0.0:
            return Node(centre, radius, rows, ())
        scale, left, children = radius / 2, np.arange(len(rows)), []
        own = points[rows]
        while len(left):
            # the centre itself comes first, then the farthest point not covered yet
            pick = left[np.argmin(away[left])] if not children else left[np.argmax(away[left])]
            gap = np.sqrt(((own[left] - own[pick]) ** 2).sum(axis=1))
            near = gap <= scale
            children.append((rows[left[near]], own[pick], gap[near]))
            left = left[~near]
            if len(children) >= 32 and len(left):  # a wide level: what is left goes to its nearest centre
                middle = np.stack([c for _, c, _ in children])
                d = (own[left] ** 2).sum(1)[:, None] - 2 * own[left] @ middle.T + (middle**2).sum(1)
                best = d.argmin(axis=1)
                for k in np.unique(best):
                    more = left[best == k]
                    r, c, g = children[k]
                    exact = np.sqrt(((own[more] - c) ** 2).sum(axis=1))
                    children[k] = (np.concatenate((r, rows[more])), c, np.concatenate((g, exact)))
                break
        width = sum(float(g.max()) * len(g) for _, _, g in children) / len(rows)
        if len(children) == 1 or (len(rows) <= most and width > 0.8 * radius):
            return Node(centre, radius, rows, ())
        return Node(centre, radius, None, tuple(build(*c) for c in children))

    rows = np.arange(len(points))
    return build(rows, points[0], np.sqrt(((points - points[0]) ** 2).sum(axis=1)))


def runs_of(new: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From where runs begin: the number of each row's run, and the row's place in it."""
    run = np.cumsum(new) - 1
    return run, np.arange(len(new)) - np.flatnonzero(new)[run]


def distinct(vectors: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct vectors, the number of ids of each, and the smallest ids of each, one after another.

    An id stands up to k times, and 2 k ids are kept, so that k are left without any one of them.
    """
    order = np.lexsort((ids, *vectors.T))
    vectors, ids = vectors[order], ids[order]
    new = np.concatenate(([True], (vectors[1:] != vectors[:-1]).any(axis=1)))
    points = vectors[new]
    copies = runs_of(new | np.concatenate(([True], ids[1:] != ids[:-1])))[1]
    point, ids = (np.cumsum(new) - 1)[copies < k], ids[copies < k]
    some = runs_of(np.concatenate(([True], point[1:] != point[:-1])))[1] < 2 * k
    return points, np.bincount(point[some]), ids[some]


class Best:
    """The `keep` best (score, id) of each query so far, and under which score nothing more is wanted."""

    def __init__(self, floors: np.ndarray, keep: int):
        self.score = np.full((len(floors), keep), -np.inf)
        self.id = np.full((len(floors), keep), np.iinfo(np.int64).max)
        self.worst, self.keep = floors.astype(np.float64), keep

    def add(self, rows: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        """Candidates of rows[row]."""
        n = len(rows)
        row = np.concatenate((np.repeat(np.arange(n), self.keep), row))
        score = np.concatenate((self.score[rows].ravel(), score))
        ids = np.concatenate((self.id[rows].ravel(), ids))
        order = np.lexsort((ids, -score, row))
        place = np.arange(len(order)) - np.searchsorted(row[order], np.arange(n))[row[order]]
        order = order[place < self.keep]  # each row has `keep` or more
        self.score[rows] = score[order].reshape(n, self.keep)
        self.id[rows] = ids[order].reshape(n, self.keep)
        self.worst[rows] = np.maximum(self.worst[rows], self.score[rows, -1])


def search(
    queries: np.ndarray, query_ids: np.ndarray, floors: np.ndarray, data: np.ndarray, data_ids: np.ndarray, k: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Query ids, ids and scores of the k best candidates in this block for each query, rows of its own id
    left out, and the number of pairs scored.  Candidates under a query's floor aren't wanted."""
    points, n_ids, ids = distinct(data, data_ids, k)
    first_id = np.cumsum(n_ids) - n_ids
    # so many points may have nothing but a query's own id
    own = max(1, int(np.unique(ids[np.isin(ids, query_ids)], return_counts=True)[1].max(initial=0)))
    best = Best(floors, k)
    left, right = cover_tree(queries), cover_tree(points)
    scored = 0

    def bound(a: Node, b: Node) -> float:
        """The largest product of a point of a and one of b, a little more for rounding."""
        x = float(a.centre @ b.centre) + a.norm * b.radius + b.norm * a.radius + a.radius * b.radius
        return x + 1e-9 * abs(x) + 1e-6

    def compare(a: Node, b: Node) -> None:
        score = queries[a.rows] @ points[b.rows].T
        enough = best.worst[a.rows]
        if score.shape[1] > k + own:
            enough = np.maximum(enough, np.partition(score, -k - own, axis=1)[:, -k - own])
        row, at = np.nonzero(score >= enough[:, None])
        point = b.rows[at]
        times = n_ids[point]
        each = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(first_id[point], times)
        row, score, found = np.repeat(row, times), np.repeat(score[row, at], times), ids[each]
        others = found != query_ids[a.rows][row]
        if others.any():
            best.add(a.rows, row[others], score[others], found[others])
        a.worst = float(best.worst[a.rows].min())

    def refresh(a: Node) -> float:
        if a.children:
            a.worst = min(c.worst for c in a.children)
        elif a.worst == -math.inf:
            a.worst = float(best.worst[a.rows].min())
        return a.worst

    count = 0
    heap = [(-bound(left, right), count, left, right)]
    while heap:
        b, _, x, y = heapq.heappop(heap)
        if -b < refresh(x):
            continue
        if not x.children and not y.children:
            compare(x, y)
            scored += len(x.rows) * len(y.rows)
            continue
        pairs = [(u, y) for u in x.children] if x.children and (not y.children or x.radius >= y.radius) else [(x, v) for v in y.children]
        for u, v in pairs:
            d = bound(u, v)
            if d >= refresh(u):
                count += 1
                heapq.heappush(heap, (-d, count, u, v))
    there = np.isfinite(best.score)
    row, _ = np.nonzero(there)
    return query_ids[row], best.id[there], best.score[there].astype(np.int64), scored


def matrix(column: pa.ChunkedArray | pa.Array, rows: int) -> np.ndarray:
    """Lists of one length as a matrix."""
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(rows, -1) if rows else np.zeros((0, 0))


def quantised(df: DataFrame, id_col: str, vector_col: str, factor: int = 1024) -> DataFrame:
    """id and integer vector of the rows that take part."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < F.lit(float("inf"))))
    return df.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite).select(
        F.col(id_col).cast("long").alias("vec_id"), F.transform(x, lambda v: F.floor(v * factor).cast("double")).alias("v")
    )


class Cells:
    """Balls around sampled vectors that together hold every row: centre, radius and number of blocks of each."""

    def __init__(self, sample: list, n: int, block: int):
        self.points, self.ids = {}, {}
        for dim in sorted({len(r.v) for r in sample}):
            own = sorted((r for r in sample if len(r.v) == dim), key=lambda r: r.vec_id)
            self.points[dim] = np.array([r.v for r in own], np.float64).reshape(len(own), dim)
            self.ids[dim] = np.array([r.vec_id for r in own], np.int64)
        most = min(PIVOTS, max(1, 4 * n // block))
        self.pivots = {dim: np.unique(x, axis=0)[:most] if dim else x[:1] for dim, x in self.points.items()}
        self.block, self.of = block, {}

    def measured(self, found: list) -> None:
        """Radius and number of blocks of each ball, from how far its rows are and how many they are."""
        for number, r in enumerate(found):
            centre = self.pivots[r.dim][r.pivot] if r.pivot >= 0 else np.zeros(r.dim)
            self.of.setdefault(r.dim, []).append((number, centre, r.away, max(1, -(-r.rows // self.block))))

    def nearest(self, dim: int, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the ball of each row and its distance from the centre; -1 and the norm where the sample has no such length."""
        if dim not in self.pivots:
            return np.full(len(x), -1), np.sqrt((x**2).sum(axis=1))
        p = self.pivots[dim]
        at = ((p**2).sum(axis=1) - 2 * x @ p.T).argmin(axis=1)
        return at, np.sqrt(((x - p[at]) ** 2).sum(axis=1))

    def floors(self, dim: int, x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
        """The kth best score of each row among the sample without its own id: its kth best of all is no less."""
        if dim not in self.points:
            return np.full(len(x), -np.inf)
        score = x @ self.points[dim].T
        score[ids[:, None] == self.ids[dim]] = -np.inf
        return np.partition(score, -k, axis=1)[:, -k] if score.shape[1] >= k else np.full(len(x), -np.inf)

    def reached(self, dim: int, x: np.ndarray, floors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row and number of the ball, of each pair whose bound reaches the row's floor."""
        cells = self.of[dim]
        bound = x @ np.stack([c for _, c, _, _ in cells]).T
        bound += np.sqrt((x**2).sum(axis=1))[:, None] * np.array([r for _, _, r, _ in cells])
        bound += 1e-9 * np.abs(bound) + 1e-6
        row, at = np.nonzero(bound >= floors[:, None])
        return row, np.array([i for i, _, _, _ in cells])[at]


def by_length(batch: pa.RecordBatch, size: int = 4096):
    """Rows of a batch that have one length, some at a time: the length, their places and their vectors."""
    dims = batch.column("dim").to_numpy()
    for dim in np.unique(dims):
        at = np.flatnonzero(dims == dim)
        for i in range(0, len(at), size):
            some = at[i : i + size]
            yield int(dim), some, matrix(batch.column("v").take(pa.array(some)), len(some))


def candidates(rows: DataFrame, chosen: DataFrame) -> DataFrame:
    """Rows of each ball, once for every block of queries of which one reaches the ball; other rows are left behind.

    The pairs of blocks and balls are no more than the balls, whose number is bounded, times the blocks.
    """
    wanted = chosen.select(F.col("query_block").alias("asked_by"), F.explode("cells").alias("cell")).distinct()
    return rows.join(wanted, "cell")


def top_k(vectors: DataFrame, is_query: Column, k: int = 10, block: int | None = None) -> DataFrame:
    """query_id, rank, vec_id and score over (vec_id, v); `is_query` says which rows are queries."""
    n = vectors.agg(F.count("*").alias("n"), F.count_if(is_query).alias("q"), F.max(F.size("v")).alias("dim")).first()
    block = block or max(256, BLOCK_NUMBERS // max(1, n.dim or 1))
    cut = F.pmod(F.xxhash64("vec_id", "v"), F.lit(1 << 30)) < F.lit(int((1 << 30) * min(1.0, SAMPLE / max(1, n.n))))
    cells = Cells(vectors.select("vec_id", "v").filter(cut).limit(2 * SAMPLE).collect(), n.n, block)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pivot, away = np.zeros(b.num_rows, np.int32), np.zeros(b.num_rows)
            for dim, at, x in by_length(b):
                pivot[at], away[at] = cells.nearest(dim, x)
            names = ["vec_id", "v", "dim", "asks", "salt", "pivot", "away"]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(pivot), pa.array(away)], names)

    salt = F.floor(F.rand(20240229) * (1 << 30))  # equal rows are dealt apart; what was drawn is written down
    rows = vectors.select("vec_id", "v", F.size("v").alias("dim"), F.coalesce(is_query, F.lit(False)).alias("asks"), salt.alias("salt"))
    placed = stored(rows.mapInArrow(place, "vec_id long, v array<double>, dim int, asks boolean, salt long, pivot int, away double"))
    found = placed.groupBy("dim", "pivot").agg(F.max("away").alias("away"), F.count("*").alias("rows"), F.count_if("asks").alias("asks"))
    found = found.orderBy("dim", "pivot").collect()
    cells.measured(found)
    blocks = F.array(*[F.lit(max(1, -(-r.rows // block))) for r in found]) if found else F.array(F.lit(1))
    spark = vectors.sparkSession
    # queries before each ball's own: those of neighbouring places fill a block together, those of a large ball several
    before = itertools.accumulate((r.asks for r in found), initial=0)
    balls = [(r.dim, r.pivot, i, o, max(1, r.asks)) for i, (r, o) in enumerate(zip(found, before, strict=False))]
    numbered = spark.createDataFrame(balls, "dim int, pivot int, cell int, before long, asks_here long")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column("vec_id").to_numpy()
            for dim, at, x in by_length(b, 512):
                floors = cells.floors(dim, x, ids[at], k)
                row, cell = cells.reached(dim, x, floors)
                counts = np.bincount(row, minlength=len(at))
                own = [b.column(c).take(pa.array(at)) for c in ("v", "query_block")]
                columns = [pa.array(ids[at]), *own, pa.array(floors), lists_of(cell.astype(np.int32), counts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["vec_id", "v", "query_block", "floor", "cells"])

    asking = placed.filter("asks").join(F.broadcast(numbered), ["dim", "pivot"])  # at most PIVOTS rows a length
    at = F.col("before") + F.pmod(F.xxhash64("vec_id", F.lit(2)), F.col("asks_here"))
    asking = asking.select("vec_id", "v", "dim", F.floor(at / block).cast("int").alias("query_block"))
    chosen = stored(asking.mapInArrow(choose, "vec_id long, v array<double>, query_block int, floor double, cells array<int>"))
    queries = chosen.select("vec_id", "v", "floor", "query_block", F.explode("cells").alias("cell"))
    queries = queries.select(
        "cell",
        F.explode(F.sequence(F.lit(0).cast("long"), F.get(blocks, F.col("cell")).cast("long") - 1)).alias("block"),
        "query_block",
        "vec_id",
        "v",
        "floor",
    )
    data = candidates(placed.join(F.broadcast(numbered.select("dim", "pivot", "cell")), ["dim", "pivot"]), chosen).select(
        "cell",
        F.pmod("salt", F.get(blocks, F.col("cell")).cast("long")).alias("block"),
        F.col("asked_by").alias("query_block"),
        "vec_id",
        "v",
    )

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        ids, others, scores = np.zeros((3, 0), np.int64)
        if q.num_rows and d.num_rows:
            x, y = matrix(q.column("v"), q.num_rows), matrix(d.column("v"), d.num_rows)
            numbers = q.column("vec_id").to_numpy(), q.column("floor").to_numpy()
            ids, others, scores, _ = search(x, *numbers, y, d.column("vec_id").to_numpy(), k)
        return pa.table({"query_id": ids, "vec_id": others, "score": scores})

    keys = ["cell", "block", "query_block"]
    best = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        queries.groupBy(*keys)
        .cogroup(data.groupBy(*keys))
        .applyInArrow(run, "query_id long, vec_id long, score long")
        .withColumn("rank", F.row_number().over(best))
        .filter(F.col("rank") <= k)
        .select("query_id", "rank", "vec_id", "score")
    )
