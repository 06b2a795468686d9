"""Nearest neighbours by inner product, from vantage-point trees per shard.

Inner products become distances by one more coordinate: with M the largest norm, a vector x gets
sqrt(M^2 - |x|^2) and a query 0, so that the nearest vector has the largest product. Vectors are
dealt at random into shards of a bounded number of rows. A shard's tree is grown once and stored: it
splits around vantage points at the median distance, and its leaves are runs of the shard's rows. By
the triangle inequality a side is skipped where the gap between the query's distance and the median
exceeds the distance of its k-th best so far. The gap counts `factor` times: 1 skips only what can't
hold a better vector and is exact, more skips more. Each query takes the nearer side first; all
queries of a block go down the tree together, so each node is one numpy product.

Of equal vectors only rows of the k + 1 smallest ids, k of each at most, can be among k nearest (a
query leaves out the rows of one id), so no more of them are indexed. Searches against all rows take
the queries in slabs, each against each shard's tree; no pair is formed before it is compared, and k
rows leave a slab and shard for each query.

Defined cases: vectors that are NULL, empty, zero or hold a NULL or non-finite component take no
part, as query or candidate; NULL ids neither. Vectors meet those of their own length only. Of
repeated rows (of one id and vector) each is a candidate, but they ask once. An id that asks with
several vectors gets k rows, ranked from 1, for each of them. A query leaves out every row of its
own id. Extra columns aren't read. An empty table gives no row.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored

LEAF = 64


@dataclass
class Tree:
    """Rows in the order of the leaves, and the splits: node k around points[k] at middles[k].

    kids[k] holds a node's inner and outer side: a node's number, or -1 - the number of a leaf. Leaf
    j is the rows from ends[j - 1] (0 for the first) to ends[j] - 1.
    """

    vectors: np.ndarray
    ids: np.ndarray
    points: np.ndarray
    middles: np.ndarray
    kids: np.ndarray
    ends: np.ndarray


def grow(vectors: np.ndarray, ids: np.ndarray, leaf: int = LEAF, seed: int = 11) -> Tree:
    """A tree over vectors: of a few candidates, the vantage point whose distances spread most.

    Larger leaves make fewer nodes, and so fewer and larger products where little is skipped.
    """
    rng, order = np.random.default_rng(seed), np.arange(len(vectors))
    points, middles, kids, ends = [], [], [], []

    def side(rows: np.ndarray, at: int) -> int:
        """The number of what holds these rows, whose first place is `at`."""
        order[at : at + len(rows)] = rows
        split = _split(vectors, rows, rng) if len(rows) > leaf else None
        if split is None:
            ends.append(at + len(rows))
            return -len(ends)
        point, middle, near = split
        k = len(points)
        points.append(point)
        middles.append(middle)
        kids.append((0, 0))
        kids[k] = (side(rows[near], at), side(rows[~near], at + int(near.sum())))
        return k

    side(order.copy(), 0)
    width = vectors.shape[1]
    return Tree(vectors[order], ids[order], np.array(points).reshape(-1, width), np.array(middles), np.array(kids, np.int64).reshape(-1, 2), np.array(ends, np.int64))


def _split(vectors: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, float, np.ndarray] | None:
    """Vantage point, median distance and which rows lie within it; None where no distance tells rows apart."""
    tries, sample = vectors[rng.choice(rows, 5)], vectors[rng.choice(rows, 64)]
    spread = np.linalg.norm(tries[:, None] - sample[None], axis=2).var(axis=1)
    point = tries[int(spread.argmax())]
    away = np.linalg.norm(vectors[rows] - point, axis=1)
    middle = float(np.median(away))
    near = away <= middle
    if near.all():  # over half the rows as far
        near = away < middle
        if not near.any():
            return None
        middle = float(away[near].max())
    return point, middle, near


class Search:
    """k nearest rows of a tree for a block of queries, all at once. Rows of a query's own id don't count.

    `compared` is the number of pairs whose product was formed.
    """

    def __init__(self, tree: Tree, queries: np.ndarray, own: np.ndarray, k: int, factor: float):
        self.tree, self.queries, self.own, self.k, self.factor = tree, queries, own, k, factor
        self.square = (tree.vectors**2).sum(axis=1)
        # slack in squared distance: products of other shapes round otherwise, and ties are settled later
        self.slack = 1e-9 * max(1.0, float(self.square.max(initial=0)))
        self.q_square = (queries**2).sum(axis=1)
        self.best = np.full((len(queries), k), np.inf)  # squared distances, ascending
        self.found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.compared = 0
        if len(tree.vectors) and len(queries):
            self.visit(0 if len(tree.points) else -1, np.arange(len(queries)))

    def visit(self, node: int, at: np.ndarray) -> None:
        if not len(at):
            return
        if node < 0:
            self.leaf(-1 - node, at)
            return
        point, middle, (inner, outer) = self.tree.points[node], self.tree.middles[node], self.tree.kids[node]
        away = np.sqrt(np.maximum(self.q_square[at] + (point**2).sum() - 2 * (self.queries[at] @ point), 0))
        gap = self.factor * np.abs(away - middle)
        inside = away <= middle
        self.visit(inner, at[inside])
        self.visit(outer, at[~inside])
        reach = np.sqrt(self.best[at, -1] + self.slack) + 1e-9
        self.visit(outer, at[inside & (gap <= reach)])
        self.visit(inner, at[~inside & (gap <= reach)])

    def leaf(self, leaf: int, at: np.ndarray) -> None:
        begin, end = self.tree.ends[leaf - 1] if leaf else 0, self.tree.ends[leaf]
        self.compared += len(at) * int(end - begin)
        d = self.square[None, begin:end] + self.q_square[at][:, None] - 2 * (self.queries[at] @ self.tree.vectors[begin:end].T)
        d[self.own[at][:, None] == self.tree.ids[None, begin:end]] = np.inf
        hit, col = np.nonzero(d <= self.best[at, -1:] + self.slack)
        some = np.isfinite(d[hit, col])
        hit, col = hit[some], col[some]
        if len(hit):
            self.found.append((at[hit], begin + col, d[hit, col]))
            touched = np.unique(hit)
            both = np.concatenate([self.best[at[touched]], d[touched]], axis=1)
            self.best[at[touched]] = np.sort(np.partition(both, self.k - 1, axis=1)[:, : self.k], axis=1)

    def result(self) -> tuple[np.ndarray, np.ndarray]:
        """Query and row numbers of all that are among the k best or tie with the last."""
        if not self.found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        q, r, d = (np.concatenate(x) for x in zip(*self.found, strict=True))
        keep = d <= self.best[q, -1] + self.slack
        return q[keep], r[keep]


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of row pairs, components added one after the other, so that any shape gives the same digits."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += a[:, k] * b[:, k]
    return out


def _matrix(column: pa.ChunkedArray, length: int) -> np.ndarray:
    return column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, length)


TREES = "length int, shard long, ids array<long>, vectors binary, points binary, middles binary, kids binary, ends binary"


def growing(norm: float, leaf: int):
    """Arrow function of one shard (id, v1, vector, length, shard): its tree, as one row."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("id", "ascending"), ("v1", "ascending")])  # the same tree at every run
        length = table.column("length")[0].as_py()
        x = _matrix(table.column("vector"), length)
        t = grow(np.column_stack([x, np.sqrt(np.maximum(norm**2 - (x**2).sum(axis=1), 0))]), table.column("id").to_numpy(), leaf)
        raw = [pa.array([m.tobytes()], pa.binary()) for m in (t.vectors, t.points, t.middles, t.kids, t.ends)]
        first = [table.column(c).slice(0, 1).combine_chunks() for c in ("length", "shard")]
        return pa.Table.from_arrays([*first, pa.array([t.ids], pa.list_(pa.int64())), *raw], names=["length", "shard", "ids", "vectors", "points", "middles", "kids", "ends"])

    return run


def _read_tree(table: pa.Table) -> Tree:
    width = table.column("length")[0].as_py() + 1
    raw = lambda name, kind=np.float64: np.frombuffer(table.column(name)[0].as_buffer(), kind)
    ids = table.column("ids").combine_chunks().flatten().to_numpy()
    return Tree(raw("vectors").reshape(-1, width), ids, raw("points").reshape(-1, width), raw("middles"), raw("kids", np.int64).reshape(-1, 2), raw("ends", np.int64))


def searching(k: int, factor: float):
    """Arrow function of one shard's tree and a slab (id, v1, v2, vector, ...): k rows a query, which v1 and v2 tell from others of its id."""

    def run(trees: pa.Table, asks: pa.Table) -> pa.Table:
        names = ["query_id", "v1", "v2", "vec_id", "score"]
        if not trees.num_rows or not asks.num_rows:
            return pa.Table.from_arrays([pa.array([], t) for t in (pa.int64(),) * 4 + (pa.float64(),)], names=names)
        tree, length = _read_tree(trees), trees.column("length")[0].as_py()
        q, q_ids = _matrix(asks.column("vector"), length), asks.column("id").to_numpy()
        a, r = Search(tree, np.column_stack([q, np.zeros(len(q))]), q_ids, k, factor).result()
        x = tree.vectors[:, :length]
        score = np.concatenate([products(q[a[i : i + 100_000]], x[r[i : i + 100_000]]) for i in range(0, len(a), 100_000)] or [np.zeros(0)])
        order = np.lexsort((tree.ids[r], -score, a))
        a, r, score = a[order], r[order], score[order]
        first = np.concatenate([[0], np.cumsum(np.bincount(a, minlength=len(q)))])
        top = np.arange(len(a)) - first[a] < k
        v1, v2 = (asks.column(n).to_numpy()[a[top]] for n in ("v1", "v2"))
        return pa.Table.from_arrays([pa.array(c) for c in (q_ids[a[top]], v1, v2, tree.ids[r[top]], score[top])], names=names)

    return run


def usable(vector: Column) -> Column:
    """Whether a vector takes part: not NULL or empty, all components finite, not all zero."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def nearest(vectors: DataFrame, queries: Column, k: int = 20, factor: float = 1.0, id_col: str = "vec_id", vector: str = "embedding", shard_rows: int = 16_384, slab_rows: int = 16_384) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the k rows of largest inner product for every row where `queries` holds.

    Ties go to the smaller id. `shard_rows` and `slab_rows` bound a tree and the queries that meet it
    in one task. Every tree goes to each slab and every query to each shard, so what is shuffled grows
    as rows x queries / `slab_rows` + queries x rows / `shard_rows`.
    """
    rows = vectors.where(F.col(id_col).isNotNull() & usable(F.col(vector)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("vector"), F.coalesce(queries, F.lit(False)).alias("asks"))
    rows = rows.withColumn("length", F.size("vector"))
    distinct = rows.groupBy("id", "vector", "length").agg(F.count("*").alias("n"), F.max("asks").alias("asks"))
    distinct = stored(distinct.withColumns({"v1": F.xxhash64("vector"), "v2": F.xxhash64(F.lit(7), "vector")}), "distinct-vectors")
    square = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    n, asked, most = distinct.agg(F.sum(F.least("n", F.lit(k))), F.count_if("asks"), F.max(square)).first()
    if not n or not asked:
        return distinct.select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.lit(0.0).alias("score")).limit(0)
    shards, slabs = -(-n // shard_rows), -(-asked // slab_rows)
    # first by parts of a vector's ids, so that no task meets all rows of a common vector
    first = lambda keys: F.row_number().over(Window.partitionBy("vector", *keys).orderBy("id"))
    indexed = distinct.withColumn("_part", F.pmod(F.xxhash64(F.lit(3), "id"), F.lit(16)))
    indexed = indexed.withColumn("_n", first(["_part"])).where(F.col("_n") <= k + 1).withColumn("_n", first([])).where(F.col("_n") <= k + 1)
    indexed = indexed.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least(F.col("n"), F.lit(k)))))
    part = lambda salt, m: F.pmod(F.xxhash64(F.lit(salt), "id", "v1"), F.lit(m))
    every = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    dealt = indexed.select("id", "v1", "vector", "length", part(1, shards).alias("shard"))
    trees = stored(dealt.groupBy("length", "shard").applyInArrow(growing(float(most) ** 0.5, max(LEAF, shard_rows // 64)), TREES), "trees")
    asks = distinct.where("asks").select("id", "v1", "v2", "vector", "length", part(2, slabs).alias("slab"), every(shards).alias("shard"))
    blocks = ["length", "shard", "slab"]
    near = trees.withColumn("slab", every(slabs)).groupBy(*blocks).cogroup(asks.groupBy(*blocks)).applyInArrow(searching(k, factor), "query_id long, v1 long, v2 long, vec_id long, score double")
    order = Window.partitionBy("query_id", "v1", "v2").orderBy(F.col("score").desc(), "vec_id")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
