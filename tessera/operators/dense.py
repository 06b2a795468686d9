"""Dense vectors: normalisation, centroids, cosines and exact top-k by blocks.

Top-k against all rows goes by blocks of queries and blocks of the tower: each task multiplies one
block by one, a slice of queries at a time, and keeps k rows a query; nothing is broadcast and no pair becomes a
row before it is scored. Blocks grow with the rows up to a bound, so up to there what is sent grows as they do.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.columns import cosine, norm
from tessera.operators.ranking import topk_per_group
from tessera.operators.sets import shared_counts
from tessera.sources.stored import stored


def normalised(df: DataFrame, vector: str) -> DataFrame:
    """Rows with a non-empty vector, scaled to length 1 (zero vectors stay)."""
    v = F.col(vector)
    length = norm(v)
    return df.where(F.size(v) > 0).withColumn(vector, F.when(length > 0, F.transform(v, lambda x: x / length)).otherwise(F.transform(v, lambda x: x.cast("double"))))


def norm_check(df: DataFrame, vector: str, tolerance: float = 1e-3) -> DataFrame:
    """n, n_off, largest_gap: how far vectors are from length 1."""
    gap = F.abs(norm(F.col(vector)) - 1)
    return df.agg(F.count("*").alias("n"), F.count_if(gap > tolerance).alias("n_off"), F.max(gap).alias("largest_gap"))


def centroid(df: DataFrame, keys: list[str], vector: str, weight: Column | None = None) -> DataFrame:
    """keys, vector: the (weighted) mean of a group's vectors, scaled to length 1; sums combine map-side by dimension."""
    w = F.lit(1.0) if weight is None else weight
    dims = df.select(*keys, w.alias("_w"), F.posexplode(vector).alias("_k", "_x"))
    sums = dims.groupBy(*keys, "_k").agg(F.sum(F.col("_w") * F.col("_x")).alias("_s"))
    mean = sums.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_k", "_s"))), lambda s: s["_s"]).alias("vector"))
    return normalised(mean, "vector")


def pair_cosines(pairs: DataFrame, vectors: DataFrame, a: str, b: str, key: str, vector: str) -> DataFrame:
    """pairs with `cosine` of the vectors of columns a and b; NULL where one is missing."""
    left = vectors.select(F.col(key).alias(a), F.col(vector).alias("_va"))
    right = vectors.select(F.col(key).alias(b), F.col(vector).alias("_vb"))
    return pairs.join(left, a, "left").join(right, b, "left").withColumn("cosine", cosine("_va", "_vb")).drop("_va", "_vb")


def _matrix(column: pa.ChunkedArray, rows: np.ndarray) -> np.ndarray:
    """The vectors of some rows, from Arrow's flat values."""
    flat = column.take(pa.array(np.flatnonzero(rows))).combine_chunks().flatten()
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(int(rows.sum()), -1)


def best_columns(scores: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of the k largest finite scores of each row, ties to smaller ids."""
    n, k = scores.shape[1], min(k, scores.shape[1])
    least = np.partition(scores, n - k, axis=1)[:, n - k]
    row, col = np.nonzero((scores >= least[:, None]) & np.isfinite(scores))
    order = np.lexsort((ids[col], -scores[row, col], row))
    row, col = row[order], col[order]
    first = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=len(scores)))])
    top = np.arange(len(row)) - first[row] < k
    return row[top], col[top]


#: Queries of a block whose scores are held at once: BLOCK x SLICE numbers.
SLICE = 256

#: Rows of a block once there are enough blocks to share: what is sent grows with the square of the rows over this.
BLOCK, AT_LEAST = 32768, 64


def _block(rows: int, block: int, most: int = 0) -> int:
    """Rows a block: `block`, or more where that gives over AT_LEAST pairs of blocks, up to BLOCK or the larger `most`."""
    return max(block, min(max(BLOCK, most), -(-rows // int(AT_LEAST**0.5))))


def _by_slices(qi: np.ndarray, xi: np.ndarray, q: np.ndarray, x: np.ndarray, k: int, out: Callable[[slice], np.ndarray] | None = None) -> pa.Table:
    """The k best rows of each query by product, itself and those marked by `out` left out, a slice of queries at a time."""
    found = [_found(qi[:0], xi, np.zeros((0, len(xi))), k)]
    for first in range(0, len(qi) if len(xi) else 0, SLICE):
        some = slice(first, first + SLICE)
        scores = np.round(q[some] @ x.T, 9)
        scores[qi[some, None] == xi[None, :]] = -np.inf
        if out is not None:
            scores[out(some)] = -np.inf
        found.append(_found(qi[some], xi, scores, k))
    return pa.concat_tables(found)


def _found(qi: np.ndarray, xi: np.ndarray, scores: np.ndarray, k: int) -> pa.Table:
    row, col = best_columns(scores, xi, k) if scores.size else (np.zeros(0, int), np.zeros(0, int))
    columns = [pa.array(qi[row], pa.int64()), pa.array(xi[col], pa.int64()), pa.array(scores[row, col], pa.float64())]
    return pa.Table.from_arrays(columns, names=["query_id", "id", "score"])


def best_in_block(k: int):
    """Arrow function of one block pair (id, vector, asks): the k best rows of each query, by product."""

    def run(table: pa.Table) -> pa.Table:
        asks, ids = table.column("asks").to_numpy(zero_copy_only=False), table.column("id").to_numpy()
        if not asks.any() or asks.all():
            return _by_slices(ids[:0], ids[:0], ids[:0], ids[:0], k)
        return _by_slices(ids[asks], ids[~asks], _matrix(table.column("vector"), asks), _matrix(table.column("vector"), ~asks), k)

    return run


def best_sets_in_block(k: int):
    """Arrow function of one block pair (id, features, asks): the k sets of largest cosine above 0 for each query's."""

    def run(table: pa.Table) -> pa.Table:
        asks, ids = table.column("asks").to_numpy(zero_copy_only=False), table.column("id").to_numpy()
        lists = table.column("features").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        row, code = np.repeat(np.arange(len(ids)), size), lists.flatten().dictionary_encode().indices.to_numpy()
        qi, xi = ids[asks], ids[~asks]
        place, of_query = np.where(asks, np.cumsum(asks), np.cumsum(~asks)) - 1, asks[row]
        shared = shared_counts(place[row[of_query]], code[of_query], len(qi), place[row[~of_query]], code[~of_query], len(xi)).astype(np.float64)
        scores = np.where(shared > 0, np.round(shared / np.sqrt(np.maximum(size[asks][:, None] * size[~asks][None, :], 1)), 9), -np.inf)
        scores[qi[:, None] == xi[None, :]] = -np.inf
        return _found(qi, xi, scores, k)

    return run


def _in_blocks(queries: DataFrame, rows: DataFrame, value: str, block: int) -> DataFrame:
    """Queries and rows dealt into block pairs (qb, xb): id, value and whether it asks."""
    nq, nx = max(1, -(-queries.count() // block)), max(1, -(-rows.count() // block))
    part = lambda n: F.pmod(F.xxhash64("id"), F.lit(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    ask = queries.select("id", value, F.lit(True).alias("asks"), part(nq).alias("qb"), every(nx).alias("xb"))
    stand = rows.select("id", value, F.lit(False).alias("asks"), every(nq).alias("qb"), part(nx).alias("xb"))
    return ask.unionByName(stand)


def dense_topk(queries: DataFrame, tower: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """query_id, id, score, rank: the k rows of the tower (id, vector) of largest product for every query (id, vector), itself left out.

    Scores count at nine digits, ties go to the smaller id.
    """
    found = _in_blocks(queries, tower, "vector", _block(tower.count(), block)).groupBy("qb", "xb").applyInArrow(best_in_block(k), "query_id long, id long, score double")
    return topk_per_group(found, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def best_positive_in_block(k: int):
    """Arrow function of one block pair (id, vector, asks): the k best rows of each query, whatever its id, that share a dimension with it; entries aren't negative."""

    def run(table: pa.Table) -> pa.Table:
        asks, ids = table.column("asks").to_numpy(zero_copy_only=False), table.column("id").to_numpy()
        qi, xi = ids[asks], ids[~asks]
        found = [_found(qi[:0], xi, np.zeros((0, len(xi))), k)]
        if asks.any() and not asks.all():
            q, x = _matrix(table.column("vector"), asks), _matrix(table.column("vector"), ~asks)
            for first in range(0, len(qi), SLICE):
                scores = q[first : first + SLICE] @ x.T
                row, col = best_columns(np.where(scores > 0, np.round(scores, 9), -np.inf), xi, k)
                columns = [pa.array(qi[first + row], pa.int64()), pa.array(xi[col], pa.int64()), pa.array(scores[row, col], pa.float64())]
                found.append(pa.Table.from_arrays(columns, names=["query_id", "id", "score"]))
        return pa.concat_tables(found)

    return run


def positive_topk(queries: DataFrame, tower: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """query_id, id, score, rank: as dense_topk, of two different tables without negative entries, for pairs of product above 0; scores are whole, compared at nine digits."""
    rows = _in_blocks(queries, tower, "vector", min(8192, _block(tower.count(), block)))  # vectors are long
    found = rows.groupBy("qb", "xb").applyInArrow(best_positive_in_block(k), "query_id long, id long, score double")
    return topk_per_group(found, ["query_id"], [F.round("score", 9).desc(), F.col("id")], k)


def best_outside_in_block(k: int):
    """Arrow function of one block pair (id, vector, label, asks): as best_in_block, without rows of the label a query is away from."""

    def run(table: pa.Table) -> pa.Table:
        asks, ids = table.column("asks").to_numpy(zero_copy_only=False), table.column("id").to_numpy()
        label = table.column("label").to_numpy(zero_copy_only=False)
        if not asks.any() or asks.all():
            return _by_slices(ids[:0], ids[:0], ids[:0], ids[:0], k)
        away = lambda some: label[asks][some, None] == label[~asks][None, :]
        return _by_slices(ids[asks], ids[~asks], _matrix(table.column("vector"), asks), _matrix(table.column("vector"), ~asks), k, away)

    return run


def dense_topk_outside(queries: DataFrame, tower: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """dense_topk of queries (id, vector, away) over rows (id, vector, label), without rows whose label is the query's `away`."""
    pack = lambda df, label: df.select("id", F.struct("vector", F.col(label).cast("long").alias("label")).alias("v"))
    rows = _in_blocks(pack(queries, "away"), pack(tower, "label"), "v", _block(tower.count(), block)).select("id", "v.vector", "v.label", "asks", "qb", "xb")
    found = rows.groupBy("qb", "xb").applyInArrow(best_outside_in_block(k), "query_id long, id long, score double")
    return topk_per_group(found, ["query_id"], [F.col("score").desc(), F.col("id")], k)


#: Rows of a block that are scored at once, and the numbers that the vectors of a block hold where these are short.
CHUNK, NUMBERS = 4096, 1 << 21


def _above(q: np.ndarray, x: np.ndarray, ids: np.ndarray, k: int, query: np.ndarray, column: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, column and score (nine digits) of each query's k best rows, ties to smaller ids, without the pairs (query, column; sorted by both).

    Rows are met by falling length, CHUNK at a time, in single precision; only pairs that may reach a query's k-th score so far are
    scored in double precision, and chunks whose lengths allow none for any query of the slice are left out.
    """
    length, mine = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
    order = np.argsort(-length, kind="stable")
    x, length, ids = x[order], length[order], ids[order]
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    column = place[column]
    of_pair = np.lexsort((column, query))
    query, column = query[of_pair], column[of_pair]
    kind = np.float32 if mine.max(initial=0.0) * length.max(initial=0.0) < 1e30 else np.float64
    q32, x32 = q.astype(kind), x.astype(kind)
    slack = (q.shape[1] + 4) * 2.0**-23 * mine * (length[0] if len(length) else 0.0) + 2e-9
    found = []
    for first in range(0, len(q), SLICE):
        some = slice(first, min(first + SLICE, len(q)))
        n = some.stop - some.start
        low, high = np.searchsorted(query, [some.start, some.stop])
        key = np.argsort(column[low:high] // CHUNK, kind="stable")
        out_q, out_c = query[low:high][key] - first, column[low:high][key]
        cut = np.searchsorted(out_c // CHUNK, np.arange(-(-len(x) // CHUNK) + 1))
        best = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.float64))
        least = np.full(n, -np.inf)
        for c, at in enumerate(range(0, len(x), CHUNK)):
            if (mine[some] * length[at] + slack[some] < least).all():
                break
            scores = q32[some] @ x32[at : at + CHUNK].T
            scores[out_q[cut[c] : cut[c + 1]], out_c[cut[c] : cut[c + 1]] - at] = -np.inf
            bar = least - slack[some]
            if c == 0 and scores.shape[1] > k:
                bar = np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k].astype(np.float64) - 2 * slack[some]
            row, col = np.divmod(np.flatnonzero(scores >= np.nextafter(bar.astype(kind), kind(-np.inf))[:, None]), scores.shape[1])
            keep = np.isfinite(scores[row, col])
            row, col = row[keep], col[keep] + at
            if not len(row):
                continue
            exact = np.round(np.einsum("ij,ij->i", q[first + row], x[col]), 9)
            row, col, exact = (np.concatenate([o, v]) for o, v in zip(best, (row, col, exact), strict=True))
            order = np.lexsort((ids[col], -exact, row))
            row, col, exact = row[order], col[order], exact[order]
            rank = np.arange(len(row)) - np.searchsorted(row, row)
            best = row[rank < k], col[rank < k], exact[rank < k]
            full = np.flatnonzero(rank == k - 1)
            least[row[full]] = exact[full]
        found.append((first + best[0], best[1], best[2]))
    row, col, score = (np.concatenate([f[j] for f in found]) if found else np.zeros(0, t) for j, t in enumerate((np.int64, np.int64, np.float64)))
    return row, ids[col] if len(ids) else col, score


def best_unseen_in_block(k: int):
    """Arrow function of one block pair (id, vector, seen, asks): as best_in_block, without the rows that a query has seen."""

    def run(table: pa.Table) -> pa.Table:
        asks, ids = table.column("asks").to_numpy(zero_copy_only=False), table.column("id").to_numpy()
        qi, xi = ids[asks], ids[~asks]
        if not asks.any() or asks.all():
            return _found(qi, xi, np.zeros((len(qi), len(xi))), k)
        q, x = _matrix(table.column("vector"), asks), _matrix(table.column("vector"), ~asks)
        seen = table.column("seen").take(pa.array(np.flatnonzero(asks))).combine_chunks()
        query, item = np.repeat(np.arange(len(qi)), np.diff(seen.offsets.to_numpy())), seen.flatten().to_numpy()
        order = np.argsort(xi)
        at = np.minimum(np.searchsorted(xi[order], item), len(xi) - 1)
        here = xi[order][at] == item
        row, best, score = _above(q, x, xi, k, query[here], order[at[here]])
        return pa.Table.from_arrays([pa.array(qi[row], pa.int64()), pa.array(best, pa.int64()), pa.array(score, pa.float64())], names=["query_id", "id", "score"])

    return run


def dense_topk_unseen(queries: DataFrame, tower: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """query_id, id, score, rank: the k rows of the tower (distinct id, vector) of largest product for every query (id, vector, seen), without those in `seen`.

    Still every query meets every row; blocks hold a bounded number of numbers, so short vectors are sent seldom.
    """
    none = F.array().cast("array<long>")
    pack = lambda df, seen: df.select("id", F.struct("vector", seen.alias("seen")).alias("v"))
    queries = stored(pack(queries, F.coalesce(F.col("seen").cast("array<long>"), none)), "queries")  # counted, then dealt
    n_rows, width = tower.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
    block = _block(n_rows, block, NUMBERS // max(1, width))
    pairs = max(1, -(-queries.count() // block)) * max(1, -(-n_rows // block))
    rows = _in_blocks(queries, pack(tower, none), "v", block).select("id", "v.vector", "v.seen", "asks", "qb", "xb").repartition(pairs, "qb", "xb")
    found = rows.groupBy("qb", "xb").applyInArrow(best_unseen_in_block(k), "query_id long, id long, score double")
    return topk_per_group(found, ["query_id"], [F.col("score").desc(), F.col("id")], k)


def sparse_topk(sets: DataFrame, k: int, block: int = 2048) -> DataFrame:
    """query_id, id, score, rank: the k other sets (distinct id, features) of largest cosine above 0 for every set, at nine digits.

    Equal sets are one class with one list. Of a class no more than its k + 1 smallest ids can be on a list, and no other
    classes than the k + 1 nearest beside its own; so only classes meet, in blocks. A block's features get numbers of
    their own, so the products are as wide as a block pair needs.
    """
    held = stored(sets.where(F.size("features") > 0).select("id", F.array_sort("features").alias("features")), "sets")
    classes = stored(held.groupBy("features").agg(F.min("id").alias("class")), "classes")
    of_class = stored(held.join(classes, "features").select("class", "id"), "members")
    members = topk_per_group(of_class, ["class"], [F.col("id")], k + 1).drop("rank")
    one = classes.select(F.col("class").alias("id"), "features")
    found = _in_blocks(one, one, "features", block).groupBy("qb", "xb").applyInArrow(best_sets_in_block(k + 1), "query_id long, id long, score double")
    best = lambda rows: topk_per_group(rows, ["query_id"], [F.col("score").desc(), F.col("id")], k + 1)
    near = best(found).select("query_id", F.col("id").alias("class"), "score").unionByName(classes.select(F.col("class").alias("query_id"), "class", F.lit(1.0).alias("score")))
    lists = best(near.join(members, "class").select("query_id", "id", "score"))
    lists = lists.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "id", "score"))).alias("_l")).withColumnRenamed("query_id", "class")
    every = of_class.withColumnRenamed("id", "query_id").join(lists, "class")
    others = F.slice(F.filter("_l", lambda x: x["id"] != F.col("query_id")), 1, k)
    return every.select("query_id", F.posexplode(others).alias("_at", "_x")).select("query_id", "_x.id", "_x.score", (F.col("_at") + 1).cast("long").alias("rank"))


def largest_in_block(asks: pa.Table, stand: pa.Table) -> pa.Table:
    """Arrow function of one group's block pair: the largest product of each asking vector with the others."""
    if not asks.num_rows or not stand.num_rows:
        return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.float64())], names=["id", "score"])
    every = lambda t: _matrix(t.column("vector"), np.ones(t.num_rows, bool))
    q, x = every(asks), every(stand)
    best = np.concatenate([(q[first : first + SLICE] @ x.T).max(axis=1) for first in range(0, len(q), SLICE)])
    return pa.Table.from_arrays([asks.column("id").combine_chunks(), pa.array(best)], names=["id", "score"])


def max_similarity_to_group(asks: DataFrame, rows: DataFrame, group: str, block: int = 2048) -> DataFrame:
    """id, max_similarity: the largest product of each row of asks (id, vector, group) with the rows (vector, group) of its group.

    Groups are cut into blocks by a hash, so one of any size is shared by tasks; no pair becomes a row.
    """
    n_rows = rows.count()
    block = _block(n_rows, block)
    na, nx = max(1, -(-asks.count() // block)), max(1, -(-n_rows // block))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = asks.select("id", "vector", group, F.pmod(F.xxhash64("id"), F.lit(na)).alias("qb"), every(nx).alias("xb"))
    right = rows.select("vector", group, every(na).alias("qb"), F.pmod(F.xxhash64("vector"), F.lit(nx)).alias("xb"))
    keys = [group, "qb", "xb"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(largest_in_block, "id long, score double")
    return found.groupBy("id").agg(F.max("score").alias("max_similarity"))


def max_similarity(pairs: DataFrame, keys: list[str], score: str) -> DataFrame:
    """keys, max_similarity: the largest over a set, missing ones left out."""
    return pairs.groupBy(*keys).agg(F.max(score).alias("max_similarity"))


def pca(df: DataFrame, vector: str, k: int) -> DataFrame:
    """Add `components`: the first k principal components (pyspark.ml)."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    rows = df.withColumn("_v", array_to_vector(F.transform(vector, lambda x: x.cast("double"))))
    return PCA(k=k, inputCol="_v", outputCol="_c").fit(rows).transform(rows).withColumn("components", vector_to_array("_c")).drop("_v", "_c")
