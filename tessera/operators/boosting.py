"""A pairwise ranker: boosted trees on lambda gradients, grown from distributed feature histograms.

Features are binned once by quantiles, and each group's rows laid in one line. Each round turns scores into gradients (every relevant row of a
group against the rows of lesser label, weighted by the change of nDCG that exchanging them would make), without an exchange,
and grows one tree level by level: one grouped sum over (node, feature, bin) a level, summed by
batches first, so nodes x features x bins rows leave the tasks whatever the input. Running sums over the
bins give each node's best split; only these reach the driver, at most 2^depth a level. Trees are small
tables of nodes; scoring and attribution walk them in Arrow batches.

Defined cases: a NULL or NaN feature has a bin of its own, below all others. Groups without a relevant row, or with
nothing else, give no gradient. NULL labels count as 0. Equal gains go to the first feature, then the lower bin; equal scores to the smaller item.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.products import ROWS
from tessera.sources.stored import stored

#: Pairs of rows whose gradients are formed at once.
PAIRS = 1 << 20


@dataclass
class Node:
    """Node 1 is the root, 2n and 2n + 1 the sides of n: rows whose bin of `feature` is at most `bin` go to 2n; -1 is a leaf."""

    node: int
    feature: int
    bin: int
    value: float
    gain: float
    n: int


@dataclass
class Forest:
    features: list[str]
    edges: list[list[float]]
    rate: float
    trees: list[list[Node]] = field(default_factory=list)

    def table(self, spark) -> DataFrame:
        """tree, node, feature (NULL for leaves), bin, value, gain, n."""
        rows = [(k, x.node, self.features[x.feature] if x.feature >= 0 else None, x.bin, x.value, x.gain, x.n) for k, t in enumerate(self.trees) for x in t]
        return spark.createDataFrame(rows, "tree int, node int, feature string, bin int, value double, gain double, n long")


def quantile_edges(df: DataFrame, features: list[str], bins: int = 32) -> list[list[float]]:
    """Up to bins - 1 distinct edges of each feature, from mergeable quantile sketches in one pass."""
    points = [k / bins for k in range(1, bins)]
    real = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    row = df.agg(*[F.percentile_approx(real(c), points, 10_000).alias(f"q{k}") for k, c in enumerate(features)]).first()
    return [sorted(set(q or [])) for q in row]


def _edges_below(x: Column, edges: list[float]) -> Column:
    return F.size(F.filter(F.array(*[F.lit(float(e)) for e in edges]).cast("array<double>"), lambda e: e < x))


def binned(features: list[str], edges: list[list[float]]) -> Column:
    """Array of bins: 0 for NULL and NaN, else 1 and the number of edges below the value."""
    out = []
    for c, e in zip(features, edges, strict=True):
        x = F.col(c).cast("double")
        out.append(F.when(x.isNull() | F.isnan(x), 0).otherwise(1 + _edges_below(x, e)).cast("int"))
    return F.array(*out)


def packed(rows: DataFrame, keys: list[str], item: str, columns: dict[str, Column]) -> DataFrame:
    """keys and an array for each of the columns: a group's rows (stored) in one line, by item. Groups are dealt into partitions of about ROWS rows."""
    n = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    one = F.struct(F.col(item).alias("_item"), *[c.alias(name) for name, c in columns.items()])
    lines = rows.select(*keys, one.alias("_x")).repartition(n, *keys).groupBy(*keys).agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    return lines.select(*keys, *[F.col(f"_x.{name}").alias(name) for name in columns])


def _pairwise(size: np.ndarray, y: np.ndarray, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivatives of the rows of groups (sizes, labels, scores), rows of a group by item; about PAIRS pairs are held at once."""
    group, start = np.repeat(np.arange(len(size)), size), np.cumsum(size) - size
    gain = 2.0**y - 1

    def disc(by: np.ndarray) -> np.ndarray:
        out = np.empty(len(y))
        out[np.lexsort((-by, group))] = 1 / np.log2(2.0 + np.arange(len(y)) - start[group])  # groups lie one after the other
        return out

    d, heads = disc(s), np.flatnonzero(y > 0)
    ideal = np.bincount(group, gain * disc(y), minlength=len(size))
    g, h = np.zeros(len(y)), np.zeros(len(y))
    upto, low = np.cumsum(size[group[heads]]), 0
    while low < len(heads):
        high = max(low + 1, int(np.searchsorted(upto, (upto[low - 1] if low else 0) + PAIRS, side="right")))
        n = size[group[heads[low:high]]]
        p = np.repeat(heads[low:high], n)
        q = np.arange(len(p)) - np.repeat(np.cumsum(n) - n, n) + start[group[p]]
        less = y[q] < y[p]
        p, q = p[less], q[less]
        with np.errstate(over="ignore"):
            rho = 1 / (1 + np.exp(s[p] - s[q]))
        delta = np.abs(gain[p] - gain[q]) * np.abs(d[p] - d[q]) / ideal[group[p]]
        g += np.bincount(q, rho * delta, minlength=len(y)) - np.bincount(p, rho * delta, minlength=len(y))
        h += np.bincount(q, rho * (1 - rho) * delta, minlength=len(y)) + np.bincount(p, rho * (1 - rho) * delta, minlength=len(y))
        low = high
    return g, h


def _of(b: pa.RecordBatch, name: str) -> np.ndarray:
    return b.column(b.schema.names.index(name)).flatten().to_numpy(zero_copy_only=False)


def _listed(b: pa.RecordBatch, values: np.ndarray) -> pa.Array:
    offsets = b.column(b.schema.names.index("_y")).offsets.to_numpy()
    return pa.ListArray.from_arrays(pa.array(offsets - offsets[0], pa.int32()), pa.array(values))


def _sizes(b: pa.RecordBatch) -> np.ndarray:
    return np.diff(b.column(b.schema.names.index("_y")).offsets.to_numpy())


def lambda_gradients(rows: DataFrame, keys: list[str], item: str, label: str = "label", score: str = "score") -> DataFrame:
    """rows with `g` and `h`: first and second derivative of the pairwise loss by the score.

    Pairs are those of a relevant row with rows of lesser label in its group: relevant rows x rows, in one exchange by group. A group's rows are held together.
    """
    names = rows.columns
    rows = stored(rows, "ranked")
    lines = packed(rows, keys, item, {"_y": _label(label), "_s": F.col(score).cast("double"), "_r": F.struct(*names)}).select("_y", "_s", "_r")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            g, h = _pairwise(_sizes(b), _of(b, "_y"), _of(b, "_s"))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index("_r")), _listed(b, g), _listed(b, h)], names=["_r", "g", "h"])

    made = lines.mapInArrow(run, f"_r {lines.schema['_r'].dataType.simpleString()}, g array<double>, h array<double>")
    return made.select(F.explode(F.arrays_zip("_r", "g", "h")).alias("_x")).select("_x._r.*", "_x.g", "_x.h")


def _label(label: str) -> Column:
    return F.coalesce(F.col(label).cast("double"), F.lit(0.0))


def _nodes(tree: list[Node], bins: np.ndarray) -> np.ndarray:
    """The number of the leaf that each row of bins falls into, or of the lowest node known so far."""
    node = np.ones(len(bins), np.int64)
    for x in sorted(tree, key=lambda x: x.node):
        if x.feature >= 0:
            at = np.flatnonzero(node == x.node)
            node[at] = 2 * x.node + (bins[at, x.feature] > x.bin)
    return node


#: A derivative as two whole numbers, so that sums don't depend on their order: millionths, and what is left in 10^-15.
COARSE, FINE = 1e6, 1e9


def _whole(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    coarse = np.floor(x * COARSE)
    return coarse, np.round((x * COARSE - coarse) * FINE)


def histograms(lines: DataFrame, tree: list[Node], n_features: int, open_nodes: list[int]) -> DataFrame:
    """node, feature, bin, n, g, h of the rows of groups (_bins, g, h) in these nodes: sums of batches, then one grouped sum.

    Sums are exact decimals of 15 places: the same rows give the same sum whatever bins and batches they stand in, so equal splits have equal gains.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = _of(b, "_bins").reshape(-1, n_features).astype(np.int64)
            node = _nodes(tree, bins)
            some = np.flatnonzero(np.isin(node, open_nodes))
            if not len(some):
                continue
            node, bins, width = node[some], bins[some], int(bins.max()) + 1
            parts = [*_whole(_of(b, "g")[some]), *_whole(_of(b, "h")[some])]
            for f in range(n_features):
                cell = node * width + bins[:, f]
                n = np.bincount(cell)
                at = np.flatnonzero(n)
                columns = [at // width, np.full(len(at), f), at % width, n[at], *[np.bincount(cell, x)[at].astype(np.int64) for x in parts]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32()] * 3 + [pa.int64()] * 5, strict=True)], names=["node", "feature", "bin", "n", "g1", "g0", "h1", "h0"])

    cells = lines.mapInArrow(run, "node int, feature int, bin int, n long, g1 long, g0 long, h1 long, h0 long")
    whole = lambda c: F.expr(f"cast(sum({c}1) as decimal(20, 0)) * 0.000001BD + cast(sum({c}0) as decimal(20, 0)) * 0.000000000000001BD").alias(c)
    return cells.groupBy("node", "feature", "bin").agg(F.sum("n").alias("n"), whole("g"), whole("h"))


def best_splits(cells: DataFrame, l2: float = 1.0, least_rows: int = 20, least_gain: float = 1e-9) -> DataFrame:
    """node, feature, bin, gain and the sums n, g, h of the node and nl, gl, hl of its lower side; feature -1 where no split gains. Sums become doubles once they are whole."""
    side = Window.partitionBy("node", "feature")
    upto = side.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = cells.withColumns({f"{c}l": F.sum(c).over(upto) for c in ("n", "g", "h")} | {f"{c}t": F.sum(c).over(side) for c in ("n", "g", "h")})
    x = x.withColumns({f"{c}r": F.col(f"{c}t") - F.col(f"{c}l") for c in "gh"})
    x = x.withColumns({f"{c}{k}": F.col(f"{c}{k}").cast("double") for c in "gh" for k in "ltr"})
    part = lambda k: F.pow(F.col(f"g{k}"), F.lit(2.0)) / (F.col(f"h{k}") + l2)
    gain = part("l") + part("r") - part("t")
    able = (F.col("nl") >= least_rows) & (F.col("nt") - F.col("nl") >= least_rows) & (gain > least_gain)
    x = x.withColumn("gain", F.when(able, F.round(gain, 9)))
    first = Window.partitionBy("node").orderBy(F.col("gain").desc_nulls_last(), "feature", "bin")
    top = x.withColumn("_k", F.row_number().over(first)).where("_k = 1")
    split = F.col("gain").isNotNull()
    return top.select("node", F.when(split, F.col("feature")).otherwise(-1).alias("feature"), "bin", F.coalesce("gain", F.lit(0.0)).alias("gain"), F.col("nt").alias("n"), F.col("gt").alias("g"), F.col("ht").alias("h"), "nl", "gl", "hl")


def grow_tree(lines: DataFrame, n_features: int, depth: int, l2: float = 1.0, least_rows: int = 20) -> list[Node]:
    """One tree on groups (_bins, g, h), a grouped sum a level."""
    tree: dict[int, Node] = {}
    value = lambda g, h: -g / (h + l2)
    open_nodes = [1]
    for _ in range(depth):
        cells = histograms(lines, list(tree.values()), n_features, open_nodes)
        open_nodes = []
        for s in best_splits(cells, l2, least_rows).collect():
            tree[s.node] = Node(s.node, s.feature, s.bin if s.feature >= 0 else -1, value(s.g, s.h), s.gain, s.n)
            if s.feature >= 0:
                tree[2 * s.node] = Node(2 * s.node, -1, -1, value(s.gl, s.hl), 0.0, s.nl)
                tree[2 * s.node + 1] = Node(2 * s.node + 1, -1, -1, value(s.g - s.gl, s.h - s.hl), 0.0, s.n - s.nl)
                open_nodes += [2 * s.node, 2 * s.node + 1]
        if not open_nodes:
            break
    return [tree[k] for k in sorted(tree)]


def _next_round(tree: list[Node], n_features: int, rate: float):
    """Arrow function of groups (_y, _bins, _s): scores with this tree's values, and their gradients."""
    values = np.zeros(max((x.node for x in tree), default=1) + 1)
    for x in tree:
        values[x.node] = x.value

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            s = _of(b, "_s")
            if tree:
                s = s + rate * values[_nodes(tree, _of(b, "_bins").reshape(-1, n_features))]
            g, h = _pairwise(_sizes(b), _of(b, "_y"), s)
            yield pa.RecordBatch.from_arrays([b.column(b.schema.names.index("_y")), b.column(b.schema.names.index("_bins")), _listed(b, s), _listed(b, g), _listed(b, h)], names=["_y", "_bins", "_s", "g", "h"])

    return run


def fit_ranker(train: DataFrame, keys: list[str], item: str, features: list[str], label: str = "label", rounds: int = 20, depth: int = 3, rate: float = 0.3, bins: int = 32, l2: float = 1.0, least_rows: int = 20, edges: list[list[float]] | None = None) -> Forest:
    """Trees fitted to rank each group's rows by label.

    Groups are laid in lines once; a round is one pass that stores scores and gradients, and a pass a level. A group's rows are held together.
    """
    train = stored(train.select(*keys, item, _label(label).alias("_y"), *[F.col(c).cast("double").alias(c) for c in features]), "training")
    forest = Forest(features, edges or quantile_edges(train, features, bins), rate)
    lines = packed(train, keys, item, {"_y": F.col("_y"), "_b": binned(features, forest.edges).cast("array<smallint>"), "_s": F.lit(0.0)})
    lines, tree = stored(lines.select("_y", F.flatten("_b").alias("_bins"), "_s"), "groups"), []
    for _ in range(rounds):
        lines = stored(lines.select("_y", "_bins", "_s").mapInArrow(_next_round(tree, len(features), rate), "_y array<double>, _bins array<smallint>, _s array<double>, g array<double>, h array<double>"), "gradients")
        tree = grow_tree(lines, len(features), depth, l2, least_rows)
        if not tree or tree[0].feature < 0:
            break
        forest.trees.append(tree)
    return forest


def _walking(forest: Forest, parts: bool):
    """Arrow function: rows with their score and, if asked for, each feature's part of it."""
    edges = [np.array(e, np.float64) for e in forest.edges]
    trees = [{x.node: x for x in t} for t in forest.trees]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bins = np.zeros((len(edges), b.num_rows), np.int64)
            for k, (c, e) in enumerate(zip(forest.features, edges, strict=True)):
                x = pc.fill_null(b.column(b.schema.names.index(c)).cast(pa.float64()), np.nan).to_numpy(zero_copy_only=False)
                bins[k] = np.where(np.isnan(x), 0, 1 + np.searchsorted(e, x, "left"))
            each, base = np.zeros((len(edges), b.num_rows)), 0.0
            for tree in trees:
                base += forest.rate * tree[1].value
                todo = [(1, np.arange(b.num_rows))]
                while todo:
                    node, at = todo.pop()
                    x = tree[node]
                    if x.feature < 0 or not len(at):
                        continue
                    low = bins[x.feature, at] <= x.bin
                    for child, rows in ((2 * node, at[low]), (2 * node + 1, at[~low])):
                        each[x.feature, rows] += forest.rate * (tree[child].value - x.value)
                        todo.append((child, rows))
            made = [pa.array(base + each.sum(axis=0))] + ([pa.array(np.full(b.num_rows, base)), *map(pa.array, each)] if parts else [])
            names = ["score"] + (["base", *[f"part_{c}" for c in forest.features]] if parts else [])
            yield pa.RecordBatch.from_arrays([*b.columns, *made], names=[*b.schema.names, *names])

    return run


def score_rows(df: DataFrame, forest: Forest, parts: bool = False) -> DataFrame:
    """df with `score`, and with parts `base` and `part_<feature>`: what a feature's splits add on a row's paths; together they are the score."""
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes) + ", score double"
    if parts:
        schema += ", base double" + "".join(f", `part_{c}` double" for c in forest.features)
    return df.mapInArrow(_walking(forest, parts), schema)


def attribution(scored: DataFrame, features: list[str]) -> DataFrame:
    """feature, mean_part (of absolute parts), rank: what each feature contributes to the scores."""
    means = scored.agg(*[F.avg(F.abs(f"part_{c}")).alias(c) for c in features])
    long = means.select(F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.coalesce(F.col(c), F.lit(0.0)).alias("mean_part")) for c in features])).alias("x")).select("x.*")
    return long.withColumn("rank", F.row_number().over(Window.orderBy(F.round("mean_part", 9).desc(), "feature")).cast("long"))
