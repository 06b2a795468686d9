"""Ranking metrics, macro-averaged by turn, and robust summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import hit_at, ndcg_at, reciprocal_rank_at


def positions(ranked: DataFrame, truth: DataFrame, keys: list[str], item: str, gt: str, missing: str = "zero") -> DataFrame:
    """truth rows with `position`, the rank of the true item; NULL where it isn't retrieved.

    missing='exclude' leaves out groups with no list at all, 'zero' keeps them.
    """
    hit = ranked.select(*keys, F.col(item).alias(gt), F.col("rank").alias("position"))
    out = truth.join(hit, [*keys, gt], "left")
    return out if missing == "zero" else out.join(ranked.select(*keys).distinct(), keys, "left_semi")


def macro_by(positioned: DataFrame, turn: str, k: int = 20) -> DataFrame:
    """turn, n and the means of nDCG, hit rate and reciprocal rank at k."""
    p = F.col("position")
    return positioned.groupBy(turn).agg(F.count("*").alias("n"), F.avg(ndcg_at(p, k)).alias(f"ndcg{k}"), F.avg(hit_at(p, k)).alias(f"recall{k}"), F.avg(reciprocal_rank_at(p, k)).alias(f"mrr{k}"))


def macro_mean(by_turn: DataFrame, columns: list[str]) -> DataFrame:
    """The mean over turns of each column: every turn weighs the same."""
    return by_turn.agg(*[F.avg(c).alias(c) for c in columns])


def recall_curve(positioned: DataFrame, ks: list[int]) -> DataFrame:
    """k, recall over all rows."""
    total = positioned.agg(*[F.avg(hit_at(F.col("position"), k)).alias(str(k)) for k in ks])
    return total.unpivot([], [str(k) for k in ks], "k", "recall").select(F.col("k").cast("long"), "recall")


def tie_aware_rank(score: Column, gt_score: Column) -> Column:
    """Aggregate: one more than the number of better scores."""
    return 1 + F.count_if(score > gt_score)


def cvar(df: DataFrame, keys: list[str], value: str, alpha: float) -> DataFrame:
    """keys, cvar: mean of the worst max(1, round((1 - alpha) n)) values (halves round to even), and the worst one."""
    by = Window.partitionBy(*keys)
    ranked = df.withColumns({"_n": F.count("*").over(by), "_r": F.row_number().over(by.orderBy(value))})
    tail = F.greatest(F.lit(1), F.bround((1 - F.lit(alpha)) * F.col("_n"), 0))
    return ranked.where(F.col("_r") <= tail).groupBy(*keys).agg(F.avg(value).alias("cvar"), F.min(value).alias("worst"))


def expected_calibration_error(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """bin, n, gap (|mean p - mean y|) and weight (share of rows) of equal-width bins; the error is sum(gap * weight)."""
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("long")
    rows = df.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.abs(F.avg(p) - F.avg(y)).alias("gap"))
    return rows.crossJoin(F.broadcast(df.agg(F.count("*").alias("_all")))).withColumn("weight", F.col("n") / F.col("_all")).drop("_all")


def bernstein_interval(df: DataFrame, keys: list[str], delta: str, confidence: float = 0.05) -> DataFrame:
    """keys, n, mean, low, high: empirical Bernstein interval of paired differences."""
    g = df.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(delta).alias("mean"), F.var_samp(delta).alias("var"))
    lead = F.log(F.lit(3.0 / confidence))
    half = F.sqrt(2 * F.coalesce("var", F.lit(0.0)) * lead / F.col("n")) + 3 * lead / F.col("n")
    return g.select(*keys, "n", "mean", (F.col("mean") - half).alias("low"), (F.col("mean") + half).alias("high"))


def holm(df: DataFrame, p: str, key: str, alpha: float = 0.05) -> DataFrame:
    """Add `rejected` by Holm's step-down over all rows (few: one a hypothesis)."""
    order = Window.orderBy(p, key)
    ok = F.col(p) <= alpha / (F.count("*").over(Window.partitionBy()) - F.row_number().over(order) + 1)
    return df.withColumn("rejected", F.min(ok.cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1)


def conformal_quantile(df: DataFrame, keys: list[str], score: str, alpha: float) -> DataFrame:
    """keys, q, n: the nonconformity score at place min(n - 1, ceil((n + 1)(1 - alpha)) - 1) from 0.

    Equal scores are counted first, so the window orders distinct scores, of which ranks give few.
    """
    by = Window.partitionBy(*keys)
    counts = df.where(F.col(score).isNotNull()).groupBy(*keys, score).agg(F.count("*").alias("_c"))
    ranked = counts.withColumns({"_n": F.sum("_c").over(by), "_upto": F.sum("_c").over(by.orderBy(score))})
    at = F.least(F.col("_n") - 1, F.ceil((F.col("_n") + 1) * (1 - F.lit(alpha))) - 1)
    return ranked.where(F.col("_upto") > at).groupBy(*keys).agg(F.min(score).alias("q"), F.max("_n").alias("n"))


def effective_size(df: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """keys, ess: (sum of weights)^2 over the sum of squares."""
    return df.groupBy(*keys).agg(F.try_divide(F.sum(weight) ** 2, F.sum(F.col(weight) ** 2)).alias("ess"))


def auc(df: DataFrame, score: str, label: str) -> DataFrame:
    """n, positives, auc: the share of (positive, negative) pairs in order, ties by half; NULL scores are left out."""
    from tessera.operators.ranking import counts_below

    rows = df.where(F.col(score).isNotNull())
    ranks = counts_below(rows, score).select(score, (F.col("below") + (F.col("count") + 1) / 2).alias("_r"))
    y = F.col(label).cast("long")
    sums = rows.join(ranks, score).agg(F.count("*").alias("n"), F.sum(y).alias("positives"), F.sum(F.when(y == 1, F.col("_r"))).alias("_s"))
    n1, n0 = F.col("positives"), F.col("n") - F.col("positives")
    return sums.select("n", "positives", F.try_divide(F.col("_s") - n1 * (n1 + 1) / 2, n1 * n0).alias("auc"))


def leaderboard(positioned: DataFrame, generator: str, group: str, k: int, alpha: float) -> DataFrame:
    """generator, recall, cvar, place: generators by the mean of their worst groups' hit rates, then by the mean over all rows."""
    hit = hit_at(F.col("position"), k)
    groups = positioned.groupBy(generator, group).agg(F.avg(hit).alias("_x"))
    all_rows = positioned.groupBy(generator).agg(F.avg(hit).alias("recall"))
    out = cvar(groups, [generator], "_x", alpha).select(generator, "cvar").join(all_rows, generator)
    place = F.row_number().over(Window.orderBy(F.round("cvar", 9).desc(), F.round("recall", 9).desc(), generator))  # one row a generator
    return out.select(generator, "recall", "cvar", place.cast("long").alias("place"))
