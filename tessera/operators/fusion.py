"""Fusion of candidate lists. The pool is long: one row per group, item and generator (cg, rank, score)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import min_max, z_score
from tessera.operators.ranking import topk_per_group


def explode_lists(wide: DataFrame, keys: list[str], items: str, scores: str, cg: str, k: int) -> DataFrame:
    """keys, cg, track_id, rank, score of the first k of parallel arrays; NULL items go."""
    pairs = F.slice(F.arrays_zip(F.col(items).alias("track_id"), F.col(scores).alias("score")), 1, k)
    rows = wide.select(*keys, F.posexplode(pairs).alias("_p", "_x"))
    return rows.select(*keys, F.lit(cg).alias("cg"), "_x.track_id", (F.col("_p") + 1).cast("long").alias("rank"), "_x.score").where(F.col("track_id").isNotNull())


def normalised(pool: DataFrame, keys: list[str]) -> DataFrame:
    """Add reciprocal_rank, score_z and score_minmax within each generator's list."""
    by = [*keys, "cg"]
    return pool.withColumns({"reciprocal_rank": 1 / F.col("rank"), "score_z": z_score(F.col("score"), by), "score_minmax": min_max(F.col("score"), by)})


def union_wide(pool: DataFrame, keys: list[str], cgs: list[str]) -> DataFrame:
    """keys, track_id and rank_/score_ columns per generator: the full outer union in one grouped pass."""
    pick = lambda cg, c: F.max(F.when(F.col("cg") == cg, F.col(c))).alias(f"{c}_{cg}")
    return pool.groupBy(*keys, "track_id").agg(*[pick(cg, c) for cg in cgs for c in ("rank", "score")])


def fusion_features(pool: DataFrame, keys: list[str], n_cgs: int, depth: int = 200) -> DataFrame:
    """All fusion scores of a pool that has score_minmax: one aggregation over the long rows.

    Generators that don't hold an item count in the rank products only, with their penalty. NULL
    normalised scores (constant lists) count as 0.
    """
    r = F.col("rank")
    product = lambda penalty: -(F.sum(F.log(r)) + (n_cgs - F.count("*")) * F.log(F.lit(float(penalty)))) / n_cgs
    comb = F.sum(F.coalesce("score_minmax", F.lit(0.0)))
    return pool.groupBy(*keys, "track_id").agg(
        F.sum(depth + 1 - r).alias("borda"), F.sum(1 / (r + 60)).alias("rrf60"), F.sum(1 / (r + 5)).alias("rrf5"), comb.alias("combsum"), (comb * F.count("*")).alias("combmnz"),
        F.count("*").alias("n_retrieving"), F.sum(1 / (r * r)).alias("isr"), F.sum(1 / F.log2(r + 1.0)).alias("logrank"), product(200).alias("rank_product_200"), product(1000).alias("rank_product_1000"),
        F.min(r).alias("min_rank"), F.max(r).alias("max_rank"), F.median(r).alias("median_rank"), F.stddev_samp(r).alias("std_rank"),
        F.count_if(r <= 10).alias("agreement10"), F.count_if(r <= 50).alias("agreement50"),
    )


def turn_bucket(turn: Column) -> Column:
    return F.when(turn <= 2, "early").when(turn <= 5, "middle").otherwise("late")


def weighted_rrf(pool: DataFrame, weights: DataFrame, keys: list[str], bucket: str, k: float, top: int) -> DataFrame:
    """keys, track_id, score, rank: the sum of weight / (k + rank); weights (cg, bucket, weight), 1 where none is given."""
    weighed = pool.join(F.broadcast(weights), ["cg", bucket], "left")  # one row a generator and bucket
    scores = weighed.groupBy(*keys, "track_id").agg(F.sum(F.coalesce("weight", F.lit(1.0)) / (F.col("rank") + k)).alias("score"))
    return topk_per_group(scores, keys, [F.round("score", 9).desc(), F.col("track_id")], top)


def truncate_keep(scored: DataFrame, keys: list[str], score: str, k: int, keep: Column) -> DataFrame:
    """The k best of every group, and rows where `keep` holds."""
    return topk_per_group(scored, keys, [F.round(score, 9).desc(), F.col("track_id")], k, keep)


def family_consensus(pool: DataFrame, families: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Per item: retrieving generators and mean rank of each family, only_<family> flags, first places, and the spread of family means."""
    rows = pool.join(F.broadcast(families), "cg")  # one row a generator
    of = lambda f, x=None: F.when(F.col("family") == f, F.lit(1) if x is None else x)
    out = rows.groupBy(*keys, "track_id").agg(*[F.count(of(f)).alias(f"n_{f}") for f in names], *[F.avg(of(f, F.col("rank"))).alias(f"mean_rank_{f}") for f in names], F.count_if(F.col("rank") == 1).alias("n_first"))
    total = reduce(lambda a, b: a + b, [F.col(f"n_{f}") for f in names])
    means = [F.col(f"mean_rank_{f}") for f in names]
    return out.withColumns({f"only_{f}": F.col(f"n_{f}") == total for f in names} | {"disagreement": F.greatest(*means) - F.least(*means)})


def conformal_sets(scored: DataFrame, keys: list[str], by: str, quantiles: DataFrame, nonconformity: Column) -> DataFrame:
    """keys, set_size: items whose nonconformity is within their generator's quantile."""
    rows = scored.join(F.broadcast(quantiles.select(by, "q")), by, "left")
    return rows.groupBy(*keys).agg(F.count_if(nonconformity <= F.coalesce("q", F.lit(float("inf")))).alias("set_size"))


def isotonic_steps(df: DataFrame, keys: list[str], x: str, y: str, few: int = 20) -> DataFrame:
    """keys, x, y_hat: the non-decreasing least-squares fit of y on x per group.

    Means by distinct x come first; the pooled fit at x is then the largest, over starts at or below
    x, of the least mean of a run from there to an end at or above x (the min-max formula), by joins
    within a group's distinct x, of which there must be few (200 ranks, say). Groups with fewer
    than `few` rows or one class keep x clipped to [0, 1].
    """
    points = df.groupBy(*keys, x).agg(F.count("*").alias("n"), F.sum(y).alias("s"))
    total = df.groupBy(*keys).agg(F.count("*").alias("_all"), F.countDistinct(y).alias("_classes"))
    so_far = Window.partitionBy(*keys).orderBy(x).rowsBetween(Window.unboundedPreceding, 0)
    sums = points.withColumns({"_n": F.sum("n").over(so_far), "_s": F.sum("s").over(so_far)})
    start = sums.select(*keys, F.col(x).alias("_a"), (F.col("_n") - F.col("n")).alias("_n0"), (F.col("_s") - F.col("s")).alias("_s0"))
    stop = sums.select(*keys, F.col(x).alias("_b"), "_n", "_s")
    runs = start.join(stop, keys).where(F.col("_a") <= F.col("_b")).withColumn("_m", (F.col("_s") - F.col("_s0")) / (F.col("_n") - F.col("_n0")))
    ahead = Window.partitionBy(*keys, "_a").orderBy("_b").rowsBetween(0, Window.unboundedFollowing)
    least = runs.withColumn("_l", F.min("_m").over(ahead))  # over ends at or above _b, for every start
    fit = least.groupBy(*keys, F.col("_b").alias(x)).agg(F.max("_l").alias("_fit"))
    plain = F.least(F.greatest(F.col(x).cast("double"), F.lit(0.0)), F.lit(1.0))
    return fit.join(total, keys).select(*keys, x, F.when((F.col("_all") < few) | (F.col("_classes") < 2), plain).otherwise(F.col("_fit")).alias("y_hat"))


def platt(df: DataFrame, x: str, y: str):
    """A fitted logistic regression of y on x (pyspark.ml), for `.transform` on a `features` vector of x."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    rows = VectorAssembler(inputCols=[x], outputCol="features").transform(df)
    return LogisticRegression(featuresCol="features", labelCol=y, regParam=0.0).fit(rows)


def chosen_calibrator(df: DataFrame, p: str, y: str, most_error: float = 0.05, least_slope: float = 0.7) -> str:
    """'isotonic', or 'platt' where the calibration error of p is over `most_error` or y's logistic slope on the logit of p under `least_slope`."""
    from tessera.operators.metrics import expected_calibration_error

    error = expected_calibration_error(df, p, y).agg(F.sum(F.col("gap") * F.col("weight"))).first()[0] or 0.0
    if error > most_error:
        return "platt"
    q = F.least(F.greatest(F.col(p), F.lit(1e-6)), F.lit(1 - 1e-6))
    slope = platt(df.select(F.log(q / (1 - q)).alias("_l"), F.col(y).cast("double").alias("_y")), "_l", "_y").coefficients[0]
    return "isotonic" if slope >= least_slope else "platt"
