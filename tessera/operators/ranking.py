"""Top-k selection, list handling and filling."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import average_rank
from tessera.sources.stored import stored


def topk_per_group(df: DataFrame, keys: list[str], order: list[Column], k: int, keep: Column | None = None, rank: str = "rank") -> DataFrame:
    """The first k rows of every group in a total order, numbered from 1; rows where `keep` holds stay beyond k."""
    ranked = df.withColumn(rank, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
    return ranked.where(F.col(rank) <= k if keep is None else (F.col(rank) <= k) | F.coalesce(keep, F.lit(False)))


def as_list(df: DataFrame, keys: list[str], item: str, rank: str = "rank", name: str = "items") -> DataFrame:
    """One row a group with its items as an array in rank order."""
    return df.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(rank, item))), lambda x: x[item]).alias(name))


def fill_short(main: DataFrame, fallback: DataFrame, keys: list[str], item: str, k: int) -> DataFrame:
    """Main lists topped up to k from fallback lists (both with `rank`), without repeats; adds `source` 0 or 1."""
    both = main.select(*keys, item, "rank", F.lit(0).alias("source")).unionByName(fallback.select(*keys, item, "rank", F.lit(1).alias("source")))
    first = topk_per_group(both, [*keys, item], [F.col("source"), F.col("rank")], 1, rank="_first").drop("_first")
    return topk_per_group(first.withColumnRenamed("rank", "_r"), keys, [F.col("source"), F.col("_r"), F.col(item)], k).drop("_r")


def graft_first(head: Column, body: Column, n: int) -> Column:
    """The head list's first item, then the body without it, topped up from the head; n items at most."""
    return F.slice(F.array_distinct(F.concat(F.slice(head, 1, 1), body, head)), 1, n)


def drop_seen(candidates: DataFrame, seen: DataFrame, keys: list[str]) -> DataFrame:
    """Candidates without those that the group has seen."""
    return candidates.join(seen.select(*keys).distinct(), keys, "left_anti")


def rank_average(members: list[DataFrame], keys: list[str], item: str, score: str = "score") -> DataFrame:
    """Items all members score, with the mean of their ordinal ranks (best first) as a negative score.

    The members are laid end to end and grouped once, rather than joined one by one.
    """
    ranked = [topk_per_group(m.select(*keys, item, score), keys, [F.col(score).desc(), F.col(item)], 1 << 30).select(*keys, item, F.lit(k).alias("_m"), "rank") for k, m in enumerate(members)]
    every = reduce(DataFrame.unionByName, ranked)
    return every.groupBy(*keys, item).agg(F.count("*").alias("_n"), (-F.avg("rank")).alias("score")).where(F.col("_n") == len(members)).drop("_n")


def counts_below(df: DataFrame, value: str, ranges: int = 1024) -> DataFrame:
    """value, count, below: every distinct number that isn't NULL, its rows and the rows of smaller ones.

    Two levels: `ranges` equal ranges of the values are summed up in one task, and each range's values in
    a window of their own.
    """
    counts = df.groupBy(value).count().where(F.col(value).isNotNull())
    ends = counts.agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    part = F.coalesce(F.floor(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")) * (ranges - 1)), F.lit(0))
    counts = counts.crossJoin(F.broadcast(ends)).withColumn("_b", part)
    upto = lambda w: F.coalesce(F.sum("count").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    firsts = counts.groupBy("_b").agg(F.sum("count").alias("count")).select("_b", upto(Window.orderBy("_b")).alias("_first"))
    inside = counts.withColumn("_in", upto(Window.partitionBy("_b").orderBy(value))).join(F.broadcast(firsts), "_b")  # a row a range
    return inside.select(value, "count", (F.col("_first") + F.col("_in")).alias("below"))


def positions(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """df with `name`: each row's place from 1 in the order of these columns, which should leave no ties.

    Spark cuts the rows into ranges of equal size by a sample of their whole order, so neither outliers nor
    many rows of one value meet in one task; ranges are counted, and rows numbered within their own.
    """
    ranged = stored(df.repartitionByRange(*order).withColumn("_b", F.spark_partition_id()), "ranged")
    upto = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    before = ranged.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_first"))
    inside = F.row_number().over(Window.partitionBy("_b").orderBy(*order))
    return ranged.withColumn(name, inside).join(F.broadcast(before), "_b").withColumn(name, F.col(name) + F.col("_first")).drop("_b", "_first")


def linear_quantile(df: DataFrame, value: str, q: float, name: str) -> DataFrame:
    """One row: the exact quantile of a column, linear between the two nearest values."""
    ranked = counts_below(df, value)
    at = F.lit(q) * (F.col("_n") - 1)
    rows = ranked.crossJoin(F.broadcast(ranked.agg(F.sum("count").alias("_n"))))
    of = lambda k: F.max(F.when((F.col("below") <= k) & (k < F.col("below") + F.col("count")), F.col(value)))
    found = rows.agg(of(F.floor(at)).alias("_a"), of(F.ceil(at)).alias("_z"), F.max(at - F.floor(at)).alias("_f"))
    return found.select((F.col("_a") + (F.col("_z") - F.col("_a")) * F.col("_f")).alias(name))


def percentile_of(df: DataFrame, value: str, name: str) -> DataFrame:
    """Average rank of the value over its largest one."""
    ranks = counts_below(df, value)
    ranks = ranks.select(value, (F.col("below") + (F.col("count") + 1) / 2).alias("_r"))
    top = ranks.agg(F.max("_r").alias("_top"))
    return df.join(ranks, value, "left").join(F.broadcast(top)).withColumn(name, F.col("_r") / F.col("_top")).drop("_r", "_top")


def masked_ranks(df: DataFrame, group: list[str], mask: Column, value: Column, name: str) -> DataFrame:
    """Average rank, best first, among the rows of a group where the mask holds; NULL elsewhere."""
    held = F.when(mask, value)
    return df.withColumn(name, F.when(mask, average_rank(held, group, descending=True)))
