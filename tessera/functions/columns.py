"""Column helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F


def uniform01(*parts: Column | str) -> Column:
    """A reproducible number in [0, 1): the first 13 hex digits of the SHA-256 of the parts joined by ':'."""
    digest = F.sha2(F.concat_ws(":", *[p.cast("string") if isinstance(p, Column) else F.lit(p) for p in parts]), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") / float(1 << 52)


def average_rank(value: Column, partition: list[str] | None = None, descending: bool = False) -> Column:
    """Rank with ties at their mean; NULL stays NULL. Without a partition all rows are ranked in one task."""
    keys = partition or []
    order = value.desc_nulls_last() if descending else value.asc_nulls_last()
    ties = F.count(F.lit(1)).over(Window.partitionBy(*keys, value))
    return F.when(value.isNotNull(), F.rank().over(Window.partitionBy(*keys).orderBy(order)) + (ties - 1) / 2)


def reciprocal(rank: Column, k: float) -> Column:
    """1 / (k + rank) for a rank from 1."""
    return 1.0 / (F.lit(float(k)) + rank)


def share_of_max(value: Column, partition: list[str]) -> Column:
    """value / (largest in the group + 1e-9)."""
    return value / (F.max(value).over(Window.partitionBy(*partition)) + 1e-9)


def min_max(value: Column, partition: list[str]) -> Column:
    """(value - least) / (largest - least) of the group; NULL where they are equal."""
    w = Window.partitionBy(*partition)
    return F.try_divide(value - F.min(value).over(w), F.max(value).over(w) - F.min(value).over(w))


def z_score(value: Column, partition: list[str]) -> Column:
    """(value - mean) / sample deviation of the group; NULL where that is 0 or there is one row."""
    w = Window.partitionBy(*partition)
    return F.try_divide(value - F.avg(value).over(w), F.stddev_samp(value).over(w))


def dot(a: Column | str, b: Column | str) -> Column:
    """Inner product of two arrays, in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column | str) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine of two arrays; NULL where one is missing or zero."""
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def words_of(text: Column) -> Column:
    """Runs of a-z and 0-9 of the text in lower case."""
    return F.filter(F.split(F.lower(text), "[^a-z0-9]+"), lambda w: w != "")


def year_proximity(a: Column, b: Column, scale: float = 5.0) -> Column:
    """exp(-|a - b| / scale)."""
    return F.exp(-F.abs(a - b) / scale)


def ndcg_at(position: Column, k: int) -> Column:
    """Discounted gain of the one relevant item at a position from 1; 0 where it is missing or beyond k."""
    return F.when(position <= k, 1 / F.log2(position + 1.0)).otherwise(0.0)


def hit_at(position: Column, k: int) -> Column:
    return F.when(position <= k, 1.0).otherwise(0.0)


def reciprocal_rank_at(position: Column, k: int) -> Column:
    return F.when(position <= k, 1.0 / position).otherwise(0.0)
