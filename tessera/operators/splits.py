"""Deterministic, user-coherent splits by hashes, and distribution-shift statistics over them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import uniform01
from tessera.operators.ranking import linear_quantile


def hash_holdout(users: DataFrame, user: str, seed: str, share: float) -> DataFrame:
    """user, is_holdout: users whose hash is below the share."""
    return users.select(user).distinct().withColumn("is_holdout", uniform01(F.col(user), seed) < share)


def session_split(df: DataFrame, session: str, seed: str, per_10000: int) -> DataFrame:
    """session, side: 'val' where the SHA-1 of seed:session modulo 10000 is below the share, else 'train'."""
    h = F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), F.col(session).cast("string")).cast("binary")), 1, 12), 16, 10).cast("long")
    return df.select(session).distinct().withColumn("side", F.when(h % 10000 < per_10000, "val").otherwise("train"))


def greedy_holdout(inter: DataFrame, user: str, session: str, seed: str, sessions: int) -> DataFrame:
    """user, n_sessions: users in hash order until the sessions before them reach the wanted number.

    The running sum goes in two levels, by the hash's first hex digits and within them, so that no
    task orders all users.
    """
    per_user = inter.groupBy(user).agg(F.countDistinct(session).alias("n_sessions"))
    h = F.sha2(F.concat_ws(":", F.col(user).cast("string"), F.lit(seed)), 256)
    keyed = per_user.withColumns({"_h": h, "_b": F.substring(h, 1, 2)})
    blocks = keyed.groupBy("_b").agg(F.sum("n_sessions").alias("_n"))
    first = blocks.select("_b", F.coalesce(F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_first"))  # 256 rows
    inside = Window.partitionBy("_b").orderBy("_h").rowsBetween(Window.unboundedPreceding, -1)
    run = keyed.join(F.broadcast(first), "_b").withColumn("_before", F.col("_first") + F.coalesce(F.sum("n_sessions").over(inside), F.lit(0)))
    return run.where(F.col("_before") < sessions).select(user, "n_sessions")


def manifest(assigned: DataFrame, key: str, bucket: str) -> DataFrame:
    """bucket, n, digest: rows and an order-free digest of each bucket's keys (exclusive or of their hashes), combined map-side."""
    h = F.conv(F.substring(F.sha2(F.col(key).cast("string"), 256), 1, 13), 16, 10).cast("long")
    return assigned.groupBy(bucket).agg(F.count("*").alias("n"), F.bit_xor(h).alias("digest"))


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repeats counted."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def inject_earlier(inter: DataFrame) -> DataFrame:
    """Every session with the rows of its user's earlier sessions (by date, then id); one row per (session, track), own rows first."""
    s = inter.select("session_id", "user_id", "session_date").distinct()
    own = inter.select("session_id", "track_id", F.lit(0).alias("injected"))
    later = s.select(F.col("session_id").alias("to"), "user_id", F.col("session_date").alias("_d"))
    rows = inter.select("session_id", "user_id", "session_date", "track_id").distinct().join(later, "user_id")
    rows = rows.where((F.col("session_date") < F.col("_d")) | ((F.col("session_date") == F.col("_d")) & (F.col("session_id") < F.col("to"))))
    both = own.unionByName(rows.select(F.col("to").alias("session_id"), "track_id", F.lit(1).alias("injected")))
    return both.groupBy("session_id", "track_id").agg(F.min("injected").alias("injected"))


def augmented(sessions: DataFrame, key: str, pmf: list[float], draws: int, seed: str) -> DataFrame:
    """key, aug_id, max_turn: `draws` reproducible draws from a distribution over 0, 1, 2, ..."""
    u = uniform01(F.col(key), F.col("aug_id"), seed)
    cdf, total = [], 0.0
    for p in pmf:
        total += p
        cdf.append(total)
    pick = F.lit(len(pmf) - 1)
    for k in range(len(pmf) - 2, -1, -1):
        pick = F.when(F.col("_u") < cdf[k], k).otherwise(pick)
    rows = sessions.select(key, F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("aug_id")).withColumn("_u", u)
    return rows.select(key, F.col("aug_id").cast("long"), pick.cast("long").alias("max_turn"))


def truncated(inter: DataFrame, draws: DataFrame, key: str) -> DataFrame:
    """Turns of every draw up to max_turn + 1."""
    return inter.join(draws, key).where(F.col("turn") <= F.col("max_turn") + 1)


def weighted_subsets(rows: DataFrame, key: str, weight: str, subsets: int, size: int, seed: str) -> DataFrame:
    """subset_id, key: `size` rows without replacement in proportion to weight, by exponential keys of hashes."""
    each = rows.select(key, weight, F.explode(F.sequence(F.lit(0), F.lit(subsets - 1))).alias("subset_id"))
    u = F.greatest(uniform01(F.col(key), F.col("subset_id"), seed), F.lit(1e-15))
    order = Window.partitionBy("subset_id").orderBy("_e", key)
    return each.where(F.col(weight) > 0).withColumn("_e", -F.log(u) / F.col(weight)).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= size).select(F.col("subset_id").cast("long"), key)


def pmf(df: DataFrame, column: str, alpha: float = 0.0) -> DataFrame:
    """value, p: shares of a column's values, smoothed by alpha each."""
    n = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("_n"))
    total = n.agg(F.sum("_n").alias("_t"), F.count("*").alias("_k"))
    return n.crossJoin(F.broadcast(total)).select("value", ((F.col("_n") + alpha) / (F.col("_t") + alpha * F.col("_k"))).alias("p"))


def divergences(p: DataFrame, q: DataFrame) -> DataFrame:
    """kl (over values both have) and tv (half the sum of absolute differences) of two distributions (value, p)."""
    both = p.join(q.select("value", F.col("p").alias("q")), "value", "full")
    a, b = F.coalesce("p", F.lit(0.0)), F.coalesce("q", F.lit(0.0))
    return both.agg(F.sum(F.when((a > 0) & (b > 0), a * (F.log(F.col("p")) - F.log(F.col("q")))).otherwise(0.0)).alias("kl"), (F.sum(F.abs(a - b)) / 2).alias("tv"))


def rake(cells: DataFrame, goals: dict[str, DataFrame], rounds: int = 20) -> DataFrame:
    """Cells (dimensions, n) with `w`, scaled until weighted shares meet every goal (value, p) in turn.

    Works on cells, one row per combination of values, whose number doesn't grow with the rows. The
    goals are joined once; every step is then a window over the cells, so the plan grows in line
    with the steps.
    """
    out = cells.withColumn("w", F.lit(1.0))
    for c, goal in goals.items():
        out = out.join(F.broadcast(goal.select(F.col("value").alias(c), F.col("p").alias(f"_p_{c}"))), c, "left")
    mass = F.col("w") * F.col("n")
    for _ in range(rounds):
        for c in goals:
            held = F.sum(mass).over(Window.partitionBy(c))
            out = out.withColumn("w", F.col("w") * F.coalesce(F.try_divide(F.col(f"_p_{c}") * F.sum(mass).over(Window.partitionBy()), held), F.lit(0.0)))
    return out.drop(*[f"_p_{c}" for c in goals])


def density_ratio(p: Column, n_train: float, n_blind: float) -> Column:
    """p / (1 - p) * n_train / n_blind, with p clipped away from 0 and 1."""
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return q / (1 - q) * (n_train / n_blind)


def clipped(df: DataFrame, weight: str, quantile: float, name: str) -> DataFrame:
    """Weights cut at a linear quantile of theirs."""
    cap = linear_quantile(df, weight, quantile, "_cap")
    return df.crossJoin(F.broadcast(cap)).withColumn(name, F.least(F.col(weight), F.col("_cap"))).drop("_cap")


def group_id(turns: Column, age: Column) -> Column:
    """A 3 x 3 bucket of turns (up to 2, up to 5, more) and a second count likewise."""
    three = lambda c: F.when(c <= 2, 0).when(c <= 5, 1).otherwise(2)
    return three(turns) * 3 + three(age)


def apportion(shares: DataFrame, key: str, share: str, total: int) -> DataFrame:
    """key, seats: largest remainders; ties go to the smaller key. One row a key, few of them."""
    s = shares.crossJoin(F.broadcast(shares.agg(F.sum(share).alias("_t")))).withColumn("_x", F.col(share) / F.col("_t") * total)
    s = s.withColumns({"_f": F.floor("_x"), "_r": F.round(F.col("_x") - F.floor("_x"), 9)})
    left = total - F.sum("_f").over(Window.partitionBy())
    return s.select(key, (F.col("_f") + (F.row_number().over(Window.orderBy(F.col("_r").desc(), key)) <= left).cast("int")).alias("seats"))


def random_truncation(inter: DataFrame, key: str, seed: str) -> DataFrame:
    """Turns of every session up to one drawn evenly from 1 to its last, with `target_turn`."""
    last = inter.groupBy(key).agg(F.max("turn").alias("_m"))
    drawn = last.select(key, (F.floor(uniform01(F.col(key), seed) * F.col("_m")) + 1).alias("target_turn"))
    return inter.join(drawn, key).where(F.col("turn") <= F.col("target_turn"))


def quota_sample(df: DataFrame, stratum: str, key: str, total: int, seed: str) -> DataFrame:
    """key, stratum: `total` rows, each stratum's share by largest remainders, its rows in the order of a hash."""
    counts = df.groupBy(stratum).agg(F.count("*").alias("n"))
    seats = apportion(counts, stratum, "n", total)
    order = Window.partitionBy(stratum).orderBy(uniform01(F.col(key), seed), key)
    ranked = df.select(key, stratum).withColumn("_r", F.row_number().over(order))
    return ranked.join(F.broadcast(seats), stratum).where(F.col("_r") <= F.col("seats")).select(key, stratum)  # one row a stratum
