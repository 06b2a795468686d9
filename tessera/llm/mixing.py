"""Mixing sources to target weights by entropy balancing, in DataFrame functions only.

Among all document rates r in (0, cap) whose words meet each source's target, the ones closest to 1
in (bounded) relative entropy have odds tilted exponentially by size:
``r / (cap - r) = exp(lambda * size / mean size) / (cap - 1)``. The multipliers solve a convex dual,
one per source; guarded Newton steps find them from distributed sums over (source, size) counts.
Rates become copies by systematic rounding along each source's sizes, so that a source's rounding
error stays within one document's length.

Defined cases: a NULL or empty text has size 0 and takes 0 words. A NULL source is a source of its
own, the last. NULL ids and repeated rows are documents like others. A source of size 0 has target
0. Columns that aren't keys aren't read. An empty table gives no row.

The number of sources and of distinct sizes is taken to be small beside the number of documents: a
window over all sources, and one over a source's distinct sizes, runs in one task. No document does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import stored, word_count

TOLERANCE = 1e-7
SALT_ROWS = 512


def targets(sizes: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Sources by code point, NULL last, weigh `weights` in turn and share `share` of all sizes; a target
    stops at `cap` times its source's size and its excess is shared by the others by weight. That ends
    where every target is the lesser of its cap and level * weight, with one level for all.
    """
    everything = Window.partitionBy()
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = F.array(*[F.lit(float(w)) for w in weights])
    rows = sizes.withColumn("_w", F.get(turn, (F.row_number().over(by_name) - 1) % len(weights)))
    rows = rows.withColumns({"_cap": cap * F.col("source_size"), "_at": cap * F.col("source_size") / F.col("_w"), "_all": share * F.sum("source_size").over(everything)})
    filling = Window.orderBy("_at", F.col("source").asc_nulls_last())
    capped = F.coalesce(F.sum("_cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_weight = F.sum("_w").over(filling.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.withColumn("_level", (F.col("_all") - capped) / open_weight)
    # the level of the first source that it doesn't fill; none: every source is full
    level = F.min(F.when(F.col("_level") <= F.col("_at"), F.struct("_at", "_level"))).over(everything)["_level"]
    target = F.when(level.isNull(), F.col("_cap")).otherwise(F.least(F.col("_cap"), level * F.col("_w")))
    return rows.withColumn("target", target).select("source", "source_size", "target")


def _rate(multiplier: Column, x: Column, cap: float) -> Column:
    """cap / (1 + (cap - 1) exp(-multiplier * x)), without overflow."""
    z = F.greatest(F.least(multiplier * x, F.lit(500.0)), F.lit(-500.0))
    return cap / (1 + (cap - 1) * F.exp(-z))


def multipliers(counts: DataFrame, goals: DataFrame, cap: float, most_steps: int = 60) -> DataFrame:
    """source, multiplier: the dual's solution for counts (source, size, n) and goals (source, mean, target, full).

    Every step sums the words taken and their slope over the counts, moves each source by a Newton
    step, or halves its bracket where that step leaves it, and stores the few numbers it ends with.
    """
    start = {"multiplier": F.lit(0.0), "low": F.lit(-1e6), "high": F.lit(1e6), "gap": F.lit(float("inf"))}
    now = stored(goals.where(~F.col("full")).withColumns(start), "multipliers")
    c = F.col
    for _ in range(most_steps):
        x = c("size") / c("mean")
        r = _rate(c("multiplier"), x, cap)
        taken = counts.join(now, counts["source"].eqNullSafe(now["source"])).select(now["source"], (c("n") * c("size") * r).alias("t"), (c("n") * c("size") * x * r * (cap - r) / cap).alias("s"))
        sums = taken.groupBy("source").agg(F.sum("t").alias("taken"), F.sum("s").alias("slope")).withColumnRenamed("source", "_source")
        met = now.join(sums, now["source"].eqNullSafe(c("_source"))).drop("_source")
        met = met.withColumns({"low": F.when(c("taken") < c("target"), c("multiplier")).otherwise(c("low")), "high": F.when(c("taken") > c("target"), c("multiplier")).otherwise(c("high")), "gap": F.abs(c("taken") - c("target")) / c("target")})
        step = c("multiplier") + F.try_divide(c("target") - c("taken"), c("slope"))
        step = F.when((step > c("low")) & (step < c("high")), step).otherwise((c("low") + c("high")) / 2)
        met = met.withColumn("multiplier", F.when(c("gap") <= TOLERANCE, c("multiplier")).otherwise(step)).select(*now.columns)
        now = stored(met, "multipliers")
        if (now.agg(F.max("gap")).first()[0] or 0) <= TOLERANCE:
            break
    # sums in another order differ in the last digits; rounded, the multipliers of two runs agree
    return now.select("source", F.round("multiplier", 5).alias("multiplier"))


def _offsets(plan: DataFrame, tried: int = 64) -> DataFrame:
    """_source, offset: of `tried` starts of the systematic rounding, the one that takes closest to the target.

    What a source takes follows from its sizes' counts alone, so no document is read for this.
    """
    each = plan.select("_source", "_size", "n", "rate", "before", "target", F.explode(F.array(*[F.lit((k + 0.5) / tried) for k in range(tried)])).alias("offset"))
    after = F.floor(F.col("before") + F.col("n") * F.col("rate") + F.col("offset")) - F.floor(F.col("before") + F.col("offset"))
    gaps = each.groupBy("_source", "offset", "target").agg(F.sum(F.col("_size") * after).alias("taken"))
    return gaps.groupBy("_source").agg(F.min_by("offset", F.struct(F.abs(F.col("taken") - F.col("target")), "offset")).alias("offset"))


def mix(docs: DataFrame, keys: list[str], source: str = "source", text: str = "text", weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: int = 2) -> DataFrame:
    """The key columns of every row with source, size, source_size, target, rate, copies and taken (copies * size)."""
    names = [f"_key{k}" for k in range(len(keys))]
    rows = docs.select(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col(source).alias("source"), word_count(F.col(text)).alias("size"))
    rows = stored(rows.withColumn("_pick", F.xxhash64(*names)), "sizes")
    counts = stored(rows.groupBy("source", "size").agg(F.count("*").alias("n")), "size-counts")
    per_source = counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size"), F.sum("n").alias("_n"))
    aims = targets(per_source.select("source", "source_size"), weights, share, cap)
    means = per_source.select(F.col("source").alias("_s"), (F.greatest(F.col("source_size"), F.lit(1)) / F.col("_n")).alias("mean"))
    goals = aims.join(means, aims["source"].eqNullSafe(F.col("_s"))).drop("_s")
    goals = stored(goals.withColumn("full", F.col("target") >= cap * F.col("source_size")), "goals")
    solved = multipliers(counts, goals.drop("source_size"), float(cap)).withColumnRenamed("source", "_s")

    goals = goals.join(solved, goals["source"].eqNullSafe(F.col("_s")), "left").drop("_s").withColumnRenamed("source", "_source")
    plan = counts.join(goals, counts["source"].eqNullSafe(F.col("_source"))).drop("_source")
    rate = F.when(F.col("full"), F.lit(float(cap))).otherwise(_rate(F.col("multiplier"), F.col("size") / F.col("mean"), float(cap)))
    up_to = Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1)
    plan = plan.withColumn("rate", rate).withColumn("before", F.coalesce(F.sum(F.col("n") * F.col("rate")).over(up_to), F.lit(0.0)))
    plan = stored(plan.select(F.col("source").alias("_source"), F.col("size").alias("_size"), "n", "source_size", "target", "rate", "before", F.ceil(F.col("n") / SALT_ROWS).alias("salts")), "rates")
    offsets = stored(_offsets(plan), "offsets").withColumnRenamed("_source", "_s")
    plan = plan.join(offsets, plan["_source"].eqNullSafe(F.col("_s"))).drop("_s", "n")

    # a document's place among those of its source and size: before its salt, then within it
    planned = rows.join(plan, rows["source"].eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size"))).drop("_source", "_size")
    planned = stored(planned.withColumn("salt", F.pmod("_pick", "salts")), "planned")
    salted = planned.groupBy("source", "size", "salt").agg(F.count("*").alias("_n"))
    lower = Window.partitionBy("source", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    salted = salted.select(F.col("source").alias("_source"), F.col("size").alias("_size"), F.col("salt").alias("_salt"), F.coalesce(F.sum("_n").over(lower), F.lit(0)).alias("first"))
    inside = Window.partitionBy("source", "size", "salt").orderBy("_pick", *names)
    ranked = planned.withColumn("_rank", F.row_number().over(inside) - 1)
    ranked = ranked.join(stored(salted, "salts"), ranked["source"].eqNullSafe(F.col("_source")) & (F.col("size") == F.col("_size")) & (F.col("salt") == F.col("_salt")))
    place = F.col("first") + F.col("_rank")
    upto = lambda j: F.floor(F.col("before") + j * F.col("rate") + F.col("offset"))
    copies = F.least(upto(place + 1) - upto(place), F.lit(cap)).cast("int")
    ranked = ranked.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return ranked.select(*[F.col(n).alias(k) for k, n in zip(keys, names, strict=True)], "source", "size", "source_size", "target", "rate", "copies", "taken")
