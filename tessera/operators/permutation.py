"""How far chance alone would part two samples: the null of a score's AUC under permuted labels, all permutations in one pass.

Ranks don't depend on labels, so scores are ranked once. Each permutation deals the label out anew by an affine hash of
the key, with the data's share of ones; given its number of ones every choice of them is as likely, and its AUC is taken with
that number. A task adds up one number and one count a permutation over its rows.

Defined cases: rows with NULL or NaN scores or NULL labels or keys are left out. Rows of one key get one label. Without a row, or
with one label alone, AUCs and p are NULL.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators.ranking import counts_below
from tessera.sources.stored import stored

#: A prime, the range of the hashes.
PRIME = (1 << 31) - 1


def affine(permutations: int, seed: str) -> list[tuple[int, int]]:
    """The factor and the offset of each permutation's hash."""
    out = []
    for p in range(permutations):
        digest = hashlib.sha256(f"{seed}:{p}".encode()).digest()
        out.append((1 + int.from_bytes(digest[:8], "big") % (PRIME - 1), int.from_bytes(digest[8:16], "big") % PRIME))
    return out


def place(key: Column) -> Column:
    """A key's place in the range: the first 8 hex digits of its SHA-256, modulo the prime."""
    return F.conv(F.substring(F.sha2(key.cast("string"), 256), 1, 8), 16, 10).cast("long") % PRIME


def _summing(hashes: list[tuple[int, int]], least: int):
    """Arrow function of (x, rank, y): for permutation 0, the data, and each further one the number of ones and the sum of their ranks."""
    a, b = (np.array(c, np.int64)[:, None] for c in zip(*hashes, strict=True)) if hashes else (np.zeros((0, 1), np.int64),) * 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ones, sums = np.zeros(len(hashes) + 1, np.int64), np.zeros(len(hashes) + 1)
        for batch in batches:
            x, rank, y = (batch.column(k).to_numpy() for k in range(3))
            dealt = np.vstack([y[None, :] == 1, (a * x + b) % PRIME < least])
            ones += dealt.sum(axis=1)
            sums += dealt @ rank
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(ones))), pa.array(ones), pa.array(sums)], names=["permutation", "ones", "ranks"])

    return run


def permutation_null(df: DataFrame, score: str, label: str, key: str, permutations: int = 200, seed: str = "5") -> DataFrame:
    """permutation, n, positives, auc: permutation 0 is the data."""
    rows = df.select(F.col(score).cast("double").alias("s"), (F.col(label).cast("double") == 1).cast("int").alias("y"), place(F.col(key)).alias("x"))
    rows = stored(rows.where("s IS NOT NULL AND NOT isnan(s) AND y IS NOT NULL AND x IS NOT NULL"), "scores")
    n, n1 = rows.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    least = PRIME * n1 // n if n else 0
    ranks = counts_below(rows, "s").select("s", (F.col("below") + (F.col("count") + 1) / 2).alias("rank"))
    sums = rows.join(ranks, "s").select("x", "rank", "y").mapInArrow(_summing(affine(permutations, seed), least), "permutation long, ones long, ranks double")
    total = sums.groupBy("permutation").agg(F.sum("ones").alias("positives"), F.sum("ranks").alias("_s"))
    every = df.sparkSession.range(permutations + 1).select(F.col("id").alias("permutation"))  # also where no task has a row
    total = every.join(F.broadcast(total), "permutation", "left").withColumn("positives", F.coalesce("positives", F.lit(0).cast("long")))
    ones = F.col("positives")
    return total.select("permutation", F.lit(n).cast("long").alias("n"), "positives", F.try_divide(F.col("_s") - ones * (ones + 1) / 2, ones * (n - ones)).alias("auc"))


def permutation_test(null: DataFrame) -> DataFrame:
    """n, positives, auc, null_mean, null_sd, p of the data in its null; p is the share, the data among them, at least as far from 1/2."""
    data = null.where("permutation = 0").select("n", "positives", "auc")
    far = lambda c: F.round(F.abs(F.col(c) - 0.5), 9)
    both = null.where("permutation > 0").select(F.col("auc").alias("_a")).join(F.broadcast(data))  # the data are one row
    p = (F.count_if(far("_a") >= far("auc")) + 1) / (F.count("_a") + 1)
    return both.groupBy("n", "positives", "auc").agg(F.avg("_a").alias("null_mean"), F.stddev_samp("_a").alias("null_sd"), F.when(F.first("auc").isNotNull(), p).alias("p"))


def permutation_tests(df: DataFrame, scores: list[str], label: str, key: str, permutations: int = 200, seed: str = "5") -> DataFrame:
    """variant and its permutation_test, for each of several score columns."""
    each = [permutation_test(permutation_null(df, s, label, key, permutations, seed)).select(F.lit(s).alias("variant"), "*") for s in scores]
    return reduce(DataFrame.unionByName, each)
