"""The permutation null against plain counting."""

import hashlib

import numpy as np

from tessera.operators import permutation


def test_all_permutations_at_once(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(rng.integers(0, 30)) + 4.0 * (k % 3 == 0), int(k % 3 == 0)) for k in range(300)]
    odd = [(900, None, 1), (901, float("nan"), 0), (902, 3.0, None), (None, 3.0, 1)]
    df = spark.createDataFrame(rows + odd, "id long, s double, y int").repartition(5)
    got = {r.permutation: (r.n, r.positives, r.auc) for r in permutation.permutation_null(df, "s", "y", "id", 20).collect()}
    least = permutation.PRIME * 100 // 300
    x = [int(hashlib.sha256(str(k).encode()).hexdigest()[:8], 16) % permutation.PRIME for k, _, _ in rows]
    labels = [[y for _, _, y in rows]] + [[int((a * v + b) % permutation.PRIME < least) for v in x] for a, b in permutation.affine(20, "5")]
    for p, y in enumerate(labels):
        one, other = [r[1] for r, t in zip(rows, y) if t], [r[1] for r, t in zip(rows, y) if not t]
        want = np.mean([[(a > b) + 0.5 * (a == b) for b in other] for a in one])
        assert got[p][:2] == (300, len(one)) and abs(got[p][2] - want) < 1e-12
    test = permutation.permutation_test(permutation.permutation_null(df, "s", "y", "id", 99)).first()
    assert test.p == 0.01 and abs(test.null_mean - 0.5) < 0.02  # the data stand out
    noise = permutation.permutation_test(permutation.permutation_null(df.withColumn("s", df.id % 7), "s", "y", "id", 99)).first()
    assert noise.p > 0.05


def test_one_label_or_no_row(spark):
    df = spark.createDataFrame([(k, float(k), 1) for k in range(5)], "id long, s double, y int")
    for some in (df, df.limit(0)):
        r = permutation.permutation_test(permutation.permutation_null(some, "s", "y", "id", 5)).first()
        assert r.auc is None and r.p is None
