"""The pairwise ranker and the matrix-factor generators against plain solvers."""

import numpy as np
from pyspark.sql import functions as F

from tessera.operators import boosting, dense, factors
from tessera.plans import catalogue_queries, learned_queries

SF = "/root/testdata/sf0.001"


def plain_gradients(groups):
    out = {}
    for k, rows in groups.items():
        order = sorted(rows, key=lambda r: (-r[2], r[0]))
        disc = {r[0]: 1 / np.log2(2 + p) for p, r in enumerate(order)}
        ideal = sum((2 ** r[1] - 1) / np.log2(2 + p) for p, r in enumerate(sorted(rows, key=lambda r: -r[1])))
        for a in rows:
            for b in rows:
                if a[1] > b[1]:
                    rho = 1 / (1 + np.exp(a[2] - b[2]))
                    delta = (2 ** a[1] - 2 ** b[1]) * abs(disc[a[0]] - disc[b[0]]) / ideal
                    for r, sign in ((a, -1), (b, 1)):
                        g, h = out.get((k, r[0]), (0, 0))
                        out[k, r[0]] = (g + sign * rho * delta, h + rho * (1 - rho) * delta)
    return out


def test_graded_gradients(spark):
    rng = np.random.default_rng(0)
    groups = {k: [(i, int(rng.integers(0, 4)), float(rng.normal())) for i in range(int(rng.integers(1, 9)))] for k in range(30)}
    df = spark.createDataFrame([(k, i, float(y) if y or i % 2 else None, s) for k, rows in groups.items() for i, y, s in rows], "q int, item int, label double, score double")
    want = plain_gradients(groups)
    for r in boosting.lambda_gradients(df, ["q"], "item").collect():
        assert np.allclose((r.g, r.h), want.get((r.q, r.item), (0, 0)), atol=1e-12)


def test_missing_and_constant_features(spark):
    rows = [(q, i, [None, float("nan"), 1.0, 5.0][i % 4], 3.0, float(i % 4 == 1)) for q in range(40) for i in range(8)]
    df = spark.createDataFrame(rows, "q int, item int, a double, b double, label double")
    forest = boosting.fit_ranker(df, ["q"], "item", ["a", "b"], rounds=3, depth=2)
    parts = boosting.score_rows(df, forest, parts=True).collect()
    assert forest.trees and all(x.feature <= 0 for t in forest.trees for x in t)  # the constant never splits
    assert {r.part_b for r in parts} == {0.0} and all(abs(r.base + r.part_a + r.part_b - r.score) < 1e-9 for r in parts)
    nothing = boosting.fit_ranker(df.withColumn("label", F.lit(0.0)), ["q"], "item", ["a", "b"], rounds=2)
    assert nothing.trees == [] and {r.score for r in boosting.score_rows(df, nothing).collect()} == {0.0}
    assert boosting.fit_ranker(df.limit(0), ["q"], "item", ["a", "b"]).trees == []


def test_attribution_of_two_trees(spark):
    N = boosting.Node
    forest = boosting.Forest(["a", "b"], [[1.0, 2.0], [0.5]], 0.5, [[N(1, 0, 2, 0.1, 1.0, 9), N(2, -1, -1, -0.4, 0, 5), N(3, 1, 1, 0.6, 1.0, 4), N(6, -1, -1, 0.2, 0, 2), N(7, -1, -1, 1.0, 0, 2)], [N(1, 1, 1, 0.0, 1.0, 9), N(2, -1, -1, 0.3, 0, 4), N(3, -1, -1, -0.3, 0, 5)]])
    df = spark.createDataFrame([(1, 1.5, 0.2), (2, 3.0, 0.2), (3, 3.0, 0.9), (4, None, None)], "k int, a double, b double")
    df.createOrReplaceTempView("two_trees")
    scored = boosting.score_rows(df, forest, parts=True)
    # values on the paths, written out: a at most 2 goes low; then b at most 0.5 in both trees
    want = spark.sql("""SELECT k, 0.5 * CASE WHEN a IS NULL OR a <= 2 THEN -0.5 ELSE 0.5 END AS pa,
      0.5 * (CASE WHEN a IS NULL OR a <= 2 THEN 0 WHEN b IS NULL OR b <= 0.5 THEN -0.4 ELSE 0.4 END + CASE WHEN b IS NULL OR b <= 0.5 THEN 0.3 ELSE -0.3 END) AS pb FROM two_trees""")
    both = {r.k: r for r in scored.collect()}
    for r in want.collect():
        x = both[r.k]
        assert abs(x.part_a - float(r.pa)) < 1e-12 and abs(x.part_b - float(r.pb)) < 1e-12 and abs(x.base - 0.05) < 1e-12 and abs(x.score - x.base - x.part_a - x.part_b) < 1e-12
    means = {r.feature: (r.mean_part, r.rank) for r in boosting.attribution(scored, ["a", "b"]).collect()}
    assert means["a"] == (0.25, 1) and means["b"][1] == 2


def ndcg(ranked, truth):
    hits = ranked.where("held_out").join(truth, "user_id").where("gt = track_id").select(F.avg(F.when(F.col("rank") <= 10, 1 / F.log2(1.0 + F.col("rank"))).otherwise(0.0)))
    return hits.first()[0]


def test_pairwise_beats_pointwise(spark):
    from tessera.plans import fusion_queries

    truth = fusion_queries._gt(spark, SF)
    pair, point = ndcg(learned_queries.pairwise_ranker(spark, SF), truth), ndcg(catalogue_queries.pointwise_ranker(spark, SF), truth)
    assert pair > point


def entries(spark, n_rows=80, n_items=30, seed=1):
    """A sparse table of few directions and noise, with a repeated entry and a NULL, and its matrix."""
    rng = np.random.default_rng(seed)
    a = (rng.random((n_rows, 4)) @ rng.random((4, n_items)) > 1.1) & (rng.random((n_rows, n_items)) < 0.6)
    a = a * rng.integers(1, 4, a.shape) * 1.0
    a[0, 0], a[0, 1] = 2.0, 0.0
    rows = [(i + 100, j + 500, float(a[i, j])) for i, j in np.argwhere(a).tolist()] + [(100, 500, 1.0), (100, 501, None)]
    a[0, 0] += 1
    return spark.createDataFrame(rows, "row long, item long, value double").repartition(3), a


def as_matrix(df, n, key="item", column="vector"):
    out = {r[key]: r[column] for r in df.collect()}
    size = len(next(iter(out.values())))
    return np.array([out.get(500 + j, [0.0] * size) for j in range(n)])  # items of no row don't occur


def test_singular_vectors(spark):
    rows, a = entries(spark)
    vectors, values = factors.singular_vectors(rows, 3, extra=8)
    _, s, vt = np.linalg.svd(a)
    assert np.abs(np.array(values) - s[:3]).max() < 1e-9
    v = as_matrix(vectors, a.shape[1])
    assert np.abs(v @ v.T - vt[:3].T @ vt[:3]).max() < 1e-6
    sums = {r.id: (r.vector, sorted(r.seen)) for r in factors.projected(rows.where("value > 0"), vectors, 3).collect()}
    assert np.abs(np.array(sums[103][0]) - v[a[3] > 0].sum(0)).max() < 1e-9 and sums[103][1] == (500 + np.flatnonzero(a[3])).tolist()


def test_sppmi_vectors(spark):
    rng = np.random.default_rng(3)
    w = np.maximum(rng.normal(size=(20, 20)), 0)
    w = np.triu(w, 1) + np.triu(w, 1).T
    pairs = spark.createDataFrame([(int(i), int(j) + 0, float(w[i, j])) for i, j in np.argwhere(w)], "i long, j long, w double")
    vectors, values = factors.sppmi_vectors(pairs, 4)
    u, s, _ = np.linalg.svd(w)
    want = u[:, :4] * s[:4] * np.sqrt(s[:4])
    out = {r.item: r.vector for r in vectors.collect()}
    e = np.array([out[j] for j in range(20)])
    assert np.abs(np.array(values) - s[:4]).max() < 1e-8 and np.abs(e @ e.T - want @ want.T).max() < 1e-5


def test_half_step_folds_in_any_row(spark):
    rows, a = entries(spark)
    rows = rows.where("value > 0").select("row", "item").distinct()
    rng = np.random.default_rng(5)
    y = rng.normal(size=(a.shape[1], 5))
    vectors = spark.createDataFrame([(500 + j, y[j].tolist()) for j in range(len(y))], "item long, vector array<double>")
    got = {r.item: r.vector for r in factors.half_step(rows, vectors, 5, 3.0, 7.0).collect()}
    for i, x in enumerate(a):
        own = y[x > 0]
        if len(own):
            want = np.linalg.solve(y.T @ y + 3 * np.eye(5) + 7 * own.T @ own, 8 * own.sum(0))
            assert np.abs(want - got[100 + i]).max() < 1e-10
        else:
            assert 100 + i not in got
    # a row that goes on over many batches
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        again = {r.item: r.vector for r in factors.half_step(rows, vectors, 5, 3.0, 7.0).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert again.keys() == got.keys() and all(np.allclose(again[k], got[k], atol=1e-12) for k in got)


def test_ridge_items(spark):
    rows, a = entries(spark, 40, 11)
    model = factors.ridge_items(rows, 20.0, m=4)
    p = np.linalg.inv(a.T @ a + 20 * np.eye(a.shape[1]))
    want = p / -np.diag(p)
    cells = {(r.i - 500, r.j - 500): r.w for r in model.weights.collect()}
    some = int(a.any(0).sum())  # items of no row don't occur
    assert len(cells) == some * (some - 1) and max(abs(want[k] - w) for k, w in cells.items()) < 1e-6
    assert model.residuals.agg(F.max("residual")).first()[0] <= 1e-10


def test_unseen_topk(spark):
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(50, 4)), rng.normal(size=(9, 4))
    tower = spark.createDataFrame([(int(i), v.tolist()) for i, v in enumerate(x)], "id long, vector array<double>")
    asks = spark.createDataFrame([(int(i), v.tolist(), [int(i), 7, 999] if i else None) for i, v in enumerate(q)], "id long, vector array<double>, seen array<long>")
    got = {(r.query_id, r["rank"]): r.id for r in dense.dense_topk_unseen(asks, tower, 5, block=8).collect()}
    for i in range(9):
        order = [j for j in np.argsort(-(x @ q[i])) if not i or j not in (i, 7)][:5]
        assert [got[i, k + 1] for k in range(5)] == order


def test_equal_splits_go_to_the_first_feature(spark):
    """Two features that part the rows alike, one in many bins and one in two: their gains are equal however the sums are put together."""
    for seed in range(8):
        rng = np.random.default_rng(seed)
        fine = np.concatenate([rng.integers(0, 15, 400), rng.integers(15, 30, 400)])
        g, h = rng.normal(np.where(fine < 15, 900.0, -900.0), 50.0), rng.random(800) + 0.1
        bins = np.stack([fine, np.where(fine < 15, 1, 2)], 1)
        lines = spark.createDataFrame([(bins[k::20].ravel().tolist(), g[k::20].tolist(), h[k::20].tolist()) for k in range(20)], "_bins array<smallint>, g array<double>, h array<double>")
        (best,) = boosting.best_splits(boosting.histograms(lines, [], 2, [1])).collect()
        assert (best.feature, best.bin, best.nl, best.n) == (0, 14, 400, 800)
        assert abs(best.g - g.sum()) < 1e-6 and abs(best.hl - h[:400].sum()) < 1e-6
