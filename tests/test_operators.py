"""Formulas on hand-computed rows, edge cases, and properties."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions.columns import average_rank, cosine, min_max, ndcg_at, uniform01, year_proximity, z_score
from tessera.operators import collaborative as cf
from tessera.operators import catalogue, dense, fusion, metrics, splits, text
from tessera.operators import sets as set_blocks
from tessera.operators.ranking import fill_short, graft_first, positions, rank_average, topk_per_group
from tessera.sources import tables as T


def rows(df, *columns):
    return sorted(tuple(round(v, 6) if isinstance(v, float) else v for v in r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def pool(spark):
    data = [("g", "A", "t1", 1, 3.0), ("g", "A", "t2", 2, 2.0), ("g", "A", "t3", 3, 1.0), ("g", "B", "t2", 1, 10.0), ("g", "B", "t4", 2, 5.0)]
    return spark.createDataFrame(data, "k string, cg string, track_id string, rank long, score double")


def test_fusion_features(pool):
    norm = fusion.normalised(pool, ["k"])
    assert rows(norm.where("cg = 'A'"), "track_id", "score_z") == [("t1", 1.0), ("t2", 0.0), ("t3", -1.0)]
    got = fusion.fusion_features(norm, ["k"], 2)
    assert rows(got, "track_id", "borda", "rrf60", "rrf5", "combsum", "combmnz", "isr", "logrank", "rank_product_200", "min_rank", "max_rank", "median_rank", "std_rank") == [
        ("t1", 200, 0.016393, 0.166667, 1.0, 1.0, 1.0, 1.0, -2.649159, 1, 1, 1.0, None),
        ("t2", 399, 0.032522, 0.309524, 1.5, 3.0, 1.25, 1.63093, -0.346574, 1, 2, 1.5, 0.707107),
        ("t3", 198, 0.015873, 0.125, 0.0, 0.0, 0.111111, 0.5, -3.198465, 3, 3, 3.0, None),
        ("t4", 199, 0.016129, 0.142857, 0.0, 0.0, 0.25, 0.63093, -2.995732, 2, 2, 2.0, None),
    ]


def test_fusion_of_constant_lists_counts_null_as_zero(spark):
    one = spark.createDataFrame([("g", "A", "t1", 1, 5.0), ("g", "A", "t2", 2, 5.0)], "k string, cg string, track_id string, rank long, score double")
    assert rows(fusion.fusion_features(fusion.normalised(one, ["k"]), ["k"], 1), "track_id", "combsum") == [("t1", 0.0), ("t2", 0.0)]


def test_weight_scale_leaves_the_order(spark, pool):
    p = pool.withColumn("bucket", F.lit("b"))
    w = lambda x: spark.createDataFrame([("A", "b", 2.0 * x), ("B", "b", 1.0 * x)], "cg string, bucket string, weight double")
    order = lambda x: rows(fusion.weighted_rrf(p, w(x), ["k"], "bucket", 60, 9), "rank", "track_id")
    assert order(1) == order(10)


@pytest.fixture(scope="module")
def plays(spark):
    return spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "a"), (3, "a")], "session_id long, track_id string")


def test_item_knn_rp3_and_sppmi(plays):
    b = cf.binary(plays)
    pick = lambda df: [r for r in rows(df, "i", "j", "w") if r[0] < r[1]]
    assert pick(cf.item_cosine(b, 0.0)) == [("a", "b", 0.816497), ("a", "c", 0.57735), ("b", "c", 0.707107)]
    assert pick(cf.item_cosine(b, 10.0)) == [("a", "b", 0.160649), ("a", "c", 0.085237), ("b", "c", 0.08761)]
    assert rows(cf.rp3beta(b, 0.5, 0.3), "i", "j", "w") == [("a", "b", 0.475001), ("a", "c", 0.333333), ("b", "a", 0.547427), ("b", "c", 0.408248), ("c", "a", 0.489634), ("c", "b", 0.520337)]
    assert pick(cf.sppmi(cf.cooccurrence(b))) == [("a", "b", 0.575364), ("a", "c", 0.287682), ("b", "c", 0.287682)]


def test_session_idf_and_knn(spark, plays):
    b = cf.binary(plays)
    assert rows(cf.session_idf(b), "item", "weight") == [("a", 1.0), ("b", 1.287682), ("c", 1.693147)]
    profile = spark.createDataFrame([(9, "b")], "row long, item string")
    sims = cf.row_similarity(profile, b, cf.session_idf(b))
    assert rows(sims, "other", "sim") == [(1, 0.613356), (2, 0.425441)]
    assert rows(cf.session_knn(profile, b), "item", "score") == [("a", 1.038796), ("c", 0.720333)]  # b is in the profile


def test_sequential_rules(spark):
    s = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 4, "c")], "session_id long, turn long, track_id string")
    assert rows(cf.sequential_rules(s, 10), "i", "j", "w") == [("a", "b", 1.0), ("a", "c", 0.333333), ("b", "c", 0.5)]
    assert rows(cf.sequential_rules(s, 2), "i", "j") == [("a", "b"), ("b", "c")]


def test_text_weights(spark):
    docs = spark.createDataFrame([(1, "red ring"), (2, "red red bolt"), (3, "blue gear"), (4, None), (5, "")], "d long, t string")
    q = spark.createDataFrame([(1, "red bolt")], "q long, t string")
    three = docs.where("d <= 3")
    n = three.agg(F.count("*").alias("n"))
    dp, qp = text.postings(three, "d", F.col("t")), text.postings(q, "q", F.col("t"))
    got = text.match(qp.select("q", "term", F.lit(1.0).alias("w")), "q", text.bm25_weights(dp, "d", n), "d", 5)
    assert rows(got, "d", "score") == [(1, 0.502294), (2, 1.484047)]
    idf = text.smooth_idf(dp, n)
    got = text.match(text.tfidf_weights(qp, "q", idf), "q", text.tfidf_weights(dp, "d", idf), "d", 5)
    assert rows(got, "d", "score") == [(1, 0.366447), (2, 0.966315)]
    assert text.postings(docs, "d", F.col("t")).where("d > 3").count() == 0


def test_bigrams(spark):
    t = spark.createDataFrame([(1, "a b a b"), (2, "a b c"), (3, "alone"), (4, None)], "id long, t string")
    grams = text.bigrams(t, ["id"], F.col("t"))
    assert rows(text.distinct_share(grams.withColumn("all", F.lit(1)), ["all"]), "n", "n_distinct", "distinct2") == [(5, 3, 0.6)]
    assert rows(set_blocks.jaccard_pairs(grams.withColumnRenamed("bigram", "member"), "id", 5), "x", "y", "jaccard") == [(1, 2, 0.333333)]


def test_metrics(spark):
    hits = spark.createDataFrame([(1, 1), (1, None), (2, 3)], "turn long, position long")
    by = metrics.macro_by(hits, "turn")
    assert rows(by, "turn", "n", "ndcg20") == [(1, 2, 0.5), (2, 1, 0.5)]
    assert rows(metrics.macro_mean(by, ["ndcg20"]), "ndcg20") == [(0.5,)]
    v = spark.createDataFrame([(1, k / 10) for k in range(1, 11)], "g long, x double")
    assert rows(metrics.cvar(v, ["g"], "x", 0.7), "cvar") == [(0.2,)]
    assert rows(metrics.cvar(v, ["g"], "x", 0.75), "cvar") == [(0.15,)]  # 2.5 rounds to even
    five = v.where("x <= 0.5")
    assert rows(metrics.conformal_quantile(five, ["g"], "x", 0.1), "q") == [(0.5,)]
    assert rows(metrics.conformal_quantile(five, ["g"], "x", 0.4), "q") == [(0.4,)]
    d = spark.createDataFrame([(1, x) for x in (0.1, 0.2, 0.3, 0.0)], "g long, d double")
    assert rows(metrics.bernstein_interval(d, ["g"], "d"), "low", "high") == [(-3.105473, 3.405473)]
    e = spark.createDataFrame([(0.05, 0), (0.15, 1), (0.95, 1)], "p double, y int")
    assert metrics.expected_calibration_error(e, "p", "y").agg(F.sum(F.col("gap") * F.col("weight"))).first()[0] == pytest.approx(0.316667, abs=1e-6)


def test_isotonic_is_monotone_and_keeps_small_groups(spark):
    data = [("g", x, int((x * 7) % 10 < x)) for x in range(10) for _ in range(3)] + [("few", 0, 1), ("few", 2, 0)]
    fit = {(r.k, r.x): r.y_hat for r in fusion.isotonic_steps(spark.createDataFrame(data, "k string, x long, y int"), ["k"], "x", "y").collect()}
    line = [fit["g", x] for x in range(10)]
    assert line == sorted(line) and sum(line) == pytest.approx(sum(y for k, _, y in data if k == "g") / 3)
    assert fit["few", 2] == 1.0 and fit["few", 0] == 0.0


def test_lists(spark):
    df = spark.createDataFrame([(["x", "y", "z"], ["y", "x", "w"])], "a array<string>, b array<string>")
    assert df.select(graft_first(F.col("a"), F.col("b"), 4)).first()[0] == ["x", "y", "w", "z"]
    main = spark.createDataFrame([(1, "a", 1)], "g long, item string, rank long")
    back = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (1, "c", 3)], "g long, item string, rank long")
    assert rows(fill_short(main, back, ["g"], "item", 2), "item", "rank", "source") == [("a", 1, 0), ("b", 2, 1)]
    scored = spark.createDataFrame([("g", t, s, t == "d") for t, s in zip("abcd", (4.0, 3.0, 3.0, 1.0))], "k string, track_id string, score double, gt boolean")
    top = topk_per_group(scored, ["k"], [F.col("score").desc(), F.col("track_id")], 1, F.col("gt"))
    assert rows(top, "track_id", "rank") == [("a", 1), ("d", 4)]
    assert rows(rank_average([scored, scored.where("track_id <> 'a'")], ["k"], "track_id"), "track_id", "score") == [("b", -1.5), ("c", -2.5), ("d", -3.5)]


def test_column_helpers(spark):
    df = spark.createDataFrame([(1, 5.0), (1, 5.0), (1, 7.0), (1, None), (2, 1.0)], "g long, x double")
    assert sorted(r[0] or 0 for r in df.where("g = 1").select(average_rank(F.col("x"), ["g"])).collect()) == [0, 1.5, 1.5, 3.0]
    assert df.where("g = 2").select(min_max(F.col("x"), ["g"]), z_score(F.col("x"), ["g"])).first() == (None, None)
    one = spark.createDataFrame([([3.0, 4.0], [0.0, 0.0], 2000, 2005)], "a array<double>, b array<double>, y long, z long")
    r = one.select(cosine("a", "a").alias("s"), cosine("a", "b").alias("n"), year_proximity(F.col("y"), F.col("z")).alias("p")).first()
    assert r.s == pytest.approx(1) and r.n is None and r.p == pytest.approx(0.367879, abs=1e-6)
    p = spark.createDataFrame([(1,), (3,), (21,), (None,)], "p long")
    assert [round(x[0], 6) for x in p.select(ndcg_at(F.col("p"), 20)).collect()] == [1.0, 0.5, 0.0, 0.0]
    u = [r[0] for r in spark.range(500).select(uniform01(F.col("id"), "s")).collect()]
    assert all(0 <= x < 1 for x in u) and 0.4 < sum(u) / 500 < 0.6


def test_dense(spark):
    v = spark.createDataFrame([(1, [3.0, 4.0]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, None)], "id long, vector array<double>")
    unit = dense.normalised(v, "vector")
    assert {r.id: r.vector for r in unit.collect()} == {1: [0.6, 0.8], 2: [1.0, 0.0], 3: [0.0, 0.0]}
    top = dense.dense_topk(unit.where("id = 1"), unit, 2, block=2)
    assert rows(top, "query_id", "id", "score", "rank") == [(1, 2, 0.6, 1), (1, 3, 0.0, 2)]
    c = dense.centroid(unit.where("id < 3").withColumn("g", F.lit(1)), ["g"], "vector").first().vector
    assert sum(x * x for x in c) == pytest.approx(1)


def test_splits(spark):
    inter = spark.createDataFrame([(u, s) for u in range(40) for s in range(u * 3, u * 3 + u % 3 + 1)], "u long, s long")
    held = splits.greedy_holdout(inter, "u", "s", "42", 20)
    total = held.agg(F.sum("n_sessions")).first()[0]
    assert 20 <= total <= 22
    assert splits.same_rows(held, splits.greedy_holdout(inter.repartition(7), "u", "s", "42", 20))
    seats = splits.apportion(spark.createDataFrame([("a", 0.5), ("b", 0.3), ("c", 0.2)], "k string, x double"), "k", "x", 7)
    assert rows(seats, "k", "seats") == [("a", 4), ("b", 2), ("c", 1)]
    cells = spark.createDataFrame([("x", "p", 10), ("x", "q", 30), ("y", "p", 40), ("y", "q", 20)], "a string, b string, n long")
    goal = lambda c, p: spark.createDataFrame(p, "value string, p double")
    raked = splits.rake(cells, {"a": goal("a", [("x", 0.5), ("y", 0.5)]), "b": goal("b", [("p", 0.7), ("q", 0.3)])}, 10)
    mass = {(r.a, r.b): r.w * r.n for r in raked.collect()}
    assert sum(m for (a, _), m in mass.items() if a == "x") / sum(mass.values()) == pytest.approx(0.5, abs=1e-3)
    assert sum(m for (_, b), m in mass.items() if b == "p") / sum(mass.values()) == pytest.approx(0.7, abs=1e-6)
    assert spark.range(1).select(splits.density_ratio(F.lit(0.5), 100, 10), splits.group_id(F.lit(3), F.lit(9))).first() == (10.0, 5)
    subsets = splits.weighted_subsets(spark.range(1, 50).select("id", F.col("id").cast("double").alias("w")), "id", "w", 30, 5, "s")
    assert subsets.count() == 150 and subsets.distinct().count() == 150


def test_context_of_a_short_session(spark):
    inter = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 3, "c"), (2, 1, "z")], "session_id long, turn long, track_id string")
    assert rows(T.context(inter), "session_id", "turn") == [(1, 1), (1, 2)]
    assert rows(T.ground_truth(inter), "session_id", "target_turn", "gt_track_id") == [(1, 3, "c")]


def test_sources(spark, tmp_path):
    for name, v in (("a", 1), ("b", 2)):
        spark.createDataFrame([(7, v), (v, v)], "k long, v long").coalesce(1).write.parquet(f"{tmp_path}/{name}")
    got = T.last_file_wins(spark, [f"{tmp_path}/a", f"{tmp_path}/b"], ["k"])
    assert rows(got, "k") == [(1,), (2,), (7,)]
    (tmp_path / "log.jsonl").write_text('{"s": "x", "content": "old"}\n{"s": "y", "content": "b"}\n{"s": "x", "content": "new"}\n')
    assert rows(T.last_line_wins(spark, f"{tmp_path}/log.jsonl", "s", "s string, content string"), "s", "content") == [("x", "new"), ("y", "b")]
    cache = spark.createDataFrame([(1, "c")], "k long, v string")
    filled = T.fill_misses(cache, spark.createDataFrame([(1,), (2,)], "k long"), ["k"], lambda m: m.withColumn("v", F.lit("new")))
    assert rows(filled, "k", "v") == [(1, "c"), (2, "new")]
    assert T.write_once(cache, f"{tmp_path}/once") and not T.write_once(cache, f"{tmp_path}/once")
    assert T.with_columns(cache, {"k": "string", "x": "double"}).dtypes == [("k", "string"), ("x", "double")]
    lists = spark.createDataFrame([(1, ["a", "b"])], "session_id long, track_ids array<string>")
    texts = spark.createDataFrame([(1, "hi")], "session_id long, response string")
    assert T.submission_records(lists, texts).first().record == '{"session_id":1,"predicted_track_ids":["a","b"],"predicted_response":"hi"}'


def test_jaccard_pairs_count_common_members(spark):
    rng = random.Random(4)
    sets = {i: {m for m in range(40) if rng.random() < (0.9 if m < 4 else 0.15)} | {f"only {i}"} for i in range(30)}
    df = spark.createDataFrame([(i, str(m)) for i, s in sets.items() for m in s], "id long, member string")
    share = lambda a, b: len(a & b) / len(a | b)
    pairs = [(x, y, share(sets[x], sets[y])) for x in sets for y in sets if x < y and sets[x] & sets[y]]
    want = sorted(pairs, key=lambda p: (-round(p[2], 9), p[0], p[1]))[:12]
    for block in (1, 7, 100):  # the cost alone
        got = [(r.x, r.y, round(r.jaccard, 9)) for r in set_blocks.jaccard_pairs(df, "id", 12, block).collect()]
        assert got == [(x, y, round(j, 9)) for x, y, j in want]


def test_shared_counts_by_products_and_by_pairs(monkeypatch):
    rng = np.random.default_rng(3)
    share = np.concatenate([np.full(40, 0.6), np.full(300, 0.02)])  # common members and rare ones
    x, y = (rng.random((n, 340)) < share for n in (50, 70))
    monkeypatch.setattr(set_blocks, "MEMBERS", 16)
    monkeypatch.setattr(set_blocks, "PAIRS", 5)
    got = set_blocks.shared_counts(*np.nonzero(x), 50, *np.nonzero(y), 70)
    assert (got == x.astype(int) @ y.T.astype(int)).all()
    none = np.zeros(0, int)
    assert (set_blocks.shared_counts(none, none, 2, *np.nonzero(y), 70) == 0).all()


def test_jaccard_pairs_defined_cases(spark):
    schema = "id long, member string"
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (3, None), (4, "b"), (5, "a"), (5, "c")], schema)
    got = [tuple(r) for r in set_blocks.jaccard_pairs(df, "id", 9, 2).collect()]
    assert got == [(1, 2, 1.0), (1, 5, 0.5), (2, 5, 0.5)]
    assert set_blocks.jaccard_pairs(spark.createDataFrame([], schema), "id", 9).count() == 0


def test_positions_with_an_outlier_and_ties(spark):
    df = spark.createDataFrame([(i, 1e300 if i == 7 else float(i % 3)) for i in range(200)], "id long, v double").repartition(5)
    got = {r.id: r.place for r in positions(df, [F.col("v").asc(), F.col("id").asc()], "place").collect()}
    want = sorted(range(200), key=lambda i: (1e300 if i == 7 else i % 3, i))
    assert got == {i: k + 1 for k, i in enumerate(want)}


def test_first_available_against_plain_lists(spark):
    rng = random.Random(8)
    years = [None, 1955, 1975, 1984, 1999, 2003, 2015, 2021]
    data = [(i, rng.choice(years), rng.choice([None, 1.0, 2.0, 3.0])) for i in range(60)]
    order = catalogue.fallback_order(spark.createDataFrame(data, "track_id long, year long, popularity double"))
    turn = lambda y: catalogue.FALLBACK_DECADES.index(y // 10 * 10) if y and y // 10 * 10 in catalogue.FALLBACK_DECADES else 6
    plain = [i for i, y, p in sorted(data, key=lambda r: (turn(r[1]), r[2] is None, -(r[2] or 0), r[0]))]
    assert [r.track_id for r in order.orderBy("place").collect()] == plain
    held = {0: [], 1: plain[:12], 2: plain[3:30:2], 3: rng.sample(plain, 55), 4: plain}
    excluded = spark.createDataFrame([(u, t) for u, ts in held.items() for t in ts + ts[:2]] + [(None, 1), (1, 999)], "user_id long, track_id long")
    got = {}
    for r in catalogue.first_available(spark.createDataFrame([(u,) for u in [*held, None]], "user_id long"), "user_id", order, excluded, 9).collect():
        got.setdefault(r.user_id, {})[r.position] = r.track_id
    want = {u: dict(enumerate([t for t in plain if t not in ts][:9], 1)) for u, ts in held.items()}
    assert got == {u: w for u, w in want.items() if w}
