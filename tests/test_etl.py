"""ETL, popularity, nearest rows, folds, calibration choice and sources on small rows, against plain Python."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import collaborative as cf
from tessera.operators import dense, etl, fusion, heuristic, learned, ranking
from tessera.sources import tables as T

DAY = dt.date(2024, 1, 1)


def test_nearest_rows_with_common_items_equal_those_without_the_short_way(spark):
    rng = random.Random(3)
    data = [(r, i) for r in range(120) for i in set(rng.choices(range(40), [40] * 3 + [1] * 37, k=6))]
    rows = spark.createDataFrame(data, "row long, item long")
    weights = cf.session_idf(rows)
    for w in (None, weights):
        plain = cf.row_similarity(rows, rows, w, 5, common=10**9)
        for common in (1, 8, 30):
            some = cf.row_similarity(rows, rows, w, 5, common=common)
            key = lambda df: sorted((r.row, r["rank"], r.other, round(r.sim, 9)) for r in df.collect())
            assert key(some) == key(plain)


def test_following_keeps_gaps_and_ties(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 2, "c"), (1, 5, "d"), (2, 1, "e")], "session_id long, turn long, track_id string")
    assert sorted(map(tuple, cf.following(df, 3).collect())) == [("a", "b", 1), ("a", "c", 1), ("b", "d", 3), ("c", "d", 3)]


def test_popularity_steps_against_counting(spark):
    rng = random.Random(1)
    rows = [(DAY + dt.timedelta(days=rng.randrange(40)), rng.randrange(5)) for _ in range(120)]
    df = spark.createDataFrame(rows, "session_date date, track_id long")
    for days in (1, 7, None):
        got = {(r.session_date, r.track_id): r.plays for r in cf.popularity_window(df, days).collect()}
        want = {}
        for day in {d for d, _ in rows}:
            for d, t in rows:
                if d < day and (days is None or (day - d).days <= days):
                    want[day, t] = want.get((day, t), 0) + 1
        assert got == want


def test_blocks_of_sets_and_groups(spark):
    rng = random.Random(4)
    sets = [(i, rng.sample("abcdefghijkl", rng.randrange(1, 6))) for i in range(50)]
    df = spark.createDataFrame(sets, "id long, features array<string>")
    got = {}
    for r in dense.sparse_topk(df, 3, block=9).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.id, round(r.score, 9)))
    for i, a in sets:
        near = sorted((-round(len(set(a) & set(b)) / (len(a) * len(b)) ** 0.5, 9), j) for j, b in sets if j != i and set(a) & set(b))[:3]
        assert sorted(got.get(i, [])) == [(n + 1, j, -s) for n, (s, j) in enumerate(near)]
    v = np.random.default_rng(0).normal(size=(40, 3))
    vectors = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "id long, vector array<double>, label int")
    asks = vectors.withColumn("label", (F.col("label") + 1) % 4)
    best = {r.id: r.max_similarity for r in dense.max_similarity_to_group(asks, vectors, "label", block=7).collect()}
    assert best.keys() == {i for i in range(40) if (i % 3 + 1) % 4 < 3}
    assert all(np.isclose(best[i], max(v[i] @ v[j] for j in range(40) if j % 3 == (i % 3 + 1) % 4)) for i in best)


def test_folds_are_those_of_the_greedy_loop(spark):
    rng = random.Random(5)
    sizes = {u: rng.choice([1, 1, 1, 2, 3, 3, 7, 20]) for u in range(300)}
    counts = [(s, sum(x == s for x in sizes.values())) for s in set(sizes.values())]
    load, want = [0] * 5, {}
    for size in sorted(sizes.values(), reverse=True):
        f = min(range(5), key=lambda k: (load[k], k))
        load[f] += size
        want[size, f] = want.get((size, f), 0) + 1
    got, n = {}, dict(counts)
    for size, first, last, fold in etl.fold_plan(counts, 5):
        places = [first] if last >= 0 else list(range(first, n[size], 5))
        got[size, fold] = got.get((size, fold), 0) + len([p for p in places if p < n[size]])
    assert {k: v for k, v in got.items() if v} == want
    users = spark.createDataFrame(list(sizes.items()), "u long, n long")
    out = etl.assigned_folds(users, "u", "n", 5, "1").collect()
    assert len(out) == 300 and sorted(load) == sorted(sum(r.n for r in out if r.fold == f) for f in range(5))


def test_checks_raise(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "g long, item string")
    assert etl.filled_or_error(df, ["g"], "item", 1) is df
    with pytest.raises(ValueError, match="too few"):
        etl.filled_or_error(df, ["g"], "item", 2)
    with pytest.raises(ValueError, match="allow-list"):
        etl.allow_list(df, df.where("g > 9"), "g")
    assert etl.allow_list(df, df.where("g = 2"), "g").count() == 1


def test_groups_and_text_fields(spark):
    df = spark.createDataFrame([(g, i) for g in range(30) for i in range(2)], "g long, i long")
    protected = spark.createDataFrame([(29,)], "g long")
    some = etl.sampled_groups(df, ["g"], 5, protected)
    groups = {r.g for r in some.collect()}
    assert 29 in groups and len(groups) in (5, 6) and some.count() == 2 * len(groups)
    assert {r.g for r in etl.sampled_groups(df.repartition(7), ["g"], 5, protected).collect()} == groups
    assert etl.canonical(df, ["g"], "i").count() == 60
    rows = spark.createDataFrame([(None,), (" ",), ("None",), ("x",)], "t string")
    assert [r[0] for r in rows.select(etl.or_empty(F.col("t"))).collect()] == ["", "", "", "x"]
    flags = spark.createDataFrame([(None,), ("",), ("NaN",), ("1999",)], "t string").select(etl.undated(F.col("t")))
    assert [r[0] for r in flags.collect()] == [True, True, True, False]
    held = ranking.drop_seen(df, df.where("i = 0"), ["g", "i"])
    assert {r.i for r in held.collect()} == {1}


def test_nested_sessions_without_utterances(spark):
    df = spark.createDataFrame([(1, 7, "2024-02-30", None), (2, 7, "2024-02-03", [("music", "5", 1), ("user", "hi", 1)])], f"session_id long, user_id long, session_date string, conversations array<{etl.UTTERANCE}>")
    assert [tuple(r) for r in etl.music_turns(df).collect()] == [(2, 7, dt.date(2024, 2, 3), 1, "5")]
    assert etl.assemble_turns(etl.explode_conversation(df, ["session_id"])).count() == 0
    odd = df.withColumn("conversations", F.array(F.struct(F.lit("music").alias("role"), F.lit("9").alias("content"), F.lit(1).cast("long").alias("turn_number"))))
    assert {r.session_date for r in etl.music_turns(odd).collect()} == {None, dt.date(2024, 2, 3)}


def test_heuristic_reads_every_track_of_its_seeds(spark):
    tracks = [(i, f"a{i % 2}", f"a{i % 2}::b{i % 4}", float(1 + i % 13), 1980 + i % 20 if i % 5 else None) for i in range(400)]
    t = spark.createDataFrame(tracks, "track_id long, artist string, album string, popularity double, year long")
    history = spark.createDataFrame([(1, 1, 0), (1, 2, 6), (2, 1, 7), (3, 1, 999)], "session_id long, turn long, track_id long")
    got = {}
    for r in heuristic.additive_topk(history, t, 7).collect():
        got.setdefault(r.session_id, []).append((r["rank"], r.track_id, round(r.score, 8)))
    pos = sorted(x[3] for x in tracks)
    q1, q2, m, s = np.percentile(pos, 33), np.percentile(pos, 67), np.mean(pos), np.std(pos)
    bucket = lambda p: 0 if p < q1 else 1 if p < q2 else 2
    for session, seen in ((1, [0, 6]), (2, [7])):
        last = tracks[seen[-1]]
        pool = []
        for i, artist, album, p, year in tracks:
            score = 3 * (album == last[2]) + 2.5 * (artist == last[1]) + 1.5 * (album in {tracks[x][2] for x in seen}) + 1.2 * (artist in {tracks[x][1] for x in seen})
            inside = score > 0 or (year and last[4] and abs(year // 10 - last[4] // 10) <= 1)  # fewer than 150 a decade
            score += 0.6 * (np.exp(-abs(year - last[4]) / 5) if year and last[4] else 0) + 0.4 * (bucket(p) == bucket(last[3])) + 0.05 * (p - m) / s
            if inside and i not in seen:
                pool.append((-round(score, 9), i))
        assert sorted(got[session]) == [(n + 1, i, round(-x, 8)) for n, (x, i) in enumerate(sorted(pool)[:7])]
    assert 3 not in got


def test_factors_keep_to_their_block(spark):
    rng = random.Random(2)
    data = {(u, 20 * (u % 2) + rng.randrange(20)) for u in range(60) for _ in range(12)}
    rows = spark.createDataFrame(sorted(data), "row long, item long")
    out = learned.als_lists(rows, 3, rank=4).collect()
    assert all((r.row, r.item) not in data for r in out) and {r.row for r in out} == set(range(60))
    assert sum(r.item // 20 == r.row % 2 for r in out) > 0.9 * len(out)


def test_calibrator_choice_and_platt(spark):
    rng = random.Random(6)
    rows = [(p := rng.random(), int(rng.random() < p)) for _ in range(3000)]
    good = spark.createDataFrame(rows, "p double, y int")
    assert fusion.chosen_calibrator(good, "p", "y") == "isotonic"
    assert fusion.chosen_calibrator(good.withColumn("p", F.col("p") / 3), "p", "y") == "platt"
    assert fusion.platt(good.withColumn("y", F.col("y").cast("double")), "p", "y").coefficients[0] > 0


def test_quantiles_and_counts_below(spark):
    rng = random.Random(7)
    values = [round(rng.expovariate(1), 2) for _ in range(500)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    known = sorted(v for v in values if v is not None)
    for q in (0.0, 0.25, 0.99, 1.0):
        assert ranking.linear_quantile(df, "v", q, "x").first()[0] == pytest.approx(np.quantile(known, q))
    assert {r.v: r.below for r in ranking.counts_below(df, "v", 16).collect()} == {v: known.index(v) for v in known}


def test_stores(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, None)], "k long, v string")
    T.write_csv(df, f"{tmp_path}/csv")
    assert sorted(map(tuple, T.read_csv(spark, f"{tmp_path}/csv", "k long, v string").collect())) == [(1, "a"), (2, None)]
    (tmp_path / "r.json").write_text('{"s1": "hello", "s2": "you"}')
    assert sorted(map(tuple, T.read_responses(spark, f"{tmp_path}/r.json").collect())) == [("s1", "hello"), ("s2", "you")]
    assert T.write_guarded(df, f"{tmp_path}/g", {"seed": 1}) and not T.write_guarded(df, f"{tmp_path}/g", {"seed": 1}) and T.write_guarded(df, f"{tmp_path}/g", {"seed": 2})
    with pytest.raises(Exception, match="broken off"):
        T.write_guarded(df.withColumn("v", F.raise_error(F.lit("broken off")).cast("string")), f"{tmp_path}/g", {"seed": 3})
    assert T.write_guarded(df, f"{tmp_path}/g", {"seed": 2})  # what stood there is no longer vouched for
    calls = []
    compute = lambda x: calls.append(1) or x.where("k = 1")
    for rows in (df, df.orderBy(F.col("k").desc()), df.withColumn("k", F.col("k") + 1)):
        T.cached_by_content(rows, ["k", "v"], f"{tmp_path}/c", compute).count()
    assert len(calls) == 2
    T.save_state({"w": df}, f"{tmp_path}/m")
    assert T.load_state(spark, f"{tmp_path}/m", ["w"])["w"].count() == 2
    T.write_buckets(df.fillna("z"), f"{tmp_path}/b", "v", ["k"])
    assert spark.read.parquet(f"{tmp_path}/b").where("v = 'z'").count() == 1
    assert T.write_once(df, f"{tmp_path}/o") and not T.write_once(df, f"{tmp_path}/o")
