"""What must hold for large tables: plans, and operators against plain counting."""

import datetime as dt
import os
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tessera.llm import secrets
from tessera.operators import collaborative as cf
from tessera.operators import calibration, dense, factors, features, heuristic, products, text
from tessera.plans import etl_queries
from tessera.sources import stored


def joins(df):
    """The joins of a plan as it is before it runs, by name."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [x for line in plan.splitlines() for x in ("SortMergeJoin", "BroadcastHashJoin", "ShuffledHashJoin") if x in line]


def test_grams_are_never_broadcast(spark):
    part = spark.createDataFrame([(1, "Red ring"), (2, "blue Ring red")], "k long, t string")
    names = spark.createDataFrame([("red ring", "R", 2.0), ("ring", "G", 1.0)], "alias string, entity string, weight double")
    got = text.entity_match(part, "k", F.col("t"), names)
    assert joins(got) == ["SortMergeJoin"]
    assert sorted(map(tuple, got.collect())) == [(1, "G", 1.0), (1, "R", 2.0), (2, "G", 1.0)]


def test_tracks_with_tags_are_never_broadcast(spark):
    inter = spark.createDataFrame([(1, 1, 10), (1, 2, 11), (1, 3, 10)], "session_id long, turn long, track_id long")
    tracks = spark.createDataFrame([(10, "a", "x", 1.0, ["p", "q"]), (11, "a", "y", 3.0, ["q"])], "track_id long, artist string, album string, popularity double, tags array<string>")
    got = features.overlap(inter, inter, tracks)
    assert "BroadcastHashJoin" not in joins(got)
    assert sorted(map(tuple, got.select("turn", "artist_count", "album_count", "tags_known", "tags_new").collect())) == [(1, 0, 0, 0, 2), (2, 1, 0, 1, 0), (3, 2, 1, 2, 0)]


def test_copies_of_sets_share_one_list(spark, monkeypatch):
    rng = random.Random(6)
    kinds = [rng.sample("abcdefgh", rng.randrange(1, 5)) for _ in range(12)]
    sets = [(i, rng.sample(s, len(s))) for i, s in enumerate(rng.choice(kinds) for _ in range(90))] + [(90, []), (91, ["z"]), (92, ["z"]), (93, ["y"])]
    dealt = []
    deal = dense._in_blocks
    monkeypatch.setattr(dense, "_in_blocks", lambda q, x, *a: dealt.append(q.count()) or deal(q, x, *a))
    found = dense.sparse_topk(spark.createDataFrame(sets, "id long, features array<string>"), 5, block=5).collect()
    assert dealt == [len({frozenset(s) for _, s in sets if s})]
    got = sorted((r.query_id, r["rank"], r.id, r.score) for r in found)
    want = []
    for i, a in sets:
        near = sorted((-round(len(set(a) & set(b)) / (len(a) * len(b)) ** 0.5, 9), j) for j, b in sets if j != i and set(a) & set(b))[:5]
        want += [(i, n + 1, j, -s) for n, (s, j) in enumerate(near)]
    assert got == sorted(want)


def test_top_of_windows_without_meeting_every_date(spark, monkeypatch):
    rng = random.Random(7)
    day = dt.date(2020, 1, 1)
    df = spark.createDataFrame([(day + dt.timedelta(days=rng.randrange(50)), rng.randrange(12)) for _ in range(400)] + [(None, 1)], "session_date date, track_id long")
    since = spark.createDataFrame([(t, None if t % 3 else day + dt.timedelta(days=5 * t)) for t in range(11)], "track_id long, since date")
    windows = [1, 7, 30, None]
    want = []
    for dates in (None, {r.track_id: r.since for r in since.collect()}):
        for w, days in enumerate(windows):
            lists = {}
            for r in cf.popularity_window(df, days).collect():
                if dates is None or (r.track_id in dates and (dates[r.track_id] is None or dates[r.track_id] <= r.session_date)):
                    lists.setdefault(r.session_date, []).append((-r.plays, r.track_id))
            want.append(sorted((w, d, t, -p, n + 1) for d, x in lists.items() for n, (p, t) in enumerate(sorted(x)[:4])))
    monkeypatch.setattr(cf, "popularity_window", None)
    for first, from_day in ((0, None), (4, since)):
        got = [tuple(r) for r in cf.top_of_windows(df.repartition(3), windows, 4, from_day).collect()]
        assert sorted(got) == sorted(x for part in want[first : first + 4] for x in part)
    assert cf.top_of_windows(df.where("track_id is null"), windows, 4).collect() == []


def test_released_lists_without_meeting_every_date(spark, monkeypatch):
    monkeypatch.setattr(cf, "popularity_window", None)
    assert etl_queries.top_popular_released(spark, "/root/testdata/sf0.001").count() > 0


def test_threshold_comes_from_all_words(spark, monkeypatch):
    rng = random.Random(8)
    words = sorted({"".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(7)) for _ in range(5 * secrets.N_WORDS)})
    df = spark.createDataFrame([(" ".join(words[k::40]),) for k in range(40)], "text string").repartition(3)
    held, least_cost = {}, secrets.least_cost
    monkeypatch.setattr(secrets, "least_cost", lambda models, ordinary: held.update(ordinary) or least_cost(models, ordinary))
    trained = secrets.train(df)
    assert sum(held.values()) >= 6 * (len(words) // 3)  # three words make an identifier, in six spellings
    assert np.isfinite(trained.least_ratio)
    spelt = secrets.ordinary_strings(["abc", "defghijklmnopqrstuv", "wxyz"])
    assert all(any(w in x.decode().lower() for x in spelt) for w in ("abc", "defghijklmnopqrstuv", "wxyz"))


def test_blocks_grow_with_the_rows_and_are_scored_by_slices(spark, monkeypatch):
    # up to 64 blocks of 32,768 rows what is sent grows as the rows do
    assert [dense._block(n, 2048) for n in (10, 16384, 120000, 10**7)] == [2048, 2048, 15000, 32768]
    monkeypatch.setattr(dense, "SLICE", 3)
    v = np.random.default_rng(3).normal(size=(40, 4)).round(1)
    df = spark.createDataFrame([(i, x.tolist(), i % 3) for i, x in enumerate(v)], "id long, vector array<double>, label long")
    scores = np.round(v @ v.T, 9)
    for away, found in ((False, dense.dense_topk(df, df, 4, 11)), (True, dense.dense_topk_outside(df.withColumnRenamed("label", "away"), df, 4, 11))):
        want = [(i, n + 1, j) for i in range(40) for n, (_, j) in enumerate(sorted((-scores[i, j], j) for j in range(40) if j != i and not (away and i % 3 == j % 3))[:4])]
        assert sorted((r.query_id, r["rank"], r.id) for r in found.collect()) == want
    best = {r.id: r.max_similarity for r in dense.max_similarity_to_group(df, df, "label", 11).collect()}
    assert all(np.isclose(best[i], max(v[i] @ v[j] for j in range(40) if j % 3 == i % 3)) for i in range(40))


def test_cells_of_artists_are_looked_up_where_albums_leave_them_open(spark, monkeypatch):
    rows = [(20 * a + n, "a", f"a{a}", float(1 + 20 * a + n), 2000 + n % 3) for a in range(4) for n in range(20)] + [(90, "b", "b0", 5.0, 2001), (91, "b", "b1", 6.0, 2001)]
    tracks = spark.createDataFrame(rows, "track_id long, artist string, album string, popularity double, year long")
    history = spark.createDataFrame([(1, 1, 3), (1, 2, 25), (2, 1, 90)], "session_id long, turn long, track_id long")
    kept, store = {}, heuristic.stored
    monkeypatch.setattr(heuristic, "stored", lambda df, name: kept.setdefault(name, store(df, name)))
    got = heuristic.additive_topk(history, tracks, 3, decade_n=2).collect()
    cells = sorted((r.session_id, r.cell.split('"album":')[1]) for r in kept["asked-cells"].collect())
    # the first session's last album is enough for it, so of its artist's cells only those it has heard are asked; the second needs all
    assert cells == [(1, '"a0"}'), (1, '"a1"}'), (2, '"b0"}'), (2, '"b1"}')]
    assert {r.track_id // 20 for r in got if r.session_id == 1} == {1} and [r.track_id for r in got if r.session_id == 2][0] == 91
    assert len([r for r in got if r.session_id == 2]) == 3


def test_a_years_tracks_count_as_far_as_they_are_needed(spark):
    rows = [(i, "c", 2000 + i % 2, i % 3, i // 7 * 0.1) for i in range(60)]
    tracks = spark.createDataFrame(rows, "track_id long, cell string, year long, bucket int, pop_z double")
    wanted = spark.createDataFrame([("c", 1, 4), ("c", 2, 2)], "cell string, l_bucket int, most int")
    w = heuristic.WEIGHTS
    got = {}
    for r in heuristic._heads_of_years(tracks, wanted, w).collect():
        got.setdefault((r.l_bucket, r.year), set()).add(r.track_id)
    for b, n in ((1, 4), (2, 2)):
        for year in (2000, 2001):
            best = sorted((-(w["pop_match"] * (x[3] == b) + w["pop_z"] * x[4]), x[0]) for x in rows if x[2] == year)
            assert got[b, year] == {i for _, i in best[:n]}


def test_negatives_meet_lists_not_their_tracks(spark, monkeypatch):
    rng = random.Random(9)
    rows = [(i, f"a{i % 2}", f"a{i % 2}-{i % 6}", float(i + 1), 2000 + i % 4) for i in range(120)]
    tracks = spark.createDataFrame(rows, "track_id long, artist string, album string, popularity double, year long")
    plays = spark.createDataFrame([(i, rng.randrange(5)) for i in range(120)], "track_id long, plays long")
    heard = [(s, rng.randrange(120)) for s in range(6) for _ in range(4)]
    history = spark.createDataFrame(heard, "session_id long, track_id long")
    targets = spark.createDataFrame([(s, 10 * s, "c") for s in range(6)], "session_id long, track_id long, category string")
    lift = spark.createDataFrame([("c", 100 - n, n + 1) for n in range(40)], "category string, track_id long, place long")
    sizes, top = [], heuristic.topk_per_group
    monkeypatch.setattr(heuristic, "topk_per_group", lambda df, *a, **k: sizes.append(df.count()) or top(df, *a, **k))
    got = heuristic.hard_negatives(targets, history, tracks, plays, lift, total=12).collect()
    assert max(sizes) <= 120  # only the catalogue is ranked, whatever the sessions are
    n = {r.track_id: r.plays for r in plays.collect()}
    best = lambda ids: sorted(set(ids), key=lambda i: (-n[i], i))
    q = np.quantile([r[3] for r in rows], [0.33, 0.67])
    pop = lambda i: int(np.searchsorted(q, rows[i][3], side="right"))
    for s in range(6):
        gt, mine = 10 * s, {t for x, t in heard if x == s}
        like = lambda c, of: [r[0] for r in rows if r[c] in {rows[i][c] for i in of}]
        lists = [best(mine), best(like(2, mine)), best(like(1, mine)), best(like(2, [gt])), best(like(1, [gt])), best(i for i in range(120) if pop(i) == pop(gt)), best(r[0] for r in rows if abs(r[4] - rows[gt][4]) <= 5), [100 - k for k in range(40)], best(range(120))]
        taken, want = [gt], []
        for (name, most), ids in zip(heuristic.BUDGET.items(), lists, strict=True):
            new = [i for i in ids if i not in taken][: min(most, 13 - len(taken))]
            taken += new
            want += [(name, i) for i in new]
        assert [(r.bucket, r.track_id) for r in sorted(got, key=lambda r: r.place) if r.session_id == s] == want


def test_short_rows_are_dealt_as_vectors_and_long_ones_as_sums(spark):
    f, rng = 3, np.random.default_rng(4)
    rows = np.array([1] * 9 + [2, 3, 3, 4], dtype=np.int64)
    y = rng.normal(size=(len(rows), f))
    batch = pa.RecordBatch.from_arrays([pa.array(rows), pa.array(y.tolist())], names=["row", "vector"])
    lines = [(r, x) for b in factors._partial(f)([batch]) for r, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
    assert sorted((r, len(x)) for r, x in lines) == [(1, f + f * f), (2, f), (3, f), (3, f), (4, f)]
    items = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(y)], "item long, vector array<double>")
    entries = spark.createDataFrame([(int(r), i) for i, r in enumerate(rows)], "row long, item long")
    for r in factors.half_step(entries.coalesce(1), items.coalesce(1), f, 2.0, 5.0).collect():
        mine = y[rows == r.item]
        want = np.linalg.solve(y.T @ y + 2 * np.eye(f) + 5 * mine.T @ mine, 6 * mine.sum(axis=0))
        assert np.allclose(r.vector, want)


def test_unseen_rows_by_slices_of_blocks_that_grow(spark, monkeypatch):
    monkeypatch.setattr(dense, "SLICE", 3)
    dealt, deal = [], dense._in_blocks
    monkeypatch.setattr(dense, "_in_blocks", lambda q, x, v, block: dealt.append(block) or deal(q, x, v, block))
    v = np.random.default_rng(5).normal(size=(40, 4)).round(1)
    seen = [[(7 * i + j) % 45 for j in range(i % 5)] for i in range(40)]
    queries = spark.createDataFrame([(i, x.tolist(), s) for i, (x, s) in enumerate(zip(v, seen, strict=True))], "id long, vector array<double>, seen array<long>")
    found = dense.dense_topk_unseen(queries, queries.select("id", "vector"), 4, 2).collect()
    assert dealt == [5]  # an eighth of the rows, not the 2 asked for
    scores = np.round(v @ v.T, 9)
    want = [(i, n + 1, j) for i in range(40) for n, (_, j) in enumerate(sorted((-scores[i, j], j) for j in range(40) if j not in seen[i])[:4])]
    assert sorted((r.query_id, r["rank"], r.id) for r in found) == want


def test_common_terms_meet_as_vectors(spark):
    rng = random.Random(10)
    side = lambda n: [(i, t, rng.randrange(1, 9) / 7) for i in range(n) for t in rng.sample("abcdef", rng.randrange(1, 4))]
    asks, docs = side(7), side(20)
    q, x = spark.createDataFrame(asks, "q long, term string, w double"), spark.createDataFrame(docs, "d long, term string, w double")
    terms = spark.createDataFrame([(t,) for t in "abcdef"], "term string")
    got = text.match_dense(q, "q", x, "d", terms, 4)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString()  # no pair of texts is a row
    want = text.match(q, "q", x, "d", 4)
    plain = lambda df: sorted((r.q, r["rank"], r.d, round(r.score, 9)) for r in df.collect())
    assert plain(got) == plain(want)


def test_unseen_rows_by_chunks_equal_all_products(spark, monkeypatch):
    rng = np.random.default_rng(8)
    monkeypatch.setattr(dense, "CHUNK", 16)
    for scale in (1.0, 1e20):
        q, x = np.round(rng.normal(size=(40, 5)), 1) * scale, np.round(rng.normal(size=(90, 5)), 1)
        x[45:] = x[:45]  # ties
        ids = rng.permutation(90) + 1000
        out = np.unique(rng.integers(0, 40 * 90, 300))
        scores = np.round(q @ x.T, 9)
        scores[out // 90, out % 90] = -np.inf
        row, found, score = dense._above(q, x, ids, 7, out // 90, out % 90)
        near = [np.lexsort((ids, -np.round(s / scale, 7)))[:7] for s in scores]
        if scale == 1.0:
            assert list(zip(row, found, strict=True)) == [(i, ids[j]) for i, n in enumerate(near) for j in n]
        assert np.allclose(score / scale, [scores[i, j] / scale for i, n in enumerate(near) for j in n])


def test_als_lists_meet_items_by_blocks(spark, monkeypatch):
    from pyspark.ml.recommendation import ALSModel

    from tessera.operators import learned

    rng = random.Random(5)
    data = {(u, rng.randrange(40)) for u in range(50) for _ in range(8)}
    held = []
    deal = dense._in_blocks
    monkeypatch.setattr(dense, "_in_blocks", lambda q, x, *a: held.append((q.collect(), x.collect())) or deal(q, x, *a))
    monkeypatch.delattr(ALSModel, "recommendForUserSubset")
    got = learned.als_lists(spark.createDataFrame(sorted(data), "row long, item long"), 3, rank=4).collect()
    (queries, items), = held
    want = []
    for r in queries:
        near = sorted((-round(float(np.dot(r.v.vector, i.v.vector)), 9), i.id) for i in items if (r.id, i.id) not in data)[:3]
        want += [(r.id, n + 1, i, -s) for n, (s, i) in enumerate(near)]
    assert sorted((r.row, r["rank"], r.item) for r in got) == sorted(w[:3] for w in want)
    assert np.allclose([r.score for r in sorted(got, key=lambda r: (r.row, r["rank"]))], [w[3] for w in sorted(want)], atol=2e-9)


def test_groups_of_rows_are_dealt_once_by_their_number(spark, monkeypatch):
    from tessera.operators import boosting, products
    from tessera.plans import fusion_queries

    monkeypatch.setattr(boosting, "ROWS", 50)
    rows = [(q, i, float(i == q % 7), float(i % 3)) for q in range(57) for i in range(7)]
    df = spark.createDataFrame(rows, "q long, item long, label double, score double")
    lines = boosting.packed(df, ["q"], "item", {"_y": F.col("label")})
    assert lines.rdd.getNumPartitions() == 8 and lines.count() == 57
    forest = boosting.fit_ranker(df, ["q"], "item", ["score"], rounds=1, depth=1, least_rows=5)
    assert {x.n for x in forest.trees[0]} <= {399, 114, 171, 228, 285}
    g = np.array([r.g for r in boosting.lambda_gradients(df, ["q"], "item").collect()])
    monkeypatch.setattr(boosting, "PAIRS", 10)
    size, y, s = np.full(57, 7), np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    assert np.allclose(sorted(boosting._pairwise(size, y, s)[0]), sorted(g), atol=1e-12)
    monkeypatch.setattr(products, "ROWS", 600)
    plan = fusion_queries._norm(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("hashpartitioning(user_id") == 1 and "hashpartitioning(user_id#" in plan and ", 10)" in plan


def test_texts_meet_terms_by_blocks_of_texts(spark, monkeypatch):
    rng = random.Random(11)
    monkeypatch.setattr(text, "LINES", 15)
    docs = spark.createDataFrame([(i % 27, " ".join(rng.choices("abcdefgh", k=rng.randrange(0, 9)))) for i in range(30)], "d int, t string")  # three ids twice
    asks = spark.createDataFrame([(i, " ".join(rng.sample("abcxyz", 3))) for i in range(6)], "q long, t string")
    posts, asked = text.postings(docs, "d", F.col("t")), text.postings(asks, "q", F.col("t")).withColumn("w", F.lit(1.0))
    n = docs.agg(F.count("*").alias("n"))
    some = text.postings(docs, "d", F.col("t"), terms=asked)
    weights = text.bm25_weights(some, "d", n, length=text.lengths(docs, "d", F.col("t")))
    got = text.match(asked, "q", weights, "d", 4)
    assert "Join" not in got._jdf.queryExecution().executedPlan().toString() and dict(got.dtypes)["d"] == "int"
    score = {}
    for r in asked.join(text.bm25_weights(posts, "d", n), "term").collect():
        score[r.q, r.d] = score.get((r.q, r.d), 0.0) + r[-1]
    near = {q: sorted((-round(s, 9), d) for (a, d), s in score.items() if a == q)[:4] for q in range(6)}
    assert sorted((r.q, r["rank"], r.d) for r in got.collect()) == [(q, i + 1, d) for q in range(6) for i, (_, d) in enumerate(near[q])]


def test_singular_vectors_keep_no_step(spark, monkeypatch):
    """A step sends each vector once a block, and is deleted once the next one stands; only the result stays."""
    monkeypatch.setattr(products, "LINES", 60)
    monkeypatch.setattr(factors, "PLACES", 3)
    rng = np.random.default_rng(8)
    a = rng.integers(0, 3, (50, 12)) * (rng.random((50, 12)) < 0.4) * 1.0
    rows = spark.createDataFrame([(int(i), f"i{j:02}", float(a[i, j])) for i, j in np.argwhere(a)], "row long, item string, value double")
    blocks = factors.row_blocks(rows)
    held = blocks.collect()
    assert len(held) > 2 and all(len(set(b["items"])) == len(b["items"]) for b in held) and sum(len(b["at"]) for b in held) == int((a > 0).sum())
    x, y = rng.random((12, 4)), rng.random((12, 4))
    start = spark.createDataFrame([(f"i{j:02}", x[j].tolist(), y[j].tolist()) for j in range(12)], "item string, a array<double>, b array<double>")
    got = factors.step(blocks, factors._turned(start, np.eye(4)), 4, 2.0, -0.5, 3.0).orderBy("item").collect()
    assert np.allclose([np.frombuffer(r.a) for r in got], y) and np.allclose([np.frombuffer(r.b) for r in got], 2 * a.T @ (a @ y) - 0.5 * y + 3 * x)
    before = set(os.listdir(stored.session_dir(spark).removeprefix("file://")))
    vectors, values = factors.singular_vectors(rows, 2, extra=2)
    left = [n.split("-")[0] for n in set(os.listdir(stored.session_dir(spark).removeprefix("file://"))) - before]
    assert np.allclose(values, np.linalg.svd(a)[1][:2]) and vectors.count() == 12
    assert left.count("block") <= 1 and left.count("blocks") == 0


def test_shuffles_go_once_a_table_is_stored(spark):
    assert spark.conf.get(stored.CLEANUP, None) != "true"
    with stored.shuffles_dropped(spark):
        assert spark.conf.get(stored.CLEANUP) == "true"
    assert spark.conf.get(stored.CLEANUP, None) != "true"
    df = stored.stored(spark.range(100).repartition(3), "some")
    path = df._stored_at.removeprefix("file://")
    assert df.count() == 100 and os.path.isdir(path)
    stored.dropped(df, None, df.where("id > 3"))
    assert not os.path.exists(path)


def test_launcher_terms_meet_in_one_exchange(spark):
    pool = spark.createDataFrame([(1, 10, 2.0), (1, 11, 1.0), (1, 12, 4.0), (2, 10, 1.0)], "s long, track_id long, base double")
    signal = spark.createDataFrame([(1, 10, 3.0), (1, 12, 1.0), (1, 99, 50.0), (2, 10, 7.0)], "s long, track_id long, value double")
    flag = spark.createDataFrame([(1, 11), (1, 11), (3, 10)], "s long, track_id long")
    got = calibration.launcher_scores(pool, {"a": (signal, 0.5)}, {"b": (flag, 0.25, True), "c": (flag, -0.5, False)}, ["s"], 2)
    assert sorted(map(tuple, got.select("s", "track_id", "base", "a", "b", "c", "score", "rank").collect())) == [
        (1, 10, 2.0, 0.5, 0.0, 0.0, 2.5, 2), (1, 12, 4.0, 0.5 / 3, 0.0, 0.0, 4 + 0.5 / 3, 1), (2, 10, 1.0, 0.0, 0.0, 0.0, 1.0, 1),
    ]
    assert joins(got) == [] and got._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
