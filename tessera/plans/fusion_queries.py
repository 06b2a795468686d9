"""Queries of fusion, calibration and features over customers' candidate lists, and the SQL for them.

A customer's lists (three generators, ten tracks each): by price, by quantity and by recency of the lines.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import features as X
from tessera.operators import fusion, metrics
from tessera.operators.products import spread
from tessera.operators.ranking import as_list, fill_short, graft_first, rank_average, topk_per_group
from tessera.plans.sql import CONTEXT, INTER, TRACKS, with_
from tessera.sources import tables as T

QUERIES, SQL = {}, {}
CGS = ["price", "quantity", "recent"]


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


BASE = """lines AS (SELECT o_custkey AS user_id, l_partkey AS track_id, sum(l_extendedprice) AS price, sum(l_quantity) AS quantity, max(epoch(l_shipdate) / 86400)::DOUBLE AS recent
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2),
long AS (SELECT user_id, 'price' AS cg, track_id, round(price, 2) AS score FROM lines UNION ALL SELECT user_id, 'quantity', track_id, quantity FROM lines UNION ALL SELECT user_id, 'recent', track_id, recent FROM lines),
pool AS (SELECT *, row_number() OVER (PARTITION BY user_id, cg ORDER BY score DESC, track_id) AS rank FROM long QUALIFY rank <= 10),
norm AS (SELECT *, (score - min(score) OVER w) / nullif(max(score) OVER w - min(score) OVER w, 0) AS mm, (score - avg(score) OVER w) / nullif(stddev_samp(score) OVER w, 0) AS z FROM pool WINDOW w AS (PARTITION BY user_id, cg))"""


def _pool(spark, d):
    lines, orders = T.table(spark, d, "lineitem"), T.table(spark, d, "orders")
    of_user = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("track_id"), "l_extendedprice", "l_quantity", "l_shipdate")
    # dealt by user once: sums, lists, normalisation and what is joined by user follow in place, a bounded number of lines a task
    rows = spread(of_user, "user_id", lines.count()).groupBy("user_id", "track_id")
    rows = rows.agg(F.round(F.sum("l_extendedprice"), 2).alias("price"), F.sum("l_quantity").alias("quantity"), F.max(F.unix_timestamp("l_shipdate") / 86400).alias("recent"))
    long = rows.select("user_id", "track_id", F.inline(F.array(*[F.struct(F.lit(c).alias("cg"), F.col(c).alias("score")) for c in CGS])))
    return topk_per_group(long, ["user_id", "cg"], [F.col("score").desc(), F.col("track_id")], 10)


def _norm(spark, d):
    return fusion.normalised(_pool(spark, d), ["user_id"])


@_query("wide_to_long_normalised", with_(BASE, body="SELECT user_id, cg, track_id, rank, round(score, 4) AS score, round(1.0::DOUBLE / rank, 6) AS reciprocal_rank, round(z, 6) AS score_z, round(mm, 6) AS score_minmax FROM norm"))
def wide_to_long_normalised(spark, d):
    pool = _pool(spark, d)
    lists = pool.groupBy("user_id", "cg").agg(F.array_sort(F.collect_list(F.struct("rank", "track_id", "score"))).alias("l"))
    wide = lists.select("user_id", "cg", F.transform("l", lambda x: x["track_id"]).alias("track_ids"), F.transform("l", lambda x: x["score"]).alias("scores"))
    long = None
    for cg in CGS:
        one = fusion.explode_lists(wide.where(F.col("cg") == cg), ["user_id"], "track_ids", "scores", cg, 10)
        long = one if long is None else long.unionByName(one)
    out = fusion.normalised(long, ["user_id"]).withColumn("score", F.round("score", 4))
    return _six(out, "reciprocal_rank", "score_z", "score_minmax")


@_query("pool_union", with_(BASE, body="SELECT user_id, track_id, " + ", ".join(f"max(CASE WHEN cg = '{c}' THEN rank END) AS rank_{c}, round(max(CASE WHEN cg = '{c}' THEN score END), 4) AS score_{c}" for c in CGS) + " FROM pool GROUP BY 1, 2"))
def pool_union(spark, d):
    out = fusion.union_wide(_pool(spark, d), ["user_id"], CGS)
    return out.withColumns({f"score_{c}": F.round(f"score_{c}", 4) for c in CGS})


FUSED = """fused AS (SELECT user_id, track_id, sum(201 - rank)::BIGINT AS borda, sum(1 / (rank + 60)) AS rrf60, sum(1 / (rank + 5)) AS rrf5, sum(coalesce(mm, 0)) AS combsum, sum(coalesce(mm, 0)) * count(*) AS combmnz,
  count(*) AS n_retrieving, sum(1 / (rank * rank)) AS isr, sum(1 / log2(rank + 1)) AS logrank, -(sum(ln(rank)) + (3 - count(*)) * ln(200)) / 3 AS rank_product_200, -(sum(ln(rank)) + (3 - count(*)) * ln(1000)) / 3 AS rank_product_1000,
  min(rank) AS min_rank, max(rank) AS max_rank, median(rank) AS median_rank, stddev_samp(rank) AS std_rank, count(*) FILTER (rank <= 10) AS agreement10, count(*) FILTER (rank <= 50) AS agreement50 FROM norm GROUP BY 1, 2)"""
FLOATS = ["rrf60", "rrf5", "combsum", "combmnz", "isr", "logrank", "rank_product_200", "rank_product_1000", "median_rank", "std_rank"]


@_query("fusion_features", with_(BASE, FUSED, body="SELECT user_id, track_id, borda, n_retrieving, min_rank, max_rank, agreement10, agreement50, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in FLOATS) + " FROM fused"))
def fusion_features(spark, d):
    return _six(fusion.fusion_features(_norm(spark, d), ["user_id"], 3), *FLOATS)


WEIGHTS = [("price", "early", 2.0), ("quantity", "early", 0.5), ("price", "late", 0.25), ("recent", "late", 3.0)]


@_query("weighted_rrf_topk", with_(BASE, "w(cg, bucket, weight) AS (VALUES " + ", ".join(f"('{a}', '{b}', {c}::DOUBLE)" for a, b, c in WEIGHTS) + ")",
    "b AS (SELECT *, CASE WHEN user_id % 8 <= 2 THEN 'early' WHEN user_id % 8 <= 5 THEN 'middle' ELSE 'late' END AS bucket FROM pool)",
    "s AS (SELECT user_id, track_id, sum(coalesce(weight, 1) / (rank + 46)) AS score FROM b LEFT JOIN w ON w.cg = b.cg AND w.bucket = b.bucket GROUP BY 1, 2)",
    body="SELECT user_id, track_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, track_id) AS rank FROM s QUALIFY rank <= 20"))
def weighted_rrf_topk(spark, d):
    pool = _pool(spark, d).withColumn("bucket", fusion.turn_bucket(F.col("user_id") % 8))
    weights = spark.createDataFrame(WEIGHTS, "cg string, bucket string, weight double")
    return _six(fusion.weighted_rrf(pool, weights, ["user_id"], "bucket", 46, 20), "score")


GT = "g AS (SELECT user_id, track_id AS gt FROM lines QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY recent, track_id) = 1)"


def _gt(spark, d):
    lines, orders = T.table(spark, d, "lineitem"), T.table(spark, d, "orders")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("track_id")).agg(F.max(F.unix_timestamp("l_shipdate") / 86400).alias("recent"))
    return topk_per_group(rows, ["user_id"], [F.col("recent"), F.col("track_id")], 1).select("user_id", F.col("track_id").alias("gt"))


@_query("fused_truncate_keep_gt", with_(BASE, FUSED, GT, body="""SELECT user_id, track_id, round(rrf60, 6) AS rrf60, rank, is_gt FROM (
  SELECT f.user_id, f.track_id, rrf60, coalesce(f.track_id = gt, false) AS is_gt, row_number() OVER (PARTITION BY f.user_id ORDER BY round(rrf60, 9) DESC, f.track_id) AS rank FROM fused f LEFT JOIN g USING (user_id)) WHERE rank <= 8 OR is_gt"""))
def fused_truncate_keep_gt(spark, d):
    fused = fusion.fusion_features(_norm(spark, d), ["user_id"], 3).join(_gt(spark, d), "user_id", "left")
    fused = fused.withColumn("is_gt", F.coalesce(F.col("track_id") == F.col("gt"), F.lit(False)))
    out = fusion.truncate_keep(fused, ["user_id"], "rrf60", 8, F.col("is_gt"))
    return _six(out.select("user_id", "track_id", "rrf60", "rank", "is_gt"), "rrf60")


@_query("shortfall_fill", with_(BASE, """m AS (SELECT user_id, track_id, rank, 0 AS source FROM pool WHERE cg = 'price' AND rank <= 3 UNION ALL SELECT user_id, track_id, rank, 1 FROM pool WHERE cg = 'recent'),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id, track_id ORDER BY source, rank) = 1)""",
    body="SELECT user_id, track_id, source, row_number() OVER (PARTITION BY user_id ORDER BY source, rank, track_id) AS rank FROM f QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY source, f.rank, track_id) <= 8"))
def shortfall_fill(spark, d):
    pool = _pool(spark, d)
    return fill_short(pool.where("cg = 'price' and rank <= 3"), pool.where("cg = 'recent'"), ["user_id"], "track_id", 8)


@_query("top1_graft", with_(BASE, "l AS (SELECT user_id, cg, list(track_id ORDER BY rank) AS t FROM pool GROUP BY 1, 2)",
    """a AS (SELECT x.user_id, list_concat(list_concat(x.t[1:1], y.t), x.t) AS c FROM l x JOIN l y USING (user_id) WHERE x.cg = 'price' AND y.cg = 'quantity'),
e AS (SELECT user_id, t, min(i) AS i FROM (SELECT user_id, unnest(c) AS t, generate_subscripts(c, 1) AS i FROM a) GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i) AS k FROM e QUALIFY k <= 10)""",
    body="SELECT user_id, string_agg(t, ',' ORDER BY k) AS track_ids FROM r GROUP BY 1"))
def top1_graft(spark, d):
    pool = _pool(spark, d)
    a = as_list(pool.where("cg = 'price'"), ["user_id"], "track_id", name="a")
    b = as_list(pool.where("cg = 'quantity'"), ["user_id"], "track_id", name="b")
    return a.join(b, "user_id").select("user_id", F.concat_ws(",", graft_first(F.col("a"), F.col("b"), 10).cast("array<string>")).alias("track_ids"))


@_query("cg_family_consensus", with_(BASE, "c AS (SELECT user_id, track_id, count(*) FILTER (cg <> 'recent') AS n_value, count(*) FILTER (cg = 'recent') AS n_time, avg(rank) FILTER (cg <> 'recent') AS mv, avg(rank) FILTER (cg = 'recent') AS mt, count(*) FILTER (rank = 1) AS n_first FROM pool GROUP BY 1, 2)",
    body="SELECT user_id, track_id, n_value, n_time, round(mv, 6) AS mean_rank_value, round(mt, 6) AS mean_rank_time, n_first, n_time = 0 AS only_value, n_value = 0 AS only_time, round(greatest(mv, mt) - least(mv, mt), 6) AS disagreement FROM c"))
def cg_family_consensus(spark, d):
    families = spark.createDataFrame([("price", "value"), ("quantity", "value"), ("recent", "time")], "cg string, family string")
    return _six(fusion.family_consensus(_pool(spark, d), families, ["user_id"], ["value", "time"]), "mean_rank_value", "mean_rank_time", "disagreement")


@_query("rank_average_bagging", with_(BASE, """a AS (SELECT user_id, track_id, count(*) AS n, -avg(r) AS s FROM (SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id, cg ORDER BY score DESC, track_id) AS r FROM pool WHERE cg <> 'recent') GROUP BY 1, 2)""",
    body="SELECT user_id, track_id, round(s, 6) AS score FROM a WHERE n = 2"))
def rank_average_bagging(spark, d):
    pool = _pool(spark, d)
    return _six(rank_average([pool.where(F.col("cg") == c) for c in ("price", "quantity")], ["user_id"], "track_id"), "score")


CONF = """hit AS (SELECT cg, 1 - 1.0::DOUBLE / rank AS nc FROM pool JOIN g ON g.user_id = pool.user_id AND gt = track_id),
q AS (SELECT cg, nc AS q, n FROM (SELECT *, count(*) OVER (PARTITION BY cg) AS n, row_number() OVER (PARTITION BY cg ORDER BY nc) - 1 AS r FROM hit) WHERE r = least(n - 1, ceil((n + 1) * 0.6::DOUBLE) - 1))"""


def _quantiles(spark, d, pool):
    hits = pool.join(_gt(spark, d).select("user_id", F.col("gt").alias("track_id")), ["user_id", "track_id"]).select("cg", (1 - 1 / F.col("rank")).alias("nc"))
    return metrics.conformal_quantile(hits, ["cg"], "nc", 0.4)


@_query("conformal_quantile", with_(BASE, GT, CONF, body="SELECT cg, round(q, 6) AS q, n FROM q"))
def conformal_quantile(spark, d):
    return _six(_quantiles(spark, d, _pool(spark, d)), "q")


@_query("conformal_set_sizes", with_(BASE, GT, CONF, body="SELECT user_id, count(*) FILTER (1 - 1.0::DOUBLE / rank <= coalesce(q, 'inf'::DOUBLE)) AS set_size FROM pool LEFT JOIN q USING (cg) GROUP BY 1"))
def conformal_set_sizes(spark, d):
    pool = _pool(spark, d)
    return fusion.conformal_sets(pool, ["user_id"], "cg", _quantiles(spark, d, pool), 1 - 1 / F.col("rank"))


@_query("isotonic_calibration", with_(BASE, GT, """y AS (SELECT cg, rank, (gt = track_id)::INT AS y FROM pool JOIN g USING (user_id)),
p AS (SELECT cg, -rank AS x, count(*) AS n, sum(y) AS s FROM y GROUP BY 1, 2),
runs AS (SELECT a.cg, a.x AS a, b.x AS b, sum(m.s) / sum(m.n) AS mean FROM p a JOIN p b ON a.cg = b.cg AND a.x <= b.x JOIN p m ON m.cg = a.cg AND m.x BETWEEN a.x AND b.x GROUP BY 1, 2, 3),
lo AS (SELECT cg, a, x.x AS x, min(mean) AS l FROM runs JOIN (SELECT DISTINCT cg AS c, x FROM p) x ON c = cg AND a <= x.x AND b >= x.x GROUP BY 1, 2, 3)""", body="SELECT cg, x, round(max(l), 6) AS y_hat FROM lo GROUP BY 1, 2"))
def isotonic_calibration(spark, d):
    labelled = _pool(spark, d).join(_gt(spark, d), "user_id").select("cg", (-F.col("rank")).alias("x"), (F.col("gt") == F.col("track_id")).cast("int").alias("y"))
    return _six(fusion.isotonic_steps(labelled, ["cg"], "x", "y"), "y_hat")


@_query("track_stats", with_(INTER, TRACKS, """c AS (SELECT track_id, count(*) AS plays FROM inter GROUP BY 1), t AS (SELECT tracks.*, coalesce(plays, 0) AS plays FROM tracks LEFT JOIN c USING (track_id)),
r AS (SELECT *, rank() OVER (ORDER BY popularity) + (count(*) OVER (PARTITION BY popularity) - 1) / 2 AS ar FROM t),
s AS (SELECT avg(popularity) AS m, stddev_samp(popularity) AS s, quantile_cont(popularity, 1.0 / 3) AS q1, quantile_cont(popularity, 2.0 / 3) AS q2 FROM t WHERE popularity > 0)""",
    body="""SELECT track_id, plays, sum(plays) OVER (PARTITION BY artist)::BIGINT AS artist_plays, sum(plays) OVER (PARTITION BY album)::BIGINT AS album_plays, round(ar / max(ar) OVER (), 6) AS popularity_pct,
  round((popularity - m) / s, 6) AS popularity_z, CAST(CASE WHEN popularity > 0 THEN CASE WHEN popularity <= q1 THEN 0 WHEN popularity <= q2 THEN 1 ELSE 2 END ELSE -1 END AS BIGINT) AS popularity_bucket FROM r, s"""))  # fmt: skip
def track_stats(spark, d):
    return _six(X.track_stats(T.interactions(spark, d), T.tracks(spark, d)), "popularity_pct", "popularity_z")


SF = ["mean_pop", "std_pop", "mean_year", "std_year", "undated_share"]


@_query("session_turn_features", with_(INTER, CONTEXT, TRACKS, """j AS (SELECT session_id, turn, t.* FROM ctx LEFT JOIN tracks t USING (track_id)),
n AS (SELECT session_id, count(DISTINCT tag) AS n_tags FROM (SELECT session_id, unnest(tags) AS tag FROM j) GROUP BY 1)""", body="""SELECT session_id, count(*) AS length, count(DISTINCT artist) AS n_artists, max(popularity) AS max_pop, sum(duration)::BIGINT AS total_duration,
  bool_and(year IS NULL) AS all_undated, coalesce(any_value(n_tags), 0) AS n_tags, round(avg(popularity), 6) AS mean_pop, round(stddev_samp(popularity), 6) AS std_pop, round(avg(year), 6) AS mean_year, round(stddev_samp(year), 6) AS std_year,
  round(avg((year IS NULL)::INT), 6) AS undated_share FROM j LEFT JOIN n USING (session_id) GROUP BY 1"""))
def session_turn_features(spark, d):
    return _six(X.session_features(T.context(T.interactions(spark, d)), T.tracks(spark, d)), *SF)


@_query("last_turn_dynamics", with_(INTER, TRACKS, "r AS (SELECT session_id, turn, t.* FROM inter JOIN tracks t USING (track_id))", body="""SELECT a.session_id, a.turn, a.track_id, a.artist = b.artist AS same_artist, a.album = b.album AS same_album, round(a.popularity - b.popularity, 4) AS pop_change,
  abs(a.year - b.year) AS year_gap, a.duration - b.duration AS duration_change FROM r a LEFT JOIN r b ON a.session_id = b.session_id AND a.turn = b.turn + 1"""))
def last_turn_dynamics(spark, d):
    return X.last_turn_dynamics(T.interactions(spark, d), T.tracks(spark, d)).withColumn("pop_change", F.round("pop_change", 4))


@_query("overlap_features", with_(INTER, TRACKS, """b AS (SELECT c.session_id, c.turn, h.track_id AS h FROM inter c JOIN inter h ON c.session_id = h.session_id AND h.turn < c.turn),
j AS (SELECT b.session_id, b.turn, t.* FROM b JOIN tracks t ON t.track_id = h),
s AS (SELECT session_id, turn, count(*) AS n, avg(popularity) AS m, stddev_samp(popularity) AS s, list_distinct(flatten(list(tags))) AS tags FROM j GROUP BY 1, 2),
ar AS (SELECT session_id, turn, artist, count(*) AS a FROM j GROUP BY 1, 2, 3), al AS (SELECT session_id, turn, album, count(*) AS a FROM j GROUP BY 1, 2, 3)""", body="""SELECT c.session_id, c.turn, c.track_id, coalesce(ar.a, 0) AS artist_count, coalesce(al.a, 0) AS album_count,
  round(coalesce(ar.a, 0) / (coalesce(n, 0) + 1), 6) AS artist_share, coalesce(al.a, 0) > 0 AS album_seen, len(list_intersect(t.tags, coalesce(s.tags, []))) AS tags_known,
  len(t.tags) - len(list_intersect(t.tags, coalesce(s.tags, []))) AS tags_new, round((t.popularity - m) / (s + 1e-6), 6) + 0.0 AS session_pop_z
  FROM inter c JOIN tracks t USING (track_id) LEFT JOIN s ON s.session_id = c.session_id AND s.turn = c.turn LEFT JOIN ar ON ar.session_id = c.session_id AND ar.turn = c.turn AND ar.artist = t.artist
  LEFT JOIN al ON al.session_id = c.session_id AND al.turn = c.turn AND al.album = t.album"""))
def overlap_features(spark, d):
    inter = T.interactions(spark, d)
    return _six(X.overlap(inter.select("session_id", "turn", "track_id"), inter, T.tracks(spark, d)), "artist_share", "session_pop_z")


@_query("goal_one_hot", """SELECT o_orderkey AS session_id, substr(o_orderpriority, 1, 1) AS category, o_orderstatus AS specificity, """ + ", ".join(f"(substr(o_orderpriority, 1, 1) = '{v}')::BIGINT AS category_{v}" for v in "12345") + ", " + ", ".join(f"(o_orderstatus = '{v}')::BIGINT AS specificity_{v}" for v in "FOP") + " FROM orders")
def goal_one_hot(spark, d):
    s = T.sessions(spark, d).select("session_id", "category", "specificity")
    return X.one_hot(X.one_hot(s, "category", list("12345")), "specificity", list("FOP"))


@_query("text_mention_features", """SELECT p_partkey, contains(t, lower(p_type)) AS mentions_type, contains(t, split_part(p_name, ' ', 2)) AS mentions_noun, length(t) AS text_chars, len(string_split(t, ' ')) AS text_words
FROM (SELECT *, lower(p_name || ' by ' || CASE p_partkey % 3 WHEN 0 THEN p_type WHEN 1 THEN p_brand ELSE 'Nobody?' END) AS t FROM part)""")
def text_mention_features(spark, d):
    kind = F.when(F.col("p_partkey") % 3 == 0, F.col("p_type")).when(F.col("p_partkey") % 3 == 1, F.col("p_brand")).otherwise("Nobody?")
    part = T.table(spark, d, "part").withColumns({"query": F.concat(F.col("p_name"), F.lit(" by "), kind), "noun": F.split("p_name", " ")[1]})
    return X.mentions(part, "query", {"type": "p_type", "noun": "noun"}).select("p_partkey", "mentions_type", "mentions_noun", "text_chars", "text_words")


CF = ["rrf60_of_max", "rrf60_z", "product"]


@_query("cross_feature_windows", with_(BASE, FUSED, """r AS (SELECT user_id, track_id, round(rrf60, 9) AS x, round(combsum, 9) AS y FROM fused),
k AS (SELECT *, rank() OVER (PARTITION BY user_id ORDER BY x DESC) + (count(*) OVER (PARTITION BY user_id, x) - 1) / 2 AS rx, rank() OVER (PARTITION BY user_id ORDER BY y DESC) + (count(*) OVER (PARTITION BY user_id, y) - 1) / 2 AS ry FROM r)""",
    body="""SELECT user_id, track_id, round(x / (max(x) OVER w + 1e-9), 6) AS rrf60_of_max, round(max(x) OVER w - x, 9) AS rrf60_gap, round((x - avg(x) OVER w) / nullif(stddev_samp(x) OVER w, 0), 6) + 0.0 AS rrf60_z,
  rx AS rrf60_rank, ry AS combsum_rank, abs(rx - ry) AS rank_spread, round(x * y, 6) AS product, round(x + y, 9) AS total FROM k WINDOW w AS (PARTITION BY user_id)"""))  # fmt: skip
def cross_feature_windows(spark, d):
    fused = fusion.fusion_features(_norm(spark, d), ["user_id"], 3).select("user_id", "track_id", F.round("rrf60", 9).alias("rrf60"), F.round("combsum", 9).alias("combsum"))
    out = X.cross_features(fused, ["user_id"], "rrf60", "combsum").drop("rrf60", "combsum")
    return _six(out, *CF).withColumns({c: F.round(c, 9) for c in ("rrf60_gap", "total")})  # differences of 9-digit numbers


@_query("undated_catalogue_ranks", with_(BASE, TRACKS, FUSED, "r AS (SELECT user_id, track_id, borda, year IS NULL AS u FROM fused JOIN tracks USING (track_id))",
    "k AS (SELECT *, rank() OVER (PARTITION BY user_id, u ORDER BY borda DESC) + (count(*) OVER (PARTITION BY user_id, u, borda) - 1) / 2 AS ar FROM r)",
    body="SELECT user_id, track_id, borda, round(avg(u::INT) OVER (PARTITION BY user_id), 6) AS undated_share, CASE WHEN u THEN ar END AS rank_undated, CASE WHEN NOT u THEN ar END AS rank_dated FROM k"))
def undated_catalogue_ranks(spark, d):
    fused = fusion.fusion_features(_norm(spark, d), ["user_id"], 3).join(T.tracks(spark, d).select("track_id", "year"), "track_id").select("user_id", "track_id", "borda", "year")
    return _six(X.undated(fused, ["user_id"], "borda").drop("year"), "undated_share")


@_query("session_track_block", with_(INTER, CONTEXT, TRACKS, """j AS (SELECT session_id, t.* FROM ctx JOIN tracks t USING (track_id)),
g AS (SELECT session_id, tag, count(*) AS n FROM (SELECT session_id, unnest(tags) AS tag FROM j) GROUP BY 1, 2), p AS (SELECT *, n / sum(n) OVER (PARTITION BY session_id) AS p FROM g),
e AS (SELECT session_id, -sum(p * log2(p)) AS h, arg_min(tag, (-n, tag)) AS top_tag FROM p GROUP BY 1)""", body="""SELECT session_id, count(*) AS n_prior, count(DISTINCT artist) AS n_artists, count(DISTINCT album) AS n_albums, round(stddev_pop(popularity), 6) AS std_pop,
  round(stddev_pop(duration), 6) AS std_duration, round(any_value(h), 6) AS tag_entropy, any_value(top_tag) AS top_tag FROM j LEFT JOIN e USING (session_id) GROUP BY 1"""))
def session_track_block(spark, d):
    return _six(X.session_track_block(T.context(T.interactions(spark, d)), T.tracks(spark, d)), "std_pop", "std_duration", "tag_entropy")
