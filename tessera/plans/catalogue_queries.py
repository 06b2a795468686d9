"""Queries of catalogue helpers, merges and fitted models, and the SQL for them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import catalogue as C
from tessera.operators import collaborative as cf
from tessera.operators import fusion, learned
from tessera.operators.ranking import topk_per_group
from tessera.plans import fusion_queries as FQ
from tessera.plans.collaborative_queries import PAIRS, ROWS
from tessera.plans.sql import INTER, LIFT, SESSIONS, TRACKS, with_
from tessera.sources import tables as T
from tessera.sources.stored import stored

QUERIES, SQL = {}, {}


def _query(name: str, sql: str = ""):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


@_query("cleaned_track_profile", """SELECT p_partkey AS track_id, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i)[1:10], ',') AS tags, CASE WHEN length(b) >= 7 THEN substr(b, 1, 5) END AS registrant FROM (
  SELECT p_partkey, list_filter([lower(trim(p_type))] || string_split(lower(p_name), ' '), lambda x: length(x) >= 2 AND x NOT IN ('red', 'standard')) AS t, regexp_replace(upper(p_brand), '[^A-Z0-9]', '', 'g') AS b FROM part)""")
def cleaned_track_profile(spark, d):
    part = T.table(spark, d, "part")
    tags = C.clean_tags(F.concat(F.array(F.concat(F.lit(" "), F.col("p_type"))), F.split("p_name", " ")), ["red", "standard"])
    return part.select(F.col("p_partkey").alias("track_id"), F.concat_ws(",", tags).alias("tags"), C.registrant(F.col("p_brand")).alias("registrant"))


@_query("rare_tag_sets", with_(TRACKS, "e AS (SELECT DISTINCT track_id, unnest(tags) AS tag FROM tracks)", "r AS (SELECT tag FROM e GROUP BY 1 HAVING count(*) <= (SELECT count(*) // 8 FROM part))", "h AS (SELECT track_id, string_agg(tag, ',' ORDER BY tag) AS rare FROM e SEMI JOIN r USING (tag) GROUP BY 1)",
    body="SELECT track_id, coalesce(rare, '') AS rare FROM tracks LEFT JOIN h USING (track_id)"))
def rare_tag_sets(spark, d):
    tracks = T.tracks(spark, d)
    return C.rare_tags(tracks, "track_id", "tags", tracks.count() // 8)


@_query("ordered_sequences", with_(INTER, body="SELECT session_id, string_agg(track_id, ',' ORDER BY turn) AS items FROM inter GROUP BY 1 HAVING count(*) >= 2"))
def ordered_sequences(spark, d):
    return C.sequences(T.interactions(spark, d)).select("session_id", F.concat_ws(",", F.col("items").cast("array<string>")).alias("items"))


@_query("external_merge", with_(FQ.BASE, """m AS (SELECT user_id, track_id, 0 AS source, 0 AS r FROM pool WHERE cg = 'price' AND rank <= 5 UNION ALL SELECT user_id, track_id, 1, rank FROM pool WHERE cg = 'quantity' AND rank <= 8 UNION ALL SELECT user_id, track_id, 2, rank FROM pool WHERE cg = 'recent' AND rank <= 8),
f AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY user_id, track_id ORDER BY source, r) = 1)""", body="SELECT user_id, track_id, source FROM f QUALIFY source = 0 OR row_number() OVER (PARTITION BY user_id, source ORDER BY r, track_id) <= 3"))
def external_merge(spark, d):
    pool = FQ._pool(spark, d)
    part = lambda cg: pool.where(F.col("cg") == cg)
    return C.merge_external(part("price").where("rank <= 5"), [part("quantity"), part("recent")], ["user_id"], "track_id", 8, 3)


def _lift(spark, d):
    plays = T.interactions(spark, d).join(T.tracks(spark, d), "track_id").select("session_id", F.explode("tags").alias("tag")).join(T.sessions(spark, d), "session_id")
    return C.category_lift(plays, "category", "tag")


@_query("category_lift", with_(INTER, TRACKS, SESSIONS, LIFT, body="SELECT category, tag, round(lift, 6) AS lift FROM lift"))
def category_lift(spark, d):
    return _lift(spark, d).withColumn("lift", F.round("lift", 6))


@_query("category_lift_pool", with_(INTER, TRACKS, SESSIONS, LIFT, "s AS (SELECT category, track_id, sum(lift) AS score FROM (SELECT track_id, unnest(tags) AS tag FROM tracks) JOIN lift USING (tag) GROUP BY 1, 2)",
    body="SELECT category, track_id, round(score, 6) AS score, row_number() OVER (PARTITION BY category ORDER BY round(score, 9) DESC, track_id) AS rank FROM s QUALIFY rank <= 20"))
def category_lift_pool(spark, d):
    each = T.tracks(spark, d).select("track_id", F.explode("tags").alias("tag"))
    scored = each.join(_lift(spark, d), "tag").groupBy("category", "track_id").agg(F.sum("lift").alias("score"))
    return topk_per_group(scored, ["category"], [F.round("score", 9).desc(), F.col("track_id")], 20).withColumn("score", F.round("score", 6))


@_query("covariate_buckets", with_(INTER, TRACKS, "z AS (SELECT artist, count(*) AS z FROM tracks GROUP BY 1)", "s AS (SELECT session_id, user_id, min_by(z, turn) AS z, count(DISTINCT artist) AS a, bool_or(year IS NOT NULL) AS year_known FROM inter JOIN tracks USING (track_id) JOIN z USING (artist) GROUP BY 1, 2)",
    "o AS (SELECT *, count(*) OVER (PARTITION BY user_id) - 1 AS o FROM s)", body="SELECT session_id, CASE WHEN z <= 75 THEN 'low' WHEN z <= 85 THEN 'mid' ELSE 'high' END AS catalogue, CASE WHEN o <= 5 THEN 'low' WHEN o <= 12 THEN 'mid' ELSE 'high' END AS others, CASE WHEN a = 1 THEN 'mono' ELSE 'multi' END AS artists, year_known FROM o"))
def covariate_buckets(spark, d):
    return C.covariates(T.interactions(spark, d), T.tracks(spark, d), (75, 85), (5, 12))


@_query("tie_aware_rank", with_(FQ.BASE, FQ.GT, "m AS (SELECT user_id, quantity AS g FROM lines JOIN g ON g.user_id = lines.user_id AND gt = track_id)", body="SELECT user_id, count(*) FILTER (quantity > g) + 1 AS gt_rank FROM lines JOIN m USING (user_id) GROUP BY 1").replace("SELECT user_id, quantity AS g FROM lines", "SELECT lines.user_id, quantity AS g FROM lines"))
def tie_aware_rank(spark, d):
    lines, orders = T.table(spark, d, "lineitem"), T.table(spark, d, "orders")
    scored = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy(F.col("o_custkey").alias("user_id"), F.col("l_partkey").alias("track_id")).agg(F.sum("l_quantity").alias("quantity"))
    scored = scored.join(FQ._gt(spark, d), "user_id")
    return C.tie_aware_ranks(scored, ["user_id"], "quantity", F.col("gt") == F.col("track_id"))


@_query("temporal_split", with_(INTER, "l AS (SELECT user_id, max(session_date) AS last_date FROM inter GROUP BY 1), c AS (SELECT quantile_cont(last_date - DATE '1970-01-01', 0.8::DOUBLE) AS c FROM l)", body="SELECT user_id, CAST(last_date AS VARCHAR) AS last_date, CASE WHEN last_date - DATE '1970-01-01' > c THEN 'test' ELSE 'train' END AS side FROM l, c"))
def temporal_split(spark, d):
    return C.temporal_split(T.interactions(spark, d), 0.2).withColumn("last_date", F.col("last_date").cast("string"))


@_query("co_listen_enrichment", with_(ROWS, PAIRS, TRACKS, "n AS (SELECT i, j, row_number() OVER (PARTITION BY i ORDER BY n DESC, j) AS rank FROM pairs QUALIFY rank <= 3), a AS (SELECT i, string_agg(artist, ' ' ORDER BY rank, artist) AS near FROM n JOIN tracks ON track_id = j GROUP BY 1)",
    body="SELECT track_id, concat_ws(' ', artist, near) AS text FROM tracks LEFT JOIN a ON i = track_id"))
def co_listen_enrichment(spark, d):
    near = topk_per_group(cf.cooccurrence(cf.binary(T.interactions(spark, d))), ["i"], [F.col("n").desc(), F.col("j")], 3)
    return C.enriched(T.tracks(spark, d), near, 3)


@_query("turn_one_fallback", with_(INTER, TRACKS, "o AS (SELECT track_id, row_number() OVER (ORDER BY CASE year // 10 * 10 WHEN 2010 THEN 0 WHEN 2000 THEN 1 WHEN 1990 THEN 2 WHEN 2020 THEN 3 WHEN 1980 THEN 4 WHEN 1970 THEN 5 ELSE 6 END, popularity DESC NULLS LAST, track_id) AS place FROM tracks)",
    "x AS (SELECT DISTINCT user_id, track_id FROM inter), n AS (SELECT c_custkey AS user_id, count(track_id) AS e FROM customer LEFT JOIN x ON user_id = c_custkey GROUP BY 1)",
    body="SELECT user_id, track_id, row_number() OVER (PARTITION BY user_id ORDER BY place) AS position FROM n JOIN o ON place <= 20 + e ANTI JOIN x USING (user_id, track_id) QUALIFY position <= 20"))
def turn_one_fallback(spark, d):
    """A list for every customer's next first turn: six decades in order, then all tracks, without what the customer has played."""
    users = T.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"))
    return C.first_available(users, "user_id", C.fallback_order(T.tracks(spark, d)), T.interactions(spark, d), 20)


@_query("one_shot_rrf", with_(FQ.BASE, "s AS (SELECT user_id, track_id, sum((CASE cg WHEN 'price' THEN 1.0 WHEN 'quantity' THEN 0.7 ELSE 0.2 END)::DOUBLE / (82 + rank - 1)) AS score FROM pool GROUP BY 1, 2)",
    body="SELECT user_id, track_id, round(score, 6) AS score, row_number() OVER (PARTITION BY user_id ORDER BY round(score, 9) DESC, track_id) AS rank FROM s QUALIFY rank <= 10"))
def one_shot_rrf(spark, d):
    """Weights per generator with the anchor's pinned to 1, ranks from 0."""
    pool = FQ._pool(spark, d).withColumns({"bucket": F.lit("all"), "rank": F.col("rank") - 1})
    weights = spark.createDataFrame([("price", "all", 1.0), ("quantity", "all", 0.7), ("recent", "all", 0.2)], "cg string, bucket string, weight double")
    return fusion.weighted_rrf(pool, weights, ["user_id"], "bucket", 82, 10).withColumn("score", F.round("score", 6))


@_query("events_sequence_rules", """WITH e AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS t FROM events)
SELECT a.event_type AS i, b.event_type AS j, count(*) AS n, round(sum(1.0::DOUBLE / (b.t - a.t)), 4) AS w FROM e a JOIN e b ON a.user_id = b.user_id AND b.t > a.t AND b.t - a.t <= 3 GROUP BY 1, 2""")
def events_sequence_rules(spark, d):
    """Which event types follow which within three steps of a user."""
    e = T.table(spark, d, "events").withColumn("t", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")))
    pairs = cf.following(e, 3, "user_id", "event_type", "t")
    return pairs.groupBy("i", "j").agg(F.count("*").alias("n"), F.round(F.sum(1 / F.col("gap")), 4).alias("w"))


@_query("als_lists")
def als_lists(spark, d):
    return learned.als_lists(cf.binary(T.interactions(spark, d), "user_id"), 10)


@_query("item_vectors")
def item_vectors(spark, d):
    return learned.item_vectors(C.sequences(T.interactions(spark, d)))


@_query("pointwise_ranker")
def pointwise_ranker(spark, d):
    """Fusion features of customers' pools, fitted on the first tracks of most customers; `held_out` marks those it never saw."""
    from tessera.operators import splits

    names = ["borda", "rrf60", "combsum", "combmnz", "min_rank", "n_retrieving"]
    fused = fusion.fusion_features(FQ._norm(spark, d), ["user_id"], 3).join(FQ._gt(spark, d), "user_id")
    fused = stored(fused.select("user_id", "track_id", *names, (F.col("gt") == F.col("track_id")).cast("double").alias("label")), "labelled")
    side = splits.session_split(fused, "user_id", "42", 2000).select("user_id", (F.col("side") == "val").alias("held_out"))
    ranked = learned.pointwise_ranker(fused.join(side.where("not held_out"), "user_id", "left_semi"), fused, names, "label", ["user_id"], "track_id")
    return ranked.join(side, "user_id")
