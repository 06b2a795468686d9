"""Queries of conversation ETL, candidate filters and repairs, and the SQL for them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.functions.columns import cosine
from tessera.operators import collaborative as cf
from tessera.operators import dense, etl, features
from tessera.operators.ranking import topk_per_group
from tessera.plans import fusion_queries as FQ
from tessera.plans.sql import CONTEXT, INTER, SESSIONS, TRACKS, with_
from tessera.sources import tables as T

QUERIES, SQL = {}, {}


def _query(name: str, sql: str = ""):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


RAW = """told AS (SELECT l_orderkey AS session_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS turn, CASE l_returnflag WHEN 'N' THEN 'MOVES_TOWARD_GOAL' WHEN 'R' THEN 'DOES_NOT_MOVE_TOWARD_GOAL' END AS told FROM lineitem),
raw AS (SELECT i.*, artist, album, max(turn) OVER (PARTITION BY session_id) AS last FROM inter i JOIN tracks USING (track_id)),
utt AS (SELECT session_id, turn AS turn_number, 'user' AS role, artist AS content FROM raw UNION ALL SELECT session_id, turn, 'music', track_id::VARCHAR FROM raw UNION ALL SELECT session_id, turn, 'assistant', album FROM raw WHERE turn < last)"""


@_query("explode_conversation", with_(INTER, TRACKS, RAW, body="SELECT * FROM utt"))
def explode_conversation(spark, d):
    """One row an utterance of nested sessions."""
    return etl.explode_conversation(T.raw_sessions(spark, d), ["session_id"]).select("session_id", "turn_number", "role", "content")


@_query("turn_assembly_3way", with_(INTER, TRACKS, RAW, body='SELECT session_id, turn AS turn_number, artist AS "user", track_id::VARCHAR AS music, album AS assistant FROM raw WHERE turn < last'))
def turn_assembly_3way(spark, d):
    """Turns with a user's, a music and an assistant's utterance; the last turn of a session lacks the answer."""
    return etl.assemble_turns(etl.explode_conversation(T.raw_sessions(spark, d), ["session_id"]))


@_query("all_turn_tasks", with_(INTER, TRACKS, RAW, body="""SELECT a.session_id, a.turn AS turn_number, any_value(a.artist) AS query, count(b.turn) AS n_prior, coalesce(string_agg(b.track_id, ',' ORDER BY b.turn), '') AS prior
FROM raw a LEFT JOIN raw b ON a.session_id = b.session_id AND b.turn < a.turn GROUP BY 1, 2"""))
def all_turn_tasks(spark, d):
    """A task for every user turn, with the tracks of earlier turns."""
    tasks = etl.turn_tasks(etl.explode_conversation(T.raw_sessions(spark, d), ["session_id"]))
    return tasks.withColumns({"n_prior": F.col("n_prior").cast("long"), "prior": F.concat_ws(",", "prior")})


@_query("music_turns_two_schemas", with_(INTER, body="SELECT schema, session_id, user_id, CAST(session_date AS VARCHAR) AS session_date, turn, track_id::VARCHAR AS track_id FROM inter, (VALUES ('nested'), ('flat')) v(schema)"))
def music_turns_two_schemas(spark, d):
    """The same interactions from nested sessions and from rows exploded before."""
    raw = T.raw_sessions(spark, d)
    flat = etl.explode_conversation(raw, ["session_id", "user_id", "session_date"])
    of = lambda df, name: etl.music_turns(df).select(F.lit(name).alias("schema"), "session_id", "user_id", F.col("session_date").cast("string").alias("session_date"), "turn", "track_id")
    return of(raw, "nested").unionByName(of(flat, "flat"))


@_query("blind_target_turn", with_(INTER, TRACKS, RAW, body="SELECT session_id, (count(*) + 2) // 3 AS target_turn FROM utt GROUP BY 1"))
def blind_target_turn(spark, d):
    return T.raw_sessions(spark, d).select("session_id", etl.blind_turn(F.col("conversations")).alias("target_turn"))


@_query("progress_from_assessments", with_(INTER, TRACKS, RAW, body="SELECT session_id, turn, track_id, CASE told WHEN 'MOVES_TOWARD_GOAL' THEN 'MOVES' WHEN 'DOES_NOT_MOVE_TOWARD_GOAL' THEN 'DOES_NOT' END AS progress FROM inter LEFT JOIN told USING (session_id, turn)"))
def progress_from_assessments(spark, d):
    """Every track with the assessment of its own turn."""
    said = T.raw_sessions(spark, d).select("session_id", F.inline("goal_progress_assessments")).select("session_id", F.col("turn_number").alias("turn"), F.col("goal_progress_assessment").alias("assessment"))
    return etl.progress_labels(T.interactions(spark, d).select("session_id", "turn", "track_id"), said)


@_query("candidate_schema_repair", with_(FQ.BASE, body="SELECT user_id, rank AS turn, track_id, round(score, 4) AS score FROM pool WHERE cg = 'price'"))
def candidate_schema_repair(spark, d):
    """A generator's rows with the true turn beside a constant one, and a helper column."""
    broken = FQ._pool(spark, d).where("cg = 'price'").select("track_id", F.col("rank").alias("gt_turn_number"), F.lit(1).alias("turn"), F.lit(False).alias("fallback_used"), F.round("score", 4).alias("score"), "user_id")
    return etl.repaired(broken, ["user_id", "turn", "track_id", "score"])


@_query("blind_candidate_filter", with_(FQ.BASE, FQ.GT, TRACKS, body="SELECT user_id, cg, track_id, rank FROM pool JOIN tracks USING (track_id) JOIN customer ON c_custkey = user_id JOIN g USING (user_id) WHERE c_mktsegment <> 'BUILDING' OR year IS NOT NULL OR track_id = gt"))
def blind_candidate_filter(spark, d):
    """Of the customers of one segment only dated tracks and the true one stay."""
    pool = FQ._pool(spark, d).join(FQ._gt(spark, d), "user_id")
    blind = T.table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("user_id"))
    kept = etl.keep_known(pool, blind, T.tracks(spark, d).where("year is not null"), ["user_id"], "track_id", F.col("track_id") == F.col("gt"))
    return kept.select("user_id", "cg", "track_id", "rank")


REL = """first AS (SELECT l_partkey AS track_id, min(CAST(l_shipdate AS DATE)) AS d FROM lineitem GROUP BY 1), rel AS (SELECT track_id, CASE WHEN year IS NOT NULL THEN d END AS release, year FROM tracks LEFT JOIN first USING (track_id))"""


@_query("release_predicates", with_(INTER, TRACKS, REL, body="SELECT session_id, turn, release IS NULL OR release <= session_date + 365 AS within_a_year, release IS NULL OR release <= session_date + 182 AS within_half, coalesce(release <= session_date, false) AS strict FROM inter JOIN rel USING (track_id)"))
def release_predicates(spark, d):
    """Whether each track was released by the session's date, strictly and with a margin."""
    rows = T.interactions(spark, d).join(T.releases(spark, d), "track_id")
    r, s = F.col("release"), F.col("session_date")
    return rows.select("session_id", "turn", etl.released_by(r, s, 1.0).alias("within_a_year"), etl.released_by(r, s, 0.5).alias("within_half"), etl.released_by(r, s).alias("strict"))


@_query("top_popular_released", with_(INTER, CONTEXT, TRACKS, REL, """daily AS (SELECT session_date, track_id, count(*) AS n FROM inter GROUP BY 1, 2),
w AS (SELECT d.session_date, x.track_id, sum(n)::BIGINT AS plays FROM (SELECT DISTINCT session_date FROM inter) d JOIN daily x ON x.session_date < d.session_date AND x.session_date >= d.session_date - 28 GROUP BY 1, 2),
f AS (SELECT w.* FROM w JOIN rel USING (track_id) WHERE release IS NULL OR release <= session_date + 365),
s AS (SELECT DISTINCT session_id, session_date FROM inter), seen AS (SELECT DISTINCT session_id, track_id FROM ctx)""",
    body="SELECT session_id, track_id, plays, row_number() OVER (PARTITION BY session_id ORDER BY plays DESC, track_id) AS rank FROM s JOIN f USING (session_date) ANTI JOIN seen USING (session_id, track_id) QUALIFY rank <= 5"))
def top_popular_released(spark, d):
    """Popularity of four weeks for every session, without seen tracks and those released over a year later.

    A date's list is cut to five and the most tracks a session has seen. A track may be listed from 365 days before its release on.
    """
    inter = T.interactions(spark, d)
    s, seen = inter.select("session_id", "session_date").distinct(), T.context(inter).select("session_id", "track_id").distinct()
    most = s.join(seen.groupBy("session_id").agg(F.count("*").alias("n")), "session_id", "left").withColumn("need", 5 + F.coalesce("n", F.lit(0)))
    longest = most.agg(F.max("need")).first()[0] or 5
    since = T.releases(spark, d).select("track_id", F.date_sub("release", 365).alias("since"))
    lists = cf.top_of_windows(inter, [28], longest, since).withColumnRenamed("rank", "place")
    found = most.join(lists.select("session_date", "track_id", "plays", "place"), "session_date").where("place <= need").join(seen, ["session_id", "track_id"], "left_anti")
    return topk_per_group(found.select("session_id", "track_id", "plays"), ["session_id"], [F.col("plays").desc(), F.col("track_id")], 5)


@_query("fallback_released", with_(INTER, TRACKS, REL, """c AS (SELECT track_id, count(*) AS n FROM inter GROUP BY 1), days AS (SELECT DISTINCT session_date FROM inter)""",
    body="SELECT CAST(session_date AS VARCHAR) AS session_date, track_id, round(ln(1 + n), 6) AS score, row_number() OVER (PARTITION BY session_date ORDER BY n DESC, track_id) AS rank FROM days JOIN rel ON release <= session_date JOIN c USING (track_id) QUALIFY rank <= 5"))
def fallback_released(spark, d):
    """The most played tracks released by every date; undated ones go.

    A track enters the list on its release and leaves it once five better ones are out. The best five by a date are
    the best five of the best five of each release day before it, so only these meet the dates.
    """
    inter = T.interactions(spark, d)
    counts = inter.groupBy("track_id").agg(F.count("*").alias("n")).join(T.releases(spark, d).where("release is not null"), "track_id")
    best = topk_per_group(counts, ["release"], [F.col("n").desc(), F.col("track_id")], 5).drop("rank")
    days = inter.select("session_date").distinct()
    found = days.join(best, F.col("release") <= F.col("session_date"))
    top = topk_per_group(found, ["session_date"], [F.col("n").desc(), F.col("track_id")], 5)
    return top.select(F.col("session_date").cast("string").alias("session_date"), "track_id", F.round(F.log1p("n"), 6).alias("score"), "rank")


META = """SELECT p_partkey AS track_id, [p_name] AS track_name, CASE WHEN p_size % 7 = 0 THEN [] ELSE [p_brand, p_type] END AS artist_name, CASE WHEN p_size % 5 = 0 THEN [' Unknown '] ELSE [p_type] END AS album_name, CASE WHEN p_size % 10 = 0 THEN '' ELSE (1950 + p_size) || '-01-01' END AS release_date, string_split(p_name, ' ') AS tag_list FROM part"""


def _metadata(spark, d):
    c, s = F.col, F.col("p_size")
    none = F.array().cast("array<string>")
    return T.table(spark, d, "part").select(
        c("p_partkey").alias("track_id"), F.array("p_name").alias("track_name"), F.when(s % 7 == 0, none).otherwise(F.array("p_brand", "p_type")).alias("artist_name"),
        F.when(s % 5 == 0, F.array(F.lit(" Unknown "))).otherwise(F.array("p_type")).alias("album_name"), F.when(s % 10 == 0, "").otherwise(F.concat((1950 + s).cast("string"), F.lit("-01-01"))).alias("release_date"), F.split("p_name", " ").alias("tag_list"),
    )


@_query("flat_metadata", f"SELECT track_id, track_name[1] AS track, artist_name[1] AS artist, album_name[1] AS album, TRY_CAST(substr(release_date, 1, 4) AS BIGINT) AS year, len(tag_list) AS n_tags, CASE WHEN trim(album_name[1]) <> 'Unknown' THEN coalesce(artist_name[1], '') || '::' || trim(album_name[1]) END AS album_key, release_date = '' AS undated FROM ({META})")
def flat_metadata(spark, d):
    """First names, year, number of tags, album key and undated flag of list-valued metadata."""
    raw = _metadata(spark, d)
    flat = etl.flat_metadata(raw).join(raw.select("track_id", "release_date"), "track_id")
    return flat.select("track_id", "track", "artist", "album", "year", "n_tags", etl.album_key(F.col("artist"), F.col("album")).alias("album_key"), etl.undated(F.col("release_date")).alias("undated"))


@_query("first_of_union", """WITH a AS (SELECT o_custkey AS k, min(o_orderkey) AS v, NULL::BIGINT AS gt FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_custkey AS k, max(o_orderkey) AS v, max(o_orderkey) AS gt FROM orders GROUP BY 1)
SELECT k AS user_id, coalesce(a.v, b.v) AS v, b.gt FROM a FULL JOIN b USING (k)""")
def first_of_union(spark, d):
    """History rows first, submission rows for the rest, the truth taken from where it is known."""
    orders = T.table(spark, d, "orders").withColumnRenamed("o_custkey", "user_id")
    a = orders.where("o_orderstatus = 'F'").groupBy("user_id").agg(F.min("o_orderkey").alias("v"), F.lit(None).cast("long").alias("gt"))
    b = orders.groupBy("user_id").agg(F.max("o_orderkey").alias("v"), F.max("o_orderkey").alias("gt"))
    return etl.first_of_union([a, b], ["user_id"], ["gt"])


@_query("patched_truth", with_(FQ.BASE, FQ.GT, body="SELECT user_id, rank, coalesce(CASE WHEN rank % 2 = 0 THEN track_id END, gt) AS gt FROM pool LEFT JOIN g USING (user_id) WHERE cg = 'price'"))
def patched_truth(spark, d):
    holes = FQ._pool(spark, d).where("cg = 'price'").select("user_id", "rank", F.when(F.col("rank") % 2 == 0, F.col("track_id")).alias("gt"))
    return etl.patched(holes, FQ._gt(spark, d), ["user_id"], "gt")


@_query("dense_group_index", with_(INTER, body="SELECT session_id, turn, dense_rank() OVER (ORDER BY session_id, turn) - 1 AS idx, (dense_rank() OVER (ORDER BY session_id) - 1) // 1000 AS shard FROM inter"))
def dense_group_index(spark, d):
    """Places of (session, turn) and of sessions among all, the latter cut into shards of a thousand."""
    inter = T.interactions(spark, d).select("session_id", "turn")
    both = etl.dense_index(etl.dense_index(inter, ["session_id", "turn"], "idx"), ["session_id"], "g")
    return both.select("session_id", "turn", "idx", F.floor(F.col("g") / 1000).alias("shard"))


@_query("dominant_pairs", "SELECT o_custkey AS user_id, arg_max(p, (n, c, s)).c AS category, arg_max(p, (n, c, s)).s AS specificity, max(n) AS n FROM (SELECT o_custkey, substr(o_orderpriority, 1, 1) AS c, o_orderstatus AS s, count(*) AS n, {'c': substr(o_orderpriority, 1, 1), 's': o_orderstatus} AS p FROM orders GROUP BY 1, 2, 3) GROUP BY 1")
def dominant_pairs(spark, d):
    return etl.dominant_pair(T.sessions(spark, d), "user_id", "category", "specificity")


@_query("mode_per_country", with_(SESSIONS, body="SELECT country, arg_min(specificity, (-n, specificity)) AS specificity FROM (SELECT country, specificity, count(*) AS n FROM sessions GROUP BY 1, 2) GROUP BY 1"))
def mode_per_country(spark, d):
    return etl.mode_of(T.sessions(spark, d), ["country"], "specificity")


@_query("first_known_columns", with_(INTER, TRACKS, "r AS (SELECT session_id, turn, year, CASE WHEN popularity > 950 THEN popularity END AS dear FROM inter JOIN tracks USING (track_id))",
    body="SELECT session_id, max(turn) AS max_turn, count(*) AS n, arg_min(year, turn) AS year, round(arg_min(dear, turn), 4) AS dear FROM r GROUP BY 1"))
def first_known_columns(spark, d):
    rows = T.interactions(spark, d).join(T.tracks(spark, d), "track_id").withColumn("dear", F.when(F.col("popularity") > 950, F.col("popularity")))
    return etl.first_known(rows, ["session_id"], "turn", ["year", "dear"]).withColumn("dear", F.round("dear", 4))


@_query("ordinal_codes", "WITH v AS (SELECT c_mktsegment AS s, row_number() OVER (ORDER BY c_mktsegment) AS k FROM (SELECT DISTINCT c_mktsegment FROM customer WHERE c_nationkey < 3)) SELECT c_custkey, coalesce(k, 0) AS code FROM customer LEFT JOIN v ON s = c_mktsegment")
def ordinal_codes(spark, d):
    """Codes of the segments known from three nations' customers."""
    c = T.table(spark, d, "customer")
    return etl.ordinal(c.where("c_nationkey < 3"), c, "c_mktsegment", "code").select("c_custkey", "code")


@_query("leakage_safe_interactions", with_(INTER, "b AS (SELECT *, CASE WHEN ('0x' || substr(sha1('42:' || session_id), 1, 12))::BIGINT % 10000 < 1500 THEN 'val' ELSE 'train' END AS bucket FROM inter)",
    body="SELECT part, track_id, count(*) AS n FROM b, (VALUES ('train'), ('val'), ('blind')) v(part) WHERE part <> 'train' OR bucket = 'train' GROUP BY 1, 2"))
def leakage_safe_interactions(spark, d):
    """What each part may learn from."""
    from tessera.operators import splits

    inter = T.interactions(spark, d)
    tagged = inter.join(splits.session_split(inter, "session_id", "42", 1500).withColumnRenamed("side", "bucket"), "session_id")
    each = None
    for part in ("train", "val", "blind"):
        one = etl.leakage_safe(tagged, part).groupBy("track_id").agg(F.count("*").alias("n")).select(F.lit(part).alias("part"), "track_id", "n")
        each = one if each is None else each.unionByName(one)
    return each


@_query("warm_and_cold_users", """WITH v AS (SELECT label, arg_min(embedding, vec_id)::DOUBLE[] AS v FROM embeddings WHERE len(embedding) > 0 GROUP BY 1)
SELECT c_custkey, v IS NULL AS is_cold, round(sqrt(list_inner_product(v, v)) / nullif(sqrt(list_inner_product(v, v)), 0), 6) AS length FROM customer LEFT JOIN v ON label = c_nationkey""")
def warm_and_cold_users(spark, d):
    """Customers with the first vector of their nation's number, at length 1; cold where there is none."""
    from tessera.functions.columns import norm

    users = T.table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("label"))
    vectors = T.table(spark, d, "embeddings").select("label", F.col("embedding").cast("array<double>").alias("e"), F.col("vec_id").alias("place"))
    return etl.user_vectors(users, vectors, "label", "e").select("c_custkey", "is_cold", F.round(norm("vector"), 6).alias("length"))


@_query("masked_tower", "SELECT p_partkey, vec_id IS NOT NULL AS valid FROM part LEFT JOIN embeddings ON vec_id = p_partkey")
def masked_tower(spark, d):
    """The catalogue with a mask of which tracks have a usable vector."""
    part, v = T.table(spark, d, "part"), T.table(spark, d, "embeddings").withColumnRenamed("vec_id", "p_partkey")
    return etl.masked_tower(part, v, "p_partkey", "embedding").select("p_partkey", "valid")


@_query("move_away_factor", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), s AS (SELECT q.vec_id AS q, list_inner_product(q.e, x.e) AS s, x.label = (q.label + 1) % 10 AS prior FROM v q JOIN v x ON q.vec_id <> x.vec_id),
t AS (SELECT q, avg(s) AS top FROM (SELECT * FROM s WHERE NOT prior QUALIFY row_number() OVER (PARTITION BY q ORDER BY s DESC) <= 50) GROUP BY 1), p AS (SELECT q, max(s) AS prior FROM s WHERE prior GROUP BY 1)
SELECT q AS vec_id, round(CASE WHEN prior IS NULL OR top - prior <= -0.2 THEN 1 WHEN top - prior >= 0.1 THEN 0.3 ELSE 1 - (top - prior + 0.2) / 0.3::DOUBLE * 0.7 END, 6) AS factor FROM t LEFT JOIN p USING (q)""")
def move_away_factor(spark, d):
    """How far each query's best new rows are beyond its prior ones (here another label's rows)."""
    from tessera.operators import catalogue

    v = T.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))
    asks = v.withColumn("label", (F.col("label") + 1) % 10)
    prior = dense.max_similarity_to_group(asks, v, "label").withColumnRenamed("max_similarity", "prior")
    others = asks.select("id", "vector", F.col("label").alias("away"))
    top = dense.dense_topk_outside(others, v, 50).groupBy(F.col("query_id").alias("id")).agg(F.avg("score").alias("top"))
    return top.join(prior, "id", "left").select(F.col("id").alias("vec_id"), F.round(catalogue.move_away(F.col("top"), F.col("prior"), -0.2, 0.1, 0.3), 6).alias("factor"))


@_query("recency_centroid", """WITH v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM embeddings),
w AS (SELECT *, exp((r - n + 1) / 2.0) AS w FROM v), dims AS (SELECT label, k, sum(w * e[k]) AS s FROM w, range(1, 65) t(k) GROUP BY 1, 2), cen AS (SELECT label, list(s ORDER BY k) AS c FROM dims GROUP BY 1)
SELECT vec_id, label, round(list_cosine_similarity(e, c), 6) AS cosine FROM v JOIN cen USING (label)""")
def recency_centroid(spark, d):
    """Every vector against its label's centroid, later vectors weighing more."""
    v = T.table(spark, d, "embeddings").select("vec_id", "label", F.col("embedding").cast("array<double>").alias("vector"))
    by = Window.partitionBy("label")
    v = v.withColumn("age", F.count("*").over(by) - F.row_number().over(by.orderBy("vec_id")))
    c = dense.centroid(v, ["label"], "vector", F.exp(-F.col("age") / 2.0)).withColumnRenamed("vector", "c")
    return v.join(c, "label").select("vec_id", "label", F.round(cosine("vector", "c"), 6).alias("cosine"))


@_query("turn_share_and_median", with_(INTER, TRACKS, "r AS (SELECT session_id, turn, popularity FROM inter JOIN tracks USING (track_id)), m AS (SELECT session_id, median(popularity) AS m, max(turn) AS t FROM r GROUP BY 1)",
    body="SELECT session_id, turn, round(turn / t, 6) AS turn_share, round(popularity - m, 4) AS above_median FROM r JOIN m USING (session_id)"))
def turn_share_and_median(spark, d):
    return _six(features.turn_position(T.interactions(spark, d).join(T.tracks(spark, d), "track_id"), ["session_id"], "popularity"), "turn_share").select("session_id", "turn", "turn_share", F.round("above_median", 4).alias("above_median"))


@_query("session_stats_imputed", with_(INTER, CONTEXT, TRACKS, "md AS (SELECT median(year) AS y, median(popularity) AS p, median(duration) AS d FROM tracks)", "j AS (SELECT session_id, coalesce(year, y) AS year, coalesce(popularity, p) AS popularity, coalesce(duration, d) AS duration FROM ctx LEFT JOIN tracks USING (track_id), md)",
    body="SELECT session_id, " + ", ".join(f"round(avg({c}), 4) AS mean_{c}, round(stddev_pop({c}), 4) AS std_{c}" for c in ("year", "popularity", "duration")) + " FROM j GROUP BY 1"))
def session_stats_imputed(spark, d):
    """Means and population deviations of a session's tracks, with the catalogue's median for what is unknown."""
    columns = ["year", "popularity", "duration"]
    out = features.imputed_stats(T.context(T.interactions(spark, d)), T.tracks(spark, d), columns)
    return out.withColumns({f"{n}_{c}": F.round(f"{n}_{c}", 4) for c in columns for n in ("mean", "std")})


@_query("oof_folds")
def oof_folds(spark, d):
    """Users in five folds by greedy bin packing of their numbers of sessions."""
    users = T.table(spark, d, "orders").groupBy(F.col("o_custkey").alias("user_id")).agg(F.count("*").alias("n_sessions"))
    return etl.assigned_folds(users, "user_id", "n_sessions", 5, "42")


@_query("session_history_rows", with_(INTER, body="SELECT session_id, turn, CASE WHEN turn < max(turn) OVER (PARTITION BY session_id) THEN track_id END AS track_id, turn = max(turn) OVER (PARTITION BY session_id) AS is_target FROM inter"))
def session_history_rows(spark, d):
    return etl.session_history(T.interactions(spark, d))


@_query("query_text_variants", with_(INTER, TRACKS, RAW, "b AS (SELECT session_id, turn, artist, coalesce(string_agg(artist, ' ') OVER w, '') AS said, coalesce(string_agg(album, ' ') OVER w, '') AS heard FROM raw WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))",
    body="SELECT session_id, turn AS turn_number, artist AS current, trim(said || ' ' || artist) AS history, trim(artist || ' ' || artist || ' ' || said) AS weighted, trim(artist || ' ' || heard) AS tracks FROM b"))
def query_text_variants(spark, d):
    """Four texts that every user turn can ask with."""
    names = T.tracks(spark, d).select("track_id", F.col("album").alias("name"))
    return etl.query_texts(etl.explode_conversation(T.raw_sessions(spark, d), ["session_id"]), names)


_UNIT = "(('0x' || substr(sha256(session_id || ':3'), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@_query("random_truncation", with_(INTER, f"m AS (SELECT session_id, CAST(floor({_UNIT} * max(turn)) AS BIGINT) + 1 AS target_turn FROM inter GROUP BY 1)", body="SELECT session_id, target_turn, count(*) AS n, sum(track_id)::BIGINT AS tracks FROM inter JOIN m USING (session_id) WHERE turn <= target_turn GROUP BY 1, 2"))
def random_truncation(spark, d):
    from tessera.operators import splits

    cut = splits.random_truncation(T.interactions(spark, d), "session_id", "3")
    return cut.groupBy("session_id", "target_turn").agg(F.count("*").alias("n"), F.sum("track_id").alias("tracks"))


@_query("quota_sample", """WITH s AS (SELECT c_mktsegment AS value, count(*) / (SELECT count(*) FROM customer) * 61 AS x FROM customer GROUP BY 1), f AS (SELECT value, floor(x) AS f, round(x - floor(x), 9) AS r FROM s),
q AS (SELECT value, f + (row_number() OVER (ORDER BY r DESC, value) <= 61 - sum(f) OVER ())::INT AS seats FROM f)
SELECT c_custkey, c_mktsegment FROM customer JOIN q ON value = c_mktsegment QUALIFY row_number() OVER (PARTITION BY c_mktsegment ORDER BY ('0x' || substr(sha256(c_custkey || ':8'), 1, 13))::BIGINT, c_custkey) <= seats""")
def quota_sample(spark, d):
    """Sixty-one customers, every segment by its share."""
    from tessera.operators import splits

    return splits.quota_sample(T.table(spark, d, "customer"), "c_mktsegment", "c_custkey", 61, "8")


@_query("auc_of_lengths", "WITH r AS (SELECT quality AS y, n_chars AS s FROM labels JOIN documents USING (doc_id)), k AS (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2 AS r FROM r) SELECT count(*) AS n, sum(y)::BIGINT AS positives, round((sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc FROM k")
def auc_of_lengths(spark, d):
    """How well a text's length alone tells its quality."""
    from tessera.operators import metrics

    rows = T.table(spark, d, "labels").join(T.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id")
    return _six(metrics.auc(rows, "n_chars", "quality"), "auc")


@_query("two_sample_shift")
def two_sample_shift(spark, d):
    """Whether sessions of one status can be told from the others by their tracks' statistics, beside a shuffle."""
    from tessera.operators import learned

    stats = features.imputed_stats(T.interactions(spark, d), T.tracks(spark, d), ["year", "popularity"])
    rows = stats.join(T.sessions(spark, d).select("session_id", (F.col("specificity") == "F").cast("int").alias("y")), "session_id")
    return learned.two_sample(rows, ["mean_year", "std_year", "mean_popularity", "std_popularity"], "y", "session_id", folds=2, shuffles=1)


@_query("generator_leaderboard", with_(FQ.BASE, FQ.GT, "pos AS (SELECT c.cg, g.user_id, c_nationkey AS nation, rank FROM g CROSS JOIN (SELECT DISTINCT cg FROM pool) c JOIN customer ON c_custkey = g.user_id LEFT JOIN pool p ON p.user_id = g.user_id AND p.cg = c.cg AND p.track_id = gt)",
    "gr AS (SELECT cg, nation, avg((coalesce(rank, 99) <= 10)::INT) AS x FROM pos GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY cg ORDER BY x) AS r, count(*) OVER (PARTITION BY cg) AS n FROM gr)",
    "cv AS (SELECT cg, avg(x) AS cvar FROM o WHERE r <= greatest(1, round_even(0.3::DOUBLE * n, 0)) GROUP BY 1), re AS (SELECT cg, avg((coalesce(rank, 99) <= 10)::INT) AS recall FROM pos GROUP BY 1)",
    body="SELECT cg, round(recall, 6) AS recall, round(cvar, 6) AS cvar, row_number() OVER (ORDER BY round(cvar, 9) DESC, round(recall, 9) DESC, cg) AS place FROM cv JOIN re USING (cg)"))
def generator_leaderboard(spark, d):
    """Generators by the hit rates of their worst nations."""
    from tessera.operators import metrics

    pool, gt = FQ._pool(spark, d), FQ._gt(spark, d)
    every = gt.crossJoin(F.broadcast(pool.select("cg").distinct()))  # three generators
    hits = pool.select("user_id", "cg", F.col("track_id").alias("gt"), F.col("rank").alias("position"))
    nation = T.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_nationkey").alias("nation"))
    pos = every.join(hits, ["user_id", "cg", "gt"], "left").join(nation, "user_id")
    return _six(metrics.leaderboard(pos, "cg", "nation", 10, 0.7), "recall", "cvar")
