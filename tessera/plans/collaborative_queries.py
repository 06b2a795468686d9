"""Queries of the popularity, collaborative and sequential generators, their evaluation, and the SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import collaborative as cf
from tessera.operators import metrics
from tessera.operators.ranking import topk_per_group
from tessera.plans.sql import CONTEXT, INTER, SESSIONS, TRACKS, with_
from tessera.sources import tables as T
from tessera.sources.stored import stored

QUERIES, SQL = {}, {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _rounded(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


ROWS = INTER + ",\nrows AS (SELECT DISTINCT session_id AS r, track_id AS item FROM inter),\ndf AS (SELECT item, count(*) AS df FROM rows GROUP BY 1)"
USER_ROWS = INTER + ",\nrows AS (SELECT DISTINCT user_id AS r, track_id AS item FROM inter),\ndf AS (SELECT item, count(*) AS df FROM rows GROUP BY 1)"
PAIRS = "pairs AS (SELECT a.item AS i, b.item AS j, count(*) AS n FROM rows a JOIN rows b ON a.r = b.r AND a.item <> b.item GROUP BY 1, 2)"
TOP = "SELECT i, j, round(w, 6) AS w, row_number() OVER (PARTITION BY i ORDER BY round(w, 9) DESC, j) AS rank FROM edges WHERE w > 0 QUALIFY rank <= {k}"


@_query("cooccurrence_topk", with_(ROWS, PAIRS, body="SELECT i, j, n, row_number() OVER (PARTITION BY i ORDER BY n DESC, j) AS rank FROM pairs QUALIFY rank <= 5"))
def cooccurrence_topk(spark, d):
    return topk_per_group(cf.cooccurrence(cf.binary(T.interactions(spark, d))), ["i"], [F.col("n").desc(), F.col("j")], 5)


@_query("sppmi_edges", with_(ROWS, PAIRS, """m AS (SELECT i, sum(n) AS r FROM pairs GROUP BY 1),
edges AS (SELECT p.i, p.j, ln(n * (SELECT sum(n) FROM pairs) / (a.r * b.r) + 1e-12) AS w FROM pairs p JOIN m a ON p.i = a.i JOIN m b ON p.j = b.i)""", body=TOP.format(k=5)))
def sppmi_edges(spark, d):
    return _rounded(cf.top_neighbours(cf.sppmi(cf.cooccurrence(cf.binary(T.interactions(spark, d)))), 5), "w")


KNN = """edges AS (SELECT i, j, n / (sqrt(a.df) * sqrt(b.df) + 10.0) AS w FROM pairs JOIN df a ON a.item = i JOIN df b ON b.item = j)"""


@_query("item_knn_cosine_topk", with_(ROWS, PAIRS, KNN, body=TOP.format(k=10)))
def item_knn_cosine_topk(spark, d):
    return _rounded(cf.top_neighbours(cf.item_cosine(cf.binary(T.interactions(spark, d))), 10), "w")


@_query("item_knn_recommend", with_(INTER, CONTEXT, """rows AS (SELECT DISTINCT session_id AS r, track_id AS item FROM ctx),
df AS (SELECT item, count(*) AS df FROM rows GROUP BY 1)""", PAIRS, KNN, """near AS (SELECT i, j, w FROM edges QUALIFY row_number() OVER (PARTITION BY i ORDER BY round(w, 9) DESC, j) <= 20),
scored AS (SELECT r AS session_id, j AS track_id, sum(w) AS score FROM rows JOIN near ON item = i GROUP BY 1, 2),
fresh AS (SELECT s.* FROM scored s ANTI JOIN rows ON r = session_id AND item = track_id)""",
    body="SELECT session_id, track_id, round(score, 6) AS score, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, track_id) AS rank FROM fresh QUALIFY rank <= 10"))
def item_knn_recommend(spark, d):
    rows = cf.binary(T.context(T.interactions(spark, d)))
    scored = cf.profile_scores(rows, cf.top_neighbours(cf.item_cosine(rows), 20))
    top = topk_per_group(scored, ["row"], [F.round("score", 9).desc(), F.col("item")], 10)
    return top.select(F.col("row").alias("session_id"), F.col("item").alias("track_id"), F.round("score", 6).alias("score"), "rank")


@_query("rp3beta_topk", with_(ROWS, """sz AS (SELECT r, count(*) AS size FROM rows GROUP BY 1),
steps AS (SELECT r, rows.item, df, size FROM rows JOIN df USING (item) JOIN sz USING (r)),
edges AS (SELECT a.item AS i, b.item AS j, pow(sum((1.0::DOUBLE / a.df) * (1.0::DOUBLE / b.size)) * pow(b.df, -0.3), 0.5) AS w
  FROM steps a JOIN steps b ON a.r = b.r AND a.item <> b.item GROUP BY a.item, b.item, b.df)""", body=TOP.format(k=10)))
def rp3beta_topk(spark, d):
    return _rounded(cf.top_neighbours(cf.rp3beta(cf.binary(T.interactions(spark, d)), alpha=0.5, beta=0.3), 10), "w")


NEAR_ROWS = """len AS (SELECT r, sqrt(sum(weight * weight)) AS l FROM rows JOIN wt USING (item) GROUP BY 1),
dots AS (SELECT a.r, b.r AS o, sum(weight) AS d FROM rows a JOIN rows b ON a.item = b.item AND a.r <> b.r JOIN wt ON wt.item = a.item GROUP BY 1, 2),
near AS (SELECT d.r, o, d / (x.l * y.l) AS sim FROM dots d JOIN len x ON x.r = d.r JOIN len y ON y.r = o
  QUALIFY row_number() OVER (PARTITION BY d.r ORDER BY round(d / (x.l * y.l), 9) DESC, o) <= 20)"""
LISTS = "SELECT r AS {key}, item AS track_id, round(score, 6) AS score, row_number() OVER (PARTITION BY r ORDER BY round(score, 9) DESC, item) AS rank FROM fresh QUALIFY rank <= 10"


@_query("user_knn_scores", with_(USER_ROWS, "wt AS (SELECT DISTINCT item, 1.0::DOUBLE AS weight FROM rows)", NEAR_ROWS, """sz AS (SELECT r, count(*) AS size FROM rows GROUP BY 1),
fresh AS (SELECT n.r, rows.item, sum(sim / sqrt(size)) AS score FROM near n JOIN rows ON rows.r = o JOIN sz ON sz.r = o GROUP BY 1, 2)""",
    body=LISTS.format(key="user_id").replace("FROM fresh", "FROM fresh ANTI JOIN rows USING (r, item)")))
def user_knn_scores(spark, d):
    rows = stored(cf.binary(T.interactions(spark, d), "user_id"), "rows")
    top = cf.user_knn(rows, rows, 20, best=10)
    return top.select(F.col("row").alias("user_id"), F.col("item").alias("track_id"), F.round("score", 6).alias("score"), "rank")


@_query("session_knn_scores", with_(ROWS, "wt AS (SELECT item, ln((1 + (SELECT count(DISTINCT r) FROM rows)) / (1 + df)) + 1 AS weight FROM df)", NEAR_ROWS, """scored AS (SELECT n.r, rows.item, sum(sim) AS s FROM near n JOIN rows ON rows.r = o GROUP BY 1, 2),
fresh AS (SELECT s.r, s.item, s * weight AS score FROM scored s JOIN wt USING (item) ANTI JOIN rows ON rows.r = s.r AND rows.item = s.item)""", body=LISTS.format(key="session_id")))
def session_knn_scores(spark, d):
    rows = stored(cf.binary(T.interactions(spark, d)), "rows")
    top = cf.session_knn(rows, rows, 20, best=10)
    return top.select(F.col("row").alias("session_id"), F.col("item").alias("track_id"), F.round("score", 6).alias("score"), "rank")


BLOCKS = """plays AS (SELECT track_id, count(*) AS plays FROM inter GROUP BY 1),
t AS (SELECT tracks.*, plays FROM tracks LEFT JOIN plays USING (track_id)),
e AS (SELECT quantile_cont(popularity::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS pe, quantile_cont(plays::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS le, quantile_cont(duration::DOUBLE, [0.2, 0.4, 0.6, 0.8]) AS de FROM t),
icm AS (
  SELECT track_id AS item, 'artist' AS block, artist AS feature FROM t UNION ALL SELECT track_id, 'album', album FROM t
  UNION ALL SELECT track_id, 'tag', unnest(tags) FROM t UNION ALL SELECT track_id, 'decade', CAST(year // 10 * 10 AS VARCHAR) FROM t WHERE year IS NOT NULL
  UNION ALL SELECT track_id, 'popularity', CAST(len(list_filter(pe, lambda x: x < popularity)) AS VARCHAR) FROM t, e
  UNION ALL SELECT track_id, 'plays', CAST(len(list_filter(le, lambda x: x < plays)) AS VARCHAR) FROM t, e WHERE plays IS NOT NULL
  UNION ALL SELECT track_id, 'duration', CAST(len(list_filter(de, lambda x: x < duration)) AS VARCHAR) FROM t, e)"""


def _blocks(spark, d):
    return cf.content_blocks(T.tracks(spark, d), T.interactions(spark, d).groupBy("track_id").agg(F.count("*").alias("plays")))


@_query("icm_blocks", with_(INTER, TRACKS, BLOCKS, body="SELECT block, feature, count(*) AS n, sum(item)::BIGINT AS items FROM icm GROUP BY 1, 2"))
def icm_blocks(spark, d):
    return _blocks(spark, d).groupBy("block", "feature").agg(F.count("*").alias("n"), F.sum("item").alias("items"))


@_query("cbf_similarity_topk", with_(INTER, TRACKS, BLOCKS, """f AS (SELECT DISTINCT item, block || ':' || feature AS f FROM icm),
s AS (SELECT item, count(*) AS s FROM f GROUP BY 1),
edges AS (SELECT a.item AS i, b.item AS j, count(*) / sqrt(any_value(x.s) * any_value(y.s)) AS w FROM f a JOIN f b ON a.f = b.f AND a.item <> b.item JOIN s x ON x.item = a.item JOIN s y ON y.item = b.item GROUP BY 1, 2)""", body=TOP.format(k=5)))
def cbf_similarity_topk(spark, d):
    return _rounded(cf.content_neighbours(_blocks(spark, d), 5), "w")


RULES = """rules AS (SELECT a.track_id AS i, b.track_id AS j, sum(1.0::DOUBLE / (b.turn - a.turn)) AS w
  FROM ctx a JOIN ctx b ON a.session_id = b.session_id AND b.turn > a.turn AND b.turn - a.turn <= 10 GROUP BY 1, 2)"""
RANKED = """profile AS (SELECT DISTINCT session_id, track_id FROM ctx),
scored AS (SELECT session_id, j AS track_id, sum(w) AS score FROM profile JOIN rules ON track_id = i GROUP BY 1, 2),
fresh AS (SELECT s.* FROM scored s ANTI JOIN profile p ON p.session_id = s.session_id AND p.track_id = s.track_id),
ranked AS (SELECT session_id, track_id, score, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, track_id) AS rank FROM fresh QUALIFY rank <= 20),
pos AS (SELECT gt.session_id, target_turn, gt_track_id, rank FROM gt LEFT JOIN ranked r ON r.session_id = gt.session_id AND r.track_id = gt_track_id)"""


def _rule_lists(spark, d):
    inter = T.interactions(spark, d)
    seen = T.context(inter)
    profile = cf.binary(seen)
    top = cf.profile_topk(profile, cf.sequential_rules(seen), 20)
    return inter, top.select(F.col("row").alias("session_id"), F.col("item").alias("track_id"), "score", "rank")


def _positions(spark, d, missing="zero"):
    inter, ranked = _rule_lists(spark, d)
    if missing == "exclude":  # read twice
        ranked = stored(ranked.select("session_id", "track_id", "rank"), "ranked")
    return metrics.positions(ranked, T.ground_truth(inter), ["session_id"], "track_id", "gt_track_id", missing)


@_query("sequential_rules_topk", with_(INTER, CONTEXT, RULES, RANKED, body="SELECT session_id, track_id, round(score, 6) AS score, rank FROM ranked"))
def sequential_rules_topk(spark, d):
    return _rounded(_rule_lists(spark, d)[1], "score")


EVAL = "count(*) AS n, round(avg(CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END), 6) AS ndcg20, round(avg(CASE WHEN rank <= 20 THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall20, round(avg(CASE WHEN rank <= 20 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr20"

RAW = EVAL.replace("round(avg", "(avg").replace("END), 6)", "END))")


@_query("ndcg_macro_by_turn", with_(INTER, CONTEXT, RULES, RANKED, body=f"SELECT target_turn AS turn_number, {EVAL} FROM pos GROUP BY 1"))
def ndcg_macro_by_turn(spark, d):
    return _rounded(metrics.macro_by(_positions(spark, d).withColumnRenamed("target_turn", "turn_number"), "turn_number"), "ndcg20", "recall20", "mrr20")


@_query("macro_and_micro_summary", with_(INTER, CONTEXT, RULES, RANKED, body=f"""SELECT 'macro' AS kind, sum(n)::BIGINT AS n, round(avg(ndcg20), 5) AS ndcg20, round(avg(recall20), 5) AS recall20 FROM (SELECT target_turn, {RAW} FROM pos GROUP BY 1)
UNION ALL SELECT 'micro', n, round(ndcg20, 5), round(recall20, 5) FROM (SELECT {RAW} FROM pos)"""))
def macro_and_micro_summary(spark, d):
    pos = _positions(spark, d)
    by_turn = metrics.macro_by(pos, "target_turn")
    five = [F.round("ndcg20", 5).alias("ndcg20"), F.round("recall20", 5).alias("recall20")]
    macro = metrics.macro_mean(by_turn, ["ndcg20", "recall20"]).crossJoin(by_turn.agg(F.sum("n").alias("n"))).select(F.lit("macro").alias("kind"), "n", *five)
    micro = metrics.macro_by(pos.withColumn("all", F.lit(1)), "all").select(F.lit("micro").alias("kind"), "n", *five)
    return macro.unionByName(micro)


@_query("recall_curve", with_(INTER, CONTEXT, RULES, RANKED, body="SELECT k, round(avg(CASE WHEN rank <= k THEN 1.0::DOUBLE ELSE 0 END), 6) AS recall FROM pos, (VALUES (1::BIGINT), (5), (10), (20)) v(k) GROUP BY 1"))
def recall_curve(spark, d):
    return _rounded(metrics.recall_curve(_positions(spark, d), [1, 5, 10, 20]), "recall")


@_query("stratified_recall", with_(INTER, CONTEXT, RULES, RANKED, SESSIONS, body="SELECT category, specificity, count(*) AS n, count(rank) AS hits FROM pos JOIN sessions USING (session_id) GROUP BY 1, 2"))
def stratified_recall(spark, d):
    pos = _positions(spark, d).join(T.sessions(spark, d), "session_id")
    return pos.groupBy("category", "specificity").agg(F.count("*").alias("n"), F.count("position").alias("hits"))


@_query("mrr_retrieved_only", with_(INTER, CONTEXT, RULES, RANKED, body="SELECT count(*) AS n, round(avg(CASE WHEN rank <= 10 THEN 1.0::DOUBLE / rank ELSE 0 END), 6) AS mrr10 FROM pos SEMI JOIN (SELECT DISTINCT session_id FROM ranked) l USING (session_id)"))
def mrr_retrieved_only(spark, d):
    return metrics.macro_by(_positions(spark, d, "exclude").withColumn("all", F.lit(1)), "all", 10).select("n", F.round("mrr10", 6).alias("mrr10"))


@_query("cvar_by_group", with_(INTER, CONTEXT, RULES, RANKED, SESSIONS, """v AS (SELECT country, session_id, CASE WHEN rank <= 20 THEN 1 / log2(rank + 1) ELSE 0 END AS x FROM pos JOIN sessions USING (session_id)),
g AS (SELECT country, user_id % 10 AS g, avg(x) AS x FROM v JOIN (SELECT session_id, user_id FROM sessions) u USING (session_id) GROUP BY 1, 2),
r AS (SELECT *, count(*) OVER (PARTITION BY country) AS n, row_number() OVER (PARTITION BY country ORDER BY x) AS r FROM g)""",
    body="SELECT country, round(avg(x), 6) AS cvar, round(min(x), 6) AS worst FROM r WHERE r <= greatest(1, round_even(0.3::DOUBLE * n, 0)) GROUP BY 1"))
def cvar_by_group(spark, d):
    pos = _positions(spark, d).join(T.sessions(spark, d), "session_id")
    from tessera.functions.columns import ndcg_at

    groups = pos.groupBy("country", (F.col("user_id") % 10).alias("g")).agg(F.avg(ndcg_at(F.col("position"), 20)).alias("x"))
    return _rounded(metrics.cvar(groups, ["country"], "x", 0.7), "cvar", "worst")


@_query("top_popular_window", with_(INTER, """daily AS (SELECT session_date, track_id, count(*) AS n FROM inter GROUP BY 1, 2),
w AS (SELECT d.session_date, track_id, sum(n)::BIGINT AS plays FROM (SELECT DISTINCT session_date FROM inter) d JOIN daily x ON x.session_date < d.session_date AND x.session_date >= d.session_date - INTERVAL 7 DAY GROUP BY 1, 2)""",
    body="SELECT CAST(session_date AS VARCHAR) AS session_date, track_id, plays, row_number() OVER (PARTITION BY session_date ORDER BY plays DESC, track_id) AS rank FROM w QUALIFY rank <= 10"))
def top_popular_window(spark, d):
    return topk_per_group(cf.popularity_window(T.interactions(spark, d), 7), ["session_date"], [F.col("plays").desc(), F.col("track_id")], 10).withColumn("session_date", F.col("session_date").cast("string"))


WINDOWS = {"7": 7, "28": 28, "182": 182, "365": 365, "1825": 1825, "all": None}


@_query("popularity_windows", with_(INTER, """daily AS (SELECT session_date, track_id, count(*) AS n FROM inter GROUP BY 1, 2),
p AS (SELECT d.session_date, track_id, """ + ", ".join(f"sum(n) FILTER (x.session_date >= d.session_date - {v if v else 99999})::BIGINT AS w{k}" for k, v in WINDOWS.items()) + """
  FROM (SELECT DISTINCT session_date FROM inter) d JOIN daily x ON x.session_date < d.session_date GROUP BY 1, 2),
w AS (""" + " UNION ALL ".join(f"SELECT '{k}' AS days, session_date, track_id, w{k} AS plays FROM p WHERE w{k} > 0" for k in WINDOWS) + ")",
    body="SELECT days, CAST(session_date AS VARCHAR) AS session_date, track_id, round(ln(1 + plays), 6) AS score, row_number() OVER (PARTITION BY days, session_date ORDER BY plays DESC, track_id) AS rank FROM w QUALIFY rank <= 3"))
def popularity_windows(spark, d):
    """The most played tracks of the last week, month, half year, year, five years and of all time, on every date."""
    top = cf.top_of_windows(T.interactions(spark, d), list(WINDOWS.values()), 3)
    top = top.withColumn("days", F.element_at(F.array(*map(F.lit, WINDOWS)), F.col("window") + 1))
    return top.select("days", F.col("session_date").cast("string").alias("session_date"), "track_id", F.round(F.log1p("plays"), 6).alias("score"), "rank")


@_query("popularity_fallback", with_(INTER, TRACKS, body="SELECT track_id, year, round(ln(1 + count(*)), 6) AS score FROM inter JOIN tracks USING (track_id) WHERE year IS NOT NULL GROUP BY 1, 2"))
def popularity_fallback(spark, d):
    return _rounded(cf.popularity_fallback(T.interactions(spark, d), T.tracks(spark, d)), "score")


@_query("profile_popularity_backoff", with_(INTER, SESSIONS, """p AS (SELECT s.country, s.segment, track_id, count(*) AS n FROM inter JOIN sessions s USING (session_id) GROUP BY 1, 2, 3),
tot AS (SELECT country, segment, sum(n) AS a FROM p GROUP BY 1, 2),
own AS (SELECT p.*, row_number() OVER (PARTITION BY p.country, p.segment ORDER BY n DESC, track_id) AS rank FROM p JOIN tot ON tot.country = p.country AND tot.segment = p.segment WHERE a >= 450 QUALIFY rank <= 5),
everyone AS (SELECT track_id, sum(n)::BIGINT AS n, row_number() OVER (ORDER BY sum(n) DESC, track_id) AS rank FROM p GROUP BY 1 QUALIFY rank <= 5)""",
    body="SELECT country, segment, track_id, n, rank, false AS backed_off FROM own UNION ALL SELECT country, segment, track_id, n, rank, true FROM tot, everyone WHERE a < 450"))
def profile_popularity_backoff(spark, d):
    profiles = T.sessions(spark, d).select("session_id", "country", "segment")
    return cf.profile_popularity(T.interactions(spark, d), profiles, ["country", "segment"], 450, 5)
