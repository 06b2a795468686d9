"""Queries of splits, shift statistics, dense vectors and rule-based candidates, and the SQL for them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.operators import catalogue, dense, heuristic, metrics, splits
from tessera.operators.ranking import topk_per_group
from tessera.plans.sql import CONTEXT, INTER, LIFT, SESSIONS, TRACKS, with_
from tessera.sources import tables as T

QUERIES, SQL = {}, {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


def _unit(*parts: str) -> str:
    return "(('0x' || substr(sha256(" + " || ':' || ".join(parts) + "), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE)"


@_query("context_gt_split", with_(INTER, CONTEXT, body="SELECT ctx.session_id, turn, track_id, target_turn, gt_track_id FROM ctx JOIN gt USING (session_id) UNION ALL SELECT session_id, NULL, NULL, max(turn), max(track_id) FROM inter GROUP BY 1 HAVING max(turn) < 2"))
def context_gt_split(spark, d):
    """Context rows of every session with its last turn as truth; sessions of one turn stay with no context."""
    inter = T.interactions(spark, d)
    both = T.context(inter).join(T.ground_truth(inter), "session_id").select("session_id", "turn", "track_id", "target_turn", "gt_track_id")
    alone = inter.groupBy("session_id").agg(F.max("turn").alias("target_turn"), F.max("track_id").alias("gt_track_id")).where("target_turn < 2")
    return both.unionByName(alone, allowMissingColumns=True)


@_query("session_injection", with_(INTER, "s AS (SELECT DISTINCT session_id, user_id, session_date FROM inter)", """x AS (SELECT session_id, track_id, 0 AS injected FROM inter UNION ALL
  SELECT t.session_id, i.track_id, 1 FROM inter i JOIN s t ON i.user_id = t.user_id AND (i.session_date < t.session_date OR (i.session_date = t.session_date AND i.session_id < t.session_id)))""",
    body="SELECT session_id, count(*) FILTER (injected = 0) AS n_own, count(*) FILTER (injected = 1) AS n_injected, sum(track_id)::BIGINT AS tracks FROM (SELECT session_id, track_id, min(injected) AS injected FROM x GROUP BY 1, 2) GROUP BY 1"))
def session_injection(spark, d):
    rows = splits.inject_earlier(T.interactions(spark, d))
    return rows.groupBy("session_id").agg(F.count_if(F.col("injected") == 0).alias("n_own"), F.count_if(F.col("injected") == 1).alias("n_injected"), F.sum("track_id").alias("tracks"))


@_query("hash_holdout_split", f"SELECT c_custkey, {_unit('c_custkey', chr(39) + '42' + chr(39))} < 0.1::DOUBLE AS is_holdout FROM customer")
def hash_holdout_split(spark, d):
    return splits.hash_holdout(T.table(spark, d, "customer"), "c_custkey", "42", 0.1)


@_query("session_hash_split", "SELECT o_orderkey, CASE WHEN ('0x' || substr(sha1('42:' || o_orderkey), 1, 12))::BIGINT % 10000 < 1500 THEN 'val' ELSE 'train' END AS side FROM orders")
def session_hash_split(spark, d):
    return splits.session_split(T.table(spark, d, "orders"), "o_orderkey", "42", 1500)


@_query("split_manifest", "SELECT side, count(*) AS n, bit_xor(('0x' || substr(sha256(o_orderkey::VARCHAR), 1, 13))::BIGINT) AS digest FROM (SELECT o_orderkey, CASE WHEN ('0x' || substr(sha1('42:' || o_orderkey), 1, 12))::BIGINT % 10000 < 1500 THEN 'val' ELSE 'train' END AS side FROM orders) GROUP BY 1")
def split_manifest(spark, d):
    return splits.manifest(splits.session_split(T.table(spark, d, "orders"), "o_orderkey", "42", 1500), "o_orderkey", "side")


@_query("greedy_holdout_cumsum", """SELECT o_custkey, n_sessions FROM (SELECT *, coalesce(sum(n_sessions) OVER (ORDER BY sha256(o_custkey || ':42') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b
  FROM (SELECT o_custkey, count(DISTINCT o_orderkey) AS n_sessions FROM orders GROUP BY 1)) WHERE b < 1000""")
def greedy_holdout_cumsum(spark, d):
    return splits.greedy_holdout(T.table(spark, d, "orders"), "o_custkey", "o_orderkey", "42", 1000)


# The published distribution of prior turns of the blind set, of 80 sessions.
PRIOR_TURNS = [20, 15, 10, 5, 8, 9, 8, 5]


def _cdf_case() -> str:
    total, out = 0.0, []
    for k, n in enumerate(PRIOR_TURNS[:-1]):
        total += n / 80
        out.append(f"WHEN u < {total!r}::DOUBLE THEN {k}")
    return "CASE " + " ".join(out) + f" ELSE {len(PRIOR_TURNS) - 1} END"


@_query("augmented_truncation", with_(INTER, f"a AS (SELECT session_id, aug_id, CAST({_cdf_case()} AS BIGINT) AS max_turn FROM (SELECT session_id, aug_id, {_unit('session_id', 'aug_id', chr(39) + '7' + chr(39))} AS u FROM (SELECT DISTINCT session_id FROM inter), (VALUES (0::BIGINT), (1), (2)) v(aug_id)))",
    body="SELECT session_id, aug_id, max_turn, count(*) AS n, sum(track_id)::BIGINT AS tracks FROM inter JOIN a USING (session_id) WHERE turn <= max_turn + 1 GROUP BY 1, 2, 3"))
def augmented_truncation(spark, d):
    inter = T.interactions(spark, d)
    draws = splits.augmented(inter.select("session_id").distinct(), "session_id", [n / 80 for n in PRIOR_TURNS], 3, "7")
    return splits.truncated(inter, draws, "session_id").groupBy("session_id", "aug_id", "max_turn").agg(F.count("*").alias("n"), F.sum("track_id").alias("tracks"))


SUB = f"sub AS (SELECT s AS subset_id, o_orderkey FROM orders, range(20) r(s) WHERE o_totalprice > 0 QUALIFY row_number() OVER (PARTITION BY s ORDER BY -ln(greatest({_unit('o_orderkey', 's', chr(39) + '11' + chr(39))}, 1e-15)) / o_totalprice, o_orderkey) <= 80)"


def _subsets(spark, d):
    return splits.weighted_subsets(T.table(spark, d, "orders"), "o_orderkey", "o_totalprice", 20, 80, "11")


@_query("weighted_subsets", with_(SUB, body="SELECT subset_id, o_orderkey FROM sub"))
def weighted_subsets(spark, d):
    return _subsets(spark, d)


@_query("subset_summary", with_(SUB, "m AS (SELECT subset_id, avg(x) AS score FROM (SELECT subset_id, o_orderstatus, avg(o_totalprice) / 1000 AS x FROM sub JOIN orders USING (o_orderkey) GROUP BY 1, 2) GROUP BY 1)",
    body="SELECT round(avg(score), 4) AS mean, round(stddev_samp(score), 4) AS std, round(median(score), 4) AS median, round(quantile_cont(score, 0.05), 4) AS low90, round(quantile_cont(score, 0.95), 4) AS high90 FROM m"))
def subset_summary(spark, d):
    """Scores of weighted subsets: the mean over buckets of bucket means, then their spread over subsets."""
    rows = _subsets(spark, d).join(T.table(spark, d, "orders"), "o_orderkey")
    score = rows.groupBy("subset_id", "o_orderstatus").agg((F.avg("o_totalprice") / 1000).alias("x")).groupBy("subset_id").agg(F.avg("x").alias("score"))
    r = lambda c, n: F.round(c, 4).alias(n)
    return score.agg(r(F.avg("score"), "mean"), r(F.stddev_samp("score"), "std"), r(F.median("score"), "median"), r(F.percentile("score", 0.05), "low90"), r(F.percentile("score", 0.95), "high90"))


@_query("marginal_pmfs", "SELECT c_mktsegment AS value, round((count(*) + 0.5::DOUBLE) / ((SELECT count(*) FROM customer) + 0.5 * (SELECT count(DISTINCT c_mktsegment) FROM customer)), 6) AS p FROM customer GROUP BY 1")
def marginal_pmfs(spark, d):
    return _six(splits.pmf(T.table(spark, d, "customer"), "c_mktsegment", 0.5), "p")


@_query("kl_and_tv_distance", with_("p AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS p FROM orders WHERE o_orderstatus = 'F' GROUP BY 1)", "q AS (SELECT o_orderpriority AS v, count(*) / (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS q FROM orders WHERE o_orderstatus = 'O' GROUP BY 1)",
    body="SELECT round(sum(CASE WHEN p > 0 AND q > 0 THEN p * (ln(p) - ln(q)) ELSE 0 END), 6) AS kl, round(sum(abs(coalesce(p, 0) - coalesce(q, 0))) / 2, 6) AS tv FROM p FULL JOIN q USING (v)"))
def kl_and_tv_distance(spark, d):
    orders = T.table(spark, d, "orders")
    of = lambda s: splits.pmf(orders.where(F.col("o_orderstatus") == s), "o_orderpriority")
    return _six(splits.divergences(of("F"), of("O")), "kl", "tv")


def _raking(rounds: int) -> str:
    """Two scalings a round, one CTE each."""
    out = ["""cells AS (SELECT o_orderpriority AS p, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1, 2), dear AS (SELECT * FROM orders WHERE o_totalprice >= 400000),
gp AS (SELECT o_orderpriority AS p, count(*) / (SELECT count(*) FROM dear) AS g FROM dear GROUP BY 1), gs AS (SELECT o_orderstatus AS s, count(*) / (SELECT count(*) FROM dear) AS g FROM dear GROUP BY 1),
r0 AS (SELECT cells.*, gp.g AS gp, gs.g AS gs, 1.0::DOUBLE AS w FROM cells LEFT JOIN gp USING (p) LEFT JOIN gs USING (s))"""]
    out += [f"r{k + 1} AS (SELECT * REPLACE (w * coalesce(g{'ps'[k % 2]} * sum(w * n) OVER () / nullif(sum(w * n) OVER (PARTITION BY {'ps'[k % 2]}), 0), 0) AS w) FROM r{k})" for k in range(2 * rounds)]
    return ",\n".join(out)


@_query("raked_cells", with_(_raking(8), body="SELECT p AS o_orderpriority, s AS o_orderstatus, n, round(w, 6) AS w FROM r16"))
def raked_cells(spark, d):
    """Weights of (priority, status) cells of all orders so that both margins meet those of the dearest fifth."""
    orders = T.table(spark, d, "orders")
    cells = orders.groupBy("o_orderpriority", "o_orderstatus").agg(F.count("*").alias("n"))
    dear = orders.where("o_totalprice >= 400000")
    goals = {c: splits.pmf(dear, c) for c in ("o_orderpriority", "o_orderstatus")}
    return _six(splits.rake(cells, goals, 8), "w")


@_query("density_ratio_weights", """WITH p AS (SELECT o_orderkey, least(greatest(o_totalprice / 600000, 1e-6), 1 - 1e-6) AS p FROM orders), w AS (SELECT o_orderkey, p / (1 - p) * 10.0 AS w FROM p), q AS (SELECT quantile_cont(w, 0.99) AS c FROM w)
SELECT o_orderkey, round(w, 6) AS weight_raw, round(least(w, c), 6) AS weight_clipped FROM w, q""")
def density_ratio_weights(spark, d):
    orders = T.table(spark, d, "orders").select("o_orderkey", splits.density_ratio(F.col("o_totalprice") / 600000, 100, 10).alias("weight_raw"))
    return _six(splits.clipped(orders, "weight_raw", 0.99, "weight_clipped"), "weight_raw", "weight_clipped")


@_query("effective_sample_size", "SELECT o_orderstatus, round(pow(sum(o_totalprice / 1000), 2) / sum(pow(o_totalprice / 1000, 2)), 3) AS ess FROM orders GROUP BY 1")
def effective_sample_size(spark, d):
    rows = T.table(spark, d, "orders").withColumn("w", F.col("o_totalprice") / 1000)
    return metrics.effective_size(rows, ["o_orderstatus"], "w").withColumn("ess", F.round("ess", 3))


LAB = "lab AS (SELECT doc_id, quality AS y, (n_chars % 997) / 997 AS p FROM labels JOIN documents USING (doc_id))"


def _labelled(spark, d):
    return T.table(spark, d, "labels").join(T.table(spark, d, "documents").select("doc_id", "n_chars"), "doc_id").select("doc_id", F.col("quality").alias("y"), (F.col("n_chars") % 997 / 997).alias("p"))


@_query("ece_bins", with_(LAB, body="SELECT CAST(least(floor(p * 10), 9) AS BIGINT) AS bin, count(*) AS n, round(abs(avg(p) - avg(y)), 6) AS gap, round(count(*) / (SELECT count(*) FROM lab), 6) AS weight FROM lab GROUP BY 1"))
def ece_bins(spark, d):
    return _six(metrics.expected_calibration_error(_labelled(spark, d), "p", "y"), "gap", "weight")


DELTA = "x AS (SELECT c_nationkey::BIGINT AS country, c_acctbal / 10000 - 0.45 AS delta FROM customer)"


@_query("paired_eb_ci", with_(DELTA, body="SELECT country, count(*) AS n, round(avg(delta), 6) AS mean, round(avg(delta) - sqrt(2 * coalesce(var_samp(delta), 0) * ln(60) / count(*)) - 3 * ln(60) / count(*), 6) AS low, round(avg(delta) + sqrt(2 * coalesce(var_samp(delta), 0) * ln(60) / count(*)) + 3 * ln(60) / count(*), 6) AS high FROM x GROUP BY 1"))
def paired_eb_ci(spark, d):
    rows = T.table(spark, d, "customer").select(F.col("c_nationkey").cast("long").alias("country"), (F.col("c_acctbal") / 10000 - 0.45).alias("delta"))
    return _six(metrics.bernstein_interval(rows, ["country"], "delta"), "mean", "low", "high")


@_query("holm_bonferroni", """WITH p AS (SELECT n_nationkey::BIGINT AS k, (n_nationkey * 7 % 25) / 2000 AS p FROM nation), r AS (SELECT *, p <= 0.05::DOUBLE / (count(*) OVER () - row_number() OVER (ORDER BY p, k) + 1) AS ok FROM p)
SELECT k, round(p, 6) AS p, min(ok::INT) OVER (ORDER BY p, k ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) = 1 AS rejected FROM r""")
def holm_bonferroni(spark, d):
    p = T.table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("k"), (F.col("n_nationkey") * 7 % 25 / 2000).alias("p"))
    return _six(metrics.holm(p, "p", "k"), "p")


@_query("apportionment", """WITH s AS (SELECT c_mktsegment AS value, count(*) / (SELECT count(*) FROM customer) * 137 AS x FROM customer GROUP BY 1), f AS (SELECT value, floor(x) AS f, round(x - floor(x), 9) AS r FROM s)
SELECT value, CAST(f + (row_number() OVER (ORDER BY r DESC, value) <= 137 - sum(f) OVER ())::INT AS BIGINT) AS seats FROM f""")
def apportionment(spark, d):
    shares = T.table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("value")).agg(F.count("*").alias("n"))
    return splits.apportion(shares, "value", "n", 137)


V = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings)"


def _vectors(spark, d):
    return T.table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("vector"))


@_query("tower_norm_check", with_(V, body="SELECT count(*) AS n, count(*) FILTER (abs(sqrt(list_inner_product(e, e)) - 1) > 1e-3) AS n_off, round(max(abs(sqrt(list_inner_product(e, e)) - 1)), 6) AS largest_gap FROM v"))
def tower_norm_check(spark, d):
    return _six(dense.norm_check(_vectors(spark, d), "vector"), "largest_gap")


@_query("embedding_pair_cosines", with_(V, body="SELECT a.vec_id AS a, a.vec_id + 1 AS b, round(list_cosine_similarity(a.e, b.e), 6) AS cosine FROM v a LEFT JOIN v b ON b.vec_id = a.vec_id + 1"))
def embedding_pair_cosines(spark, d):
    v = _vectors(spark, d)
    return _six(dense.pair_cosines(v.select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")), v, "a", "b", "id", "vector"), "cosine").select("a", "b", "cosine")


CEN = """dims AS (SELECT label, k, sum(e[k]) AS s FROM v, range(1, 65) r(k) GROUP BY 1, 2), cen AS (SELECT label, list(s ORDER BY k) AS c FROM dims GROUP BY 1)"""


@_query("session_centroid_cosine", with_(V, CEN, body="SELECT vec_id, label, round(list_cosine_similarity(e, c), 6) AS cosine FROM v JOIN cen USING (label)"))
def session_centroid_cosine(spark, d):
    """Every vector against the centroid of its label (the group it belongs to)."""
    from tessera.functions.columns import cosine

    v = _vectors(spark, d)
    c = dense.centroid(v, ["label"], "vector").withColumnRenamed("vector", "c")
    return v.join(c, "label").select(F.col("id").alias("vec_id"), "label", F.round(cosine("vector", "c"), 6).alias("cosine"))


TOPK = "s AS (SELECT q.vec_id AS query_id, x.vec_id AS id, round(list_inner_product(q.e, x.e), 9) AS score FROM v q JOIN v x ON q.vec_id <> x.vec_id {where})"


@_query("dense_topk", with_(V, TOPK.format(where=""), body="SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 10"))
def dense_topk(spark, d):
    v = _vectors(spark, d)
    return dense.dense_topk(v, v, 10)


@_query("item_item_embedding_topk", with_(V, TOPK.format(where="WHERE list_inner_product(q.e, x.e) > 0"), body="SELECT query_id AS i, id AS j, round(score, 6) AS w, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 5"))
def item_item_embedding_topk(spark, d):
    v = _vectors(spark, d)
    return _six(dense.dense_topk(v, v, 5).where("score > 0").select(F.col("query_id").alias("i"), F.col("id").alias("j"), F.col("score").alias("w"), "rank"), "w")


@_query("max_similarity_to_group", with_(V, body="SELECT a.vec_id AS a, b.label, round(max(list_inner_product(a.e, b.e)), 6) AS max_similarity FROM v a JOIN v b ON b.label = (a.label + 1) % 10 GROUP BY 1, 2"))
def max_similarity_to_group(spark, d):
    v = _vectors(spark, d)
    asks = v.withColumn("label", (F.col("label") + 1) % 10)
    found = dense.max_similarity_to_group(asks, v, "label").join(asks.select("id", "label"), "id")
    return _six(found.select(F.col("id").alias("a"), "label", "max_similarity"), "max_similarity")


@_query("decade_top", with_(INTER, TRACKS, "c AS (SELECT track_id, count(*) AS plays FROM inter GROUP BY 1)", body="SELECT year // 10 * 10 AS decade, track_id, coalesce(plays, 0) AS plays, row_number() OVER (PARTITION BY year // 10 ORDER BY coalesce(plays, 0) DESC, track_id) AS rank FROM tracks LEFT JOIN c USING (track_id) WHERE year IS NOT NULL QUALIFY rank <= 10"))
def decade_top(spark, d):
    inter = T.interactions(spark, d)
    return heuristic.decade_top(T.tracks(spark, d), inter.groupBy("track_id").agg(F.count("*").alias("plays")), 10)


CAT = {"1": 1.10, "2": 1.00, "3": 1.20, "4": 0.65, "5": 0.75}
SPEC = {"F": 1.20, "O": 1.05, "P": 1.00}
V0 = """t AS (SELECT tracks.*, CASE WHEN popularity > 0 THEN CASE WHEN popularity < q1 THEN 0 WHEN popularity < q2 THEN 1 ELSE 2 END ELSE -1 END AS b, coalesce((popularity - m) / nullif(s, 0), 0) AS z
  FROM tracks, (SELECT quantile_cont(popularity, 0.33) AS q1, quantile_cont(popularity, 0.67) AS q2, avg(popularity) AS m, stddev_pop(popularity) AS s FROM tracks WHERE popularity > 0)),
h AS (SELECT session_id, turn, t.* FROM ctx JOIN t USING (track_id)),
l AS (SELECT h.session_id, artist AS la, album AS ll, year AS ly, b AS lb FROM h JOIN (SELECT session_id, max(turn) AS turn FROM h GROUP BY 1) USING (session_id, turn)),
ha AS (SELECT DISTINCT session_id, artist FROM h), hl AS (SELECT DISTINCT session_id, album FROM h),
dec AS (SELECT year // 10 * 10 AS decade, track_id FROM t WHERE year > 0 QUALIFY row_number() OVER (PARTITION BY year // 10 ORDER BY popularity DESC, track_id) <= 150),
pool AS (SELECT DISTINCT session_id, track_id FROM (SELECT session_id, track_id FROM ha JOIN t USING (artist) UNION ALL SELECT session_id, track_id FROM hl JOIN t USING (album)
  UNION ALL SELECT session_id, track_id FROM l JOIN dec ON decade IN (ly // 10 * 10 - 10, ly // 10 * 10, ly // 10 * 10 + 10)) ANTI JOIN h USING (session_id, track_id)),
w AS (SELECT session_id, """ + f"(CASE category {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}::DOUBLE' for k, v in CAT.items())} END * CASE specificity {' '.join(f'WHEN {chr(39)}{k}{chr(39)} THEN {v}::DOUBLE' for k, v in SPEC.items())} END)" + """ AS boost FROM sessions),
z AS (SELECT p.session_id, p.track_id, 3.0::DOUBLE * boost * coalesce(t.album = ll, false)::INT AS album_last, 2.5::DOUBLE * boost * coalesce(t.artist = la, false)::INT AS artist_last,
    1.5::DOUBLE * boost * (hl.album IS NOT NULL)::INT AS album_any, 1.2::DOUBLE * boost * (ha.artist IS NOT NULL)::INT AS artist_any,
    0.6::DOUBLE * coalesce(exp(-abs(t.year - ly) / 5), 0) AS year_term, 0.4::DOUBLE * coalesce(lb >= 0 AND t.b = lb, false)::INT AS pop_match, 0.05::DOUBLE * t.z AS pop_z_term
  FROM pool p JOIN t USING (track_id) JOIN l USING (session_id) JOIN w USING (session_id) LEFT JOIN ha ON ha.session_id = p.session_id AND ha.artist = t.artist LEFT JOIN hl ON hl.session_id = p.session_id AND hl.album = t.album),
v0 AS (SELECT *, album_last + artist_last + album_any + artist_any + year_term + pop_match + pop_z_term AS score,
  row_number() OVER (PARTITION BY session_id ORDER BY round(album_last + artist_last + album_any + artist_any + year_term + pop_match + pop_z_term, 9) DESC, track_id) AS rank FROM z QUALIFY rank <= {k})"""


def _boosts(spark, d):
    of = lambda c, table: F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[F.col(c)]
    return T.sessions(spark, d).select("session_id", (of("category", CAT) * of("specificity", SPEC)).alias("boost"))


def _v0(spark, d, k):
    return heuristic.additive_topk(T.context(T.interactions(spark, d)), T.tracks(spark, d), k, _boosts(spark, d))


@_query("heuristic_v0_topk", with_(INTER, CONTEXT, TRACKS, SESSIONS, V0.format(k=10), body="SELECT session_id, track_id, " + ", ".join(f"round({c}, 6) + 0.0 AS {c}" for c in [*heuristic.TERMS, "score"]) + ", rank FROM v0"))
def heuristic_v0_topk(spark, d):
    """Every track of the seed artists and albums, and 150 a decade, by the sum of seven terms that stay beside it."""
    return _six(_v0(spark, d, 10), *heuristic.TERMS, "score")


@_query("heuristic_v3_fusion", with_(INTER, CONTEXT, TRACKS, SESSIONS, V0.format(k=5), """c AS (SELECT track_id, count(*) AS plays FROM inter GROUP BY 1), mine AS (SELECT session_id, track_id, row_number() OVER (PARTITION BY session_id ORDER BY max(turn) DESC) AS rank FROM ctx GROUP BY 1, 2 QUALIFY rank <= 3),
pop AS (SELECT s.session_id, track_id, rank FROM (SELECT DISTINCT session_id FROM gt) s, (SELECT track_id, row_number() OVER (ORDER BY plays DESC, track_id) AS rank FROM c QUALIFY rank <= 2)),
f AS (SELECT session_id, track_id, sum(1 / (60 + rank - 1)) AS score FROM (SELECT session_id, track_id, rank FROM v0 UNION ALL SELECT * FROM mine UNION ALL SELECT * FROM pop) GROUP BY 1, 2),
top AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY round(score, 9) DESC, track_id) AS rank FROM f QUALIFY rank <= 12),
more AS (SELECT n.session_id, p.track_id, 0.0::DOUBLE AS score, n + row_number() OVER (PARTITION BY n.session_id ORDER BY place) AS rank FROM (SELECT session_id, max(rank) AS n FROM top GROUP BY 1) n, (SELECT track_id, row_number() OVER (ORDER BY plays DESC, track_id) AS place FROM c) p
  ANTI JOIN top ON top.session_id = n.session_id AND top.track_id = p.track_id WHERE place <= 40)""", body="SELECT session_id, track_id, round(score, 6) AS score, rank FROM top UNION ALL SELECT session_id, track_id, score, rank FROM more WHERE rank <= 12"))  # fmt: skip
def heuristic_v3_fusion(spark, d):
    """The additive list, what the session heard last and the most played tracks, fused by place from 0 and padded."""
    inter = T.interactions(spark, d)
    heard = T.context(inter).groupBy("session_id", "track_id").agg(F.max("turn").alias("t"))
    mine = topk_per_group(heard, ["session_id"], [F.col("t").desc()], 3)
    plays = inter.groupBy("track_id").agg(F.count("*").alias("plays")).orderBy(F.col("plays").desc(), "track_id").limit(12)
    place = plays.withColumn("place", F.row_number().over(Window.orderBy(F.col("plays").desc(), "track_id")).cast("long"))  # 12 rows
    pop = T.ground_truth(inter).select("session_id").crossJoin(F.broadcast(place.where("place <= 2").select("track_id", F.col("place").alias("rank"))))
    return _six(heuristic.fused_with_padding([_v0(spark, d, 5), mine, pop], place, ["session_id"], 60.0, 12), "score")


_B = heuristic.BUDGET
NEG = """c AS (SELECT track_id, count(*) AS plays FROM inter GROUP BY 1),
t AS (SELECT tracks.*, coalesce(plays, 0) AS plays, CASE WHEN popularity > 0 THEN CASE WHEN popularity < q1 THEN 0 WHEN popularity < q2 THEN 1 ELSE 2 END ELSE -1 END AS b
  FROM tracks LEFT JOIN c USING (track_id), (SELECT quantile_cont(popularity, 0.33) AS q1, quantile_cont(popularity, 0.67) AS q2 FROM tracks WHERE popularity > 0)),
a AS (SELECT session_id, category, t.* FROM gt JOIN t ON t.track_id = gt_track_id JOIN sessions USING (session_id)),
h AS (SELECT DISTINCT session_id, t.* FROM ctx JOIN t USING (track_id)),
m1 AS (SELECT session_id, list(track_id ORDER BY plays DESC, track_id) AS l FROM h GROUP BY 1),
m2 AS (SELECT session_id, list(track_id ORDER BY plays DESC, track_id) AS l FROM (SELECT DISTINCT h.session_id, t.track_id, t.plays FROM h JOIN t USING (album)) GROUP BY 1),
m3 AS (SELECT session_id, list(track_id ORDER BY plays DESC, track_id) AS l FROM (SELECT DISTINCT h.session_id, t.track_id, t.plays FROM h JOIN t USING (artist)) GROUP BY 1),
m4 AS (SELECT album, list(track_id ORDER BY plays DESC, track_id) AS l FROM t GROUP BY 1), m5 AS (SELECT artist, list(track_id ORDER BY plays DESC, track_id) AS l FROM t GROUP BY 1),
m6 AS (SELECT b, list(track_id ORDER BY plays DESC, track_id) AS l FROM t WHERE b >= 0 GROUP BY 1),
m7 AS (SELECT y.year, list(track_id ORDER BY plays DESC, track_id) AS l FROM (SELECT DISTINCT year FROM t WHERE year > 0) y JOIN t ON abs(t.year - y.year) <= 5 GROUP BY 1),
m8 AS (SELECT category, list(track_id ORDER BY round(score, 9) DESC, track_id) AS l FROM (SELECT category, track_id, sum(lift) AS score FROM (SELECT track_id, unnest(tags) AS tag FROM tracks) JOIN lift USING (tag) GROUP BY 1, 2) GROUP BY 1),
m9 AS (SELECT list(track_id ORDER BY plays DESC, track_id) AS l FROM t),
k0 AS MATERIALIZED (SELECT a.session_id, [a.track_id] AS k, m1.l AS l1, m2.l AS l2, m3.l AS l3, m4.l AS l4, m5.l AS l5, m6.l AS l6, m7.l AS l7, m8.l AS l8, m9.l AS l9
  FROM a LEFT JOIN m1 ON m1.session_id = a.session_id LEFT JOIN m2 ON m2.session_id = a.session_id LEFT JOIN m3 ON m3.session_id = a.session_id LEFT JOIN m4 ON m4.album = a.album LEFT JOIN m5 ON m5.artist = a.artist
  LEFT JOIN m6 ON m6.b = a.b LEFT JOIN m7 ON m7.year = a.year LEFT JOIN m8 ON m8.category = a.category, m9),
""" + "".join(f"p{n} AS MATERIALIZED (SELECT *, list_filter(coalesce(l{n}, []), lambda x: NOT list_contains(k, x))[1:{q}] AS p{n} FROM k{n - 1}),\nk{n} AS MATERIALIZED (SELECT * REPLACE (list_concat(k, p{n}) AS k) FROM p{n}),\n" for n, q in enumerate(_B.values(), 1)) + """
u AS (""" + " UNION ALL ".join(f"SELECT session_id, '{name}' AS bucket, {n} AS n, i, p{n}[i] AS track_id FROM k9, unnest(range(1, len(p{n}) + 1)) AS u(i)" for n, name in enumerate(_B, 1)) + ")"


@_query("hard_negatives", with_(INTER, CONTEXT, TRACKS, SESSIONS, LIFT, NEG, body="SELECT session_id, bucket, track_id, row_number() OVER (PARTITION BY session_id ORDER BY n, i) AS place FROM u QUALIFY place <= 32"))
def hard_negatives(spark, d):
    """Thirty-two negatives of every session's last track, from nine buckets in turn."""
    inter, tracks, sessions = T.interactions(spark, d), T.tracks(spark, d), T.sessions(spark, d)
    targets = T.ground_truth(inter).select("session_id", F.col("gt_track_id").alias("track_id")).join(sessions.select("session_id", "category"), "session_id")
    plays = inter.join(tracks, "track_id").select("session_id", F.explode("tags").alias("tag")).join(sessions, "session_id")
    scored = tracks.select("track_id", F.explode("tags").alias("tag")).join(catalogue.category_lift(plays, "category", "tag"), "tag").groupBy("category", "track_id").agg(F.sum("lift").alias("score"))
    lift = topk_per_group(scored, ["category"], [F.round("score", 9).desc(), F.col("track_id")], 33, rank="place")
    return heuristic.hard_negatives(targets, T.context(inter), tracks, inter.groupBy("track_id").agg(F.count("*").alias("plays")), lift)


@_query("transition_rates", with_(INTER, TRACKS, "r AS (SELECT session_id, turn, t.* FROM inter JOIN tracks t USING (track_id))", body="SELECT count(*) AS n, round(avg((a.artist = b.artist)::INT), 6) AS same_artist, round(avg((a.album = b.album)::INT), 6) AS same_album, round(avg(coalesce(abs(a.year - b.year) <= 5, false)::INT), 6) AS near_year FROM r a JOIN r b ON a.session_id = b.session_id AND a.turn = b.turn + 1"))
def transition_rates(spark, d):
    return _six(heuristic.transition_rates(T.interactions(spark, d), T.tracks(spark, d)), "same_artist", "same_album", "near_year")


def _permutation_sql() -> str:
    from tessera.operators.permutation import PRIME, affine

    hashes = ", ".join(f"({p}, {a}, {b})" for p, (a, b) in enumerate(affine(200, "5"), 1))
    return with_(
        INTER, TRACKS, SESSIONS,
        "f AS (SELECT session_id, max((specificity = 'F')::INT) AS y, count(*)::DOUBLE AS turns, round(avg(popularity), 6) AS mean_popularity, round(max(popularity) - min(popularity), 6) AS spread FROM inter JOIN tracks USING (track_id) JOIN sessions USING (session_id) GROUP BY 1)",
        f"l AS (SELECT y, ('0x' || substr(sha256(session_id::VARCHAR), 1, 8))::BIGINT % {PRIME} AS x, unnest(['turns', 'mean_popularity', 'spread']) AS variant, unnest([turns, mean_popularity, spread]) AS s FROM f)",
        "k AS (SELECT *, rank() OVER (PARTITION BY variant ORDER BY s) + (count(*) OVER (PARTITION BY variant, s) - 1) / 2 AS r, count(*) OVER (PARTITION BY variant) AS n, sum(y) OVER (PARTITION BY variant)::BIGINT AS n1 FROM l)",
        f"h(p, a, b) AS (VALUES (0, 0, 0), {hashes})",
        f"d AS (SELECT variant, p, n, r, CASE WHEN p = 0 THEN y ELSE ((a * x + b) % {PRIME} < {PRIME} * n1 // n)::INT END AS y FROM k, h)",
        "a AS (SELECT variant, p, n, sum(y)::BIGINT AS m, (sum(r) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (n - sum(y))) AS auc FROM d GROUP BY 1, 2, 3)",
        body="""SELECT z.variant, z.n, z.m AS positives, round(z.auc, 6) AS auc, round(avg(a.auc), 6) AS null_mean, round(stddev_samp(a.auc), 6) AS null_sd,
  round((count(*) FILTER (round(abs(a.auc - 0.5), 9) >= round(abs(z.auc - 0.5), 9)) + 1) / (count(*) + 1), 6) AS p
FROM a z JOIN a ON a.variant = z.variant AND a.p > 0 WHERE z.p = 0 GROUP BY z.variant, z.n, z.m, z.auc""",
    )


@_query("permutation_shift", _permutation_sql())
def permutation_shift(spark, d):
    """Whether sessions of one status differ from the others in length and popularity, beside 200 permutations of the labels."""
    from tessera.operators import permutation

    rows = T.interactions(spark, d).join(T.tracks(spark, d).select("track_id", "popularity"), "track_id")
    p = F.col("popularity")
    stats = rows.groupBy("session_id").agg(F.count("*").cast("double").alias("turns"), F.round(F.avg(p), 6).alias("mean_popularity"), F.round(F.max(p) - F.min(p), 6).alias("spread"))
    labelled = stats.join(T.sessions(spark, d).select("session_id", (F.col("specificity") == "F").cast("int").alias("y")), "session_id")
    out = permutation.permutation_tests(labelled, ["turns", "mean_popularity", "spread"], "y", "session_id")
    return out.select("variant", "n", "positives", *[F.round(c, 6).alias(c) for c in ("auc", "null_mean", "null_sd", "p")])
