"""Queries of text retrieval and response analytics, and the SQL for them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import sets as S
from tessera.operators import text as X
from tessera.plans.sql import with_
from tessera.sources import tables as T
from tessera.sources.stored import stored

QUERIES, SQL = {}, {}


def _query(name: str, sql: str):
    def add(f):
        QUERIES[name], SQL[name] = f, sql
        return f

    return add


def _posts(name: str, table: str, key: str, text: str = "text") -> str:
    return f"{name} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(list_filter(regexp_split_to_array(lower({text}), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM {table}) GROUP BY 1, 2)"


D, Q = _posts("dp", "documents", "doc_id"), _posts("qp", "benchmark", "item_id")
N = "nn AS (SELECT count(*) AS n FROM documents), ddf AS (SELECT term, count(*) AS df FROM dp GROUP BY 1)"
MATCH = """hits AS (SELECT q.item_id, d.doc_id, sum(q.w * d.w) AS score FROM qw q JOIN dw d USING (term) GROUP BY 1, 2)"""
BEST = "SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hits QUALIFY rank <= 10"
BINARY = "qw AS (SELECT DISTINCT item_id, term, 1.0::DOUBLE AS w FROM qp)"


def _corpus(spark, d):
    docs, queries = T.table(spark, d, "documents"), T.table(spark, d, "benchmark")
    n = docs.agg(F.count("*").alias("n"))
    return X.postings(docs, "doc_id", F.col("text")), X.postings(queries, "item_id", F.col("text")), n


def _bm25(spark, d, qp, n):
    """BM25 weights of the queries' terms in documents; other terms are counted but never dealt."""
    docs = T.table(spark, d, "documents")
    return X.bm25_weights(X.postings(docs, "doc_id", F.col("text"), terms=qp), "doc_id", n, length=X.lengths(docs, "doc_id", F.col("text")))


def _six(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns or ("score",)})


@_query("tfidf_retrieval", with_(D, Q, N, "idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM ddf, nn)", *[
    f"{o}0 AS (SELECT {k}, term, (1 + ln(tf)) * idf AS w FROM {p} JOIN idf USING (term)), {o} AS (SELECT {k}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {k})) AS w FROM {o}0)" for o, k, p in (("dw", "doc_id", "dp"), ("qw", "item_id", "qp"))], MATCH, body=BEST))
def tfidf_retrieval(spark, d):
    dp, qp, n = _corpus(spark, d)
    dp = stored(dp, "postings")
    idf = X.smooth_idf(dp, n)
    return _six(X.match(X.tfidf_weights(qp, "item_id", idf), "item_id", X.tfidf_weights(dp, "doc_id", idf, qp), "doc_id", 10))


def _grams(name: str, table: str, key: str) -> str:
    return f"""{name}w AS (SELECT {key}, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '') AS w FROM {table}),
{name} AS (SELECT {key}, term, count(*) AS tf FROM (SELECT {key}, unnest(w) AS term FROM {name}w UNION ALL SELECT {key}, w[i] || ' ' || w[i + 1] FROM {name}w, unnest(range(1, len(w))) AS u(i)) GROUP BY 1, 2)"""


TFIDF = [f"{o}0 AS (SELECT {k}, term, (1 + ln(tf)) * idf AS w FROM {p} JOIN idf USING (term)), {o} AS (SELECT {k}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {k})) AS w FROM {o}0)" for o, k, p in (("dw", "doc_id", "dp"), ("qw", "item_id", "qp"))]


@_query("tfidf_bigram_retrieval", with_(_grams("dp", "documents", "doc_id"), _grams("qp", "benchmark", "item_id"), N, "idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM ddf, nn)", *TFIDF, MATCH, body=BEST))
def tfidf_bigram_retrieval(spark, d):
    """Terms of one and of two words."""
    docs, queries = T.table(spark, d, "documents"), T.table(spark, d, "benchmark")
    dp, qp = stored(X.postings(docs, "doc_id", F.col("text"), 2), "postings"), X.postings(queries, "item_id", F.col("text"), 2)
    idf = X.smooth_idf(dp, docs.agg(F.count("*").alias("n")))
    return _six(X.match(X.tfidf_weights(qp, "item_id", idf), "item_id", X.tfidf_weights(dp, "doc_id", idf, qp), "doc_id", 10))


@_query("weighted_term_retrieval", with_("src AS (SELECT doc_id, concat_ws(' ', source, source, source, lang, lang, text) AS text FROM documents)", _posts("dp", "src", "doc_id"),
    "cw AS (SELECT item, sum(tf * wt) AS tf, term FROM (SELECT conv_id AS item, term, count(*) AS tf, CASE role WHEN 'user' THEN 2 ELSE 1 END AS wt FROM (SELECT conv_id, role, unnest(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda w: w <> '')) AS term FROM conversations WHERE role IN ('user', 'assistant')) GROUP BY 1, 2, role) GROUP BY item, term)",
    "voc AS (SELECT term, df FROM (SELECT term, sum(tf) AS n, count(*) AS df FROM dp GROUP BY 1) ORDER BY n DESC, term LIMIT 500)", "nn AS (SELECT count(*) AS n FROM documents)", "idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM voc, nn)",
    *[f"{o}0 AS (SELECT {k}, term, (1 + ln(tf)) * idf AS w FROM {p} JOIN idf USING (term)), {o} AS (SELECT {k}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {k})) AS w FROM {o}0)" for o, k, p in (("dw", "doc_id", "dp"), ("qw", "item", "cw"))],
    "hits AS (SELECT q.item, d.doc_id, sum(q.w * d.w) AS score FROM qw q JOIN dw d USING (term) GROUP BY 1, 2)",
    body="SELECT item AS conv_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item ORDER BY round(score, 9) DESC, doc_id) AS rank FROM hits QUALIFY rank <= 10"))
def weighted_term_retrieval(spark, d):
    """Documents by texts of repeated fields, asked by conversations whose user turns weigh double, over the 500 most used terms."""
    docs, talk = T.table(spark, d, "documents"), T.table(spark, d, "conversations")
    dp = X.postings(docs, "doc_id", X.repeated_fields([(F.col("source"), 3), (F.col("lang"), 2), (F.col("text"), 1)]))
    said = lambda role, w: X.postings(talk.where(F.col("role") == role), "conv_id", F.col("text")).withColumn("weight", F.lit(w))
    qp = X.weighted_terms([said("user", 2), said("assistant", 1)], "conv_id")
    n = docs.agg(F.count("*").alias("n"))
    idf = stored(X.most_frequent_terms(dp, 500).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf")), "idf")
    return _six(X.match_dense(X.tfidf_weights(qp, "conv_id", idf), "conv_id", X.tfidf_weights(dp, "doc_id", idf), "doc_id", idf, 10))


BM25 = """dl AS (SELECT doc_id, sum(tf) AS dl FROM dp GROUP BY 1),
dw AS (SELECT doc_id, term, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl))) * ln((n - df + 0.5) / (df + 0.5) + 1) AS w FROM dp JOIN ddf USING (term) JOIN dl USING (doc_id), nn)"""


@_query("bm25_retrieval", with_(D, Q, N, BM25, BINARY, MATCH, body=BEST))
def bm25_retrieval(spark, d):
    _, qp, n = _corpus(spark, d)
    return _six(X.match(qp.select("item_id", "term", F.lit(1.0).alias("w")), "item_id", _bm25(spark, d, qp, n), "doc_id", 10))


def _field(f: str, expr: str) -> str:
    return ",\n".join([
        f"src_{f} AS (SELECT p_partkey, {expr} AS text FROM part)", _posts(f"p_{f}", f"src_{f}", "p_partkey"),
        f"df_{f} AS (SELECT term, count(*) AS df FROM p_{f} GROUP BY 1), dl_{f} AS (SELECT p_partkey, sum(tf) AS dl FROM p_{f} GROUP BY 1)",
        f"w_{f} AS (SELECT p_partkey, term, tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / (SELECT avg(dl) FROM dl_{f}))) * ln((n - df + 0.5) / (df + 0.5) + 1) AS w FROM p_{f} JOIN df_{f} USING (term) JOIN dl_{f} USING (p_partkey), np)",
    ])


@_query("bm25f_retrieval", with_("np AS (SELECT count(*) AS n FROM part)", _field("a", "p_brand"), _field("b", "p_name"), _field("c", "p_type"),
    "qsrc AS (SELECT n_nationkey, 'red ' || CASE n_nationkey % 3 WHEN 0 THEN 'widget' WHEN 1 THEN 'ring' ELSE 'bolt' END || ' brand ' || n_nationkey || ' economy' AS text FROM nation)", _posts("qq", "qsrc", "n_nationkey"),
    "dw AS (SELECT p_partkey, term, sum(w) AS w FROM (SELECT p_partkey, term, 2.0 * w AS w FROM w_a UNION ALL SELECT p_partkey, term, w FROM w_b UNION ALL SELECT p_partkey, term, 0.5 * w FROM w_c) GROUP BY 1, 2)",
    "hits AS (SELECT n_nationkey, p_partkey, sum(w) AS score FROM (SELECT DISTINCT n_nationkey, term FROM qq) JOIN dw USING (term) GROUP BY 1, 2)",
    body="SELECT n_nationkey, p_partkey, round(score, 6) AS score, row_number() OVER (PARTITION BY n_nationkey ORDER BY round(score, 9) DESC, p_partkey) AS rank FROM hits QUALIFY rank <= 10"))
def bm25f_retrieval(spark, d):
    part, nation = T.table(spark, d, "part"), T.table(spark, d, "nation")
    n = part.agg(F.count("*").alias("n"))
    fields = [(X.bm25_weights(X.postings(part, "p_partkey", F.col(c)), "p_partkey", n), w) for c, w in (("p_brand", 2.0), ("p_name", 1.0), ("p_type", 0.5))]
    kind = F.when(F.col("n_nationkey") % 3 == 0, "widget").when(F.col("n_nationkey") % 3 == 1, "ring").otherwise("bolt")
    text = F.concat(F.lit("red "), kind, F.lit(" brand "), F.col("n_nationkey").cast("string"), F.lit(" economy"))
    queries = X.postings(nation, "n_nationkey", text).select("n_nationkey", "term", F.lit(1.0).alias("w"))
    return _six(X.fields_match(queries, "n_nationkey", fields, "p_partkey", 10))


@_query("query_stopwords", with_(Q, "nq AS (SELECT count(*) AS n FROM benchmark)", body="SELECT term, count(*) AS df FROM qp, nq GROUP BY term, n HAVING count(*) >= 0.5::DOUBLE * n"))
def query_stopwords(spark, d):
    _, qp, _ = _corpus(spark, d)
    return X.common_terms(qp, T.table(spark, d, "benchmark").agg(F.count("*").alias("n")), 0.5)


@_query("entity_match", with_("""w AS (SELECT p_partkey, list_filter(regexp_split_to_array(lower(p_brand || ' ' || p_name || ' ' || p_type), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM part),
g AS (SELECT DISTINCT p_partkey, array_to_string(w[i : i + k - 1], ' ') AS alias FROM w, (VALUES (1), (2), (3)) n(k), unnest(range(1, len(w) - k + 2)) AS u(i)),
al AS (SELECT DISTINCT lower(replace(p_brand, '#', ' ')) AS alias, p_brand AS entity, 2.0::DOUBLE AS weight FROM part UNION ALL SELECT DISTINCT lower(p_type), p_type, 1.0 FROM part)""",
    body="SELECT p_partkey, entity, sum(weight) AS score FROM g JOIN al USING (alias) GROUP BY 1, 2"))
def entity_match(spark, d):
    part = T.table(spark, d, "part")
    brands = part.select(F.lower(F.replace("p_brand", F.lit("#"), F.lit(" "))).alias("alias"), F.col("p_brand").alias("entity"), F.lit(2.0).alias("weight")).distinct()
    types = part.select(F.lower("p_type").alias("alias"), F.col("p_type").alias("entity"), F.lit(1.0).alias("weight")).distinct()
    return X.entity_match(part, "p_partkey", F.concat_ws(" ", "p_brand", "p_name", "p_type"), brands.unionByName(types))


TOK = """tok AS (SELECT conv_id, turn, role, list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\x0b\\f]+'), lambda x: x <> '') AS w FROM conversations),
bg AS (SELECT conv_id, turn, role, w[i] AS a, w[i + 1] AS b, w[i] || ' ' || w[i + 1] AS bigram FROM tok, unnest(range(1, len(w))) AS u(i))"""


def _bigrams(spark, d, keys):
    return X.bigrams(T.table(spark, d, "conversations"), keys, F.col("text"))


@_query("distinct2_diversity", with_(TOK, body="SELECT conv_id, count(*) AS n, count(DISTINCT bigram) AS n_distinct, round(count(DISTINCT bigram) / count(*), 6) AS distinct2 FROM bg GROUP BY 1"))
def distinct2_diversity(spark, d):
    return _six(X.distinct_share(_bigrams(spark, d, ["conv_id"]), ["conv_id"]), "distinct2")


@_query("bigram_counts_update", with_(TOK, body="SELECT bigram, count(*) AS n FROM bg WHERE NOT (role = 'user' AND turn = 0) GROUP BY 1"))
def bigram_counts_update(spark, d):
    grams = _bigrams(spark, d, ["turn", "role"])
    counts = grams.where("role = 'user'").groupBy("bigram").agg(F.count("*").alias("n"))
    return X.updated_counts(counts, grams.where("role = 'user' and turn = 0"), grams.where("role <> 'user'"))


@_query("overused_bigrams", with_(TOK, """often AS (SELECT bigram, count(*) AS n FROM bg GROUP BY 1 HAVING count(*) >= 10),
fol AS (SELECT a, b, row_number() OVER (PARTITION BY a ORDER BY b) AS r FROM (SELECT DISTINCT a, b FROM bg) QUALIFY r <= 15),
f AS (SELECT a, string_agg(b, ',' ORDER BY b) AS avoid FROM fol GROUP BY 1)""", body="SELECT DISTINCT conv_id, bigram, n, avoid FROM bg JOIN often USING (bigram) JOIN f USING (a)"))
def overused_bigrams(spark, d):
    return X.overused(_bigrams(spark, d, ["conv_id"]), "conv_id", 10)


@_query("bigram_jaccard_top_pairs", with_(TOK, """s AS (SELECT DISTINCT conv_id, bigram FROM bg), z AS (SELECT conv_id, count(*) AS z FROM s GROUP BY 1),
p AS (SELECT a.conv_id AS x, b.conv_id AS y, count(*) AS n FROM s a JOIN s b ON a.bigram = b.bigram AND a.conv_id < b.conv_id GROUP BY 1, 2)""",
    body="SELECT x, y, round(n / (u.z + v.z - n), 6) AS jaccard FROM p JOIN z u ON u.conv_id = x JOIN z v ON v.conv_id = y ORDER BY round(n / (u.z + v.z - n), 9) DESC, x, y LIMIT 50"))
def bigram_jaccard_top_pairs(spark, d):
    sets = _bigrams(spark, d, ["conv_id"]).withColumnRenamed("bigram", "member")
    return _six(S.jaccard_pairs(sets, "conv_id", 50), "jaccard")


def _rounds(n: int) -> str:
    """The chosen texts one after the other: the pair, then each best sum, as CTEs."""
    out = ["c2 AS (SELECT 1 AS position, x AS conv_id, s AS overlap FROM best UNION ALL SELECT 2, y, s FROM best)"]
    for k in range(3, n + 1):
        out.append(f"""c{k} AS (SELECT * FROM c{k - 1} UNION ALL SELECT {k}, conv_id, o FROM (SELECT z.conv_id, round(coalesce(sum(s), 0), 9) AS o FROM (SELECT DISTINCT conv_id FROM t ANTI JOIN c{k - 1} USING (conv_id)) z
  LEFT JOIN (SELECT x, y, s0 AS s FROM cs SEMI JOIN c{k - 1} ON y = conv_id) q ON x = z.conv_id GROUP BY 1 ORDER BY o DESC, 1 LIMIT 1))""")
    return ",\n".join(out)


@_query("overlapping_batch", with_(TOK, """t AS (SELECT conv_id, bigram, count(*) AS n FROM bg GROUP BY 1, 2), u AS (SELECT *, n / sqrt(sum(n * n) OVER (PARTITION BY conv_id)) AS w FROM t),
cs AS (SELECT a.conv_id AS x, b.conv_id AS y, sum(a.w * b.w) AS s0 FROM u a JOIN u b ON a.bigram = b.bigram AND a.conv_id <> b.conv_id GROUP BY 1, 2),
best AS (SELECT x, y, round(s0, 9) AS s FROM cs WHERE x < y ORDER BY s DESC, x, y LIMIT 1)""", _rounds(5), body="SELECT position::BIGINT AS position, conv_id, round(overlap, 6) AS overlap FROM c5"))
def overlapping_batch(spark, d):
    """The five conversations that share most of their words' pairs, chosen one after the other."""
    grams = _bigrams(spark, d, ["conv_id"]).groupBy("conv_id", F.col("bigram").alias("gram")).agg(F.count("*").alias("n"))
    return _six(X.overlapping_batch(grams, "conv_id", 5), "overlap")


@_query("conversation_prefix_text", """SELECT conv_id, turn, n_prior, prefix FROM (
  SELECT conv_id, turn, role, count(*) OVER w - 1 AS n_prior, array_to_string(list(role || ': ' || text) OVER w, chr(10)) AS prefix
  FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) WHERE role = 'user'""")
def conversation_prefix_text(spark, d):
    return X.prefixes(T.table(spark, d, "conversations"), "conv_id", "turn", "role", "text")


@_query("lexical_block", """SELECT conv_id, count(*) AS n, round(avg(length(text)), 6) AS mean_chars, round(coalesce(stddev_samp(length(text)), 0), 6) AS std_chars,
  round(avg(len(string_split(text, ' '))), 6) AS mean_words, round(coalesce(stddev_samp(len(string_split(text, ' '))), 0), 6) AS std_words,
  round(avg(length(text) - length(replace(text, '?', ''))), 6) AS mean_marks, round(coalesce(stddev_samp(length(text) - length(replace(text, '?', ''))), 0), 6) AS std_marks
FROM conversations GROUP BY 1""")
def lexical_block(spark, d):
    cols = [f"{n}_{k}" for k in ("chars", "words", "marks") for n in ("mean", "std")]
    return _six(X.lexical_block(T.table(spark, d, "conversations"), ["conv_id"], "text"), *cols)


@_query("turn_assembly", """SELECT u.conv_id, u.turn, u.text AS user_query, a.text AS assistant_response FROM conversations u JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
WHERE u.role = 'user' AND a.role = 'assistant'""")
def turn_assembly(spark, d):
    """Complete exchanges: a user turn and the assistant's next one, joined on the turn number."""
    c = T.table(spark, d, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_query"))
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("assistant_response"))
    return user.join(reply, ["conv_id", "turn"])


@_query("target_turns", """SELECT conv_id, turn, text AS user_query FROM conversations u WHERE role = 'user'
AND NOT EXISTS (SELECT 1 FROM conversations a WHERE a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant')""")
def target_turns(spark, d):
    """User turns that no assistant turn answers."""
    c = T.table(spark, d, "conversations")
    user = c.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user_query"))
    return user.join(c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn")), ["conv_id", "turn"], "left_anti")


PRIOR = """plays AS (SELECT doc_id, ln(1 + n_chars) AS s FROM documents), mm AS (SELECT min(s) AS lo, max(s) AS hi FROM plays)"""


@_query("text_with_popularity_prior", with_(D, Q, N, BM25, BINARY, MATCH, PRIOR, "f AS (SELECT item_id, h.doc_id, score + 0.3 * (s - lo) / (hi - lo) AS score FROM hits h JOIN plays USING (doc_id), mm)",
    body="SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM f QUALIFY rank <= 10"))
def text_with_popularity_prior(spark, d):
    """BM25 plus a weight times the min-max of a logged count (here of characters) of the document."""
    from tessera.operators.ranking import topk_per_group

    dp, qp, n = _corpus(spark, d)
    hits = qp.select("item_id", "term").join(_bm25(spark, d, qp, n), "term").groupBy("item_id", "doc_id").agg(F.sum("w").alias("score"))
    prior = T.table(spark, d, "documents").select("doc_id", F.log1p("n_chars").alias("s"))
    ends = F.broadcast(prior.agg(F.min("s").alias("lo"), F.max("s").alias("hi")))
    scored = hits.join(prior, "doc_id").crossJoin(ends).select("item_id", "doc_id", (F.col("score") + 0.3 * F.try_divide(F.col("s") - F.col("lo"), F.col("hi") - F.col("lo"))).alias("score"))
    return _six(topk_per_group(scored, ["item_id"], [F.round("score", 9).desc(), F.col("doc_id")], 10))


@_query("hybrid_rrf", with_(D, Q, N, "idf AS (SELECT term, ln((1 + n) / (1 + df)) + 1 AS idf FROM ddf, nn)",
    *[f"{o}0 AS (SELECT {k}, term, (1 + ln(tf)) * idf AS w FROM {p} JOIN idf USING (term)), {o} AS (SELECT {k}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {k})) AS w FROM {o}0)" for o, k, p in (("td", "doc_id", "dp"), ("tq", "item_id", "qp"))],
    BM25, """a AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(q.w * d.w), 9) DESC, doc_id) AS rank FROM tq q JOIN td d USING (term) GROUP BY 1, 2 QUALIFY rank <= 600),
b AS (SELECT item_id, doc_id, row_number() OVER (PARTITION BY item_id ORDER BY round(sum(d.w), 9) DESC, doc_id) AS rank FROM (SELECT DISTINCT item_id, term FROM qp) q JOIN dw d USING (term) GROUP BY 1, 2 QUALIFY rank <= 600),
s AS (SELECT item_id, doc_id, sum(w / (rank + 60)) AS score FROM (SELECT *, 1.0::DOUBLE AS w FROM a UNION ALL SELECT *, 0.5 FROM b) GROUP BY 1, 2)""",
    body="SELECT item_id, doc_id, round(score, 6) AS score, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 9) DESC, doc_id) AS rank FROM s QUALIFY rank <= 10"))
def hybrid_rrf(spark, d):
    """Ranks of two text signals, 600 deep, fused with weights."""
    from tessera.operators.fusion import weighted_rrf

    dp, qp, n = _corpus(spark, d)
    dp = stored(dp, "postings")
    idf = X.smooth_idf(dp, n)
    tfidf = X.match(X.tfidf_weights(qp, "item_id", idf), "item_id", X.tfidf_weights(dp, "doc_id", idf, qp), "doc_id", 600)
    bm25 = X.match(qp.select("item_id", "term", F.lit(1.0).alias("w")), "item_id", _bm25(spark, d, qp, n), "doc_id", 600)
    pool = tfidf.withColumn("cg", F.lit("tfidf")).unionByName(bm25.withColumn("cg", F.lit("bm25"))).withColumn("bucket", F.lit("all")).withColumnRenamed("doc_id", "track_id")
    weights = spark.createDataFrame([("tfidf", "all", 1.0), ("bm25", "all", 0.5)], "cg string, bucket string, weight double")
    return _six(weighted_rrf(pool, weights, ["item_id"], "bucket", 60, 10).withColumnRenamed("track_id", "doc_id"))


@_query("progress_labels", """SELECT u.conv_id, u.turn, CASE WHEN a.text IS NULL THEN NULL WHEN length(a.text) > length(u.text) THEN 'MOVES' ELSE 'DOES_NOT' END AS progress
FROM conversations u LEFT JOIN conversations a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 AND a.role = 'assistant' WHERE u.role = 'user'""")
def progress_labels(spark, d):
    """A user turn's progress, from the answer of the turn after it: NULL where there is none."""
    c = T.table(spark, d, "conversations")
    reply = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("turn"), F.length("text").alias("reply"))
    rows = c.where("role = 'user'").join(reply, ["conv_id", "turn"], "left")
    label = F.when(F.col("reply") > F.length("text"), "MOVES").when(F.col("reply").isNotNull(), "DOES_NOT")
    return rows.select("conv_id", "turn", label.alias("progress"))
