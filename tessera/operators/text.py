"""Text retrieval over an inverted index held as a long table, and n-gram analytics of responses."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import words_of
from tessera.operators.dense import positive_topk
from tessera.operators.products import LINES, best_of_block
from tessera.operators.ranking import topk_per_group
from tessera.sources.stored import stored


def postings(docs: DataFrame, key: str, text: Column, grams: int = 1, terms: DataFrame | None = None) -> DataFrame:
    """key, term, tf: words, and for grams = 2 pairs of successive words too; of the given terms alone where there are any, so others are never dealt."""
    words = docs.select(F.col(key), words_of(text).alias("_w"))
    found = F.col("_w")
    if grams == 2:
        n = F.greatest(F.size("_w") - 1, F.lit(0))
        found = F.concat(found, F.zip_with(F.slice("_w", 1, n), F.slice("_w", 2, n), lambda a, b: F.concat_ws(" ", a, b)))
    return _of(words.select(key, F.explode(found).alias("term")), terms).groupBy(key, "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, key: str, text: Column) -> DataFrame:
    """key, dl: the words of every text that has some, without laying them out."""
    return docs.groupBy(key).agg(F.sum(F.coalesce(F.size(words_of(text)), F.lit(0))).alias("dl")).where("dl > 0")


def _df(posts: DataFrame) -> DataFrame:
    return posts.groupBy("term").agg(F.count("*").alias("df"))


def _of(posts: DataFrame, terms: DataFrame | None) -> DataFrame:
    """The postings of some terms (all for None)."""
    return posts if terms is None else posts.join(terms.select("term").distinct(), "term", "left_semi")


def tfidf_weights(posts: DataFrame, key: str, idf: DataFrame, terms: DataFrame | None = None) -> DataFrame:
    """key, term, w: (1 + ln tf) * idf, scaled to length 1 per key; for the given terms alone where there are any.

    Lengths need every term; the wanted terms' weights are kept beside them, so postings meet the terms once.
    """
    known = idf.withColumn("_in", F.lit(True)) if terms is None else idf.join(terms.select("term").distinct().withColumn("_in", F.lit(True)), "term", "left")
    w = posts.join(known, "term").select(key, "_in", "term", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    length = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("len"), F.collect_list(F.when(F.col("_in"), F.struct("term", "w"))).alias("_l"))
    return length.select(key, "len", F.inline("_l")).select(key, "term", (F.col("w") / F.col("len")).alias("w"))


def smooth_idf(posts: DataFrame, n: DataFrame) -> DataFrame:
    """term, idf: ln((1 + n) / (1 + df)) + 1."""
    return _df(posts).crossJoin(F.broadcast(n)).select("term", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))


def bm25_weights(posts: DataFrame, key: str, n: DataFrame, k1: float = 1.5, b: float = 0.75, terms: DataFrame | None = None, length: DataFrame | None = None) -> DataFrame:
    """key, term, w: BM25 weight of a term in a document, for the given terms alone where there are any.

    Lengths (key, dl), and their mean over documents with a term, count every term: with `length` postings need only hold the wanted ones.
    """
    length = posts.groupBy(key).agg(F.sum("tf").alias("dl")) if length is None else length
    mean = length.agg(F.avg("dl").alias("mean_dl"))
    some = _of(posts, terms)
    rows = some.join(_df(some), "term").join(length, key).crossJoin(F.broadcast(n.crossJoin(mean)))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    tf = F.col("tf")
    return rows.select(key, "term", (tf * (k1 + 1) / (tf + k1 * (1 - b + b * F.col("dl") / F.col("mean_dl"))) * idf).alias("w"))


def repeated_fields(fields: list[tuple[Column, int]]) -> Column:
    """One text of several fields, each repeated by its weight."""
    return F.concat_ws(" ", *[F.coalesce(f, F.lit("")) for f, times in fields for _ in range(times)])


def weighted_terms(parts: list[DataFrame], key: str) -> DataFrame:
    """key, term, tf: the postings of several texts added up, each (key, term, tf) with its own weight in `weight`."""
    every = reduce(DataFrame.unionByName, [p.select(key, "term", (F.col("tf") * F.col("weight")).alias("tf")) for p in parts])
    return every.groupBy(key, "term").agg(F.sum("tf").alias("tf"))


def most_frequent_terms(posts: DataFrame, most: int) -> DataFrame:
    """term, df: the `most` terms of largest total count (ties to the smaller term), with their document counts."""
    return posts.groupBy("term").agg(F.sum("tf").alias("_n"), F.count("*").alias("df")).orderBy(F.col("_n").desc(), "term").limit(most).select("term", "df")


def match(queries: DataFrame, query_key: str, docs: DataFrame, key: str, k: int) -> DataFrame:
    """query_key, key, score, rank: the k best documents by the sum of products of shared terms' weights.

    An inverted index by blocks of documents, of about LINES postings each: every block gets the queries' terms, adds up and
    sends its k best a query. Cost follows the postings of the queries' terms, never all pairs, and no pair becomes a row. Keys are whole numbers.
    """
    whole = lambda c: F.col(c).cast("long")
    kinds = dict(queries.dtypes)[query_key], dict(docs.dtypes)[key]
    docs = stored(docs.select(whole(key).alias("_id"), "term", F.col("w").cast("double").alias("w")), "weights")
    n = max(1, -(-docs.count() // LINES))
    block = F.pmod(F.xxhash64("_id"), F.lit(n))
    lists = docs.groupBy(block.alias("_n"), F.col("term").alias("item")).agg(F.collect_list(F.struct("_id", "w")).alias("_l"))
    lists = lists.select("_n", "item", F.col("_l._id").alias("columns"), F.col("_l.w").alias("values"))
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("_b")
    lines = queries.select(every, whole(query_key).alias("key"), F.col("term").alias("item"), F.col("w").cast("double").alias("value"), F.lit(None).cast("long").alias("column"), F.lit(False).alias("own"))
    found = lines.groupBy("_b").cogroup(lists.groupBy("_n")).applyInArrow(best_of_block(k, False), "key long, id long, score double, rank long")
    found = found.select(F.col("key").cast(kinds[0]).alias(query_key), F.col("id").cast(kinds[1]).alias(key), "score")
    return topk_per_group(found, [query_key], [F.round("score", 9).desc(), F.col(key)], k)


def match_dense(queries: DataFrame, query_key: str, docs: DataFrame, key: str, terms: DataFrame, k: int) -> DataFrame:
    """match over few terms (term), that most texts hold: blocks of weight vectors are multiplied, so no pair of texts becomes a row.

    Only pairs with a common term count. A task holds the vectors of one block pair; keys are longs.
    """
    place = stored(terms.select("term").distinct().withColumn("_at", F.row_number().over(Window.orderBy("term")) - 1), "terms")  # few by contract
    n = place.count()

    def vectors(weights: DataFrame, name: str) -> DataFrame:
        held = weights.join(place, "term").groupBy(F.col(name).cast("long").alias("id")).agg(F.map_from_entries(F.collect_list(F.struct("_at", F.col("w").cast("double")))).alias("_m"))
        return stored(held.select("id", F.transform(F.sequence(F.lit(0), F.lit(max(n, 1) - 1)), lambda i: F.coalesce(F.try_element_at("_m", i), F.lit(0.0))).alias("vector")), "weights")

    found = positive_topk(vectors(queries, query_key), vectors(docs, key), k)
    return found.select(F.col("query_id").alias(query_key), F.col("id").alias(key), "score", "rank")


def fields_match(queries: DataFrame, query_key: str, fields: list[tuple[DataFrame, float]], key: str, k: int) -> DataFrame:
    """match over several fields' weights, each times the field's weight."""
    every = reduce(DataFrame.unionByName, [w.select(key, "term", (F.col("w") * weight).alias("w")) for w, weight in fields])
    return match(queries, query_key, every.groupBy(key, "term").agg(F.sum("w").alias("w")), key, k)


def common_terms(posts: DataFrame, n: DataFrame, share: float) -> DataFrame:
    """term, df: terms in at least this share of the texts."""
    return _df(posts).crossJoin(F.broadcast(n)).where(F.col("df") >= share * F.col("n")).select("term", "df")


def entity_match(queries: DataFrame, query_key: str, text: Column, aliases: DataFrame, longest: int = 3) -> DataFrame:
    """query_key, entity, score: the weights of the distinct grams of a query that are aliases (alias, entity, weight).

    Grams are many times their file's size, by which Spark would choose to broadcast them, so both sides are sorted and merged.
    """
    words = queries.select(query_key, words_of(text).alias("w"))
    gram = lambda n: F.when(F.size("w") >= n, F.transform(F.sequence(F.lit(1), F.size("w") - n + 1), lambda i: F.concat_ws(" ", *[F.get("w", i + k - 1) for k in range(n)]))).otherwise(F.array().cast("array<string>"))
    grams = words.select(query_key, F.explode(F.array_distinct(F.concat(*[gram(n) for n in range(1, longest + 1)]))).alias("alias"))
    return grams.join(aliases.hint("merge"), "alias").groupBy(query_key, "entity").agg(F.sum("weight").alias("score"))


def bigrams(df: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """keys, at, a, b, bigram of successive tokens between white space, in order."""
    tokens = F.filter(F.split(text, "[ \\t\\n\\r\\x0b\\f]+"), lambda w: w != "")
    rows = df.select(*keys, tokens.alias("_w"))
    pairs = F.when(F.size("_w") >= 2, F.zip_with(F.slice("_w", 1, F.greatest(F.size("_w") - 1, F.lit(0))), F.slice("_w", 2, F.greatest(F.size("_w") - 1, F.lit(0))), lambda a, b: F.struct(a.alias("a"), b.alias("b"))))
    out = rows.select(*keys, F.posexplode(pairs).alias("at", "_p")).select(*keys, "at", "_p.a", "_p.b")
    return out.withColumn("bigram", F.concat_ws(" ", "a", "b"))


def distinct_share(grams: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, n_distinct, distinct2."""
    return grams.groupBy(*keys).agg(F.count("*").alias("n"), F.countDistinct("bigram").alias("n_distinct")).withColumn("distinct2", F.col("n_distinct") / F.col("n"))


def updated_counts(counts: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """bigram, n after bigrams left and came: a signed union instead of a recount."""
    change = counts.unionByName(removed.select("bigram", F.lit(-1).alias("n"))).unionByName(added.select("bigram", F.lit(1).alias("n")))
    return change.groupBy("bigram").agg(F.sum("n").alias("n")).where("n > 0")


def overused(grams: DataFrame, key: str, at_least: int, most: int = 15) -> DataFrame:
    """key, bigram, n, avoid: bigrams used often overall, with the words that elsewhere follow their first word (at most `most`)."""
    counts = grams.groupBy("bigram").agg(F.count("*").alias("n"))
    often = counts.where(F.col("n") >= at_least)
    follow = grams.select("a", "b").distinct()
    follow = topk_per_group(follow, ["a"], [F.col("b")], most)  # bounded lists
    follow = follow.groupBy("a").agg(F.concat_ws(",", F.array_sort(F.collect_list("b"))).alias("avoid"))
    return grams.select(key, "bigram", "a").distinct().join(often, "bigram").join(follow, "a").select(key, "bigram", "n", "avoid")


def overlapping_batch(grams: DataFrame, key: str, size: int, seed_df: int = 200) -> DataFrame:
    """position, key, overlap: the pair of texts of largest cosine of gram counts, then, one by one, the text of the largest sum of cosines with those chosen.

    Rows are (key, gram, n). The pair comes from an inverted index: the best cosine through grams of at most
    `seed_df` texts bounds it from below; with grams ordered from the rarest, two vectors that reach the bound
    share one where both still have enough of their squared length before them. Each further text is one
    aggregation over the postings; only the chosen keys, `size` of them, pass the driver. Ties go to smaller keys.
    """
    by = Window.partitionBy(key)
    v = grams.join(grams.groupBy("gram").agg(F.count("*").alias("df")), "gram")
    v = v.withColumns({"_all": F.sum(F.col("n") * F.col("n")).over(by), "_upto": F.sum(F.col("n") * F.col("n")).over(by.orderBy("df", "gram").rowsBetween(Window.unboundedPreceding, 0))})
    v = v.select(key, "gram", "df", (F.col("n") / F.sqrt("_all")).alias("w"), ((F.col("_upto") - F.col("n") * F.col("n")) / F.col("_all")).alias("before"))
    side = lambda rows, n: rows.select(F.col(key).alias(n), "gram", F.col("w").alias(f"w{n}"))
    joined = lambda rows: side(rows, "x").join(side(rows, "y"), "gram").where("x < y").groupBy("x", "y").agg(F.sum(F.col("wx") * F.col("wy")).alias("s"))
    bound = joined(v.where(F.col("df") <= seed_df)).agg(F.coalesce(F.max("s"), F.lit(0.0)).alias("_t"))
    early = v.crossJoin(F.broadcast(bound)).where(F.col("before") <= 1 - F.col("_t") ** 2 + 1e-9)
    pairs = joined(early).select("x", "y")
    whole = pairs.join(side(v, "x"), "x").join(side(v, "y"), ["y", "gram"]).groupBy("x", "y").agg(F.round(F.sum(F.col("wx") * F.col("wy")), 9).alias("s"))
    best = whole.orderBy(F.col("s").desc(), "x", "y").first()
    chosen = [] if best is None else [(best["x"], best["s"]), (best["y"], best["s"])]
    while chosen and len(chosen) < size:
        held = [k for k, _ in chosen]
        of_batch = v.where(F.col(key).isin(held)).groupBy("gram").agg(F.sum("w").alias("_b"))
        rest = v.where(~F.col(key).isin(held)).join(of_batch, "gram", "left")
        sums = rest.groupBy(key).agg(F.round(F.coalesce(F.sum(F.col("w") * F.col("_b")), F.lit(0.0)), 9).alias("s"))
        found = sums.orderBy(F.col("s").desc(), key).first()
        if found is None:
            break
        chosen.append((found[key], found["s"]))
    spark, kind = grams.sparkSession, dict(grams.dtypes)[key]
    return spark.createDataFrame([(n + 1, k, s) for n, (k, s) in enumerate(chosen)], f"position long, `{key}` {kind}, overlap double")


def prefixes(turns: DataFrame, session: str, turn: str, role: str, text: str) -> DataFrame:
    """For every user turn: the number of earlier turns and the text so far, the user's included."""
    so_far = Window.partitionBy(session).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    rows = turns.withColumns({"n_prior": F.count("*").over(so_far) - 1, "prefix": F.array_join(F.collect_list(F.concat_ws(": ", role, text)).over(so_far), "\n")})
    return rows.where(F.col(role) == "user").select(session, turn, "n_prior", "prefix")


def lexical_block(df: DataFrame, keys: list[str], text: str) -> DataFrame:
    """keys and mean and deviation (0 for one row) of characters, words and question marks."""
    c = {"chars": F.length(text), "words": F.size(F.split(text, " ")), "marks": F.regexp_count(F.col(text), F.lit("\\?"))}
    cols = [f(v).alias(f"{n}_{k}") for k, v in c.items() for n, f in (("mean", F.avg), ("std", lambda x: F.coalesce(F.stddev_samp(x), F.lit(0.0))))]
    return df.groupBy(*keys).agg(F.count("*").alias("n"), *cols)
