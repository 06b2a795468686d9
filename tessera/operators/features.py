"""Learning-to-rank features of (session, turn, candidate), as joins and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.columns import average_rank, share_of_max
from tessera.operators.ranking import masked_ranks, percentile_of


def track_stats(inter: DataFrame, tracks: DataFrame) -> DataFrame:
    """Plays of tracks, artists and albums; popularity percentile, z-score over positives and tertile (-1 where not positive)."""
    plays = inter.groupBy("track_id").agg(F.count("*").alias("plays"))
    t = tracks.join(plays, "track_id", "left").withColumn("plays", F.coalesce("plays", F.lit(0)))
    artist = t.groupBy("artist").agg(F.sum("plays").alias("artist_plays"))
    album = t.groupBy("album").agg(F.sum("plays").alias("album_plays"))
    t = percentile_of(t.join(artist, "artist").join(album, "album"), "popularity", "popularity_pct")
    some = t.where("popularity > 0").agg(F.avg("popularity").alias("_m"), F.stddev_samp("popularity").alias("_s"), F.percentile("popularity", [1 / 3, 2 / 3]).alias("_q"))
    t = t.crossJoin(F.broadcast(some))
    p, q = F.col("popularity"), F.col("_q")
    bucket = F.when(p > 0, F.when(p <= q[0], 0).when(p <= q[1], 1).otherwise(2)).otherwise(-1)
    return t.select("track_id", "plays", "artist_plays", "album_plays", "popularity_pct", F.try_divide(p - F.col("_m"), F.col("_s")).alias("popularity_z"), bucket.cast("long").alias("popularity_bucket"))


def session_features(history: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per session: length, distinct artists and tags, popularity, duration, years and the share of undated tracks."""
    rows = history.join(tracks, "track_id", "left")
    base = rows.groupBy("session_id").agg(
        F.count("*").alias("length"), F.countDistinct("artist").alias("n_artists"), F.avg("popularity").alias("mean_pop"), F.stddev_samp("popularity").alias("std_pop"),
        F.max("popularity").alias("max_pop"), F.sum("duration").alias("total_duration"), F.avg("year").alias("mean_year"), F.stddev_samp("year").alias("std_year"),
        F.avg(F.col("year").isNull().cast("double")).alias("undated_share"), F.every(F.col("year").isNull()).alias("all_undated"),
    )
    tags = rows.select("session_id", F.explode("tags").alias("tag")).groupBy("session_id").agg(F.countDistinct("tag").alias("n_tags"))
    return base.join(tags, "session_id", "left").withColumn("n_tags", F.coalesce("n_tags", F.lit(0)))


def last_turn_dynamics(inter: DataFrame, tracks: DataFrame) -> DataFrame:
    """Each track against that of the turn before (turn - 1, not the row before): same artist and album, differences."""
    rows = inter.select("session_id", "turn", "track_id").join(tracks.drop("tags"), "track_id", "left")
    prev = rows.select("session_id", (F.col("turn") + 1).alias("turn"), *[F.col(c).alias(f"prev_{c}") for c in ("artist", "album", "popularity", "year", "duration")])
    out = rows.join(prev, ["session_id", "turn"], "left")
    c = F.col
    return out.select(
        "session_id", "turn", "track_id", (c("artist") == c("prev_artist")).alias("same_artist"), (c("album") == c("prev_album")).alias("same_album"),
        (c("popularity") - c("prev_popularity")).alias("pop_change"), F.abs(c("year") - c("prev_year")).alias("year_gap"), (c("duration") - c("prev_duration")).alias("duration_change"),
    )


def overlap(candidates: DataFrame, history: DataFrame, tracks: DataFrame) -> DataFrame:
    """Candidates (session_id, turn, track_id) against earlier turns: plays of their artist and album, tags known and new, popularity z.

    History and candidates stand in one table, so what came before a turn is a running count over it and
    no session is joined with itself; a tag is known where the session first met it in an earlier turn.
    Tracks are merged: with their tags they are many times their file's size, by which Spark would broadcast them.
    """
    tags = tracks.select("track_id", F.explode("tags").alias("tag")).hint("merge")
    held, asked = history.select("session_id", "turn", "track_id", F.lit(1).alias("_h")), candidates.select("session_id", "turn", "track_id", F.lit(0).alias("_h"))
    rows = held.unionByName(asked).join(tracks.select("track_id", "artist", "album", "popularity", "tags").hint("merge"), "track_id", "left")
    before = lambda *keys: Window.partitionBy("session_id", *keys).orderBy("turn").rangeBetween(Window.unboundedPreceding, -1)
    count = lambda *keys: F.coalesce(F.sum("_h").over(before(*keys)), F.lit(0))
    pop = F.when(F.col("_h") == 1, F.col("popularity"))
    rows = rows.withColumns({"_n": count(), "_m": F.avg(pop).over(before()), "_s": F.stddev_samp(pop).over(before())}).withColumns({"artist_count": count("artist"), "album_count": count("album")})
    rows = rows.withColumns({c: F.when(F.col(k).isNotNull(), F.col(c)).otherwise(0) for k, c in (("artist", "artist_count"), ("album", "album_count"))})
    first = held.join(tags, "track_id").groupBy("session_id", "tag").agg(F.min("turn").alias("_f"))
    each = asked.select("session_id", "turn", "track_id").distinct().join(tags, "track_id").join(first, ["session_id", "tag"], "left")
    known = each.groupBy("session_id", "turn", "track_id").agg(F.count_if(F.col("_f") < F.col("turn")).alias("_known"))
    rows = rows.where("_h = 0").join(known, ["session_id", "turn", "track_id"], "left")
    k = F.coalesce("_known", F.lit(0))
    return rows.select(
        "session_id", "turn", "track_id", "artist_count", "album_count", (F.col("artist_count") / (F.col("_n") + 1)).alias("artist_share"), (F.col("album_count") > 0).alias("album_seen"),
        k.alias("tags_known"), (F.size("tags") - k).cast("long").alias("tags_new"), ((F.col("popularity") - F.col("_m")) / (F.col("_s") + 1e-6)).alias("session_pop_z"),
    )


def turn_position(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Add turn_share (turn over the group's last) and above_median (value less the group's median)."""
    stats = df.groupBy(*group).agg(F.max("turn").alias("_t"), F.median(value).alias("_m"))
    return df.join(stats, group).withColumns({"turn_share": F.col("turn") / F.col("_t"), "above_median": F.col(value) - F.col("_m")}).drop("_t", "_m")


def imputed_stats(history: DataFrame, tracks: DataFrame, columns: list[str]) -> DataFrame:
    """session_id, mean_ and std_ (population) of each column over a session's tracks, unknown values as the catalogue's median."""
    middle = tracks.agg(*[F.median(c).alias(f"_m_{c}") for c in columns])
    rows = history.join(tracks, "track_id", "left").crossJoin(F.broadcast(middle)).withColumns({c: F.coalesce(c, f"_m_{c}") for c in columns})
    return rows.groupBy("session_id").agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("mean", F.avg), ("std", F.stddev_pop))])


def one_hot(df: DataFrame, column: str, values: list[str]) -> DataFrame:
    return df.withColumns({f"{column}_{v}": F.coalesce(F.col(column) == v, F.lit(False)).cast("long") for v in values})


def mentions(df: DataFrame, text: str, names: dict[str, str]) -> DataFrame:
    """Whether a text contains each non-empty name column, by lower case; text_chars and text_words."""
    t = F.lower(F.coalesce(F.col(text), F.lit("")))
    return df.withColumns({f"mentions_{k}": F.coalesce((F.length(c) > 0) & F.contains(t, F.lower(c)), F.lit(False)) for k, c in names.items()} | {"text_chars": F.length(t).cast("long"), "text_words": F.size(F.split(t, " ")).cast("long")})


def cross_features(df: DataFrame, group: list[str], a: str, b: str) -> DataFrame:
    """Product, sum, share of the group's largest, gap to it, z and average ranks of two score columns."""
    w = Window.partitionBy(*group)
    x, y = F.col(a), F.col(b)
    return df.withColumns(
        {
            "product": x * y, "total": x + y, f"{a}_of_max": share_of_max(x, group), f"{a}_gap": F.max(x).over(w) - x,
            f"{a}_z": F.try_divide(x - F.avg(x).over(w), F.stddev_samp(x).over(w)), f"{a}_rank": average_rank(x, group, True), f"{b}_rank": average_rank(y, group, True),
        }
    ).withColumn("rank_spread", F.abs(F.col(f"{a}_rank") - F.col(f"{b}_rank")))


def undated(df: DataFrame, group: list[str], score: str) -> DataFrame:
    """Share of undated candidates in the group, and ranks among the undated and the dated alone."""
    missing = F.col("year").isNull()
    out = df.withColumn("undated_share", F.avg(missing.cast("double")).over(Window.partitionBy(*group)))
    return masked_ranks(masked_ranks(out, group, missing, F.col(score), "rank_undated"), group, ~missing, F.col(score), "rank_dated")


def staged(df: DataFrame, stages) -> DataFrame:
    """Apply stages in their order; later ones see the columns of earlier ones."""
    for stage in stages:
        df = df.transform(stage)
    return df


def word_flags(df: DataFrame, text: str, prefix: str, words: list[str]) -> DataFrame:
    """Whether a text holds each word between blanks, by lower case, as prefix_word."""
    t = F.concat(F.lit(" "), F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(" "))
    return df.withColumns({f"{prefix}_{w}": F.contains(t, F.lit(f" {w} ")) for w in words})


def embedding_features(rows: DataFrame) -> DataFrame:
    """session_id, turn, track_id and cosines of a row's vector with that of the turn before, the closest and the mean of all earlier turns of its session.

    Rows are (session_id, turn, track_id, vector). A session is compared with itself, so it should be short;
    the first turn of a session gives no row.
    """
    from tessera.functions.columns import cosine

    past = rows.select("session_id", F.col("turn").alias("_t"), F.col("vector").alias("_v"))
    pairs = rows.join(past, "session_id").where("_t < turn")
    total = F.reduce(F.collect_list("_v"), F.array_repeat(F.lit(0.0), F.size(F.first("vector"))), lambda s, v: F.zip_with(s, v, lambda x, y: x + y))
    near = pairs.withColumn("_c", cosine("vector", "_v")).groupBy("session_id", "turn", "track_id").agg(
        F.max(F.when(F.col("_t") == F.col("turn") - 1, F.col("_c"))).alias("cos_prev"), F.max("_c").alias("cos_max"), total.alias("_sum"), F.first("vector").alias("_own")
    )
    return near.withColumn("cos_mean", cosine("_own", "_sum")).drop("_sum", "_own")


def session_track_block(history: DataFrame, tracks: DataFrame) -> DataFrame:
    """Per session: counts, population deviations, entropy (bits) of tags and the top tag (ties to the smaller)."""
    rows = history.join(tracks, "track_id", "left")
    base = rows.groupBy("session_id").agg(F.count("*").alias("n_prior"), F.countDistinct("artist").alias("n_artists"), F.countDistinct("album").alias("n_albums"), F.stddev_pop("popularity").alias("std_pop"), F.stddev_pop("duration").alias("std_duration"))
    tags = rows.select("session_id", F.explode("tags").alias("tag")).groupBy("session_id", "tag").agg(F.count("*").alias("n"))
    p = F.col("n") / F.sum("n").over(Window.partitionBy("session_id"))
    tags = tags.withColumn("p", p).groupBy("session_id").agg((-F.sum(F.col("p") * F.log2("p"))).alias("tag_entropy"), F.min_by("tag", F.struct(-F.col("n"), "tag")).alias("top_tag"))
    return base.join(tags, "session_id", "left")
