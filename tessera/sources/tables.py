"""Readers of the star-schema tables in the roles the operators expect, and general sources and sinks."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, user_id, session_date, turn, track_id: an order's lines as the turns of a session."""
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    turn = F.row_number().over(Window.partitionBy("session_id").orderBy("l_linenumber", "track_id", "l_suppkey"))
    rows = lines.select(F.col("l_orderkey").alias("session_id"), "l_linenumber", F.col("l_partkey").alias("track_id"), "l_suppkey")
    rows = rows.withColumn("turn", turn.cast("long")).drop("l_linenumber", "l_suppkey")
    sessions = orders.select(F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.col("o_orderdate").cast("date").alias("session_date"))
    return rows.join(sessions, "session_id").select("session_id", "user_id", "session_date", "turn", "track_id")


def tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, artist, album, tags, popularity, year (NULL where undated), duration."""
    part = table(spark, sf_dir, "part")
    tags = F.array_distinct(F.concat(F.split("p_name", " "), F.array(F.lower("p_type"))))
    return part.select(
        F.col("p_partkey").alias("track_id"),
        F.col("p_brand").alias("artist"),
        F.concat_ws("::", "p_brand", "p_type").alias("album"),
        tags.alias("tags"),
        F.col("p_retailprice").alias("popularity"),
        F.when(F.col("p_size") % 10 != 0, 1950 + F.col("p_size")).cast("long").alias("year"),
        (F.col("p_size") * 10000).cast("long").alias("duration"),
    )


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """session_id, user_id, category (first character of the priority), specificity (status), country, segment."""
    orders, users = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    rows = orders.join(users, F.col("o_custkey") == F.col("c_custkey"), "left")
    return rows.select(
        F.col("o_orderkey").alias("session_id"), F.col("o_custkey").alias("user_id"), F.substring("o_orderpriority", 1, 1).alias("category"),
        F.col("o_orderstatus").alias("specificity"), F.col("c_nationkey").cast("long").alias("country"), F.col("c_mktsegment").alias("segment"),
    )


def context(inter: DataFrame) -> DataFrame:
    """Interactions before a session's last turn."""
    last = F.max("turn").over(Window.partitionBy("session_id"))
    return inter.withColumn("_last", last).where(F.col("turn") < F.col("_last")).drop("_last")


def ground_truth(inter: DataFrame) -> DataFrame:
    """session_id, target_turn, gt_track_id: the last turn of sessions with at least two."""
    g = inter.groupBy("session_id").agg(F.max("turn").alias("target_turn"), F.max_by("track_id", "turn").alias("gt_track_id"))
    return g.where(F.col("target_turn") >= 2)


def releases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """track_id, release: the day a part was first shipped; NULL for undated tracks and for those never shipped."""
    first = table(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("track_id")).agg(F.min(F.col("l_shipdate").cast("date")).alias("_d"))
    rows = tracks(spark, sf_dir).select("track_id", "year").join(first, "track_id", "left")
    return rows.select("track_id", F.when(F.col("year").isNotNull(), F.col("_d")).alias("release"))


def raw_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested sessions: session_id, user_id, session_date (text), conversations, conversation_goal, goal_progress_assessments.

    Every turn has a user's words (the track's artist), music (its id) and, but for the last turn, an
    assistant's answer (its album); the assessment of a turn is its line's status.
    """
    rows = interactions(spark, sf_dir).join(tracks(spark, sf_dir).select("track_id", "artist", "album"), "track_id")
    last = F.max("turn").over(Window.partitionBy("session_id"))
    say = lambda role, text: F.struct(F.lit(role).alias("role"), text.cast("string").alias("content"), F.col("turn").alias("turn_number"))
    said = F.array(say("user", F.col("artist")), say("music", F.col("track_id")), F.when(F.col("turn") < last, say("assistant", F.col("album"))))
    rows = rows.withColumn("_said", F.filter(said, lambda x: x.isNotNull()))
    lines = table(spark, sf_dir, "lineitem")
    place = F.row_number().over(Window.partitionBy("session_id").orderBy("l_linenumber", "l_partkey", "l_suppkey"))
    status = lines.select(F.col("l_orderkey").alias("session_id"), "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag").withColumn("turn", place.cast("long"))
    told = F.when(F.col("l_returnflag") == "N", "MOVES_TOWARD_GOAL").when(F.col("l_returnflag") == "R", "DOES_NOT_MOVE_TOWARD_GOAL")
    rows = rows.join(status.select("session_id", "turn", told.alias("_told")), ["session_id", "turn"])
    nested = rows.groupBy("session_id", "user_id", "session_date").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "_said"))), lambda x: x["_said"])).alias("conversations"),
        F.array_sort(F.collect_list(F.struct(F.col("turn").alias("turn_number"), F.col("_told").alias("goal_progress_assessment")))).alias("goal_progress_assessments"),
    )
    goals = sessions(spark, sf_dir).select("session_id", F.struct("category", "specificity").alias("conversation_goal"))
    return nested.join(goals, "session_id").withColumn("session_date", F.date_format("session_date", "yyyy-MM-dd"))


# general sources and sinks


def last_file_wins(spark: SparkSession, paths: list[str], keys: list[str]) -> DataFrame:
    """Rows of several Parquet files; of rows with the same keys, that of the file whose name is last."""
    rows = spark.read.parquet(*paths).withColumn("_file", F.col("_metadata.file_path"))
    order = Window.partitionBy(*keys).orderBy(F.col("_file").desc())
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_file")


def last_line_wins(spark: SparkSession, path: str, key: str, schema: str) -> DataFrame:
    """A JSON-lines checkpoint: of lines with the same key, the one appended last (by file name and place in it)."""
    rows = spark.read.schema(schema).json(path).withColumn("_at", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()))
    columns = [c for c in rows.columns if c not in (key, "_at")]
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), "_at").alias("_v")).select(key, "_v.*")


def fill_misses(cache: DataFrame, wanted: DataFrame, keys: list[str], compute) -> DataFrame:
    """Cached rows of the wanted keys, and compute(missing keys) for the others."""
    missing = wanted.select(*keys).distinct().join(cache.select(*keys).distinct(), keys, "left_anti")
    return cache.join(wanted.select(*keys).distinct(), keys, "left_semi").unionByName(compute(missing))


def write_once(df: DataFrame, path: str) -> bool:
    """Write Parquet unless the path holds a finished write; whether it wrote."""
    spark = df.sparkSession
    if _exists(spark, f"{path}/_SUCCESS"):
        return False
    df.write.mode("overwrite").parquet(path)
    return True


def write_buckets(df: DataFrame, path: str, bucket: str, sort: list[str]) -> None:
    """Parquet by bucket folder, rows sorted within files."""
    df.repartition(bucket).sortWithinPartitions(*sort).write.mode("overwrite").partitionBy(bucket).parquet(path)


def with_columns(df: DataFrame, wanted: dict[str, str]) -> DataFrame:
    """The wanted columns in order; missing ones as typed NULLs, present ones cast."""
    return df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(t).alias(c) for c, t in wanted.items()])


def submission_records(ranked: DataFrame, responses: DataFrame) -> DataFrame:
    """session_id, record: JSON of a session's list (track_ids) and response text."""
    rows = ranked.join(responses, "session_id", "left")
    return rows.select("session_id", F.to_json(F.struct("session_id", F.col("track_ids").alias("predicted_track_ids"), F.coalesce("response", F.lit("")).alias("predicted_response"))).alias("record"))


def read_responses(spark: SparkSession, path: str) -> DataFrame:
    """session_id, response from JSON files, each one object of session ids and texts."""
    rows = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "map<string,string>")).alias("session_id", "response"))
    return rows.where(F.col("session_id").isNotNull())


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).csv(path, header=True)


def write_guarded(df: DataFrame, path: str, manifest: dict) -> bool:
    """Write Parquet unless the path was written under an equal manifest; whether it wrote.

    The manifest goes before the rows do, so a write that breaks off leaves none and is made again.
    """
    spark = df.sparkSession
    wanted = json.dumps(manifest, sort_keys=True)
    if _exists(spark, f"{path}.manifest/_SUCCESS") and [r[0] for r in spark.read.text(f"{path}.manifest").collect()] == [wanted]:
        return False
    manifest_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}.manifest")
    manifest_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(manifest_path, True)
    df.write.mode("overwrite").parquet(path)
    spark.createDataFrame([(wanted,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}.manifest")
    return True


def content_key(df: DataFrame, columns: list[str]) -> str:
    """A key of a table's content, whatever the order of its rows: two exclusive-or and sum digests of row hashes."""
    h = F.xxhash64(*columns)
    n, x, s = df.agg(F.count("*"), F.bit_xor(h), F.sum(h.cast("decimal(38,0)"))).first()
    return hashlib.sha1(f"{n}:{x}:{s}".encode()).hexdigest()


def cached_by_content(df: DataFrame, columns: list[str], folder: str, compute) -> DataFrame:
    """compute(df), stored under the key of df's content and read back where it is stored already."""
    path = f"{folder}/{content_key(df, columns)}"
    if not _exists(df.sparkSession, f"{path}/_SUCCESS"):
        compute(df).write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    found = spark._jvm.org.apache.hadoop.fs.Path(path)
    return found.getFileSystem(spark._jsc.hadoopConfiguration()).exists(found)


def save_state(tables: dict[str, DataFrame], folder: str) -> None:
    """The tables of a fitted model (weights, idf, steps), each as Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def load_state(spark: SparkSession, folder: str, names: list[str]) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{folder}/{n}") for n in names}
