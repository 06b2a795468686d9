"""Streams give what the same rows give as a table, also over several files and restarts."""

from pyspark.sql import functions as F

from tessera.operators.text import bigrams
from tessera.streaming.running_counts import bigram_counts, start, windowed_counts

SF = "/root/testdata/sf0.001"


def test_bigram_counts_grow_with_the_stream(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/conversations.parquet")
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = bigram_counts(stream).writeStream.outputMode("complete").format("memory").queryName("grams").start()
    q.processAllAvailable()
    q.stop()
    want = bigrams(rows, [], F.col("text")).groupBy("bigram").count()
    assert sorted(map(tuple, spark.table("grams").collect())) == sorted(map(tuple, want.collect()))


def test_windows_survive_a_restart(spark, tmp_path):
    rows = spark.read.parquet(f"{SF}/events.parquet").orderBy("ts")
    rows.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second start finds nothing new
        start(windowed_counts(stream, "ts", ["event_type"], "1 day", "1 hour"), f"{tmp_path}/out", f"{tmp_path}/state").awaitTermination()
    got = {(r.event_type, r.start): r.n for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    want = {(r.event_type, r.start): r.n for r in rows.groupBy("event_type", F.window(F.col("ts").cast("timestamp"), "1 day").alias("w")).agg(F.count("*").alias("n")).select("event_type", F.col("w.start").alias("start"), "n").collect()}
    assert set(got) <= set(want) and all(want[k] == n for k, n in got.items())
    assert len(got) >= len(want) - 5  # only the last day's windows are still open
