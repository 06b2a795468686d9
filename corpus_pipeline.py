"""Corpus pipeline: quality rules, near-duplicates, secrets, mixing and packing over the documents table.

Every stage takes all rows that the one before it kept and its decisions take effect: rejected
documents and all but one of each near-duplicate group go, secrets' values are replaced, documents
are left out or repeated as the mix says, and what remains is packed. All but the last return the
columns of documents.

Defined cases: a NULL, empty or short text fails the quality rules. NULL ids are ids like others, and
rows are told apart by all their columns; rows equal in every column are near-duplicates of each other,
and copies that the mix makes are packed as documents of their own. A NULL source is a source of its
own, the last. Extra columns are dropped by the first stage. An empty table passes through every
stage and gives no row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.llm import mixing, packing, quality_rules, secrets, simhash
from tessera.llm.common import new_path, row_key, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass policy v1."""
    return quality_rules.keep_passing(docs.select(COLUMNS), quality_rules.POLICIES["v1"])


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component: that of the smallest doc_id, then of the smallest row key."""
    keyed = row_key(docs.select(COLUMNS))
    found = simhash.near_duplicates(keyed, ["doc_id", "_rk1", "_rk2"])
    # by the component itself: NULL ids and ids on several texts don't name one
    first = found.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_rk1", "_rk2")).alias("first"))
    stay = stored(first.select("first._rk1", "first._rk2"), "survivors")
    kept = keyed.join(stay, ["_rk1", "_rk2"], "left_semi")
    once = Window.partitionBy("_rk1", "_rk2").orderBy("_rk1")  # rows equal in every column
    return kept.withColumn("_n", F.row_number().over(once)).where(F.col("_n") == 1).select(COLUMNS)


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with the values of secrets replaced; n_chars follows."""
    clean = secrets.redact(docs.select(COLUMNS))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(COLUMNS)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them (0, 1 or 2 times)."""
    keyed = row_key(docs.select(COLUMNS))
    taken = mixing.mix(keyed, ["_rk1", "_rk2"]).select("_rk1", "_rk2", "copies")
    # rows equal in every column: the k-th of them gets the k-th decision
    nth = lambda order: F.row_number().over(Window.partitionBy("_rk1", "_rk2").orderBy(order))
    decided = stored(taken.withColumn("_n", nth("copies")).where(F.col("copies") > 0), "decided")
    rows = keyed.withColumn("_n", nth("_rk1")).join(decided, ["_rk1", "_rk2", "_n"])
    return rows.withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 4096 tokens."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1, capacity=4096)


STAGES = [
    ("quality_rules", keep_quality),
    ("simhash_near_dedup", keep_one_of_each),
    ("secret_scan", without_secrets),
    ("entropy_mix", mixed),
    ("best_fit_packing", packed),
]

#: Fingerprints, Newton steps and packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to documents; between stages the rows are written and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            path = new_path(spark, f"stage-{name}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
