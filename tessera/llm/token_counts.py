"""Token counts from a digest cache.

Every text is normalised and digested; stored counts are joined by the digests of content and
tokenizer version. Only distinct texts that the cache lacks are encoded, and their counts appended.

Defined cases: a NULL text counts as empty (0 bytes, 0 tokens). Repeated rows and NULL ids keep a
result row each. Columns other than the id and the text are not read, so extra ones don't matter.
An empty table appends nothing. Texts are counted whole, at any length.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import flat_text, read_if_there, stored, with_id
from tessera.llm.encoding import Encoder, encoder

CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"


def tokenizer_version(path: str) -> str:
    """Digest of a vocabulary file: another version of it never meets old counts."""
    with open(path, "rb") as f:
        return hashlib.file_digest(f, "sha256").hexdigest()


def normalised(text: Column, mode: str) -> Column:
    """The text as far as counts depend on it: where the tokenizer drops white space, runs of it are one blank."""
    return flat_text(text) if mode == "blank dropped" else F.coalesce(text, F.lit(""))


def count_texts(path: str):
    """Arrow function: (digest, text) rows to (digest, n_tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path)
        for b in batches:
            n = e.count_all(b.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64())], names=["digest", "n_tokens"])

    return run


def token_counts(docs: DataFrame, tokenizer: str, cache: str, id_col: str = "doc_id", text: str = "text", limit: int = 2048) -> DataFrame:
    """id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit) of every row; `cache` is a Parquet path that grows."""
    spark, version = docs.sparkSession, tokenizer_version(tokenizer)
    schema = spark.createDataFrame([], CACHE_SCHEMA).schema
    norm = normalised(F.col(text), Encoder(tokenizer).mode)
    keyed = docs.select(
        F.col(id_col).alias("_id"),
        F.octet_length(F.coalesce(F.col(text), F.lit(""))).cast("long").alias("n_bytes"),
        norm.alias("_norm"),
    ).withColumn("digest", F.unhex(F.sha2(F.col("_norm"), 256)))

    def stored_counts() -> DataFrame:
        return read_if_there(spark, cache, schema).where(F.col("tokenizer") == version).select("digest", "n_tokens")

    # distinct first: copies meet before the shuffle, so a hot text reaches its task once from each other task
    distinct = keyed.groupBy("digest").agg(F.first("_norm").alias("_norm"))
    misses = distinct.join(stored_counts().select("digest"), "digest", "left_anti")
    fresh = misses.mapInArrow(count_texts(tokenizer), "digest binary, n_tokens long")
    fresh.select("digest", F.lit(version).alias("tokenizer"), "n_tokens").write.mode("append").parquet(cache)
    counts = stored_counts().groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))  # two runs at once may add a digest twice
    counts = stored(counts, "counts")  # read anew, it is shuffled for the join, which can then split a hot digest
    out = keyed.drop("_norm").join(counts, "digest").select("_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
    return with_id(out, id_col)
