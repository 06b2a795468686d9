"""The registered queries of the training-data operators: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import classifier, conversations, licenses, mixing, nearest, ngram_join, packing, quality_rules, secrets, simhash, token_counts, token_files, whitening
from tessera.llm.common import new_path
from tessera.llm.conversation_sql import CONVERSATION_SQL


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and labels of every document."""
    return licenses.scan(_documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents as packed ids in files, read back."""
    path = new_path(spark, "token-files")
    token_files.write_tokens(_documents(spark, sf_dir), path, _vocabulary("byte_bpe_50k.json"), end_id=0)
    return token_files.read_tokens(spark, path)


def op3_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20, exact (factor one)."""
    return nearest.nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 20 == 0, k=20, factor=1.0)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of all documents through a cache that starts empty, so every distinct text is encoded once."""
    return token_counts.token_counts(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), new_path(spark, "token-counts"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ledger of every document with the verdict of policy v1; base_failed is the base policy's verdict."""
    led = quality_rules.ledger(_documents(spark, sf_dir))
    out = quality_rules.apply_policy(led, quality_rules.POLICIES["v1"]).withColumn("base_failed", ~quality_rules.passes(quality_rules.POLICIES["base"]))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
        "fail_bits", "n_lines", "n_upper", "n_distinct_words", "policy_version",
    )


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack_documents(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), end_id=1, capacity=4096)


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    found = simhash.near_duplicates(_documents(spark, sf_dir), ["doc_id"])
    return found.select("doc_id", simhash.hex_digits(F.col("fp")).alias("fingerprint"), "component_id")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    return secrets.scan(_documents(spark, sf_dir))


def op8_entropy_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words the mix takes of every document."""
    return mixing.mix(_documents(spark, sf_dir), ["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "source", "rate", "copies")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a machine that never saw the held-out labels."""
    docs = _documents(spark, sf_dir)
    return classifier.score(docs, classifier.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 16 leading whitened components of every vector."""
    return whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), most=16)


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, audit and digest of every conversation, damaged first."""
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return conversations.report(talks, conversations.damaged(conversations.turns_of(talks)))


def op13_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set size and component of every document, linked at 85 of 100 common 4-word shingles."""
    return ngram_join.near_duplicates(_documents(spark, sf_dir), ["doc_id"], percent=85, width=4)


QUERIES = {
    "op1_license_scan": op1_license_scan,
    "op2_token_files": op2_token_files,
    "op3_nearest": op3_nearest,
    "op4_token_counts": op4_token_counts,
    "op5_quality_rules": op5_quality_rules,
    "op6_best_fit_packing": op6_best_fit_packing,
    "op7_simhash": op7_simhash,
    "op8_entropy_mix": op8_entropy_mix,
    "op9_quality_classifier": op9_quality_classifier,
    "op10_secret_scan": op10_secret_scan,
    "op11_whitening": op11_whitening,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_ngram_jaccard": op13_ngram_jaccard,
}

#: DuckDB SQL where SQL can express the operator on whole tables.
ORACLE_SQL: dict[str, str] = {
    # a search with factor one is exact; products are added component by component on both sides
    "op3_nearest": """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.e) = len(c.e))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 20
""",
    "op5_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
w AS (
  SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM d),
windows AS (
  SELECT r, i, array_to_string(ws[i : i + 7], ' ') AS x
  FROM w, unnest(range(1, len(ws) - 6)) AS u(i)),
repeated AS (SELECT r, i FROM windows QUALIFY count(*) OVER (PARTITION BY r, x) > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n FROM repeated, unnest(range(0, 8)) AS o(k) GROUP BY r),
m AS (
  SELECT w.doc_id, len(ws) AS n_words,
    CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    coalesce(c.n, 0) AS n_repeat_words,
    CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS BIGINT) AS n_upper,
    CAST(len(list_distinct(ws)) AS BIGINT) AS n_distinct_words
  FROM w LEFT JOIN covered c ON c.r = w.r),
f AS (
  SELECT *, CAST(
      (n_words < 20)::INT + 2 * (100 * n_repeat_words > 30 * n_words)::INT + 4 * (10 * n_symbols > 3 * n_words)::INT
    + 8 * (2 * n_dup_lines > n_lines)::INT + 16 * (2 * word_chars < 3 * n_words OR word_chars > 40 * n_words)::INT
    + 32 * (word_chars >= 50 AND 2 * n_upper > word_chars)::INT
    + 64 * (n_words >= 20 AND n_distinct_words < 20 AND 100 * n_distinct_words < 5 * n_words)::INT AS BIGINT) AS fail_bits
  FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, n_symbols, n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
  fail_bits & 3 <> 0 AS base_failed, fail_bits & 127 = 0 AS kept, fail_bits, n_lines, n_upper, n_distinct_words, 'v1' AS policy_version
FROM f
""",
    "op12_conversation_repair": CONVERSATION_SQL,
}
