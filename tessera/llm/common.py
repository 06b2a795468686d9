"""Shared pieces of the training-data operators: durable intermediate tables and row keys."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.sources.stored import new_path, release, shared_dir, stored

__all__ = ["flat_text", "free_names", "new_path", "read_if_there", "release", "row_key", "shared_dir", "stored", "with_id", "word_count"]


def free_names(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until the table has no such column."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        out.append(n)
    return out


def with_id(out: DataFrame, id_col: str) -> DataFrame:
    """The first column under the id's name; of the others, one of that name gets an underscore before it."""
    return out.toDF(id_col, *[f"_{c}" if c.lower() == id_col.lower() else c for c in out.columns[1:]])


def row_key(df: DataFrame, names: tuple[str, str] = ("_rk1", "_rk2")) -> DataFrame:
    """Add two 64-bit hashes of all columns; together they name a row by its content.

    Rows equal in every column share a key. NULLs are marked, so (NULL, 'a') and ('a', NULL) differ.
    """
    cols: list[Column] = []
    for c in df.columns:
        cols += [F.col(f"`{c}`"), F.col(f"`{c}`").isNull()]
    return df.withColumns({names[0]: F.xxhash64(*cols), names[1]: F.xxhash64(F.lit(7), *reversed(cols))})


def flat_text(text: Column) -> Column:
    """The text with every run of blanks and ASCII controls 9 to 13 as one blank, and none at its ends; NULL becomes ''."""
    out = F.coalesce(text, F.lit(""))
    for c in "\n\t\r\x0b\f":
        out = F.replace(out, F.lit(c), F.lit(" "))
    return F.when(F.contains(out, F.lit("  ")), F.regexp_replace(F.trim(out), " {2,}", " ")).otherwise(F.trim(out))


def read_if_there(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The Parquet table at path, or an empty one of that schema where there is none yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def word_count(text: Column) -> Column:
    """Number of words between blanks and controls 9 to 13; 0 for NULL."""
    flat = flat_text(text)
    return F.when(flat == "", F.lit(0)).otherwise(F.length(flat) - F.length(F.replace(flat, F.lit(" "), F.lit(""))) + 1).cast("long")
