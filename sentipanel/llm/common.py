"""Helpers shared by the training-data operators."""

from __future__ import annotations

import gc

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ensure_checkpoint_dir

# White space of every word rule here: space, tab, \n, \v, \f, \r.
SPACE = r"\x20\x09-\x0D"
WORD = f"[^{SPACE}]+"

__all__ = ["SPACE", "WORD", "cut_lineage", "ensure_checkpoint_dir", "read", "release", "text_of", "drop_clashing",
           "broadcast_if_small", "skew_join", "join_bounded"]


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def text_of(col: str) -> Column:
    """The whole text; null counts as empty."""
    return F.coalesce(F.col(col), F.lit(""))


def release(spark: SparkSession) -> None:
    """Have the files of shuffles deleted whose tables are no longer held.

    Spark deletes a shuffle's files when the driver's garbage collector finds its table unused, which on an idle driver may be
    long after.  An operator of many steps calls this between them, so that disk holds a step and not their sum.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def drop_clashing(df: DataFrame, results: list[str]) -> DataFrame:
    """Input columns named like a result column give way to the result."""
    taken = {r.lower() for r in results}
    return df.drop(*[c for c in df.columns if c.lower() in taken])


def broadcast_if_small(df: DataFrame, max_rows: int) -> tuple[DataFrame, bool]:
    """Mark a materialised table of narrow rows for broadcast if it has at most ``max_rows`` rows.

    Counts only up to the bound.  Returns the table and whether it is within the bound.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return (F.broadcast(df) if small else df), small


def skew_join(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Join rows to a table with one row per key so that a hot key can be split.

    ``groups`` usually comes out of an aggregation by the same keys.  Spark would reuse
    that partitioning, and a reused partitioning cannot be split at run time.  Joining on
    the keys and their hash asks for an exchange of its own on both sides, and adaptive
    execution then splits a hot partition of ``rows`` (or broadcasts small groups).
    """
    h = F.xxhash64(*[F.col(k) for k in keys])
    name = "__skew_key"
    return rows.withColumn(name, h).join(groups.withColumn(name, h), [*keys, name], how).drop(name)



def join_bounded(rows: DataFrame, groups: DataFrame, keys: list[str], how: str = "inner", max_rows: int = 1_000_000) -> DataFrame:
    """Join rows to a materialised table of narrow rows, one per key: by broadcast within ``max_rows`` rows, else by :func:`skew_join`."""
    groups, small = broadcast_if_small(groups, max_rows)
    return rows.join(groups, keys, how) if small else skew_join(rows, groups, keys, how)
