"""Row filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def filter_mentions(df: DataFrame, c: str, patterns: list[str]) -> DataFrame:
    """Rows whose ``c`` contains any pattern (case-sensitive, literal)."""
    cond = reduce(lambda a, b: a | b, [F.contains(F.col(c), F.lit(p)) for p in patterns])
    return df.filter(cond)


def filter_symbols(df: DataFrame, symbols: list[str], key: str = "symbol") -> DataFrame:
    return df.filter(F.col(key).isin(symbols))


def filter_nonzero(df: DataFrame, c: str) -> DataFrame:
    return df.filter(F.col(c) != 0)


def train_test_split_by_date(df: DataFrame, train_end, test_start, day: str = "dt"):
    """(train, test): train dt < train_end, test dt >= test_start (a gap between)."""
    return (df.filter(F.col(day) < F.lit(train_end).cast("date")),
            df.filter(F.col(day) >= F.lit(test_start).cast("date")))


def drop_cols(df: DataFrame, cols: list[str]) -> DataFrame:
    """Without the named columns; names that are not there are passed over."""
    return df.drop(*cols)


def numeric_only(df: DataFrame) -> DataFrame:
    """Its number columns, in order."""
    keep = [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]
    return df.select(*keep)


def fill_zero(df: DataFrame, cols=None) -> DataFrame:
    return df.fillna(0.0, subset=cols) if cols else df.fillna(0.0)


def drop_null(df: DataFrame, cols=None) -> DataFrame:
    return df.dropna(subset=cols) if cols else df.dropna()
