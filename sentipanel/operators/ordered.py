"""Operators on a whole ordered table without a window over it.

``carry`` is a distributed forward fill: rows are range-partitioned in order, every partition fills itself as its batches come, and the last values
of the partitions before it (one row a partition) fill its head.  ``last_rows`` and ``last_values`` are arg-max aggregations: a
fixed-width order key is aggregated by hash, the rows that reach their key's maximum are the candidates, and only these are compared in full.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage


def _changes(b: pa.RecordBatch, keys: list[str], last: tuple | None) -> tuple[np.ndarray, tuple | None]:
    """Where a row's keys differ from the row before it, and the last row's keys."""
    rows = list(zip(*[b.column(k).to_pylist() for k in keys])) if keys else [()] * b.num_rows
    new = np.zeros(b.num_rows, dtype=bool)
    for i, r in enumerate(rows if keys else ()):
        new[i], last = r != last, r
    return new, last


def carry(df: DataFrame, order: list[str], cols: list[str], since: Column | None = None, keys: list[str] | None = None,
          partitions: int | None = None) -> DataFrame:
    """``df`` with ``cols`` carried forward in ``order``: each row gets every column's last value that is not null, or, with
    ``since``, all columns' values of the last row for which it holds, nulls included.

    ``keys``, which come first in ``order``, bound the carry.  Rows before the first value keep null.  A key or value may hold any
    share of the rows: ranges are cut on the whole order.
    """
    keys = list(keys or [])
    n = partitions or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    flag = df.withColumn("__since", F.coalesce(since, F.lit(False)) if since is not None else F.lit(False))
    ranged = flag.repartitionByRange(n, *[F.col(c) for c in order]).sortWithinPartitions(*order)
    plain = since is None
    groups = [[c] for c in cols] if plain else [list(cols)]  # columns that are taken from one row
    schema = T.StructType([*ranged.schema.fields, *[T.StructField(f"__seen{i}", T.BooleanType()) for i in range(len(groups))],
                           T.StructField("__part", T.IntegerType()), T.StructField("__no", T.LongType())])

    def fill(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no, last = TaskContext.get().partitionId(), 0, None
        held: list[dict | None] = [None] * len(groups)  # by group the row to carry on, within the last key
        for b in it:
            if not b.num_rows:
                continue
            new, last_key = _changes(b, keys, last)
            run = np.maximum.accumulate(np.where(new, np.arange(b.num_rows), -1))  # -1: the key of the batch before goes on
            out = {c: b.column(c) for c in b.schema.names}
            seen = []
            for g, names in enumerate(groups):
                valid = ~np.asarray(b.column(names[0]).is_null()) if plain else np.asarray(b.column("__since"), dtype=bool)
                at = np.maximum.accumulate(np.where(valid, np.arange(b.num_rows), -1))
                at = np.where(at >= run, at, -1)
                old = (at < 0) & (run < 0) & (held[g] is not None)
                pick = pa.array(np.where(at >= 0, at + 1, 0), pa.int64(), mask=(at < 0) & ~old)
                for c in names:
                    head = pa.array([held[g][c] if held[g] is not None else None], b.column(c).type)
                    out[c] = pa.concat_arrays([head, b.column(c)]).take(pick)
                seen.append(pa.array((at >= 0) | old))
                if at[-1] >= 0:
                    held[g] = {c: b.column(c)[int(at[-1])].as_py() for c in names}
                elif run[-1] >= 0:
                    held[g] = None
            last = last_key
            yield pa.RecordBatch.from_arrays([*out.values(), *seen, pa.array([part] * b.num_rows, pa.int32()), pa.array(np.arange(no, no + b.num_rows))], schema.fieldNames())
            no += b.num_rows
    local = cut_lineage(ranged.mapInArrow(fill, schema))
    # one row a partition: what its last row carries
    ends = local.groupBy("__part").agg(F.max("__no").alias("__no"))
    ends = local.join(F.broadcast(ends), ["__part", "__no"])
    w = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    held = [F.last(F.when(F.col(f"__seen{g}"), F.struct(*keys, *[F.col(c).alias(f"v{i}") for i, c in enumerate(names)])), ignorenulls=True).over(w).alias(f"__held{g}")
            for g, names in enumerate(groups)]
    before = ends.select(F.col("__part"), *held)
    out = local.join(F.broadcast(before), "__part", "left")
    for g, names in enumerate(groups):
        own = F.col(f"__seen{g}")
        fits = F.lit(True)
        for k in keys:
            fits = fits & F.col(f"__held{g}.{k}").eqNullSafe(F.col(k))
        out = out.withColumns({c: F.when(own, F.col(c)).otherwise(F.when(fits, F.col(f"__held{g}.v{i}"))) for i, c in enumerate(names)})
    return out.select(*df.columns)


# ------------------------------------------------------------ arg-max ----

def order_key(c: str, kind: T.DataType) -> Column | None:
    """A fixed-width column that never falls where ``c`` rises, or none: numbers and times as they are, strings by their first 7 bytes."""
    if isinstance(kind, (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType, T.BooleanType)):
        return F.col(c)
    if isinstance(kind, T.StringType):
        return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(c), "UTF-8"), 1, 7)), 14, "0"), 16, 10).cast("long")
    return None


def _first_key(df: DataFrame, order: list[str]) -> Column:
    key = order_key(order[0], df.schema[order[0]].dataType) if order else None
    return key if key is not None else F.lit(0)


def _reach(df: DataFrame, keys: list[str], marks: list[Column], key: Column) -> DataFrame:
    """The rows that have their key's greatest order key among the rows that a mark holds for, for any of the marks, with ``__h``.

    The maxima are hash aggregates, partial on every task.  The rows travel once: on the keys and their hash, an exchange of their
    own that adaptive execution can split, so a hot key's rows are compared in many tasks and few go on.
    """
    h = F.xxhash64(*[F.col(k) for k in keys])
    rows = df.withColumns({"__d": key, "__h": h})
    tops = df.withColumn("__d", key).groupBy(*keys).agg(*[F.max(F.when(m, F.col("__d"))).alias(f"__top{i}") for i, m in enumerate(marks)],
                                                        *[F.max(m.cast("int")).alias(f"__any{i}") for i, m in enumerate(marks)])
    tops = tops.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], *[f"__top{i}" for i in range(len(marks))], *[f"__any{i}" for i in range(len(marks))],
                       h.alias("__kh"))
    on = F.col("__h") == F.col("__kh")
    for i, k in enumerate(keys):
        on = on & F.col(k).eqNullSafe(F.col(f"__k{i}"))
    hit = F.lit(False)
    for i, m in enumerate(marks):
        hit = hit | (m & F.col("__d").eqNullSafe(F.col(f"__top{i}")))
    return rows.join(tops, on & hit, "left_semi").drop("__d")


def last_rows(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key in ``order``; equal rows are interchangeable.  Null keys are keys, null order values come first."""
    near = _reach(df, keys, [F.lit(True)], _first_key(df, order))
    w = Window.partitionBy(*keys, "__h").orderBy(*[F.desc(c) for c in order])
    return near.withColumn("__r", F.row_number().over(w)).where("__r = 1").select(*df.columns)


def last_values(df: DataFrame, keys: list[str], cols: list[str], order: list[str]) -> DataFrame:
    """(keys, cols): per key each column's last value in ``order`` that is not null."""
    marks = [F.col(c).isNotNull() for c in cols]
    # a key without any value keeps its row
    near = _reach(df.select(*dict.fromkeys([*keys, *cols, *order])), keys, [*marks, F.lit(True)], _first_key(df, order))
    w = Window.partitionBy(*keys, "__h").orderBy(*[F.asc(c) for c in order])
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    last = [F.last(c, ignorenulls=True).over(whole).alias(f"__v{i}") for i, c in enumerate(cols)]
    out = near.select(*keys, *last, F.row_number().over(w).alias("__r")).where("__r = 1")
    return out.select(*keys, *[F.col(f"__v{i}").alias(c) for i, c in enumerate(cols) if c not in keys])
