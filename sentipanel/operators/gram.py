"""Block Gram aggregates: the moments of hundreds of columns in one pass.

A partition folds its Arrow batches into one packed state (count, means and centred cross products) by matrix products, so the plan has one
node however many columns there are, and what is shuffled is a state per partition (and group), never a row.  States are
centred and merged by their mean differences, so offsets and constant columns lose no digits.  They are merged in two rounds, of at most
``FAN`` partitions each.

:func:`prefix_grams` gives the states of all rows before each of a list of days: rows are range-partitioned by day, a partition
emits its own prefix at each day it holds and its total, the totals are scanned in partition order, and each prefix is merged with the total of the
partitions before it.
"""

from __future__ import annotations

import datetime
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage

FAN = 64
HELD = 64 << 20  # bytes of group states a task holds before it hands them on


class Gram:
    """Moments of complete rows: n, means and centred cross products, in columns' order."""

    def __init__(self, n: float, mean: np.ndarray, cross: np.ndarray):
        self.n, self.mean, self.cross = n, mean, cross

    @classmethod
    def of(cls, x: np.ndarray) -> "Gram":
        if not len(x):
            return cls(0, np.zeros(x.shape[1]), np.zeros((x.shape[1], x.shape[1])))
        z = x - x[0]
        m = z.mean(axis=0)
        z -= m
        return cls(len(x), x[0] + m, z.T @ z)

    def merge(self, o: "Gram") -> "Gram":
        if not self.n or not o.n:
            return o if not self.n else self
        n, d = self.n + o.n, o.mean - self.mean
        return Gram(n, self.mean + d * (o.n / n), self.cross + o.cross + np.outer(d, d) * (self.n * o.n / n))

    def pack(self) -> bytes:
        k = len(self.mean)
        return np.concatenate([[self.n], self.mean, self.cross[np.triu_indices(k)]]).tobytes()

    @classmethod
    def unpack(cls, data: bytes, k: int) -> "Gram":
        a = np.frombuffer(data)
        cross = np.zeros((k, k))
        cross[np.triu_indices(k)] = a[1 + k:]
        return cls(a[0], a[1:1 + k], cross + np.triu(cross, 1).T)

    def ridge(self, y: int, xs: list[int], alpha: float) -> tuple[np.ndarray, float]:
        """(intercept and slopes, squared error) with an unpenalised intercept; the least-norm solution if singular."""
        a, b = self.cross[np.ix_(xs, xs)], self.cross[xs, y]
        m = a + alpha * np.eye(len(xs))
        try:
            s = np.linalg.solve(m, b)
        except np.linalg.LinAlgError:
            s = np.linalg.lstsq(m, b, rcond=None)[0]
        error = self.cross[y, y] - 2 * s @ b + s @ a @ s
        return np.concatenate([[self.mean[y] - self.mean[xs] @ s], s]), max(float(error), 0.0)


class PairGram:
    """Moments of every pair of columns (a of the left, b of the right list) over the rows that have both."""

    def __init__(self, parts: np.ndarray):
        self.n, self.ma, self.mb, self.ab, self.aa, self.bb = self.parts = parts

    @classmethod
    def of(cls, x: np.ndarray, y: np.ndarray) -> "PairGram":
        def shifted(v):
            ok = ~np.isnan(v)
            near = np.where(ok, np.abs(v - np.nan_to_num(np.nansum(v, axis=0) / np.maximum(ok.sum(axis=0), 1))), np.inf)
            at = near.argmin(axis=0)  # a value of the column near its mean: constants become exactly zero
            ref = np.nan_to_num(v[at, np.arange(v.shape[1])])
            return ok.astype(float), np.where(ok, v - ref, 0), ref
        (va, za, ra), (vb, zb, rb) = shifted(x), shifted(y)
        n = va.T @ vb
        c = np.maximum(n, 1)
        sa, sb = za.T @ vb, va.T @ zb
        return cls(np.stack([n, ra[:, None] + sa / c, rb[None, :] + sb / c, za.T @ zb - sa * sb / c, (za * za).T @ vb - sa * sa / c, va.T @ (zb * zb) - sb * sb / c]))

    def merge(self, o: "PairGram") -> "PairGram":
        n = self.n + o.n
        share, both = o.n / np.maximum(n, 1), self.n * o.n / np.maximum(n, 1)
        da, db = np.where(both > 0, o.ma - self.ma, 0), np.where(both > 0, o.mb - self.mb, 0)
        mean = lambda m, w, d: np.where(self.n > 0, m + d * share, w)
        return PairGram(np.stack([n, mean(self.ma, o.ma, da), mean(self.mb, o.mb, db), self.ab + o.ab + da * db * both, self.aa + o.aa + da * da * both, self.bb + o.bb + db * db * both]))

    def pack(self) -> bytes:
        return self.parts.tobytes()

    @classmethod
    def unpack(cls, data: bytes, ka: int, kb: int) -> "PairGram":
        return cls(np.frombuffer(data).reshape(6, ka, kb))

    def corr(self) -> np.ndarray:
        """Pearson r of every pair; NaN without two rows or where a column does not vary."""
        scale = np.sqrt(np.maximum(self.aa, 0) * np.maximum(self.bb, 0))
        return np.where((self.n > 1) & (scale > 0), np.clip(self.ab / np.where(scale > 0, scale, 1), -1, 1), np.nan)


def _values(b, cols: list[str]) -> np.ndarray:
    """Columns as doubles, nulls as NaN."""
    return np.column_stack([np.asarray(b.column(c).cast(pa.float64()).fill_null(np.nan)) for c in cols]) if b.num_rows else np.empty((0, len(cols)))


def _states(df: DataFrame, keys: list[str], cols: list[str], fold, unpack, held: int) -> DataFrame:
    """(keys, data): merged states; ``fold`` makes one of an array of values, ``held`` is its size in bytes."""
    fields = [f for f in df.schema.fields if f.name in keys]
    fields = sorted(fields, key=lambda f: keys.index(f.name))
    most = max(1, HELD // held)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, groups = TaskContext.get().partitionId(), {}

        def out():
            names = [pa.array([k[i] for k in groups], type=kinds[i]) for i in range(len(keys))]
            rows = pa.RecordBatch.from_arrays([*names, pa.array([part] * len(groups), pa.int32()), pa.array([s.pack() for s in groups.values()], pa.binary())], [*keys, "__part", "data"])
            groups.clear()
            return rows
        kinds = []
        for b in it:
            kinds = kinds or [b.column(k).type for k in keys]
            x = _values(b, cols)
            if keys and len(x):
                coded = np.column_stack([np.asarray(b.column(k).dictionary_encode(null_encoding="encode").indices) for k in keys])
                _, first, at = np.unique(coded, axis=0, return_index=True, return_inverse=True)
                order = np.argsort(at.ravel(), kind="stable")
                parts = np.split(order, np.cumsum(np.bincount(at.ravel()))[:-1])
                named = [(tuple(b.column(k)[int(i)].as_py() for k in keys), p) for i, p in zip(first, parts)]
            else:
                named = [((), np.arange(len(x)))]
            for name, rows in named:
                s = fold(x[rows])
                groups[name] = groups[name].merge(s) if name in groups else s
                if keys and len(groups) >= most:
                    yield out()
        if groups:
            yield out()

    def merge(table: pa.Table) -> pa.Table:
        total = None
        for d in table["data"]:
            s = unpack(d.as_py())
            total = s if total is None else total.merge(s)
        return table.slice(0, 1).select([c for c in table.column_names if c != "data"]).append_column("data", pa.array([total.pack()], pa.binary()))
    out = T.StructType([*fields, T.StructField("__part", T.IntegerType()), T.StructField("data", T.BinaryType())])
    parts = df.select(*keys, *[F.col(c).cast("double").alias(c) for c in cols if c not in keys]).mapInArrow(run, out)
    # groups of equal keys may hold a large share of the rows, but only one state a task
    some = parts.withColumn("__part", (F.col("__part") / FAN).cast("int")).groupBy(*keys, "__part").applyInArrow(merge, out)
    if not keys:
        some = some.withColumn("__all", F.lit(0))
        return some.groupBy("__all").applyInArrow(lambda t: merge(t.select(["__part", "data"])).select(["data"]), "data binary")
    final = T.StructType([*fields, T.StructField("data", T.BinaryType())])
    return some.groupBy(*keys).applyInArrow(lambda t: merge(t.select([*keys, "data"])), final)


def gram(df: DataFrame, cols: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, data): the packed :class:`Gram` of each group's rows that have all ``cols``; a group without such rows has a state of none."""
    k = len(cols)
    whole = lambda x: Gram.of(x[~np.isnan(x).any(axis=1)])
    return _states(df, list(keys or []), cols, whole, lambda d: Gram.unpack(d, k), 8 * (1 + k + k * (k + 1) // 2))


def collect_gram(df: DataFrame, cols: list[str]) -> Gram:
    """The Gram of all complete rows.  Its size depends on the number of columns alone."""
    row = gram(df, cols).first()
    return Gram.unpack(row["data"], len(cols)) if row else Gram.of(np.empty((0, len(cols))))


def pair_corr(df: DataFrame, left: list[str], right: list[str], keys: list[str] | None = None, names: tuple[str, str] = ("a", "b"), upper: bool = False) -> DataFrame:
    """(keys, a, b, r): pairwise-complete Pearson r of every left and right column; only pairs of a column and a later one if ``upper``.

    r is null without two rows that have both, or where one of the columns does not vary over them.  NaN counts as missing.
    """
    keys = list(keys or [])
    ka, kb = len(left), len(right)
    cols = list(dict.fromkeys([*left, *right]))
    ia, ib = [cols.index(c) for c in left], [cols.index(c) for c in right]
    state = _states(df, keys, cols, lambda x: PairGram.of(x[:, ia], x[:, ib]) if len(x) else PairGram(np.zeros((6, ka, kb))), lambda d: PairGram.unpack(d, ka, kb), 48 * ka * kb)
    i, j = np.triu_indices(ka, 1) if upper else (v.ravel() for v in np.indices((ka, kb)))
    a, b = [left[x] for x in i], [right[x] for x in j]
    fields = [f for f in state.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.StringType()), T.StructField("r", T.DoubleType())])

    def rows(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in it:
            for at in range(batch.num_rows):
                r = PairGram.unpack(batch.column("data")[at].as_py(), ka, kb).corr()[i, j]
                own = [pa.array([batch.column(k)[at].as_py()] * len(a), batch.column(k).type) for k in keys]
                yield pa.RecordBatch.from_arrays([*own, pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(r, mask=np.isnan(r))], schema.fieldNames())
    return state.mapInArrow(rows, schema)


def prefix_grams(df: DataFrame, cols: list[str], day: str, wanted: list[datetime.date], partitions: int | None = None) -> DataFrame:
    """(day, data): the packed Gram of the complete rows before each wanted day that has such a row itself.

    ``wanted`` is a part of the calendar.  A day may hold any share of the rows: it is spread over partitions by a hash of the row.
    """
    k = len(cols)
    spark = df.sparkSession
    rows = df.select(F.col(day).cast("date").alias("__day"), *[F.col(c).cast("double").alias(c) for c in cols]).dropna()
    parts = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = rows.repartitionByRange(parts, "__day", F.xxhash64(*cols)).sortWithinPartitions("__day")
    days = frozenset(wanted)

    def walk(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per wanted day at which it begins here (the rows before it), then the total."""
        part, state, last = TaskContext.get().partitionId(), Gram.of(np.empty((0, k))), None

        def row(d):
            return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([d], pa.date32()), pa.array([state.pack()], pa.binary())], ["part", "day", "data"])
        for b in it:
            x = _values(b, cols)
            d = np.asarray(b.column("__day").cast(pa.int32()))
            starts = np.flatnonzero(np.diff(d)) + 1
            for lo, hi in zip([0, *starts], [*starts, len(d)]):
                here = b.column("__day")[int(lo)].as_py() if hi > lo else last
                if here != last and here in days:
                    yield row(here)
                last = here
                state = state.merge(Gram.of(x[lo:hi]))
        yield row(None)
    states = cut_lineage(ranged.mapInArrow(walk, "part int, day date, data binary"))

    def scan(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The total of the partitions before each one: a state a partition, folded as they come."""
        before = Gram.of(np.empty((0, k)))
        for b in it:
            for i in range(b.num_rows):
                yield pa.RecordBatch.from_arrays([b.column("part").slice(i, 1), pa.array([before.pack()], pa.binary())], ["part", "before"])
                before = before.merge(Gram.unpack(b.column("data")[i].as_py(), k))
    totals = states.where("day is null").select("part", "data").coalesce(1).sortWithinPartitions("part")
    before = cut_lineage(totals.mapInArrow(scan, "part int, before binary"))
    # a day that spans partitions begins in the first of them
    begins = states.where("day is not null").groupBy("day").agg(F.min("part").alias("part"))
    local = states.where("day is not null").join(begins, ["day", "part"]).join(before, "part")

    def whole(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            for i in range(b.num_rows):
                s = Gram.unpack(b.column("before")[i].as_py(), k).merge(Gram.unpack(b.column("data")[i].as_py(), k))
                yield pa.RecordBatch.from_arrays([b.column("day").slice(i, 1), pa.array([s.pack()], pa.binary())], [day, "data"])
    return local.select("day", "data", "before").mapInArrow(whole, T.StructType([T.StructField(day, T.DateType()), T.StructField("data", T.BinaryType())]))


def solved(states: DataFrame, keys: list[str], k: int, alpha: float) -> DataFrame:
    """(keys, b): intercept and slopes of column 0 on the others for each state with rows."""
    fields = [f for f in states.schema.fields if f.name in keys]
    schema = T.StructType([*fields, T.StructField("b", T.ArrayType(T.DoubleType()))])

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            grams = [Gram.unpack(d.as_py(), k) for d in b.column("data")]
            fits = [g.ridge(0, list(range(1, k)), alpha)[0].tolist() if g.n else None for g in grams]
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in fields], pa.array(fits, pa.list_(pa.float64()))], schema.fieldNames())
    return states.mapInArrow(run, schema).where("b is not null")


def subset_errors(g: Gram, sets: list[tuple[str, list[int]]], spark, alpha: float) -> DataFrame:
    """(name, mse): in-sample ridge error of column 0 on each set of columns; the sets are spread over tasks, the state goes along."""
    state = pickle.dumps(g)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = pickle.loads(state)
        for b in it:
            mse = [own.ridge(0, xs, alpha)[1] / own.n for xs in b.column("xs").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("feature_set"), pa.array(mse, pa.float64())], ["feature_set", "mse"])
    rows = spark.createDataFrame(sets, "feature_set string, xs array<int>")
    return rows.repartition(max(1, min(len(sets) // 16, 64)), "feature_set").mapInArrow(run, "feature_set string, mse double")
