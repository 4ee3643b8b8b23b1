"""Rolling moments over long series, linear in the rows and exact.

A trailing frame of n rows spans at most two blocks of n rows: a tail of the block before and a head of its own.  Running (count, mean, sum of
squared deviations) forward through each block gives every head, running it backward gives every tail, and one merge of two such states gives
the frame.  Nothing is subtracted from a running sum, so large offsets and constant stretches lose no digits, and
the cost per row does not depend on n.

One pass over a series (a symbol's days, bounded by its calendar) computes all frames of all columns: the states of a block position are vectors over
the blocks and columns, so hundreds of features cost arithmetic and no plan nodes.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

KINDS = ("mean", "sum", "std", "momentum")


@dataclass(frozen=True)
class Frame:
    """One rolling column: ``kind`` of ``col`` over the last ``n`` rows, null with fewer than ``min_periods`` values.

    ``momentum`` is (mean over n - mean over 3 n) / std over 6 n, and 0 where that is null.
    """
    kind: str
    col: str
    n: int
    min_periods: int | None = None

    @property
    def least(self) -> int:
        return self.n if self.min_periods is None else self.min_periods

    def lengths(self) -> list[int]:
        return [self.n, 3 * self.n, 6 * self.n] if self.kind == "momentum" else [self.n]


def running(x: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean less base, squared deviations and base of x[:, :j + 1] along axis 1 of (blocks, positions, columns).

    The base is a run's first value, so an offset that the run shares is gone before anything is averaged or squared.
    """
    first = valid.argmax(axis=1)[:, None, :]
    base = np.where(np.take_along_axis(valid, first, 1), np.take_along_axis(x, first, 1), 0)
    x = np.where(valid, x - base, 0)
    count = np.cumsum(valid, axis=1, dtype=np.float64)
    mean, dev = np.empty_like(x), np.empty_like(x)
    m, d = np.zeros((x.shape[0], x.shape[2])), np.zeros((x.shape[0], x.shape[2]))
    share = valid / np.maximum(count, 1)
    for j in range(x.shape[1]):
        off = np.where(valid[:, j], x[:, j] - m, 0)
        m = m + off * share[:, j]
        d = d + off * np.where(valid[:, j], x[:, j] - m, 0)
        mean[:, j], dev[:, j] = m, d
    return count, mean, dev, np.broadcast_to(base, x.shape)


def merged(a, b):
    """Count, mean and squared deviations of two disjoint runs as one; an empty run changes nothing."""
    count = a[0] + b[0]
    share = b[0] / np.maximum(count, 1)
    off = np.where((a[0] > 0) & (b[0] > 0), (b[1] - a[1]) + (b[3] - a[3]), 0)
    mean = np.where(a[0] > 0, a[3] + (a[1] + off * share), b[3] + b[1])
    return count, mean, a[2] + b[2] + off * off * a[0] * share


def _blocks(x: np.ndarray, n: int) -> np.ndarray:
    """(rows, columns) as (blocks, n, columns), zeros at the end."""
    pad = -len(x) % n
    return np.concatenate([x, np.zeros((pad, *x.shape[1:]), dtype=x.dtype)]).reshape(-1, n, *x.shape[1:])


def _frames(head, tail, rows: int, n: int, empty, join):
    """Values of every row's frame from the block heads and the tails one block before."""
    out = []
    for h, t, zero in zip(head, tail, empty):
        before = np.full_like(h, zero)
        before[1:, :-1] = t[:-1, 1:]
        out.append((h, before))
    both = join([b for _, b in out], [h for h, _ in out])
    return [v.reshape(-1, v.shape[2])[:rows] for v in both]


def frame_moments(x: np.ndarray, valid: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count, mean and squared deviations of the last n rows at every row of (rows, columns)."""
    n = max(1, min(n, len(x)))
    b, v = _blocks(x, n), _blocks(valid, n)
    head = running(b, v)
    tail = [s[:, ::-1] for s in running(b[:, ::-1], v[:, ::-1])]
    return tuple(_frames(head, tail, len(x), n, (0, 0, 0, 0), merged))


def frame_sums(x: np.ndarray, n: int) -> np.ndarray:
    """Sums over the last n rows; whole numbers stay whole."""
    n = max(1, min(n, len(x)))
    b = _blocks(x, n)
    head, tail = np.cumsum(b, axis=1), np.cumsum(b[:, ::-1], axis=1)[:, ::-1]
    return _frames([head], [tail], len(x), n, (0,), lambda t, h: [t[0] + h[0]])[0]


def _std(state) -> tuple[np.ndarray, np.ndarray]:
    count, _, dev = state
    return np.sqrt(dev / np.maximum(count - 1, 1)), count > 1


def _momentum(short, middle, long) -> np.ndarray:
    spread, known = _std(long)
    known = known & (short[0] > 0) & (spread != 0)
    return np.where(known, (short[1] - middle[1]) / np.where(known, spread, 1), 0)


def rolling(df: DataFrame, frames: dict[str, Frame], key: str | list[str] = "symbol", order: str | list[str] = "dt") -> DataFrame:
    """``df`` with a rolling column per entry of ``frames``, trailing rows of each key in ``order``.

    Nulls are no values: means and deviations skip them and ``min_periods`` counts what is left.  NaN is a value and makes the
    frames that hold it NaN.  A mean of no value is null, a deviation of fewer than two is null, a sum of none is 0 with
    ``min_periods`` 0 and null otherwise.  Sums of whole-number columns are whole.  An existing column of a result's name is replaced.  Rows of equal
    order keep an arbitrary order among themselves; an empty frame gives an empty result.
    """
    if not frames:
        return df
    keys = [key] if isinstance(key, str) else list(key)
    orders = [order] if isinstance(order, str) else list(order)
    for f in frames.values():
        if f.kind not in KINDS or f.n < 1:
            raise ValueError(f"no such frame: {f}")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    whole = {f.col for f in frames.values() if f.kind == "sum" and isinstance(kinds[f.col], (T.ByteType, T.ShortType, T.IntegerType, T.LongType))}
    moments = list(dict.fromkeys(f.col for f in frames.values() if f.kind != "sum"))
    lengths = {n: list(dict.fromkeys(f.col for f in frames.values() if f.kind != "sum" and n in f.lengths()))
               for f in frames.values() for n in f.lengths() if f.kind != "sum"}
    kept = [f for f in df.schema.fields if f.name not in frames]
    schema = T.StructType(kept + [T.StructField(name, T.LongType() if f.kind == "sum" and f.col in whole else T.DoubleType()) for name, f in frames.items()])
    names = [f.name for f in kept]

    def values(table: pa.Table, c: str, kind) -> tuple[np.ndarray, np.ndarray]:
        col = table[c].combine_chunks().cast(kind)
        valid = ~np.asarray(col.is_null())
        return np.asarray(col.fill_null(0)), valid

    def one_series(table: pa.Table) -> pa.Table:
        table = table.take(pc.sort_indices(table, sort_keys=[(c, "ascending") for c in orders], null_placement="at_start"))
        read = {c: values(table, c, pa.float64()) for c in moments}
        state = {}
        for n, cols in lengths.items():
            x, v = np.column_stack([read[c][0] for c in cols]), np.column_stack([read[c][1] for c in cols])
            s = frame_moments(x, v, n)
            state |= {(n, c): tuple(p[:, k] for p in s) for k, c in enumerate(cols)}
        out = table.select(names)
        for name, f in frames.items():
            if f.kind == "momentum":
                value, known = _momentum(*[state[n, f.col] for n in f.lengths()]), None
            elif f.kind == "sum":
                x, v = values(table, f.col, pa.int64() if f.col in whole else pa.float64())
                value = frame_sums(x[:, None], f.n)[:, 0]
                known = frame_sums(v.astype(np.int64)[:, None], f.n)[:, 0] >= f.least
            else:
                s = state[f.n, f.col]
                value, known = (s[1], s[0] > 0) if f.kind == "mean" else _std(s)
                known = known & (s[0] >= f.least)
            out = out.append_column(name, pa.array(value, mask=None if known is None else ~known))
        return out
    return df.groupBy(*keys).applyInArrow(one_series, schema)
