"""Joins and set operations that build the (symbol, dt) panel.

Size notes for the cluster:
* the spine is generated with ``explode(sequence(...))`` per symbol: a
  Generate, not a cross join; it is #symbols x #days rows;
* the index-price side is keyed by day only, so it is bounded by the calendar
  (~7.7k rows for 21 years).  It is broadcast only behind ``bounded_broadcast``
  which checks a row count; larger inputs fall back to a shuffle join.
"""

from __future__ import annotations

import datetime as _dt

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 1_000_000


def bounded_broadcast(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, known_bound: int | None = None) -> DataFrame:
    """Broadcast ``df`` only when its size is proven small.

    ``known_bound`` is a static bound from the caller (e.g. days in a calendar,
    literal rows); without one the rows are counted (one cheap pass over an
    already small, usually aggregated side).  Above the bound the frame is
    returned unchanged and Spark plans a shuffle join.
    """
    if known_bound is not None and known_bound <= max_rows:
        return F.broadcast(df)
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


def _lit_date(d) -> Column:
    if isinstance(d, Column):
        return d
    if isinstance(d, str):
        d = _dt.date.fromisoformat(d)
    return F.lit(d)


def calendar_spine(symbols: DataFrame, start, end, key: str = "symbol", day: str = "dt") -> DataFrame:
    """Distinct symbols x every day in [start, end] (both inclusive)."""
    return (symbols.select(key).distinct()
                   .select(key, F.explode(F.sequence(_lit_date(start), _lit_date(end))).alias(day)))


def calendar_spine_by_range(ranges: DataFrame, key: str = "symbol", day: str = "dt",
                            lo: str = "lo", hi: str = "hi") -> DataFrame:
    """Per-key day ranges -> dense days (keys carry their own min/max)."""
    return ranges.select(key, F.explode(F.sequence(F.col(lo), F.col(hi))).alias(day))


def join_panel(spine: DataFrame, channels: dict[str, DataFrame] | DataFrame, prices: DataFrame | None,
               index: DataFrame | None, key: str = "symbol", day: str = "dt",
               sentiment_col: str = "roberta_normalised_compound", start=None, end=None) -> DataFrame:
    """spine LEFT JOIN each channel (symbol, dt) LEFT JOIN prices LEFT JOIN index (dt).

    ``channels`` maps a channel name to a daily frame (output column
    ``{name}_sentiment``), or is one wide daily frame that already carries the
    ``*_sentiment`` columns.  All equi-joins share the (symbol, dt) key, so
    after the first shuffle the rest are co-partitioned.

    The index side is keyed by day: restricted to [start, end] and reduced to
    one row per day, its size is bounded by the calendar length, which is the
    proven bound used for the broadcast (no counting job).
    """
    out = spine
    if isinstance(channels, DataFrame):
        out = out.join(channels, [key, day], "left")
    else:
        for name, ch in channels.items():
            out = out.join(ch.select(key, day, F.col(sentiment_col).alias(f"{name}_sentiment")), [key, day], "left")
    if prices is not None:
        out = out.join(prices.select(key, day, "open", "close", "high", "low"), [key, day], "left")
    if index is not None:
        idx = index.select(day, "sp500_open", "sp500_close")
        if start is not None and end is not None:
            s_, e_ = _as_date(start), _as_date(end)
            idx = (idx.filter(F.col(day).between(F.lit(s_), F.lit(e_)))
                      .groupBy(day).agg(*[F.max_by(c, F.struct("sp500_open", "sp500_close")).alias(c) for c in ("sp500_open", "sp500_close")]))
            out = out.join(bounded_broadcast(idx, known_bound=(e_ - s_).days + 1), [day], "left")
        else:
            out = out.join(bounded_broadcast(idx), [day], "left")
    return out


def _as_date(d):
    return _dt.date.fromisoformat(d) if isinstance(d, str) else d


def pivot_sources(long: DataFrame, source: str, value: str, prefix: str, sources: list[str],
                  keys=("symbol", "dt")) -> DataFrame:
    """One pivot with explicit values (no extra job to discover them); of repeated cells the greatest value."""
    wide = long.groupBy(*keys).pivot(source, sources).agg(F.max(value))
    return wide.select(*keys, *[F.col(f"`{s}`").alias(f"{prefix}{s}") for s in sources])


def join_channels_full(frames: dict[str, DataFrame], keys=("symbol", "dt"), value: str = "value") -> DataFrame:
    """Full outer join of several (keys, value) frames, NULL -> 0."""
    out = None
    names = []
    for name, f in frames.items():
        f = f.select(*keys, F.col(value).alias(name))
        names.append(name)
        out = f if out is None else out.join(f, list(keys), "full")
    return out.fillna(0.0, subset=names)


def join_symbol_compare(df: DataFrame, symbols: list[str], value_cols: list[str], key="symbol", day="dt") -> DataFrame:
    """Side by side series of a few symbols on dt (pivot instead of self-joins)."""
    sub = df.filter(F.col(key).isin(symbols))
    aggs = [F.first(c).alias(c) for c in value_cols]
    wide = sub.groupBy(day).pivot(key, symbols).agg(*aggs)
    return wide


def delayed_join(left: DataFrame, right: DataFrame, days: int, keys=("symbol",), day="dt") -> DataFrame:
    """left LEFT JOIN right after shifting right's date forward by ``days``."""
    r = right.withColumn(day, F.date_add(F.col(day), days))
    return left.join(r, [*keys, day], "left")


def asof_backward(left: DataFrame, right: DataFrame, left_on: str, right_on: str, right_cols: list[str],
                  key: str | None = None, partitions: int | None = None) -> DataFrame:
    """Backward as-of join: each left row gets the latest right row with right_on <= left_on, and with the same ``key`` if one is given.

    Both sides are range-partitioned together by (key, time), so no window spans a table or a key: every partition carries the
    last right row on, and the last right rows of the partitions before it fill its head (:func:`ordered.carry`).  Of right rows of equal time
    the greatest by ``right_cols`` counts.  Left rows with a null time or key, or without an earlier right row, get nulls.
    """
    from .ordered import carry
    lcols = left.columns
    k = [key] if key else []
    clash = {f"__r_{c}": t for c, t in right.select(*right_cols).dtypes}
    one = left.select(*lcols, F.col(left_on).alias("__t"), F.lit(1).alias("__side"), *[F.lit(None).cast(t).alias(c) for c, t in clash.items()])
    two = right.where(F.col(right_on).isNotNull()).select(
        *[F.col(c).cast(t).alias(c) if c == key else F.lit(None).cast(t).alias(c) for c, t in left.dtypes],
        F.col(right_on).alias("__t"), F.lit(0).alias("__side"), *[F.col(c).alias(f"__r_{c}") for c in right_cols])
    order = [*k, "__t", "__side", *clash]
    known = F.col("__t").isNotNull() & (F.col(key).isNotNull() if key else F.lit(True))
    both = carry(one.where(known).unionByName(two), order, list(clash), since=F.col("__side") == 0, keys=k, partitions=partitions)
    out = both.where("__side = 1").unionByName(one.where(~known))
    return out.select(*lcols, *[F.col(f"__r_{c}").alias(c) for c in right_cols])


def asof_dimension(left: DataFrame, dim: DataFrame, left_on: str, dim_on: str, cols: list[str],
                   bucket: str = "month") -> DataFrame:
    """Backward as-of join against a small dated dimension (e.g. monthly macro
    figures), every dimension column forward-filled in date order first.

    The dimension becomes validity ranges [from, next from); each range is
    exploded to the calendar buckets (months) it overlaps and the left side is
    left-joined on its own bucket and range, read once.  Left rows after
    the last dimension date use the last range (bucket clamped to the last
    bucket, read as a scalar subquery); rows before the first date get NULLs.
    The dimension is a few hundred rows (one per month) and is broadcast only
    behind a row-count check.  The ordered window below runs over that
    dimension alone.
    """
    w = Window.orderBy(dim_on)
    wf = w.rowsBetween(Window.unboundedPreceding, 0)
    ranges = dim.select(F.col(dim_on).alias("__from"), F.lead(dim_on).over(w).alias("__to"),
                        *[F.last(c, ignorenulls=True).over(wf).alias(c) for c in cols])
    last_from = F.trunc(F.coalesce(F.date_sub(F.col("__to"), 1), F.col("__from")), bucket)
    ranges = ranges.select("*", F.explode(F.sequence(F.trunc("__from", bucket), last_from,
                                                     F.expr("INTERVAL 1 MONTH"))).alias("__bucket"))
    max_b = ranges.select(F.max("__bucket")).scalar()
    l2 = left.withColumn("__b", F.least(F.trunc(F.col(left_on), bucket), max_b))
    # ranges tile [first date, +inf) without overlap: a left row matches at most one
    ok = (F.col("__b") == F.col("__bucket")) & (F.col(left_on) >= F.col("__from")) & (F.col("__to").isNull() | (F.col(left_on) < F.col("__to")))
    return l2.join(bounded_broadcast(ranges), ok, "left").select(*left.columns, *cols)


def merge_macro(left: DataFrame, macro: DataFrame, left_on: str, macro_on: str, order: list[str], cols: list[str]) -> DataFrame:
    """The as-of join with the macro figures, then every column filled forward in ``order`` (a total order that starts with the day)."""
    from .ordered import carry
    joined = asof_dimension(left, macro, left_on, macro_on, cols)
    return carry(joined, order, [c for c in joined.columns if c not in order])


def top_child_join(posts: DataFrame, comments: DataFrame, post_key: str, child_key: str, score: str,
                   child_cols: list[str], order_tiebreak: str) -> DataFrame:
    """Highest-scored child per post (ties: lowest ``order_tiebreak``) left-joined to posts."""
    best = (comments.groupBy(child_key)
                    .agg(F.max_by(F.struct(*[F.col(c) for c in child_cols]),
                                  F.struct(F.col(score), -F.col(order_tiebreak))).alias("__best")))
    best = best.select(F.col(child_key).alias(post_key), *[F.col(f"__best.{c}").alias(f"top_{c}") for c in child_cols])
    return posts.join(best, [post_key], "left")


def union_files(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f, allowMissingColumns=True)
    return out


def union_symbols(frames: list[DataFrame], key="symbol", day="dt") -> tuple[DataFrame, DataFrame]:
    """Distinct union of symbol sets and the global [min, max] day."""
    syms = union_files([f.select(key) for f in frames]).distinct()
    days = union_files([f.select(day) for f in frames]).agg(F.min(day).alias("lo"), F.max(day).alias("hi"))
    return syms, days


def exact_dedup(df: DataFrame) -> DataFrame:
    return df.dropDuplicates()


def dedup_keep_last(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Keep the last row per key under ``order``, ties by the other columns; null keys are keys.  See :func:`ordered.last_rows`."""
    from .ordered import last_rows
    return last_rows(df, keys, [*order, *[c for c in df.columns if c not in (*keys, *order)]])


def join_post_meta(comments: DataFrame, posts: DataFrame, post_key: str = "post_id",
                   meta: dict[str, str] | None = None) -> DataFrame:
    """comment LEFT JOIN its post; a missing post yields empty metadata."""
    meta = meta or {}
    p = posts.select(F.col(post_key).alias("__pk"), *[F.col(src).alias(dst) for src, dst in meta.items()])
    out = comments.join(p, comments[post_key] == p["__pk"], "left")
    return out.withColumn("found_post_id", F.coalesce(F.col("__pk").cast("string"), F.lit(""))).drop("__pk")


def symbol_dimension(df: DataFrame, dim: DataFrame, key="symbol") -> DataFrame:
    """Attach the standard name of each symbol (dimension of ~500 rows)."""
    return df.join(bounded_broadcast(dim, known_bound=None), [key], "left")
