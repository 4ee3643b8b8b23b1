"""Aggregations.  Every one is a hash aggregate with a partial (map-side)
phase, so a hot key is pre-aggregated on each task before the shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_div, utc_ms_to_day
from ..session import cut_lineage
from .ordered import last_values
from .panel import bounded_broadcast

SCORE_COLS = ("roberta_pos", "roberta_neu", "roberta_neg", "roberta_compound", "roberta_normalised_compound")


def daily_mean_sentiment(df: DataFrame, scores=SCORE_COLS, key="symbol", day: Column | str | None = None,
                         ms_col: str | None = None) -> DataFrame:
    """Mean of the score columns per (key, UTC day).

    ``day`` is a date column/expression; with ``ms_col`` the day is derived from
    epoch milliseconds.  NULL scores (empty segments) are skipped by ``avg``.
    """
    if ms_col is not None:
        day_col = utc_ms_to_day(ms_col)
    elif day is None:
        day_col = F.col("dt").cast("date")
    else:
        day_col = F.col(day) if isinstance(day, str) else day
    keys = [key] if isinstance(key, str) else list(key)
    return (df.withColumn("dt", day_col)
              .groupBy(*keys, "dt")
              .agg(*[F.avg(c).alias(c) for c in scores]))


def last_non_null_per_key(df: DataFrame, key: str, cols: list[str], order: list[str]) -> DataFrame:
    """pandas ``groupby(key).agg('last')``: per column the last NON-NULL value.

    Deterministic order = ``order`` columns; null keys are dropped.  The maxima of a fixed-width order key per column are hash
    aggregates; only the rows that reach one are compared in full (:func:`ordered.last_values`).
    """
    return last_values(df.filter(F.col(key).isNotNull()), [key], cols, order)


def weighted_daily_sentiment(df: DataFrame, day: str, keys: list[str], weighted: str, weight: str,
                             out: str = "avg_sentiment") -> DataFrame:
    """sum(weighted)/sum(weight) per (day, keys); ``weighted`` = value*weight per row."""
    return (df.groupBy(day, *keys)
              .agg(F.sum(weight).alias("score_sum"), F.sum(F.col(weighted)).alias("weighted_sum"))
              .withColumn(out, safe_div(F.col("weighted_sum"), F.col("score_sum"))))


def equal_daily_sentiment(df: DataFrame, day: str, keys: list[str], value: str,
                          out: str = "avg_sentiment") -> DataFrame:
    return (df.groupBy(day, *keys)
              .agg(F.sum(value).alias("weighted_sum"), F.count(F.lit(1)).alias("weight_sum"))
              .withColumn(out, safe_div(F.col("weighted_sum"), F.col("weight_sum"))))


def top_sources(df: DataFrame, source: str, day: str, n: int = 50) -> DataFrame:
    """Sources with the most distinct days; ties broken by name."""
    return (df.groupBy(source).agg(F.count_distinct(day).alias("n_days"))
              .orderBy(F.desc("n_days"), F.asc(source)).limit(n))


def value_counts_top(df: DataFrame, c: str, n: int = 50) -> DataFrame:
    return df.groupBy(c).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.asc(c)).limit(n)


def sum_by_day(df: DataFrame, day: str, value: str, out: str = "total") -> DataFrame:
    return df.groupBy(day).agg(F.sum(value).alias(out))


def mean_by_source(df: DataFrame, source: str, cols: list[str]) -> DataFrame:
    return df.groupBy(source).agg(*[F.avg(c).alias(c) for c in cols])


def binned_target(df: DataFrame, feature: str, target: str, digits: int = 2, min_count: int = 500) -> DataFrame:
    return (df.withColumn("bin", F.round(F.col(feature), digits))
              .groupBy("bin").agg(F.avg(target).alias("mean_target"), F.count(F.lit(1)).alias("n"))
              .filter(F.col("n") > min_count))


def histogram(df: DataFrame, c: str, bins: int, group: list[str] | None = None) -> DataFrame:
    """Equal-width histogram between min and max (numpy/pandas convention: the
    last bin is closed on the right).  Bounds come from one aggregate, read as a
    scalar subquery; the counting is a partial aggregate."""
    group = group or []
    lo = df.select(F.min(c)).scalar()
    hi = df.select(F.max(c)).scalar()
    width = (hi - lo) / F.lit(bins)
    b = F.when(hi == lo, F.lit(0)).otherwise(
        F.least(F.floor((F.col(c) - lo) / width).cast("int"), F.lit(bins - 1)))
    return (df.filter(F.col(c).isNotNull())
              .withColumn("bin", b)
              .groupBy(*group, "bin").agg(F.count(F.lit(1)).alias("n"))
              .withColumn("bin_lo", lo + F.col("bin") * width)
              .withColumn("bin_hi", lo + (F.col("bin") + 1) * width))


def exact_quantiles(df: DataFrame, c: str, quantiles: list[float], key: str, bins: int = 256) -> DataFrame:
    """(key, q array): exact quantiles with linear interpolation per key, by counting.

    The order statistics around each quantile start with their key's whole range.  Each round counts the values of a range in
    equal bins (a hash aggregate of at most ``bins`` rows a range) and narrows it to the least and greatest value of
    the bin that holds the rank, until both are equal.  No task holds a key's values.  Nulls and NaN are no values.
    """
    rows = df.select(key, F.col(c).cast("double").alias("__x")).where("__x is not null and not isnan(__x)")
    whole = rows.groupBy(key).agg(F.count(F.lit(1)).alias("__n"), F.min("__x").alias("lo"), F.max("__x").alias("hi"))
    at = lambda q: (F.col("__n") - 1) * F.lit(float(q))
    ranks = F.array(*[f(at(q)).cast("long") for q in quantiles for f in (F.floor, F.ceil)])
    open_ = whole.select(key, "__n", "lo", "hi", F.posexplode(ranks).alias("i", "rank"))
    open_ = cut_lineage(open_.select("*", F.col("rank").alias("left")))
    done = []
    while True:
        done.append(open_.where("lo = hi").select(key, "__n", "i", "lo"))
        open_ = open_.where("lo < hi")
        if not open_.limit(1).count():
            break
        ranges = open_.select(F.col(key).alias("__k"), "lo", "hi").distinct()
        inside = rows.join(bounded_broadcast(ranges), F.col(key).eqNullSafe(F.col("__k")) & (F.col("__x") >= F.col("lo")) & (F.col("__x") <= F.col("hi")))
        share = F.when(F.col("hi") - F.col("lo") < float("inf"), (F.col("__x") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(
            (F.col("__x") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2))
        bin_ = F.floor(share * F.lit(bins)).cast("int")
        counts = inside.groupBy("__k", F.col("lo").alias("__lo"), F.col("hi").alias("__hi"), bin_.alias("bin")).agg(
            F.count(F.lit(1)).alias("m"), F.min("__x").alias("least"), F.max("__x").alias("most"))
        w = Window.partitionBy("__k", "__lo", "__hi").orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("before", F.coalesce(F.sum("m").over(w), F.lit(0)))
        hit = (F.col(key).eqNullSafe(F.col("__k")) & (F.col("lo") == F.col("__lo")) & (F.col("hi") == F.col("__hi"))
               & (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("m")))
        open_ = cut_lineage(open_.join(counts, hit).select(key, "__n", F.col("least").alias("lo"), F.col("most").alias("hi"), "i", "rank", (F.col("left") - F.col("before")).alias("left")))
    found = done[0]
    for d in done[1:]:
        found = found.unionByName(d)
    v = found.groupBy(key).agg(F.max("__n").alias("__n"), *[F.max(F.when(F.col("i") == i, F.col("lo"))).alias(f"__v{i}") for i in range(2 * len(quantiles))])
    part = [at(q) - F.floor(at(q)) for q in quantiles]
    q = F.array(*[F.col(f"__v{2 * i}") + (F.col(f"__v{2 * i + 1}") - F.col(f"__v{2 * i}")) * p for i, p in enumerate(part)])
    return v.select(key, q.alias("q"))


def describe_by_symbol(df: DataFrame, c: str, key: str = "symbol") -> DataFrame:
    """count, mean, std, min, quartiles (linear interpolation), max per key; the quartiles are exact and found by counting."""
    stats = df.groupBy(key).agg(F.count(c).alias("count"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    q = exact_quantiles(df, c, [0.25, 0.5, 0.75], key).withColumnRenamed(key, "__key")
    return stats.join(q, F.col(key).eqNullSafe(F.col("__key")), "left").select(
        key, "count", "mean", "std", "min", F.get("q", F.lit(0)).alias("p25"), F.get("q", F.lit(1)).alias("p50"), F.get("q", F.lit(2)).alias("p75"), "max")


def null_profile(df: DataFrame) -> DataFrame:
    """One row per column: column, dtype, null count, row count (one pass)."""
    aggs = [F.count_if(F.col(c).isNull()).alias(c) for c in df.columns]
    wide = df.agg(F.count(F.lit(1)).alias("__rows"), *aggs)
    stack = ", ".join(f"'{c}', `{c}`" for c in df.columns)
    dtypes = dict(df.dtypes)
    out = wide.selectExpr("__rows AS n_rows", f"stack({len(df.columns)}, {stack}) AS (column, n_null)")
    mapping = F.create_map(*[x for c in df.columns for x in (F.lit(c), F.lit(dtypes[c]))])
    return out.withColumn("dtype", mapping[F.col("column")])


def conditional_stats(df: DataFrame, feature: str, target: str, threshold: float, above: bool = True) -> DataFrame:
    cond = F.col(feature) > threshold if above else F.col(feature) < threshold
    return df.filter(cond).agg(F.sum(target).alias("sum_target"), F.avg(target).alias("mean_target"),
                               F.count(F.lit(1)).alias("n"))


def coef_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    return df.groupBy(group).agg(F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"),
                                 F.median(value).alias("median"))


def market_features(df: DataFrame, day: str, feature_cols: list[str], market_cols: list[str],
                    order: str = "symbol") -> DataFrame:
    """Per day: mean of the features and the last (by ``order``) market value."""
    aggs = [F.avg(c).alias(c) for c in feature_cols]
    aggs += [F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in market_cols]
    return df.groupBy(day).agg(*aggs)


def position_share(df: DataFrame, value: str, day: str = "dt", out: str = "share") -> DataFrame:
    """value / row total per day (window per day: one day's rows = #symbols)."""
    return df.withColumn(out, safe_div(F.col(value), F.sum(value).over(Window.partitionBy(day))))


def row_mean(cols: list[str]) -> Column:
    """Mean across columns skipping NULLs (pandas ``mean(axis=1)``)."""
    arr = F.filter(F.array(*[F.col(c).cast("double") for c in cols]), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(arr, F.lit(0.0), lambda a, x: a + x), F.size(arr))
