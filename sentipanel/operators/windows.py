"""Window and time-series operators on the long (symbol, dt) panel.

All windows are partitioned by the series key and ordered by ``dt``.  On a
dense daily panel a partition holds at most one row per calendar day, so a
series never outgrows a task no matter how much raw text fed it.  Build all
windows of one frame in a single ``select`` so Spark sorts once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import _c, safe_div
from .moments import Frame, rolling

UNB_P = Window.unboundedPreceding
UNB_F = Window.unboundedFollowing


def series_window(key: str | list[str] = "symbol", order: str = "dt"):
    keys = [key] if isinstance(key, str) else list(key)
    return Window.partitionBy(*keys).orderBy(order)


# ------------------------------------------------------------ fills ----

def backfill(c: str, key="symbol", order="dt") -> Column:
    """Next known value (bfill) within the series.

    Written as a forward fill over the DESCENDING order: an unbounded-preceding
    frame is evaluated incrementally (linear), whereas a
    current-row..unbounded-following frame is re-aggregated for every row
    (quadratic in the series length)."""
    keys = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*keys).orderBy(F.col(order).desc()).rowsBetween(UNB_P, 0)
    return F.last(F.col(c), ignorenulls=True).over(w)


def forward_fill_col(c: Column | str, key="symbol", order="dt") -> Column:
    w = series_window(key, order).rowsBetween(UNB_P, 0)
    return F.last(_c(c), ignorenulls=True).over(w)


def backfill_prices(df: DataFrame, cols=("open", "close", "high", "low", "sp500_open", "sp500_close"),
                    key="symbol", order="dt") -> DataFrame:
    return df.withColumns({c: backfill(c, key, order) for c in cols if c in df.columns})


def forward_fill(df: DataFrame, cols, key="symbol", order="dt") -> DataFrame:
    return df.withColumns({c: forward_fill_col(c, key, order) for c in cols})


# ------------------------------------------------------------- shifts ----

def lead_lag(df: DataFrame, c: str, n: int, key="symbol", order="dt", name: str | None = None) -> DataFrame:
    """pandas ``shift(n)``: n > 0 looks back (lag), n < 0 looks ahead (lead)."""
    w = series_window(key, order)
    expr = F.lag(c, n).over(w) if n >= 0 else F.lead(c, -n).over(w)
    return df.withColumn(name or f"{c}_shift_{n}", expr)


def tradeable_price(c: str = "close", same_day: bool = False, key="symbol", order="dt") -> Column:
    """The price one can trade at: same-day close, or the next row's close."""
    return F.col(c) if same_day else F.lead(c, 1).over(series_window(key, order))


def inverse_step_return(p: str, key="symbol", order="dt") -> Column:
    """p(t)/p(t+1) - 1 after a forward fill (pandas ``pct_change(-1)`` semantics)."""
    filled = forward_fill_col(p, key, order)
    return safe_div(filled, F.lead(filled, 1).over(series_window(key, order))) - 1


def past_return(p: str, n: int, key="symbol", order="dt") -> Column:
    """p(t)/p(t-n) - 1."""
    return safe_div(F.col(p), F.lag(p, n).over(series_window(key, order))) - 1


def forward_log_return(close: str, tradeable: str, h: int, key="symbol", order="dt") -> Column:
    """ln(close(t+h) forward-filled / tradeable(t)); NULL -> 0."""
    fwd = F.lead(close, h).over(series_window(key, order))
    fwd_ff = F.last(fwd, ignorenulls=True).over(series_window(key, order).rowsBetween(UNB_P, 0))
    return F.coalesce(F.log(safe_div(fwd_ff, F.col(tradeable))), F.lit(0.0))


def forward_volatility(step_ret: str, h: int, key="symbol", order="dt") -> Column:
    """Sample std of ``step_ret`` over rows t+1..t+h, NULL unless all h are present."""
    w = series_window(key, order).rowsBetween(1, h)
    return F.when(F.count(step_ret).over(w) == h, F.stddev_samp(step_ret).over(w))


# ------------------------------------------------------------ rolling ----

def _guard(value: Column, c: str, w, min_periods: int) -> Column:
    if min_periods <= 1:
        return value
    return F.when(F.count(F.col(c)).over(w) >= min_periods, value)


def _rolling(kind: str, c: str, n: int, min_periods: int, key, order) -> Column:
    """Plain sliding frame, for short n inside a larger select: costs rows x n.  ``moments.rolling`` costs the same at every n."""
    w = series_window(key, order).rowsBetween(-(n - 1), 0)
    agg = {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp}[kind](c).over(w)
    return _guard(agg, c, w, min_periods)


def rolling_mean(c: str, n: int, min_periods: int | None = None, key="symbol", order="dt") -> Column:
    return _rolling("mean", c, n, n if min_periods is None else min_periods, key, order)


def rolling_sum(c: str, n: int, min_periods: int | None = None, key="symbol", order="dt") -> Column:
    """pandas rolling sum: 0 for an all-null frame when min_periods = 0."""
    mp = n if min_periods is None else min_periods
    s = _rolling("sum", c, n, mp, key, order)
    return F.coalesce(s, F.lit(0.0)) if mp == 0 else s


def rolling_std(c: str, n: int, min_periods: int | None = None, key="symbol", order="dt") -> Column:
    return _rolling("std", c, n, n if min_periods is None else min_periods, key, order)


def momentum_feature(c: str, L: int, key="symbol", order="dt") -> Column:
    """(mean_L - mean_3L) / std_6L with min_periods 0; NULL -> 0."""
    m1 = rolling_mean(c, L, 0, key, order)
    m3 = rolling_mean(c, 3 * L, 0, key, order)
    s6 = rolling_std(c, 6 * L, 0, key, order)
    return F.coalesce(safe_div(m1 - m3, s6), F.lit(0.0))


def feature_volatility(c: str, L: int, key="symbol", order="dt") -> Column:
    return rolling_std(c, L, 0, key, order)


def momentum_feature_fixed(c: str, key="symbol", order="dt") -> Column:
    """(mean_30[>=10] - coalesce(mean_90[>=10], 0)) / std_365[>=20]."""
    m30 = rolling_mean(c, 30, 10, key, order)
    m90 = F.coalesce(rolling_mean(c, 90, 10, key, order), F.lit(0.0))
    s365 = rolling_std(c, 365, 20, key, order)
    return safe_div(m30 - m90, s365)


def rolling_zscore_clip(c: str, n: int = 365, lo: float = 0.0, hi: float = 5.0,
                        min_periods: int | None = None, key="symbol", order="dt") -> Column:
    z = safe_div(F.col(c) - rolling_mean(c, n, min_periods, key, order), rolling_std(c, n, min_periods, key, order))
    return F.when(z.isNull(), z).otherwise(F.least(F.greatest(z, F.lit(lo)), F.lit(hi)))


def with_momentum_fixed(df: DataFrame, c: str, out: str, key="symbol", order="dt") -> DataFrame:
    """:func:`momentum_feature_fixed` from linear rolling moments."""
    t = {"__m30": Frame("mean", c, 30, 10), "__m90": Frame("mean", c, 90, 10), "__s365": Frame("std", c, 365, 20)}
    m90 = F.coalesce(F.col("__m90"), F.lit(0.0))
    return rolling(df, t, key, order).withColumn(out, safe_div(F.col("__m30") - m90, F.col("__s365"))).drop(*t)


def with_zscore_clip(df: DataFrame, c: str, out: str, n: int = 365, lo: float = 0.0, hi: float = 5.0,
                     min_periods: int | None = None, key="symbol", order="dt") -> DataFrame:
    """:func:`rolling_zscore_clip` from linear rolling moments."""
    t = {"__m": Frame("mean", c, n, min_periods), "__s": Frame("std", c, n, min_periods)}
    z = safe_div(F.col(c) - F.col("__m"), F.col("__s"))
    return rolling(df, t, key, order).withColumn(out, F.when(z.isNotNull(), F.least(F.greatest(z, F.lit(lo)), F.lit(hi)))).drop(*t)


def with_detrend(df: DataFrame, c: str, out: str, n: int = 90, min_periods: int | None = None, key="symbol", order="dt") -> DataFrame:
    """:func:`detrend` from linear rolling moments."""
    return rolling(df, {"__m": Frame("mean", c, n, min_periods)}, key, order).withColumn(out, F.col(c) - F.col("__m")).drop("__m")


def detrend(c: str, n: int = 90, min_periods: int | None = None, key="symbol", order="dt") -> Column:
    return F.col(c) - rolling_mean(c, n, min_periods, key, order)


def calendar_rolling_mean(c: str, days: int = 30, key="symbol", order="dt") -> Column:
    """Time-based frame (t - days, t] on a date column."""
    w = Window.partitionBy(key).orderBy(F.unix_date(F.col(order).cast("date"))).rangeBetween(-(days - 1), 0)
    return F.avg(c).over(w)


def rebase_series(c: str, key: str, order="dt", base: float = 10000.0) -> Column:
    """x * base / first(x) per series (key required: a series is bounded by its days)."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(UNB_P, UNB_F)
    return F.col(c) * F.lit(base) / F.first(c).over(w)


def drawdown(c: str, key: str, order="dt") -> Column:
    w = Window.partitionBy(key).orderBy(order).rowsBetween(UNB_P, 0)
    return F.col(c) / F.max(c).over(w) - 1


# ------------------------------------------------------- calendar ops ----

def resample_mean(df: DataFrame, cols: list[str], days: int = 30, key: str = "symbol", day: str = "dt") -> DataFrame:
    """Tumbling ``days`` bins per key, origin = the key's first day, label = bin
    start; empty bins between the first and last are kept with NULL means."""
    first = F.min(day).over(Window.partitionBy(key))
    binned = df.withColumn("__bin", F.floor(F.datediff(F.col(day), first) / days).cast("int")) \
               .withColumn("__origin", first)
    agg = binned.groupBy(key, "__bin").agg(F.first("__origin").alias("__origin"), *[F.avg(c).alias(c) for c in cols])
    rng = agg.groupBy(key).agg(F.max("__bin").alias("__max"), F.first("__origin").alias("__origin"))
    spine = rng.select(key, "__origin", F.explode(F.sequence(F.lit(0), F.col("__max"))).alias("__bin"))
    out = spine.join(agg.drop("__origin"), [key, "__bin"], "left")
    return out.select(key, F.date_add(F.col("__origin"), F.col("__bin") * days).alias(day), *cols)


def rolling30_then_resample(df: DataFrame, cols: list[str], n: int = 30, days: int = 30,
                            key: str = "symbol", day: str = "dt") -> DataFrame:
    means = {f"__{c}": Frame("mean", c, n, 1) for c in cols}
    rolled = rolling(df, means, key, day).withColumns({c: F.col(f"__{c}") for c in cols}).drop(*means)
    return resample_mean(rolled, cols, days, key, day)


def reindex_daily(df: DataFrame, cols: list[str], key: str = "symbol", day: str = "dt", fill: float = 0.0) -> DataFrame:
    """Dense daily series between each key's first and last day, gaps filled."""
    rng = df.groupBy(key).agg(F.min(day).alias("__lo"), F.max(day).alias("__hi"))
    spine = rng.select(key, F.explode(F.sequence("__lo", "__hi")).alias(day))
    out = spine.join(df.select(key, day, *cols), [key, day], "left")
    return out.fillna(fill, subset=cols)


def consecutive_pairs(df: DataFrame, c: str, key: str = "symbol", day: str = "dt") -> DataFrame:
    """(x_t, x_{t+1}) per key with both present."""
    w = series_window(key, day)
    return (df.select(key, day, F.col(c).alias("x_t"), F.lead(c, 1).over(w).alias("x_next"))
              .filter(F.col("x_t").isNotNull() & F.col("x_next").isNotNull()))


def downsample(df: DataFrame, n: int, key: str | None = "symbol", order: str | list[str] = "dt") -> DataFrame:
    """Rows 0, n, 2n, ... of each key in order; without a key, of the whole
    frame in ``order`` (a global row index from range-partitioned offsets,
    never a single-partition window).  ``order`` must be a total order."""
    orders = [order] if isinstance(order, str) else list(order)
    if key:
        w = Window.partitionBy(key).orderBy(*orders)
        return df.withColumn("__rn", F.row_number().over(w) - 1).filter(F.col("__rn") % n == 0).drop("__rn")
    return global_row_index(df, orders, "__rn").filter(F.col("__rn") % n == 0).drop("__rn")


def _ranged(df: DataFrame, keys: list[str], partitions: int | None):
    from ..session import cut_lineage
    spark = df.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranged = df.repartitionByRange(n, *[F.col(k) for k in keys]).withColumn("__pid", F.spark_partition_id())
    return cut_lineage(ranged)  # pin partition ids (reliable checkpoint: identical on recompute)


def global_row_index(df: DataFrame, order: list[str], out: str = "row_index", partitions: int | None = None) -> DataFrame:
    """0-based position of each row in the global ``order`` (a total order).

    Range partitioning on the full sort key spreads even a hot value; each
    partition numbers its rows; per-partition counts (one row per partition)
    become prefix offsets, broadcast back."""
    ranged = _ranged(df, order, partitions)
    wl = Window.partitionBy("__pid").orderBy(*order)
    local = ranged.withColumn("__i", F.row_number().over(wl) - 1)
    counts = ranged.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    wo = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # <= #partitions rows
    offsets = counts.select("__pid", F.coalesce(F.sum("__c").over(wo), F.lit(0)).alias("__o"))
    return (local.join(F.broadcast(offsets), ["__pid"], "inner")
                 .withColumn(out, F.col("__i") + F.col("__o")).drop("__pid", "__i", "__o"))


def cumulative_by_feature(df: DataFrame, feature: str, target: str, tiebreak: list[str],
                          partitions: int | None = None) -> DataFrame:
    """Sort by feature; running sum of target and running count.

    Never a single-partition window: rows are range-partitioned on the full
    sort key (feature + tiebreak, so even a hot feature value is spread), each
    partition computes a local prefix sum, and per-partition totals (one row
    per partition) are prefix-summed into offsets and broadcast back.
    """
    keys = [feature, *tiebreak]
    ranged = _ranged(df, keys, partitions)
    wl = Window.partitionBy("__pid").orderBy(*keys).rowsBetween(Window.unboundedPreceding, 0)
    local = ranged.withColumns({"__cs": F.sum(target).over(wl), "__cn": F.count(F.lit(1)).over(wl)})
    totals = ranged.groupBy("__pid").agg(F.sum(target).alias("__ts"), F.count(F.lit(1)).alias("__tn"))
    wo = Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)  # <= n rows
    offsets = totals.select("__pid", F.coalesce(F.sum("__ts").over(wo), F.lit(0.0)).alias("__os"),
                            F.coalesce(F.sum("__tn").over(wo), F.lit(0)).alias("__on"))
    out = local.join(F.broadcast(offsets), ["__pid"], "inner")
    return (out.withColumn("cs_ret", F.col("__cs") + F.col("__os"))
               .withColumn("cs_trades", F.col("__cn") + F.col("__on"))
               .drop("__pid", "__cs", "__cn", "__os", "__on"))


def nav_curve(df: DataFrame, price: str, signal: str, key: str = "strategy", day: str = "dt",
              base: float = 10000.0) -> DataFrame:
    """returns = p(t+1)/p(t) where signal == 1 else 1 (NULL -> 1);
    nav = base * running product, as exp(running sum of logs), and 0 from a total loss on."""
    w = series_window(key, day)
    r = F.when(F.col(signal) == 1, safe_div(F.lead(price, 1).over(w), F.col(price))).otherwise(F.lit(1.0))
    out = df.withColumn("returns", F.coalesce(r, F.lit(1.0)))
    wc = w.rowsBetween(UNB_P, 0)
    return out.withColumn("nav", running_product(F.col("returns"), wc) * F.lit(base))


def running_product(factor: Column, w) -> Column:
    """Product of the factors of a frame; 0 once one of them is 0 or less, which no logarithm tells."""
    lost = F.max((factor <= 0).cast("int")).over(w) == 1
    return F.when(lost, F.lit(0.0)).otherwise(F.exp(F.sum(F.when(factor > 0, F.log(factor))).over(w)))
