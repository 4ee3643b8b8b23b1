"""Signals, NAV curves and strategy metrics.

Per-strategy daily series are bounded by the number of calendar days, so the
running windows here are partitioned by strategy; the cross-sectional step
(weights per day) is a group by (strategy, day).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from .windows import running_product


def drawdown_col(nav: str, key: str = "strategy", day: str = "dt"):
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, 0)
    return F.col(nav) / F.max(nav).over(w) - 1


def rebase_col(c: str, key: str = "strategy", day: str = "dt", base: float = 10000.0):
    w = Window.partitionBy(key).orderBy(day).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return F.col(c) * F.lit(base) / F.first(c).over(w)


def strategy_metrics(nav: DataFrame, key: str = "strategy", day: str = "dt", value: str = "nav") -> DataFrame:
    """total return, CAGR (365-day years), Sharpe (daily, x sqrt(252)), max drawdown, CAGR / |max drawdown|."""
    w = Window.partitionBy(key).orderBy(day)
    d = nav.withColumns({"__ret": safe_div(F.col(value), F.lag(value).over(w)) - 1, "__dd": drawdown_col(value, key, day)})
    agg = d.groupBy(key).agg(
        F.min_by(value, day).alias("__first"), F.max_by(value, day).alias("__last"),
        F.min(day).alias("__d0"), F.max(day).alias("__d1"),
        F.avg("__ret").alias("__mr"), F.stddev_samp("__ret").alias("__sr"), F.min("__dd").alias("max_drawdown"))
    years = F.datediff("__d1", "__d0") / F.lit(365.0)
    total = F.col("__last") / F.col("__first")
    cagr = F.when(years > 0, F.pow(total, 1 / years) - 1)
    return agg.select(key, total.alias("total_return"), cagr.alias("cagr"),
                      (safe_div(F.col("__mr"), F.col("__sr")) * F.sqrt(F.lit(252.0))).alias("sharpe"), "max_drawdown",
                      safe_div(cagr, F.abs(F.col("max_drawdown"))).alias("calmar"))


def signal_weighted_nav(df: DataFrame, signal: str = "signal", price: str = "close", key: str = "strategy",
                        symbol: str = "symbol", day: str = "dt", cost_rate: float = 0.001, base: float = 10000.0) -> DataFrame:
    """Weights = signal / sum(signal) per day (held to the next day; a day with no
    signal keeps the previous weights); daily return = sum(w * r) - cost *
    turnover; NAV = base * running product.  Output: key, day, ret, nav."""
    ws = Window.partitionBy(key, symbol).orderBy(day)
    tot = F.sum(signal).over(Window.partitionBy(key, day))
    d = df.withColumn("__tot", tot).withColumn("__w0", F.when(F.col("__tot") > 0, F.col(signal) / F.col("__tot")))
    d = d.withColumn("__w", F.coalesce(F.last("__w0", ignorenulls=True).over(ws.rowsBetween(Window.unboundedPreceding, 0)),
                                       F.lit(0.0)))
    d = d.withColumn("__r", F.coalesce(safe_div(F.lead(price).over(ws), F.col(price)) - 1, F.lit(0.0)))
    d = d.withColumn("__turn", F.abs(F.col("__w") - F.coalesce(F.lag("__w").over(ws), F.lit(0.0))))
    daily = d.groupBy(key, day).agg((F.sum(F.col("__w") * F.col("__r")) - F.lit(cost_rate) * F.sum("__turn")).alias("ret"))
    wk = Window.partitionBy(key).orderBy(day)
    # the return earned over (t, t+1] is booked on t+1
    daily = daily.withColumn("ret", F.coalesce(F.lag("ret").over(wk), F.lit(0.0)))
    nav = running_product(1 + F.col("ret"), wk.rowsBetween(Window.unboundedPreceding, 0))
    return daily.withColumn("nav", nav * F.lit(base))


def threshold_sweep(df: DataFrame, forecasts: list[str], thresholds: list[float], price: str = "close",
                    symbol: str = "symbol", day: str = "dt", cost_rate: float = 0.0002, base: float = 10000.0) -> DataFrame:
    """Every (forecast, threshold) strategy plus an always-on baseline, all in
    one job: the strategy grid is a literal array exploded per row (a bounded
    generator, not a join); NAV per strategy; one metrics row per strategy."""
    grid = [F.struct(F.lit("baseline").alias("forecast"), F.lit(None).cast("double").alias("threshold"))]
    grid += [F.struct(F.lit(f).alias("forecast"), F.lit(float(t)).alias("threshold")) for f in forecasts for t in thresholds]
    g = df.select(symbol, day, price, *forecasts, F.explode(F.array(*grid)).alias("__s"))
    fval = F.lit(None).cast("double")
    for f in forecasts:
        fval = F.when(F.col("__s.forecast") == f, F.col(f)).otherwise(fval)
    sig = F.when(F.col("__s.forecast") == "baseline", F.lit(1.0)).otherwise(
        F.when(fval > F.col("__s.threshold"), F.lit(1.0)).otherwise(F.lit(0.0)))
    g = g.withColumn("signal", sig).withColumn(
        "strategy", F.concat_ws(":", F.col("__s.forecast"), F.coalesce(F.col("__s.threshold").cast("string"), F.lit("n/a"))))
    nav = signal_weighted_nav(g, "signal", price, "strategy", symbol, day, cost_rate, base)
    return strategy_metrics(nav, "strategy", day, "nav")
