"""The panel -> features -> targets plan (``load_dataset``).

One frame, keyed (symbol, dt); every window is partitioned by symbol and
ordered by dt, so Spark shuffles the panel once and re-uses that sort for the
fills, targets and rolling features.
"""

from __future__ import annotations

from collections.abc import Collection

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import safe_div
from ..operators import windows as W
from ..operators.moments import Frame, rolling

PRICE_COLS = ("open", "close", "high", "low", "sp500_open", "sp500_close")
CHANNELS = ("news", "submissions", "comments")


def filter_date_range(df: DataFrame, start=None, end=None, day: str = "dt", closed: str = "both") -> DataFrame:
    """Inclusive both ends by default; ``closed`` in both|left|right|neither."""
    c = F.col(day)
    cond = F.lit(True)
    if start is not None:
        cond = cond & ((c >= F.lit(start).cast("date")) if closed in ("both", "left") else (c > F.lit(start).cast("date")))
    if end is not None:
        cond = cond & ((c <= F.lit(end).cast("date")) if closed in ("both", "right") else (c < F.lit(end).cast("date")))
    return df.filter(cond)


def trim_to_price_coverage(df: DataFrame, price: str = "open", day: str = "dt") -> DataFrame:
    """Keep days between the first and last day that has a price (all symbols).

    The bounds are scalar subqueries: one small aggregate job, no join.
    """
    priced = df.filter(F.col(price).isNotNull())
    b = priced.select(F.struct(F.min(day).alias("lo"), F.max(day).alias("hi"))).scalar()
    return df.filter((F.col(day) >= b.getField("lo")) & (F.col(day) <= b.getField("hi")))


def residual_beta(x: str, y: str, key: str = "symbol", beta: str = "reference"):
    """Per-series beta of y on x.

    ``reference``: cov_samp(x, y) / sqrt(var_pop(x) var_pop(y)) (= corr * n/(n-1));
    ``ols``: cov_samp / var_samp(x).  Non-finite -> 0.
    """
    w = Window.partitionBy(key)
    if beta == "ols":
        b = safe_div(F.covar_samp(x, y).over(w), F.var_samp(x).over(w))
    else:
        b = safe_div(F.covar_samp(x, y).over(w), F.sqrt(F.var_pop(x).over(w) * F.var_pop(y).over(w)))
    return F.coalesce(b, F.lit(0.0))


def build_dataset(panel: DataFrame, target_horizons=(30,), lookback_periods=(30,), residualise_returns: bool = True,
                  start_date=None, end_date=None, sources: bool = False, group_sources: bool = False,
                  beta: str = "reference", rolled: Collection[str] | None = None) -> DataFrame:
    """Features (ft_*), volatility features (vol_ft_*) and targets (tgt_*, vol_tgt_*, sp_*).

    ``rolled`` names the rolling columns (ft_x_L, vol_ft_x_L) to compute; all of them by default.

    The panel (symbols x days, small next to the raw text behind it) is
    materialised once with a reliable checkpoint: the price-coverage bounds
    and the windows both read it, so the upstream aggregation of raw text
    runs once, and lineage stays short.
    """
    from ..session import cut_lineage
    df = cut_lineage(filter_date_range(panel, start_date, end_date))
    df = trim_to_price_coverage(df)
    df = W.backfill_prices(df, [c for c in PRICE_COLS if c in df.columns])

    if sources:
        df = df.withColumns({"tradeable_price": F.col("close"), "sp_tradeable_price": F.col("sp500_close")})
    else:
        df = df.withColumns({"tradeable_price": W.tradeable_price("close"),
                             "sp_tradeable_price": W.tradeable_price("sp500_close")})
    df = df.withColumn("forward_returns_1", W.inverse_step_return("tradeable_price"))

    for h in target_horizons:
        df = df.withColumns({
            f"tgt_forward_returns_{h}": W.forward_log_return("close", "tradeable_price", h),
            f"vol_tgt_{h}": W.forward_volatility("forward_returns_1", h),
            f"sp_forward_returns_{h}": W.forward_log_return("sp500_close", "sp_tradeable_price", h),
        })
        df = df.withColumn(f"vol_tgt_{h}", W.forward_fill_col(f"vol_tgt_{h}"))
        if residualise_returns:
            b = residual_beta(f"sp_forward_returns_{h}", f"tgt_forward_returns_{h}", beta=beta)
            df = df.withColumn(f"tgt_resid_returns_{h}", F.col(f"tgt_forward_returns_{h}") - b * F.col(f"sp_forward_returns_{h}"))

    if sources:
        fts = [c for c in df.columns if c.startswith("ft_")]
        df = df.fillna(0.0, subset=fts)
        if group_sources:
            df = group_source_columns(df)
    else:
        df = df.withColumns({f"ft_{ch}": F.coalesce(F.col(f"{ch}_sentiment"), F.lit(0.0)) for ch in CHANNELS})
        df = df.withColumns({
            "ft_combined": F.col("ft_news") + F.col("ft_submissions") + F.col("ft_comments"),
            **{f"ft_abs_{ch}": F.abs(F.col(f"ft_{ch}")) for ch in CHANNELS},
        })
        df = df.withColumn("ft_combined_abs", F.col("ft_abs_news") + F.col("ft_abs_submissions") + F.col("ft_abs_comments"))

    fts = [c for c in df.columns if c.startswith("ft_")]
    frames = {}
    for L in lookback_periods:
        for c in fts:
            frames[f"{c}_{L}"] = Frame("momentum", c, L)
            frames[f"vol_{c}_{L}"] = Frame("std", c, L, 0)
    return rolling(df, frames if rolled is None else {name: f for name, f in frames.items() if name in rolled})


def group_source_columns(df: DataFrame, kinds=CHANNELS) -> DataFrame:
    """Sum all ft_{kind}_* into ft_{kind} and drop the parts."""
    out = df
    drop = []
    for k in kinds:
        parts = [c for c in df.columns if c.startswith(f"ft_{k}_")]
        drop += parts
        expr = F.lit(0.0)
        for p in parts:
            expr = expr + F.col(p)
        out = out.withColumn(f"ft_{k}", expr)
    return out.drop(*drop)


def select_features(columns: list[str], prefix: str = "ft_", suffix: str | None = None,
                    exclude: tuple = ()) -> list[str]:
    return [c for c in columns if c.startswith(prefix) and (suffix is None or c.endswith(suffix)) and c not in exclude]
