"""Shared fixture compositions (Spark side) and their SQL twins (oracle side)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.aggs import daily_mean_sentiment
from ..operators.panel import calendar_spine, join_panel
from ..plans.dataset import build_dataset
from ..plans.fixtures import Fixtures, cte_prefix

SPINE_START, SPINE_END = "1995-01-01", "2001-12-31"
H, L = 10, 10


def channels(fx: Fixtures) -> dict[str, DataFrame]:
    post = fx.fx_post.withColumn("dt", F.to_date("ts"))
    news = daily_mean_sentiment(post, scores=("compound",), day="dt")
    subs = daily_mean_sentiment(post.filter(F.col("subreddit") == "NO"), scores=("compound",), day="dt")
    comm = daily_mean_sentiment(post.filter(F.col("subreddit") == "NF"), scores=("compound",), day="dt")
    return {"news": news, "submissions": subs, "comments": comm}


def wide_channels(fx: Fixtures) -> DataFrame:
    """The three channels in ONE scan + aggregate (conditional means)."""
    post = fx.fx_post.withColumn("dt", F.to_date("ts"))
    return post.groupBy("symbol", "dt").agg(
        F.avg("compound").alias("news_sentiment"),
        F.avg(F.when(F.col("subreddit") == "NO", F.col("compound"))).alias("submissions_sentiment"),
        F.avg(F.when(F.col("subreddit") == "NF", F.col("compound"))).alias("comments_sentiment"))


def panel(fx: Fixtures) -> DataFrame:
    wide = wide_channels(fx)
    spine = calendar_spine(wide, SPINE_START, SPINE_END)
    return join_panel(spine, wide, fx.fx_price, fx.fx_index, start=SPINE_START, end=SPINE_END)


def dataset(fx: Fixtures, residualise: bool = True, rolled=None) -> DataFrame:
    return build_dataset(panel(fx), target_horizons=[H], lookback_periods=[L], residualise_returns=residualise, rolled=rolled)


# ------------------------------------------------------------- SQL twins ---

PANEL_CTES = cte_prefix("fx_post", "fx_price", "fx_index") + f""",
ch_news AS (SELECT symbol, cast(ts AS date) AS dt, avg(compound) AS s FROM fx_post GROUP BY 1, 2),
ch_subs AS (SELECT symbol, cast(ts AS date) AS dt, avg(compound) AS s FROM fx_post WHERE subreddit = 'NO' GROUP BY 1, 2),
ch_comm AS (SELECT symbol, cast(ts AS date) AS dt, avg(compound) AS s FROM fx_post WHERE subreddit = 'NF' GROUP BY 1, 2),
spine AS (SELECT s.symbol, cast(g.d AS date) AS dt FROM (SELECT DISTINCT symbol FROM ch_news) s,
          generate_series(DATE '{SPINE_START}', DATE '{SPINE_END}', INTERVAL 1 DAY) AS g(d)),
panel AS (
  SELECT sp.symbol, sp.dt, n.s AS news_sentiment, su.s AS submissions_sentiment, co.s AS comments_sentiment,
         p.open, p.close, p.high, p.low, i.sp500_open, i.sp500_close
  FROM spine sp
  LEFT JOIN ch_news n ON n.symbol = sp.symbol AND n.dt = sp.dt
  LEFT JOIN ch_subs su ON su.symbol = sp.symbol AND su.dt = sp.dt
  LEFT JOIN ch_comm co ON co.symbol = sp.symbol AND co.dt = sp.dt
  LEFT JOIN fx_price p ON p.symbol = sp.symbol AND p.dt = sp.dt
  LEFT JOIN fx_index i ON i.dt = sp.dt)"""

_FT = ["news", "submissions", "comments", "combined", "abs_news", "abs_submissions", "abs_comments", "combined_abs"]


def _mom(c: str, Lb: int) -> str:
    return (f"coalesce((avg({c}) OVER (w ROWS BETWEEN {Lb - 1} PRECEDING AND CURRENT ROW)"
            f" - avg({c}) OVER (w ROWS BETWEEN {3 * Lb - 1} PRECEDING AND CURRENT ROW))"
            f" / nullif(stddev_samp({c}) OVER (w ROWS BETWEEN {6 * Lb - 1} PRECEDING AND CURRENT ROW), 0), 0)")


DATASET_CTES = PANEL_CTES + f""",
bounds AS (SELECT min(dt) AS lo, max(dt) AS hi FROM panel WHERE open IS NOT NULL),
trimmed AS (SELECT panel.* FROM panel, bounds WHERE panel.dt >= bounds.lo AND panel.dt <= bounds.hi),
bf AS (
  SELECT symbol, dt, news_sentiment, submissions_sentiment, comments_sentiment,
    first_value(open IGNORE NULLS) OVER wf AS open, first_value(close IGNORE NULLS) OVER wf AS close,
    first_value(high IGNORE NULLS) OVER wf AS high, first_value(low IGNORE NULLS) OVER wf AS low,
    first_value(sp500_open IGNORE NULLS) OVER wf AS sp500_open, first_value(sp500_close IGNORE NULLS) OVER wf AS sp500_close
  FROM trimmed WINDOW wf AS (PARTITION BY symbol ORDER BY dt ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
tp AS (SELECT *, lead(close) OVER w AS tradeable_price, lead(sp500_close) OVER w AS sp_tradeable_price,
              lead(close, {H}) OVER w AS fc, lead(sp500_close, {H}) OVER w AS sfc
       FROM bf WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
tp2 AS (SELECT *, last_value(tradeable_price IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS tp_ff,
               last_value(fc IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fc_ff,
               last_value(sfc IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS sfc_ff
        FROM tp WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
fr AS (SELECT *, tp_ff / nullif(lead(tp_ff) OVER w, 0) - 1 AS forward_returns_1,
              coalesce(ln(fc_ff / nullif(tradeable_price, 0)), 0) AS tgt_forward_returns_{H},
              coalesce(ln(sfc_ff / nullif(sp_tradeable_price, 0)), 0) AS sp_forward_returns_{H}
       FROM tp2 WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
vt AS (SELECT *, CASE WHEN count(forward_returns_1) OVER (w ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING) = {H}
                      THEN stddev_samp(forward_returns_1) OVER (w ROWS BETWEEN 1 FOLLOWING AND {H} FOLLOWING) END AS vt_raw,
              coalesce(covar_samp(sp_forward_returns_{H}, tgt_forward_returns_{H}) OVER (PARTITION BY symbol)
                / nullif(sqrt(var_pop(sp_forward_returns_{H}) OVER (PARTITION BY symbol) * var_pop(tgt_forward_returns_{H}) OVER (PARTITION BY symbol)), 0), 0) AS beta
       FROM fr WINDOW w AS (PARTITION BY symbol ORDER BY dt)),
tg AS (SELECT *, last_value(vt_raw IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS vol_tgt_{H},
              tgt_forward_returns_{H} - beta * sp_forward_returns_{H} AS tgt_resid_returns_{H},
              coalesce(news_sentiment, 0) AS ft_news, coalesce(submissions_sentiment, 0) AS ft_submissions,
              coalesce(comments_sentiment, 0) AS ft_comments
       FROM vt),
ft AS (SELECT *, ft_news + ft_submissions + ft_comments AS ft_combined, abs(ft_news) AS ft_abs_news,
              abs(ft_submissions) AS ft_abs_submissions, abs(ft_comments) AS ft_abs_comments,
              abs(ft_news) + abs(ft_submissions) + abs(ft_comments) AS ft_combined_abs FROM tg),
ds AS (SELECT *, {", ".join(f"{_mom('ft_' + c, L)} AS ft_{c}_{L}" for c in _FT)},
              {", ".join(f"stddev_samp(ft_{c}) OVER (w ROWS BETWEEN {L - 1} PRECEDING AND CURRENT ROW) AS vol_ft_{c}_{L}" for c in _FT)}
       FROM ft WINDOW w AS (PARTITION BY symbol ORDER BY dt))
"""


# ----------------------------------------------------- article / post views --

def article_score_expr():
    """Deterministic stand-in model score in [-1, 1] for fixture articles."""
    return ((F.length("text") % 101) - 50) / F.lit(50.0)


ARTICLE_SCORE_SQL = "((length(text) % 101) - 50) / 50.0"


def articles(fx: Fixtures) -> DataFrame:
    return fx.fx_article.withColumn("score", article_score_expr())


def dataset_cols(fx: Fixtures, *cols: str) -> DataFrame:
    return dataset(fx, residualise=False, rolled=cols).select("symbol", "dt", *cols)
