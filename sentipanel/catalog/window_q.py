"""Window / time-series operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.moments import Frame, rolling
from . import common as C
from . import register, cte

EV = cte("fx_event_day")
WIN = "WINDOW w AS (PARTITION BY symbol ORDER BY dt)"


def _ev(fx):
    return fx.fx_event_day


@register("rolling_mean", EV + f"""SELECT symbol, dt, CASE WHEN count(x) OVER (w ROWS 6 PRECEDING) >= 3
  THEN avg(x) OVER (w ROWS 6 PRECEDING) END AS m FROM fx_event_day {WIN}""", dbl="m")
def q_rolling_mean(fx):
    return rolling(_ev(fx), {"m": Frame("mean", "x", 7, 3)}).select("symbol", "dt", "m")


@register("rolling_sum", EV + f"""SELECT symbol, dt, coalesce(sum(x) OVER (w ROWS 6 PRECEDING), 0) AS s,
  CASE WHEN count(n) OVER (w ROWS 2 PRECEDING) >= 3 THEN sum(n) OVER (w ROWS 2 PRECEDING) END AS s3
  FROM fx_event_day {WIN}""", dbl="s")
def q_rolling_sum(fx):
    return rolling(_ev(fx), {"s": Frame("sum", "x", 7, 0), "s3": Frame("sum", "n", 3)}).select("symbol", "dt", "s", "s3")


@register("rolling_std", EV + f"""SELECT symbol, dt, CASE WHEN count(x) OVER (w ROWS 6 PRECEDING) >= 2
  THEN stddev_samp(x) OVER (w ROWS 6 PRECEDING) END AS sd FROM fx_event_day {WIN}""", dbl="sd")
def q_rolling_std(fx):
    return rolling(_ev(fx), {"sd": Frame("std", "x", 7, 2)}).select("symbol", "dt", "sd")


@register("momentum_feature_fixed", C.DATASET_CTES + f"""SELECT symbol, dt,
  (CASE WHEN count(ft_news) OVER (w ROWS 29 PRECEDING) >= 10 THEN avg(ft_news) OVER (w ROWS 29 PRECEDING) END
   - coalesce(CASE WHEN count(ft_news) OVER (w ROWS 89 PRECEDING) >= 10 THEN avg(ft_news) OVER (w ROWS 89 PRECEDING) END, 0))
  / nullif(CASE WHEN count(ft_news) OVER (w ROWS 364 PRECEDING) >= 20 THEN stddev_samp(ft_news) OVER (w ROWS 364 PRECEDING) END, 0) AS mf
FROM ds {WIN}""", dbl="mf")
def q_momentum_fixed(fx):
    return W.with_momentum_fixed(C.dataset_cols(fx, "ft_news"), "ft_news", "mf").drop("ft_news")


@register("rolling_zscore_clip", C.DATASET_CTES + f"""SELECT symbol, dt, CASE WHEN z IS NOT NULL THEN least(greatest(z, 0), 5) END AS z FROM (SELECT symbol, dt,
  (ft_news - avg(ft_news) OVER (w ROWS 364 PRECEDING)) / nullif(stddev_samp(ft_news) OVER (w ROWS 364 PRECEDING), 0) AS z
FROM ds {WIN})""", dbl="z")
def q_zscore(fx):
    return W.with_zscore_clip(C.dataset_cols(fx, "ft_news"), "ft_news", "z", 365, 0, 5, 0).drop("ft_news")


@register("detrend", C.DATASET_CTES + f"""SELECT symbol, dt, ft_news - coalesce(avg(ft_news) OVER (w ROWS 89 PRECEDING), 0) AS d
FROM ds {WIN}""", dbl="d")
def q_detrend(fx):
    return W.with_detrend(C.dataset_cols(fx, "ft_news"), "ft_news", "d", 90, 0).drop("ft_news")


@register("calendar_rolling_mean", EV + """SELECT symbol, dt, avg(x) OVER (PARTITION BY symbol ORDER BY dt
  RANGE BETWEEN INTERVAL 29 DAY PRECEDING AND CURRENT ROW) AS m FROM fx_event_day""", dbl="m")
def q_calendar_rolling(fx):
    return _ev(fx).select("symbol", "dt", W.calendar_rolling_mean("x", 30).alias("m"))


RESAMPLE_SQL = """,
o AS (SELECT *, min(dt) OVER (PARTITION BY symbol) AS origin FROM src),
b AS (SELECT symbol, origin, cast(floor(datediff('day', origin, dt) / 6) AS INTEGER) AS bin, x FROM o),
agg AS (SELECT symbol, bin, any_value(origin) AS origin, avg(x) AS x FROM b GROUP BY 1, 2),
rng AS (SELECT symbol, any_value(origin) AS origin, max(bin) AS mx FROM agg GROUP BY 1),
sp AS (SELECT symbol, origin, g.bin FROM rng, generate_series(0, rng.mx) AS g(bin))
SELECT sp.symbol, cast(sp.origin + cast(sp.bin * 6 AS INTEGER) AS date) AS dt, agg.x FROM sp LEFT JOIN agg ON agg.symbol = sp.symbol AND agg.bin = sp.bin"""


@register("resample_mean", EV + ", src AS (SELECT symbol, dt, x FROM fx_event_day)" + RESAMPLE_SQL, dbl="x")
def q_resample(fx):
    return W.resample_mean(_ev(fx), ["x"], 6)


@register("rolling30_then_resample", EV + f""", src AS (SELECT symbol, dt, avg(x) OVER (w ROWS 29 PRECEDING) AS x
  FROM fx_event_day {WIN})""" + RESAMPLE_SQL, dbl="x")
def q_rolling_resample(fx):
    return W.rolling30_then_resample(_ev(fx), ["x"], 30, 6)


@register("reindex_daily", EV + """,
rng AS (SELECT symbol, min(dt) AS lo, max(dt) AS hi FROM fx_event_day GROUP BY 1),
sp AS (SELECT symbol, cast(g.d AS date) AS dt FROM rng, generate_series(rng.lo, rng.hi, INTERVAL 1 DAY) AS g(d)),
dense AS (SELECT sp.symbol, sp.dt, coalesce(e.n, 0) AS n FROM sp LEFT JOIN fx_event_day e ON e.symbol = sp.symbol AND e.dt = sp.dt)
SELECT symbol, dt, n, sum(n) OVER (PARTITION BY symbol ORDER BY dt ROWS 29 PRECEDING) AS n30 FROM dense""")
def q_reindex(fx):
    d = W.reindex_daily(_ev(fx), ["n"], fill=0)
    return rolling(d, {"n30": Frame("sum", "n", 30, 0)})


@register("consecutive_pairs", EV + f""", p AS (SELECT symbol, dt, x AS x_t, lead(x) OVER w AS x_next FROM fx_event_day {WIN})
SELECT * FROM p WHERE x_t IS NOT NULL AND x_next IS NOT NULL""", dbl="x_t x_next")
def q_pairs(fx):
    return W.consecutive_pairs(_ev(fx), "x")


@register("multi_channel_rolling", C.DATASET_CTES + f"""SELECT symbol, dt, {", ".join(
    f"CASE WHEN count({c}) OVER (w ROWS 4 PRECEDING) >= 5 THEN avg({c}) OVER (w ROWS 4 PRECEDING) END AS {c}_r5"
    for c in ["ft_news", "ft_submissions", "ft_comments"])} FROM ds {WIN}""",
    dbl="ft_news_r5 ft_submissions_r5 ft_comments_r5")
def q_multi_rolling(fx):
    cols = ["ft_news", "ft_submissions", "ft_comments"]
    ds = C.dataset_cols(fx, *cols)
    return rolling(ds, {f"{c}_r5": Frame("mean", c, 5, 5) for c in cols}).drop(*cols)


@register("downsample", C.DATASET_CTES + """SELECT symbol, dt, ft_news_10, tgt_forward_returns_10 FROM ds
QUALIFY (row_number() OVER (PARTITION BY symbol ORDER BY dt) - 1) % 10 = 0""", dbl="ft_news_10 tgt_forward_returns_10")
def q_downsample(fx):
    return W.downsample(C.dataset_cols(fx, "ft_news_10", "tgt_forward_returns_10"), 10)


@register("cumulative_by_feature", C.DATASET_CTES + """, r AS (SELECT symbol, dt, round(ft_news_10 + 3.14159265e-9, 6) + 0.0 AS ft,
  tgt_forward_returns_10 FROM ds)
SELECT symbol, dt, ft, sum(tgt_forward_returns_10) OVER (ORDER BY ft, symbol, dt ROWS UNBOUNDED PRECEDING) AS cs_ret,
  count(*) OVER (ORDER BY ft, symbol, dt ROWS UNBOUNDED PRECEDING) AS cs_trades FROM r""", dbl="ft cs_ret", digits=4)
def q_cumulative(fx):
    # sort key rounded like the oracle so exact-arithmetic ties order the same way in both engines
    d = C.dataset_cols(fx, "ft_news_10", "tgt_forward_returns_10").withColumn(
        "ft", F.round(F.col("ft_news_10") + F.lit(3.14159265e-9), 6))
    return W.cumulative_by_feature(d, "ft", "tgt_forward_returns_10", ["symbol", "dt"]).select(
        "symbol", "dt", "ft", "cs_ret", "cs_trades")



@register("lead_lag", cte("fx_price") + f"""SELECT symbol, dt, lag(close, 2) OVER w AS close_shift_2, lead(close, 3) OVER w AS close_shift_m3
FROM fx_price {WIN}""", dbl="close_shift_2 close_shift_m3")
def q_lead_lag(fx):
    d = W.lead_lag(fx.fx_price.select("symbol", "dt", "close"), "close", 2)
    return W.lead_lag(d, "close", -3, name="close_shift_m3").drop("close")


@register("forward_fill", C.PANEL_CTES + """
SELECT symbol, dt, last_value(news_sentiment IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING) AS news_sentiment
FROM panel""", dbl="news_sentiment")
def q_forward_fill(fx):
    return W.forward_fill(C.panel(fx).select("symbol", "dt", "news_sentiment"), ["news_sentiment"])


@register("past_return", cte("fx_price") + f"""SELECT symbol, dt, close / nullif(lag(close, 5) OVER w, 0) - 1 AS r5,
  close / nullif(lag(close, 30) OVER w, 0) - 1 AS r30 FROM fx_price {WIN}""", dbl="r5 r30")
def q_past_return(fx):
    return fx.fx_price.select("symbol", "dt", W.past_return("close", 5).alias("r5"), W.past_return("close", 30).alias("r30"))


@register("sort_by_top_n", EV + "SELECT symbol, dt, x FROM fx_event_day ORDER BY x DESC, symbol, dt LIMIT 25", dbl="x")
def q_top_n(fx):
    return _ev(fx).select("symbol", "dt", "x").orderBy(F.desc("x"), "symbol", "dt").limit(25)


@register("downsample_global", cte("fx_event_day") + """SELECT symbol, dt, x FROM fx_event_day
QUALIFY (row_number() OVER (ORDER BY dt, symbol) - 1) % 7 = 0""", dbl="x")
def q_downsample_global(fx):
    return W.downsample(fx.fx_event_day.select("symbol", "dt", "x"), 7, key=None, order=["dt", "symbol"])
