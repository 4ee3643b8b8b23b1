"""Panel, targets and rolling features."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import windows as W
from ..operators.aggs import daily_mean_sentiment
from ..operators.panel import calendar_spine
from ..operators.stats import corr_by_group
from . import common as C
from . import register, cte

FT = C._FT
L, H = C.L, C.H


@register("daily_mean_sentiment", cte("fx_post") + """
SELECT symbol, cast(ts AS date) AS dt, avg(pos) AS pos, avg(neu) AS neu, avg(neg) AS neg, avg(compound) AS compound
FROM fx_post GROUP BY 1, 2""", dbl="pos neu neg compound")
def q_daily_mean_sentiment(fx):
    return daily_mean_sentiment(fx.fx_post, scores=("pos", "neu", "neg", "compound"), day=F.to_date("ts"))


@register("calendar_spine", C.PANEL_CTES + "\nSELECT symbol, dt FROM spine")
def q_calendar_spine(fx):
    return calendar_spine(C.channels(fx)["news"], C.SPINE_START, C.SPINE_END)


@register("join_panel", C.PANEL_CTES + "\nSELECT * FROM panel",
          dbl="news_sentiment submissions_sentiment comments_sentiment open close high low sp500_open sp500_close")
def q_join_panel(fx):
    return C.panel(fx)


@register("backfill_prices", C.DATASET_CTES + "\nSELECT symbol, dt, open, close, high, low, sp500_open, sp500_close FROM bf",
          dbl="open close high low sp500_open sp500_close")
def q_backfill(fx):
    from ..plans.dataset import trim_to_price_coverage
    p = trim_to_price_coverage(C.panel(fx))
    return W.backfill_prices(p).select("symbol", "dt", "open", "close", "high", "low", "sp500_open", "sp500_close")


@register("trim_to_price_coverage", C.DATASET_CTES + "\nSELECT symbol, dt FROM trimmed")
def q_trim(fx):
    from ..plans.dataset import trim_to_price_coverage
    return trim_to_price_coverage(C.panel(fx)).select("symbol", "dt")


@register("tradeable_price", C.DATASET_CTES + "\nSELECT symbol, dt, tradeable_price, sp_tradeable_price FROM fr",
          dbl="tradeable_price sp_tradeable_price")
def q_tradeable(fx):
    return C.dataset_cols(fx, "tradeable_price", "sp_tradeable_price")


@register("inverse_step_return", C.DATASET_CTES + "\nSELECT symbol, dt, forward_returns_1 FROM fr",
          dbl="forward_returns_1")
def q_inverse_step(fx):
    return C.dataset_cols(fx, "forward_returns_1")


@register("forward_log_return", C.DATASET_CTES + f"\nSELECT symbol, dt, tgt_forward_returns_{H}, sp_forward_returns_{H} FROM ds",
          dbl=f"tgt_forward_returns_{H} sp_forward_returns_{H}")
def q_forward_log_return(fx):
    return C.dataset_cols(fx, f"tgt_forward_returns_{H}", f"sp_forward_returns_{H}")


@register("forward_volatility", C.DATASET_CTES + f"\nSELECT symbol, dt, vol_tgt_{H} FROM ds", dbl=f"vol_tgt_{H}")
def q_forward_volatility(fx):
    return C.dataset_cols(fx, f"vol_tgt_{H}")


@register("residual_returns", C.DATASET_CTES + f"\nSELECT symbol, dt, tgt_resid_returns_{H} FROM ds",
          dbl=f"tgt_resid_returns_{H}")
def q_residual(fx):
    return C.dataset(fx, rolled=()).select("symbol", "dt", f"tgt_resid_returns_{H}")


@register("momentum_feature", C.DATASET_CTES + f"\nSELECT symbol, dt, {', '.join(f'ft_{c}_{L}' for c in FT)} FROM ds",
          dbl=" ".join(f"ft_{c}_{L}" for c in FT))
def q_momentum(fx):
    return C.dataset_cols(fx, *[f"ft_{c}_{L}" for c in FT])


@register("feature_volatility", C.DATASET_CTES + f"\nSELECT symbol, dt, {', '.join(f'vol_ft_{c}_{L}' for c in FT)} FROM ds",
          dbl=" ".join(f"vol_ft_{c}_{L}" for c in FT))
def q_feature_vol(fx):
    return C.dataset_cols(fx, *[f"vol_ft_{c}_{L}" for c in FT])


@register("abs_features", C.DATASET_CTES + "\nSELECT symbol, dt, ft_combined, ft_abs_news, ft_abs_submissions, ft_abs_comments, ft_combined_abs FROM ds",
          dbl="ft_combined ft_abs_news ft_abs_submissions ft_abs_comments ft_combined_abs")
def q_abs_features(fx):
    return C.dataset_cols(fx, "ft_combined", "ft_abs_news", "ft_abs_submissions", "ft_abs_comments", "ft_combined_abs")


FLAGSHIP_SQL = C.DATASET_CTES + f"""
SELECT symbol, corr(ft_news_{L}, tgt_forward_returns_{H}) AS r, count(*) AS n FROM ds GROUP BY symbol"""


@register("momentum_target_corr", FLAGSHIP_SQL, dbl="r")
def q_flagship(fx):
    return corr_by_group(C.dataset_cols(fx, f"ft_news_{L}", f"tgt_forward_returns_{H}"), "symbol", f"ft_news_{L}", f"tgt_forward_returns_{H}")
