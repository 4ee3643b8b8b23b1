"""Models and strategies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import models as M
from ..operators import strategy as ST
from ..operators.aggs import coef_summary
from ..operators.windows import nav_curve
from . import common as C
from . import register
from .agg_q import MARKET_SQL, market_frame

X2 = ["ft_news_10", "ft_comments_10"]
Y = "tgt_forward_returns_10"

_RIDGE_MOM = """SELECT {k}count(*) AS n, avg(ft_news_10) AS m1, avg(ft_comments_10) AS m2, avg(tgt_forward_returns_10) AS my,
  var_pop(ft_news_10) AS c11, var_pop(ft_comments_10) AS c22, covar_pop(ft_news_10, ft_comments_10) AS c12,
  covar_pop(ft_news_10, tgt_forward_returns_10) AS c1y, covar_pop(ft_comments_10, tgt_forward_returns_10) AS c2y FROM ds {g}"""


def _ridge_sql(key: str | None) -> str:
    k = f"{key}, " if key else ""
    g = f"GROUP BY {key}" if key else ""
    return C.DATASET_CTES + f""",
rm AS ({_RIDGE_MOM.format(k=k, g=g)}),
ra AS (SELECT *, n * c11 + 1 AS a11, n * c22 + 1 AS a22, n * c12 AS a12, n * c1y AS r1, n * c2y AS r2 FROM rm),
rb AS (SELECT *, (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) AS b1, (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS b2 FROM ra),
coefs AS (SELECT {k}'intercept' AS term, my - b1 * m1 - b2 * m2 AS coef FROM rb
          UNION ALL SELECT {k}'ft_news_10', b1 FROM rb UNION ALL SELECT {k}'ft_comments_10', b2 FROM rb)
"""


@register("ridge_fit", _ridge_sql(None) + "SELECT * FROM coefs", dbl="coef")
def q_ridge_fit(fx):
    return M.ridge_fit(C.dataset_cols(fx, *X2, Y), X2, Y, alpha=1.0)


@register("ridge_predict", _ridge_sql(None).replace("\nds AS (", "\nds AS MATERIALIZED (") + """,
b AS MATERIALIZED (SELECT max(coef) FILTER (term = 'intercept') AS b0, max(coef) FILTER (term = 'ft_news_10') AS b1,
  max(coef) FILTER (term = 'ft_comments_10') AS b2 FROM coefs)
SELECT symbol, dt, b0 + b1 * ft_news_10 + b2 * ft_comments_10 AS prediction FROM ds, b""", dbl="prediction")
def q_ridge_predict(fx):
    ds = C.dataset_cols(fx, *X2, Y)
    return M.ridge_predict(ds, M.ridge_fit(ds, X2, Y, alpha=1.0), X2).select("symbol", "dt", "prediction")


@register("coef_summary", _ridge_sql("symbol") + """SELECT term, avg(coef) AS mean, stddev_pop(coef) AS std,
  median(coef) AS median FROM coefs GROUP BY term""", dbl="mean std median")
def q_coef_summary(fx):
    return coef_summary(M.ridge_fit(C.dataset_cols(fx, *X2, Y), X2, Y, alpha=1.0, key="symbol"), "term", "coef")


_WALK_OFFSET = 15
_WALK_SQL = C.DATASET_CTES + f""",
z AS (SELECT symbol, dt, ft_news_10 AS x1, ft_comments_10 AS x2, tgt_forward_returns_10 AS y FROM ds),
dd AS (SELECT dt, count(*) AS n, sum(x1) AS s1, sum(x2) AS s2, sum(y) AS sy, sum(x1 * x1) AS q11, sum(x2 * x2) AS q22, sum(x1 * x2) AS q12,
  sum(x1 * y) AS q1y, sum(x2 * y) AS q2y FROM z WHERE x1 IS NOT NULL AND x2 IS NOT NULL AND y IS NOT NULL GROUP BY dt),
cu AS (SELECT dt, {", ".join(f"sum({c}) OVER p AS {c}" for c in "n s1 s2 sy q11 q22 q12 q1y q2y".split())} FROM dd
  WINDOW p AS (ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
td AS (SELECT d.dt, max(e.dt) AS t FROM dd d JOIN dd e ON e.dt < d.dt - INTERVAL {_WALK_OFFSET + 1} DAY
  WHERE d.dt BETWEEN DATE '1998-01-01' AND DATE '2001-12-31' GROUP BY d.dt),
ce AS (SELECT td.dt, n, s1 / n AS m1, s2 / n AS m2, sy / n AS my, q11 - s1 * s1 / n + 1 AS a11, q22 - s2 * s2 / n + 1 AS a22,
  q12 - s1 * s2 / n AS a12, q1y - s1 * sy / n AS r1, q2y - s2 * sy / n AS r2 FROM td JOIN cu ON cu.dt = td.t WHERE n > 0),
be AS (SELECT *, (a22 * r1 - a12 * r2) / (a11 * a22 - a12 * a12) AS b1, (a11 * r2 - a12 * r1) / (a11 * a22 - a12 * a12) AS b2 FROM ce)
SELECT z.symbol, z.dt, my - b1 * m1 - b2 * m2 + b1 * x1 + b2 * x2 AS prediction FROM z LEFT JOIN be ON be.dt = z.dt"""


@register("walk_forward_ridge", _WALK_SQL, dbl="prediction")
def q_walk_forward(fx):
    ds = C.dataset_cols(fx, *X2, Y)
    return M.walk_forward_ridge(ds, X2, Y, "1998-01-01", "2001-12-31", offset=_WALK_OFFSET, alpha=1.0).select(
        "symbol", "dt", "prediction")


X3 = ["ft_news_10", "ft_submissions_10", "ft_comments_10"]


def _ablation_sql() -> str:
    """In-sample ridge errors of every set of up to three features by Cramer's rule."""
    pairs = [(i, j) for i in range(3) for j in range(i, 3)]
    a = lambda i, j: f"(n * c{min(i, j)}{max(i, j)}" + (" + 1)" if i == j else ")")

    def det(m):
        if len(m) == 1:
            return m[0][0]
        return "(" + " ".join(f"{'+-'[j % 2]} {m[0][j]} * {det([r[:j] + r[j + 1:] for r in m[1:]])}" for j in range(len(m))) + ")"
    rows = []
    for name, fts in M.ablation_sets(X3).items():
        xs = [X3.index(f) for f in fts]
        m = [[a(i, j) for j in xs] for i in xs]
        b = {i: f"({det([r[:k] + [f'(n * y{x})'] + r[k + 1:] for r, x in zip(m, xs)])} / {det(m)})" for k, i in enumerate(xs)}
        sq = " + ".join(f"{b[i]} * {b[j]} * c{min(i, j)}{max(i, j)}" for i in xs for j in xs)
        cross = " + ".join(f"{b[i]} * y{i}" for i in xs)
        rows.append(f"SELECT '{name}' AS feature_set, yy - 2 * ({cross}) + {sq} AS mse FROM mo" if xs else f"SELECT '{name}' AS feature_set, yy AS mse FROM mo")
    moments = ", ".join([f"covar_pop({X3[i]}, {X3[j]}) AS c{i}{j}" for i, j in pairs] + [f"covar_pop({f}, {Y}) AS y{i}" for i, f in enumerate(X3)])
    return C.DATASET_CTES.replace("\nds AS (", "\nds AS MATERIALIZED (") + f""",
mo AS MATERIALIZED (SELECT count(*) AS n, var_pop({Y}) AS yy, {moments} FROM ds WHERE {" AND ".join(f"{c} IS NOT NULL" for c in [*X3, Y])}),
er AS MATERIALIZED ({" UNION ALL ".join(rows)})
SELECT feature_set, mse, (mse - (SELECT mse FROM er WHERE feature_set = 'all')) / nullif((SELECT yy FROM mo) - (SELECT mse FROM er WHERE feature_set = 'all'), 0)
  AS contribution FROM er"""


@register("ablation", _ablation_sql(), dbl="mse contribution")
def q_ablation(fx):
    return M.ablation(C.dataset_cols(fx, *X3, Y), X3, Y, alpha=1.0)


@register("gbt_fit_predict", None, note="boosted trees (Spark ML); rows-only")
def q_gbt(fx):
    ds = C.dataset_cols(fx, *X2, Y)
    train = ds.filter(F.col("dt") < F.lit("1999-01-01").cast("date"))
    test = ds.filter(F.col("dt") >= F.lit("1999-06-01").cast("date"))
    return M.gbt_fit_predict(train, test, X2, Y, max_iter=300).select("symbol", "dt", "prediction")


@register("train_test_split_by_date", C.DATASET_CTES + """SELECT 'train' AS part, count(*) AS n FROM ds WHERE dt < DATE '1999-01-01'
UNION ALL SELECT 'test', count(*) FROM ds WHERE dt >= DATE '1999-06-01'""")
def q_split(fx):
    from ..operators.filters import train_test_split_by_date
    tr, te = train_test_split_by_date(C.dataset(fx, residualise=False, rolled=()), "1999-01-01", "1999-06-01")
    return tr.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("train")).unionByName(
        te.agg(F.count(F.lit(1)).alias("n")).withColumn("part", F.lit("test")))


# -------------------------------------------------------------- strategy --

NAV_SQL = MARKET_SQL.rstrip() + """,
sig AS (SELECT 'sp' AS strategy, dt, sp_tradeable_price, CASE WHEN ft_news_10 > 0 THEN 1 ELSE 0 END AS signal FROM mkt),
rt AS (SELECT *, coalesce(CASE WHEN signal = 1 THEN lead(sp_tradeable_price) OVER (PARTITION BY strategy ORDER BY dt)
        / nullif(sp_tradeable_price, 0) ELSE 1.0 END, 1.0) AS returns FROM sig),
navs AS (SELECT *, 10000 * exp(sum(ln(returns)) OVER (PARTITION BY strategy ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS nav FROM rt)
"""


def _nav(fx):
    m = market_frame(fx).withColumn("strategy", F.lit("sp")).withColumn(
        "signal", F.when(F.col("ft_news_10") > 0, 1).otherwise(0))
    return nav_curve(m.select("strategy", "dt", "sp_tradeable_price", "signal"), "sp_tradeable_price", "signal")


@register("nav_curve", NAV_SQL + "SELECT strategy, dt, signal, returns, nav FROM navs", dbl="returns nav")
def q_nav(fx):
    return _nav(fx).select("strategy", "dt", "signal", "returns", "nav")


@register("drawdown", NAV_SQL + """SELECT strategy, dt, nav / max(nav) OVER (PARTITION BY strategy ORDER BY dt
  ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM navs""", dbl="drawdown")
def q_drawdown(fx):
    return _nav(fx).select("strategy", "dt", ST.drawdown_col("nav").alias("drawdown"))


@register("rebase_series", NAV_SQL + """SELECT strategy, dt, sp_tradeable_price * 10000 / first_value(sp_tradeable_price)
  OVER (PARTITION BY strategy ORDER BY dt ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS rebased FROM navs""",
          dbl="rebased")
def q_rebase(fx):
    return _nav(fx).select("strategy", "dt", ST.rebase_col("sp_tradeable_price").alias("rebased"))


def metrics_sql(src: str) -> str:
    return f""",
m0 AS (SELECT strategy, dt, nav, nav / lag(nav) OVER (PARTITION BY strategy ORDER BY dt) - 1 AS r,
       nav / max(nav) OVER (PARTITION BY strategy ORDER BY dt ROWS UNBOUNDED PRECEDING) - 1 AS dd FROM {src}),
m1 AS (SELECT strategy, arg_min(nav, dt) AS f, arg_max(nav, dt) AS l, datediff('day', min(dt), max(dt)) AS days,
       avg(r) AS mr, stddev_samp(r) AS sr, min(dd) AS max_drawdown FROM m0 GROUP BY 1),
m2 AS (SELECT *, CASE WHEN days > 0 THEN pow(l / f, 1 / (days / 365.0)) - 1 END AS cagr FROM m1)
SELECT strategy, l / f AS total_return, cagr, mr / nullif(sr, 0) * sqrt(252) AS sharpe, max_drawdown,
  cagr / nullif(abs(max_drawdown), 0) AS calmar FROM m2"""


@register("strategy_metrics", NAV_SQL.rstrip() + metrics_sql("navs"), dbl="total_return cagr sharpe max_drawdown calmar")
def q_metrics(fx):
    return ST.strategy_metrics(_nav(fx))


SMOOTH_SQL = C.DATASET_CTES + """,
sds AS (SELECT symbol, dt, round(ft_news_10, 9) AS ft_news_10, round(ft_comments_10, 9) AS ft_comments_10,
  100 * exp(sum(ft_news / 10) OVER (PARTITION BY symbol ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS close FROM ds)"""

SW_SQL = SMOOTH_SQL + """,
sw AS (SELECT 'news' AS strategy, symbol, dt, close, CASE WHEN ft_news_10 > 0 THEN 1.0 ELSE 0.0 END AS signal FROM sds),""" + """
a AS (SELECT *, sum(signal) OVER (PARTITION BY strategy, dt) AS tot FROM sw),
b AS (SELECT *, CASE WHEN tot > 0 THEN signal / tot END AS w0 FROM a),
c AS (SELECT *, coalesce(last_value(w0 IGNORE NULLS) OVER (PARTITION BY strategy, symbol ORDER BY dt ROWS UNBOUNDED PRECEDING), 0) AS w,
      coalesce(lead(close) OVER (PARTITION BY strategy, symbol ORDER BY dt) / nullif(close, 0) - 1, 0) AS r FROM b),
d AS (SELECT *, abs(w - coalesce(lag(w) OVER (PARTITION BY strategy, symbol ORDER BY dt), 0)) AS turn FROM c),
daily AS (SELECT strategy, dt, sum(w * r) - 0.001 * sum(turn) AS ret0 FROM d GROUP BY 1, 2),
nv AS (SELECT strategy, dt, coalesce(lag(ret0) OVER (PARTITION BY strategy ORDER BY dt), 0) AS ret FROM daily),
swnav AS (SELECT strategy, dt, ret, 10000 * exp(sum(ln(1 + ret)) OVER (PARTITION BY strategy ORDER BY dt ROWS UNBOUNDED PRECEDING)) AS nav FROM nv)
"""


def smooth_frame(fx):
    """Test input: a smooth positive price path driven by the news channel
    (keeps compounded NAVs in a range where float rounding is stable) and
    forecasts rounded to 9 digits (exact-zero features compare alike)."""
    from pyspark.sql import Window
    ds = C.dataset_cols(fx, "ft_news", "ft_news_10", "ft_comments_10")
    w = Window.partitionBy("symbol").orderBy("dt").rowsBetween(Window.unboundedPreceding, 0)
    return ds.select("symbol", "dt", F.round("ft_news_10", 9).alias("ft_news_10"), F.round("ft_comments_10", 9).alias("ft_comments_10"),
                     (F.lit(100.0) * F.exp(F.sum(F.col("ft_news") / 10).over(w))).alias("close"))


@register("signal_weighted_nav", SW_SQL + "SELECT * FROM swnav", dbl="ret nav", digits=5)
def q_swnav(fx):
    ds = smooth_frame(fx).select(
        F.lit("news").alias("strategy"), "symbol", "dt", "close",
        F.when(F.col("ft_news_10") > 0, F.lit(1.0)).otherwise(F.lit(0.0)).alias("signal"))
    return ST.signal_weighted_nav(ds, "signal", "close", "strategy", cost_rate=0.001)


_TH = [0.0, 0.01, 0.02, 0.03, 0.04]
_FC = ["ft_news_10", "ft_comments_10"]
SWEEP_SQL = SMOOTH_SQL + """,
grid AS (SELECT * FROM (VALUES ('baseline', NULL::DOUBLE), """ + ", ".join(
    f"('{f}', {t})" for f in _FC for t in _TH) + """) AS g(forecast, threshold)),
sw AS (SELECT forecast || ':' || coalesce(CASE WHEN threshold IS NULL THEN NULL ELSE
         CASE WHEN threshold = 0 THEN '0.0' ELSE cast(threshold AS string) END END, 'n/a') AS strategy, symbol, dt, close,
         CASE WHEN forecast = 'baseline' THEN 1.0 WHEN (CASE forecast """ + " ".join(f"WHEN '{f}' THEN {f}" for f in _FC) + """ END) > threshold
              THEN 1.0 ELSE 0.0 END AS signal FROM sds, grid),""" + SW_SQL.split("sw AS (SELECT 'news' AS strategy, symbol, dt, close, CASE WHEN ft_news_10 > 0 THEN 1.0 ELSE 0.0 END AS signal FROM sds),", 1)[1].replace(
    "0.001 * sum(turn)", "0.0002 * sum(turn)")


@register("threshold_sweep", SWEEP_SQL.rstrip() + metrics_sql("swnav"), dbl="total_return cagr sharpe max_drawdown calmar",
          digits=5)
def q_sweep(fx):
    ds = smooth_frame(fx)
    return ST.threshold_sweep(ds, _FC, _TH, price="close", cost_rate=0.0002)
