"""Statistics on the panel."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import stats as S
from . import common as C
from . import register, cte

FTS = ["ft_news_10", "ft_submissions_10", "ft_comments_10", "ft_combined_10"]
TGTS = ["tgt_forward_returns_10", "tgt_resid_returns_10", "vol_tgt_10"]


@register("pearson_r", C.DATASET_CTES + """SELECT symbol, corr(ft_news_10, tgt_forward_returns_10) AS r,
  count(ft_news_10 + tgt_forward_returns_10) AS n,
  corr(ft_news_10, tgt_forward_returns_10) * sqrt((count(ft_news_10 + tgt_forward_returns_10) - 2)
    / nullif(1 - corr(ft_news_10, tgt_forward_returns_10) ^ 2, 0)) AS t_stat FROM ds GROUP BY symbol""", dbl="r t_stat")
def q_pearson_r(fx):
    return S.pearson_stats(C.dataset_cols(fx, "ft_news_10", "tgt_forward_returns_10"), "ft_news_10", "tgt_forward_returns_10", "symbol")


@register("pearson_test", None, note="p-values need the t tail; unit-tested against known tables")
def q_pearson_test(fx):
    return S.pearson_test(C.dataset_cols(fx, "ft_news_10", "tgt_forward_returns_10"), "ft_news_10", "tgt_forward_returns_10", "symbol")


def _pairs_sql(cols, key=None):
    ks = f"{key}, " if key else ""
    parts = []
    for i, a in enumerate(cols):
        for b in cols[i + 1:]:
            parts.append(f"SELECT {ks}'{a}' AS a, '{b}' AS b, corr({a}, {b}) AS r FROM ds" + (f" GROUP BY {key}" if key else ""))
    return "\nUNION ALL ".join(parts)


@register("corr_matrix", C.DATASET_CTES + _pairs_sql(FTS + TGTS), dbl="r")
def q_corr_matrix(fx):
    return S.corr_matrix(C.dataset(fx, rolled=FTS), FTS + TGTS)


@register("corr_matrix_by_symbol", C.DATASET_CTES + _pairs_sql(FTS[:2] + TGTS[:1], "symbol"), dbl="r")
def q_corr_matrix_sym(fx):
    return S.corr_matrix(C.dataset(fx, rolled=FTS[:2]), FTS[:2] + TGTS[:1], "symbol")


_VOL_FTS = ["vol_ft_news_10", "vol_ft_comments_10"]


@register("feature_target_corr", C.DATASET_CTES + "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, '{t}' AS target, corr({f}, {t}) AS r FROM ds"
    for f, t in [(f, t) for f in FTS + _VOL_FTS for t in TGTS]), dbl="r")
def q_ft_corr(fx):
    return S.feature_target_corr(C.dataset(fx, rolled=FTS + _VOL_FTS), FTS + _VOL_FTS, TGTS)


@register("feature_corr_rank", C.DATASET_CTES + "SELECT * FROM (" + "\nUNION ALL ".join(
    f"SELECT '{f}' AS feature, corr({f}, tgt_forward_returns_10) AS r FROM ds" for f in FTS) + ") ORDER BY r DESC, feature",
    dbl="r")
def q_ft_rank(fx):
    return S.feature_corr_rank(C.dataset_cols(fx, *FTS, "tgt_forward_returns_10"), FTS, "tgt_forward_returns_10")


@register("autocorr_by_symbol", cte("fx_event_day") + """, p AS (SELECT symbol, x AS x_t,
  lead(x) OVER (PARTITION BY symbol ORDER BY dt) AS x_next FROM fx_event_day WHERE x IS NOT NULL)
SELECT symbol, corr(x_t, x_next) AS r, count(*) AS n,
  corr(x_t, x_next) * sqrt((count(*) - 2) / nullif(1 - corr(x_t, x_next) ^ 2, 0)) AS t_stat
FROM p WHERE x_t IS NOT NULL AND x_next IS NOT NULL GROUP BY symbol""", dbl="r t_stat")
def q_autocorr(fx):
    return S.autocorr_by_symbol(fx.fx_event_day, "x").drop("p_value")


_OLS_SQL = C.DATASET_CTES + """,
o AS (SELECT * FROM ds WHERE ft_news IS NOT NULL AND ft_submissions IS NOT NULL AND ft_comments IS NOT NULL),
mo AS (SELECT symbol, count(*) AS n, avg(ft_news) AS my, avg(ft_submissions) AS m1, avg(ft_comments) AS m2,
  var_pop(ft_submissions) AS c11, var_pop(ft_comments) AS c22, covar_pop(ft_submissions, ft_comments) AS c12,
  covar_pop(ft_submissions, ft_news) AS c1y, covar_pop(ft_comments, ft_news) AS c2y, var_pop(ft_news) AS cyy FROM o GROUP BY 1),
b AS (SELECT *, c11 * c22 - c12 * c12 AS det FROM mo),
b2 AS (SELECT *, (c22 * c1y - c12 * c2y) / det AS b1, (c11 * c2y - c12 * c1y) / det AS b2 FROM b WHERE det <> 0),
b3 AS (SELECT *, my - b1 * m1 - b2 * m2 AS b0, n * (cyy - b1 * c1y - b2 * c2y) AS ssr FROM b2),
b4 AS (SELECT *, ssr / (n - 3) AS s2, 1 - ssr / (n * cyy) AS r2 FROM b3),
terms AS (
  SELECT symbol, 'const' AS term, b0 AS coef, sqrt(s2 * (1.0 / n + (m1 * m1 * c22 - 2 * m1 * m2 * c12 + m2 * m2 * c11) / (n * det))) AS std_err, n, r2 FROM b4
  UNION ALL SELECT symbol, 'ft_submissions', b1, sqrt(s2 * c22 / (n * det)), n, r2 FROM b4
  UNION ALL SELECT symbol, 'ft_comments', b2, sqrt(s2 * c11 / (n * det)), n, r2 FROM b4)
SELECT symbol, term, coef, std_err, coef / std_err AS t_stat, n, r2, 1 - (1 - r2) * (n - 1) / (n - 3) AS adj_r2,
  (r2 / 2) / ((1 - r2) / (n - 3)) AS f_stat FROM terms"""


@register("ols_by_symbol", _OLS_SQL, dbl="coef std_err t_stat r2 adj_r2 f_stat", digits=5)
def q_ols(fx):
    return S.ols_by_group(C.dataset_cols(fx, "ft_news", "ft_submissions", "ft_comments"), "ft_news", ["ft_submissions", "ft_comments"], "symbol").drop(
        "p_value", "f_p_value")


@register("ols_by_symbol_pvalues", None, note="t/F tails; unit-tested")
def q_ols_p(fx):
    return S.ols_by_group(C.dataset_cols(fx, "ft_news", "ft_submissions", "ft_comments"), "ft_news", ["ft_submissions", "ft_comments"], "symbol")


GRANGER_PAIRS = [("ft_news", "ft_submissions"), ("ft_news", "ft_comments"), ("ft_submissions", "ft_news"), ("ft_comments", "ft_news")]
_CHANNELS = ["ft_news", "ft_submissions", "ft_comments"]
_GRANGER_COLS = ["symbol", "effect", "cause", "lag", "n", "ssr_r", "ssr_u", "f_stat", "chi2", "lr", "params_f"]


def _granger_sql(maxlag: int = 4) -> str:
    """Sums of squared residuals by elimination: y's lags first, then x's lags, out of y's sum of squares, one CTE a pivot."""
    sql = C.DATASET_CTES + ", gp AS MATERIALIZED (" + " UNION ALL ".join(
        f"SELECT symbol, dt, '{y}' AS effect, '{x}' AS cause, {y} AS y0, {x} AS x0 FROM ds WHERE {' AND '.join(f'{c} IS NOT NULL' for c in _CHANNELS)}"
        for y, x in GRANGER_PAIRS) + "),\ngl AS MATERIALIZED (SELECT *, row_number() OVER w AS rn, " + ", ".join(
        f"lag({v}0, {j}) OVER w AS {v}{j}" for v in "yx" for j in range(1, maxlag + 1)) + " FROM gp WINDOW w AS (PARTITION BY effect, cause, symbol ORDER BY dt))"
    done = []
    for lag in range(1, maxlag + 1):
        v = [f"y{j}" for j in range(1, lag + 1)] + [f"x{j}" for j in range(1, lag + 1)] + ["y0"]
        pairs = [(i, j) for i in range(len(v)) for j in range(i, len(v))]
        sql += f",\ng{lag}_0 AS MATERIALIZED (SELECT symbol, effect, cause, count(*) AS n, " + ", ".join(
            f"covar_pop({v[i]}, {v[j]}) * count(*) AS m{i}_{j}" for i, j in pairs) + f", NULL::DOUBLE AS ssr_r FROM gl WHERE rn > {lag} GROUP BY ALL)"
        for k in range(len(v) - 1):
            left = [(i, j) for i, j in pairs if i > k]
            last = len(v) - 1
            keep = f"m{last}_{last} - m{k}_{last} * m{k}_{last} / nullif(m{k}_{k}, 0)" if k == lag - 1 else "ssr_r"
            sql += f",\ng{lag}_{k + 1} AS MATERIALIZED (SELECT symbol, effect, cause, n, " + ", ".join(
                f"m{i}_{j} - m{k}_{i} * m{k}_{j} / nullif(m{k}_{k}, 0) AS m{i}_{j}" for i, j in left) + f", {keep} AS ssr_r FROM g{lag}_{k})"
        last = len(v) - 1
        done.append(f"SELECT symbol, effect, cause, {lag} AS lag, n, ssr_r, m{last}_{last} AS ssr_u FROM g{lag}_{last} WHERE n > {2 * lag + 1}")
    return sql + ",\ngs AS (" + " UNION ALL ".join(done) + """)
SELECT symbol, effect, cause, lag, n, ssr_r, ssr_u, ((ssr_r - ssr_u) / lag) / (ssr_u / (n - 2 * lag - 1)) AS f_stat, n * (ssr_r - ssr_u) / ssr_u AS chi2,
  n * ln(ssr_r / ssr_u) AS lr, ((ssr_r - ssr_u) / lag) / (ssr_u / (n - 2 * lag - 1)) AS params_f FROM gs"""


def _granger(fx):
    return S.granger_by_group(C.dataset_cols(fx, *_CHANNELS), GRANGER_PAIRS, "symbol", "dt", 4)


@register("granger_by_symbol", _granger_sql(), dbl="ssr_r ssr_u f_stat chi2 lr params_f", digits=5)
def q_granger(fx):
    return _granger(fx).select(*_GRANGER_COLS)


@register("granger_by_symbol_pvalues", None, note="F and chi2 tails; unit-tested against a table")
def q_granger_p(fx):
    return _granger(fx)


def _simple_ols_sql(y: str, x: str) -> str:
    return f"""SELECT symbol, '{y}' AS y, '{x}' AS x, regr_count({y}, {x}) AS n, regr_slope({y}, {x}) AS slope, regr_intercept({y}, {x}) AS intercept,
  regr_r2({y}, {x}) AS r2, sqrt(regr_syy({y}, {x}) * (1 - regr_r2({y}, {x})) / (regr_count({y}, {x}) - 2) / nullif(regr_sxx({y}, {x}), 0)) AS slope_se FROM ds GROUP BY symbol"""


OLS_FORMS = [("ft_submissions", "ft_news"), ("ft_comments", "ft_news"), ("ft_news", "ft_submissions"), ("ft_news", "ft_comments")]


@register("ols_forms_by_symbol", C.DATASET_CTES + " UNION ALL ".join(_simple_ols_sql(y, x) for y, x in OLS_FORMS), dbl="slope intercept r2 slope_se", digits=5)
def q_ols_forms(fx):
    """The four one-regressor forms beside the two-regressor one of ``ols_by_symbol``."""
    ds = C.dataset_cols(fx, *_CHANNELS)
    out = None
    for y, x in OLS_FORMS:
        t = S.ols_by_group(ds, y, [x], "symbol")
        one = lambda term, c: F.max(F.when(F.col("term") == term, F.col(c)))
        t = t.groupBy("symbol").agg(F.max("n").alias("n"), one(x, "coef").alias("slope"), one("const", "coef").alias("intercept"), F.max("r2").alias("r2"),
                                    one(x, "std_err").alias("slope_se")).select("symbol", F.lit(y).alias("y"), F.lit(x).alias("x"), "n", "slope", "intercept", "r2", "slope_se")
        out = t if out is None else out.unionByName(t)
    return out
