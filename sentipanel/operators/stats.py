"""Correlation, tests and per-group regressions.

Pattern: Spark aggregates (corr / covar_pop / count, partial + final) produce
one small row per group; the only Python is a vectorised pandas UDF or an
``applyInPandas`` over those rows (k x k solves, distribution tails).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from . import gram as G
from . import linalg as LA
from .windows import consecutive_pairs


@F.pandas_udf(T.DoubleType())
def _pearson_p_udf(r: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([LA.pearson_p(a, b) if pd.notna(a) and pd.notna(b) else None for a, b in zip(r, n)], dtype="float64")


def _keys(key):
    return [] if key is None else ([key] if isinstance(key, str) else list(key))


def corr_by_group(df: DataFrame, key, x: str, y: str) -> DataFrame:
    return df.groupBy(*_keys(key)).agg(F.corr(x, y).alias("r"), F.count(F.lit(1)).alias("n"))


def pearson_stats(df: DataFrame, x: str, y: str, key=None) -> DataFrame:
    """r, n (complete pairs) and t statistic per group."""
    both = F.col(x).isNotNull() & F.col(y).isNotNull()
    out = df.groupBy(*_keys(key)).agg(F.corr(x, y).alias("r"), F.count_if(both).alias("n"))
    t = F.col("r") * F.sqrt(F.try_divide(F.col("n") - 2, 1 - F.col("r") * F.col("r")))
    return out.withColumn("t_stat", t)


def pearson_test(df: DataFrame, x: str, y: str, key=None) -> DataFrame:
    """r and two-sided p (t with n-2 df), whole frame or per group."""
    return pearson_stats(df, x, y, key).withColumn("p_value", _pearson_p_udf(F.col("r"), F.col("n").cast("double")))


def corr_matrix(df: DataFrame, cols: list[str], key=None) -> DataFrame:
    """Pairwise-complete Pearson r of every pair (long form: a, b, r), from one block Gram however many columns there are."""
    return G.pair_corr(df, cols, cols, _keys(key), upper=True)


def feature_target_corr(df: DataFrame, features: list[str], targets: list[str], key=None) -> DataFrame:
    """r of every (feature, target) pair, long form."""
    return G.pair_corr(df, features, targets, _keys(key), names=("feature", "target"))


def feature_corr_rank(df: DataFrame, features: list[str], target: str) -> DataFrame:
    return feature_target_corr(df, features, [target]).select("feature", "r").orderBy(F.desc("r"), "feature")


def autocorr_by_symbol(df: DataFrame, c: str, key: str = "symbol", day: str = "dt") -> DataFrame:
    """Pearson test of consecutive values per series (series with < 2 rows yield no pair)."""
    pairs = consecutive_pairs(df.filter(F.col(c).isNotNull()), c, key, day)
    return pearson_test(pairs, "x_t", "x_next", key)


# ------------------------------------------------------------- OLS ----

def ols_by_group(df: DataFrame, y: str, xs: list[str], key=None, dropna: bool = True) -> DataFrame:
    """y ~ const + xs per group: coefficient table + model statistics.

    Columns: keys, term, coef, std_err, t_stat, p_value, n, r2, adj_r2, f_stat, f_p_value.
    """
    keys = _keys(key)
    cols = [y, *xs]
    data = df.dropna(subset=cols) if dropna else df
    mom = LA.moments(data, keys, cols)
    k = len(cols)
    terms = ["const", *xs]
    key_fields = [f for f in mom.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + [T.StructField(n, t) for n, t in [
        ("term", T.StringType()), ("coef", T.DoubleType()), ("std_err", T.DoubleType()), ("t_stat", T.DoubleType()),
        ("p_value", T.DoubleType()), ("n", T.LongType()), ("r2", T.DoubleType()), ("adj_r2", T.DoubleType()),
        ("f_stat", T.DoubleType()), ("f_p_value", T.DoubleType())]])

    def solve_rows(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = []
        for _, row in pdf.iterrows():
            n, mean, C = LA.unpack(row, k)
            res = LA.ols_from_moments(n, mean, C, 0, list(range(1, k)))
            if res is None:  # collinear regressors: the group keeps its rows, without estimates
                rows += [{**{kk: row[kk] for kk in keys}, "term": term, "n": int(n)} for term in terms]
                continue
            p = len(xs)
            dfr = res["df_resid"]
            r2 = 1 - res["ssr"] / res["sst"] if res["sst"] > 0 else np.nan
            adj = 1 - (1 - r2) * (n - 1) / dfr if dfr > 0 else np.nan
            fstat = (r2 / p) / ((1 - r2) / dfr) if (p > 0 and dfr > 0 and r2 < 1) else np.nan
            fp = LA.f_sf(fstat, p, dfr) if np.isfinite(fstat) else np.nan
            for i, term in enumerate(terms):
                coef = res["coef"][i]
                se = res["se"][i] if res["se"] is not None else np.nan
                t = coef / se if se and se > 0 else np.nan
                pv = LA.t_two_sided_p(t, dfr) if np.isfinite(t) else np.nan
                rows.append({**{kk: row[kk] for kk in keys}, "term": term, "coef": coef, "std_err": se, "t_stat": t,
                             "p_value": pv, "n": int(n), "r2": r2, "adj_r2": adj, "f_stat": fstat, "f_p_value": fp})
        return pd.DataFrame(rows, columns=schema.fieldNames())

    # one row per group already: solve partition-wise (no shuffle, no per-group call)
    return mom.mapInPandas(lambda it: (solve_rows(pdf) for pdf in it), schema)


# ----------------------------------------------------------- Granger ----

GRANGER = [("lag", T.IntegerType()), ("n", T.LongType()), ("ssr_r", T.DoubleType()), ("ssr_u", T.DoubleType()),
           ("f_stat", T.DoubleType()), ("f_p_value", T.DoubleType()), ("chi2", T.DoubleType()), ("chi2_p_value", T.DoubleType()),
           ("lr", T.DoubleType()), ("lr_p_value", T.DoubleType()), ("params_f", T.DoubleType()), ("params_f_p_value", T.DoubleType())]


def pivots(cross: np.ndarray) -> np.ndarray:
    """Squared diagonal of the Cholesky factor: what is left of each variable's sum of squares after the ones before it.  NaN from
    the first variable on that the ones before it determine."""
    m, out = cross.copy(), np.full(len(cross), np.nan)
    for k in range(len(m)):
        if m[k, k] <= 1e-11 * cross[k, k] or cross[k, k] <= 0:
            break
        out[k] = m[k, k]
        m[k + 1:, k + 1:] -= np.outer(m[k + 1:, k], m[k, k + 1:]) / m[k, k]
    return out


def lag_grams(x: np.ndarray, maxlag: int) -> list[G.Gram]:
    """By lag L = 1..maxlag the moments of the rows after the first L, columns (lag, channel), lag 0 first.

    The rows after ``maxlag`` are one lag-stacked matrix; a smaller L takes its block and adds the rows between.
    """
    n, k = x.shape
    stack = lambda lo, hi, lags: np.column_stack([x[lo - j:hi - j] for j in range(lags + 1)])
    common = G.Gram.of(stack(maxlag, n, maxlag)) if n > maxlag else None
    out = []
    for lag in range(1, maxlag + 1):
        size = k * (lag + 1)
        own = G.Gram.of(stack(lag, min(maxlag, n), lag) if min(maxlag, n) > lag else np.empty((0, size)))
        out.append(own if common is None else G.Gram(common.n, common.mean[:size], common.cross[:size, :size]).merge(own))
    return out


def granger_by_group(df: DataFrame, pairs: list[tuple[str, str]], key="symbol", order: str = "dt", maxlag: int = 4) -> DataFrame:
    """For every (effect, cause) of ``pairs``: does the cause Granger-cause the effect?  For each lag L = 1..maxlag: restricted effect ~ const +
    its lags; unrestricted adds the cause's lags; rows = complete rows (in all columns named) after dropping the first
    L (row lags).  Returns F (ssr), chi2, LR and params-F tests per (key, effect, cause, lag).

    A series is read once; all pairs and lags are sub-blocks of one moment matrix.  With the effect ordered after its own lags and
    the cause's lags, the last pivots of two Cholesky factors are the sums of squared residuals.  Lags that leave too few rows have no row; collinear
    ones have null statistics.
    """
    keys = _keys(key)
    cols = list(dict.fromkeys(c for pair in pairs for c in pair))
    data = df.select(*keys, order, *[F.col(c).cast("double").alias(c) for c in cols]).dropna(subset=cols)
    key_fields = [f for f in data.schema.fields if f.name in keys]
    names = [f.name for f in key_fields]
    schema = T.StructType([*key_fields, T.StructField("effect", T.StringType()), T.StructField("cause", T.StringType()), *[T.StructField(c, t) for c, t in GRANGER]])
    at = [(y, x, cols.index(y), cols.index(x)) for y, x in pairs]
    k = len(cols)

    def one_series(table: pa.Table) -> pa.Table:
        table = table.sort_by(order)
        x = np.column_stack([np.asarray(table[c]) for c in cols])
        own = {c: table[c][0].as_py() for c in names}
        rows = []
        for lag, g in enumerate(lag_grams(x, maxlag), 1):
            if g.n <= 2 * lag + 1:
                continue
            for y, c, iy, ix in at:
                ylags, xlags = [j * k + iy for j in range(1, lag + 1)], [j * k + ix for j in range(1, lag + 1)]
                last = lambda v: pivots(g.cross[np.ix_(v, v)])[-1]
                rows.append(own | {"effect": y, "cause": c} | _granger(int(g.n), lag, last([*ylags, iy]), last([*ylags, *xlags, iy])))
        return pa.Table.from_pylist(rows, schema=arrow)
    arrow = to_arrow_schema(schema)
    return data.groupBy(*keys).applyInArrow(one_series, schema)


def _granger(n: int, lag: int, ssr_r: float, ssr_u: float) -> dict:
    out = {"lag": lag, "n": n, "ssr_r": ssr_r, "ssr_u": ssr_u}
    if np.isfinite(ssr_r) and np.isfinite(ssr_u):
        free = n - 2 * lag - 1
        f = (ssr_r - ssr_u) / lag / (ssr_u / free)
        chi2, lr = n * (ssr_r - ssr_u) / ssr_u, n * np.log(ssr_r / ssr_u)
        p = LA.f_sf(f, lag, free)
        out |= {"f_stat": f, "f_p_value": p, "chi2": chi2, "chi2_p_value": LA.chi2_sf(chi2, lag), "lr": lr, "lr_p_value": LA.chi2_sf(lr, lag), "params_f": f, "params_f_p_value": p}
    return {c: None if isinstance(v, float) and not np.isfinite(v) else v for c, v in out.items()}
