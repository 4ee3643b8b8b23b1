"""Moment aggregates and small dense solves.

Data-sized work is a Spark aggregate (counts, means and centred co-moments via
the built-in, numerically stable ``covar_pop``; partial aggregation makes it
skew safe).  Python only ever sees one row per group: a (k x k) matrix whose
size depends on the number of variables, never on the number of rows.

Distribution tails are implemented here (no scipy): regularised incomplete
beta by Lentz's continued fraction, regularised incomplete gamma by series /
continued fraction.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def moments(df: DataFrame, keys: list[str], cols: list[str]) -> DataFrame:
    """One row per group: n, m_i (means) and c_i_j (population co-moments, i <= j)."""
    aggs = [F.count(F.lit(1)).alias("n")]
    aggs += [F.avg(c).alias(f"m_{i}") for i, c in enumerate(cols)]
    for i in range(len(cols)):
        for j in range(i, len(cols)):
            aggs.append(F.covar_pop(cols[i], cols[j]).alias(f"c_{i}_{j}"))
    return df.groupBy(*keys).agg(*aggs)


def unpack(row, k: int):
    """(n, mean vector, population covariance matrix) from a moments row (dict-like)."""
    n = float(row["n"])
    mean = np.array([row[f"m_{i}"] for i in range(k)], dtype=float)
    C = np.zeros((k, k))
    for i in range(k):
        for j in range(i, k):
            C[i, j] = C[j, i] = row[f"c_{i}_{j}"]
    return n, mean, C


def ols_from_moments(n: float, mean: np.ndarray, C: np.ndarray, y: int, xs: list[int], alpha: float = 0.0):
    """Least squares (ridge when alpha > 0, intercept unpenalised) from moments.

    Returns dict(coef (with intercept first), se, ssr, sst, df_resid) or None if singular.
    """
    Sxx = n * C[np.ix_(xs, xs)]
    Sxy = n * C[np.ix_(xs, [y])][:, 0]
    Syy = n * C[y, y]
    A = Sxx + alpha * np.eye(len(xs))
    try:
        b = np.linalg.solve(A, Sxy) if len(xs) else np.zeros(0)
    except np.linalg.LinAlgError:
        return None
    b0 = mean[y] - (mean[xs] @ b if len(xs) else 0.0)
    ssr = max(Syy - 2 * b @ Sxy + b @ Sxx @ b, 0.0)
    p = len(xs) + 1
    dfr = n - p
    se = None
    if alpha == 0.0 and dfr > 0:
        s2 = ssr / dfr
        try:
            inv = np.linalg.inv(Sxx) if len(xs) else np.zeros((0, 0))
        except np.linalg.LinAlgError:
            inv = None
        if inv is not None:
            se_b = np.sqrt(np.maximum(np.diag(inv) * s2, 0))
            se_0 = math.sqrt(max(s2 * (1.0 / n + mean[xs] @ inv @ mean[xs]), 0)) if len(xs) else math.sqrt(s2 / n)
            se = np.concatenate([[se_0], se_b])
    return {"coef": np.concatenate([[b0], b]), "se": se, "ssr": float(ssr), "sst": float(Syy), "df_resid": dfr}


# ------------------------------------------------------------ tails ----

def _betacf(a, b, x, itmax=300, eps=3e-16):
    tiny = 1e-300
    qab, qap, qam = a + b, a + 1.0, a - 1.0
    c, d = 1.0, 1.0 - qab * x / qap
    d = tiny if abs(d) < tiny else d
    d = 1.0 / d
    h = d
    for m in range(1, itmax + 1):
        m2 = 2 * m
        aa = m * (b - m) * x / ((qam + m2) * (a + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        h *= d * c
        aa = -(a + m) * (qab + m) * x / ((a + m2) * (qap + m2))
        d = 1.0 + aa * d
        d = tiny if abs(d) < tiny else d
        c = 1.0 + aa / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < eps:
            break
    return h


def betainc_reg(a: float, b: float, x: float) -> float:
    if x is None or a <= 0 or b <= 0 or not math.isfinite(x):
        return float("nan")
    if x <= 0:
        return 0.0
    if x >= 1:
        return 1.0
    lbt = math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    if x < (a + 1.0) / (a + b + 2.0):
        return math.exp(lbt) * _betacf(a, b, x) / a
    return 1.0 - math.exp(lbt) * _betacf(b, a, 1.0 - x) / b


def gammainc_upper_reg(s: float, x: float) -> float:
    if x is None or s <= 0 or not math.isfinite(x):
        return float("nan")
    if x <= 0:
        return 1.0
    if x < s + 1.0:
        term = total = 1.0 / s
        ap = s
        for _ in range(1000):
            ap += 1.0
            term *= x / ap
            total += term
            if abs(term) < abs(total) * 1e-16:
                break
        return 1.0 - total * math.exp(-x + s * math.log(x) - math.lgamma(s))
    tiny = 1e-300
    b = x + 1.0 - s
    c = 1.0 / tiny
    d = 1.0 / b
    h = d
    for i in range(1, 1000):
        an = -i * (i - s)
        b += 2.0
        d = an * d + b
        d = tiny if abs(d) < tiny else d
        c = b + an / c
        c = tiny if abs(c) < tiny else c
        d = 1.0 / d
        de = d * c
        h *= de
        if abs(de - 1.0) < 1e-16:
            break
    return math.exp(-x + s * math.log(x) - math.lgamma(s)) * h


def t_two_sided_p(t: float, df: float) -> float:
    if t is None or df is None or not math.isfinite(t) or df <= 0:
        return float("nan")
    return betainc_reg(df / 2.0, 0.5, df / (df + t * t))


def f_sf(f: float, d1: float, d2: float) -> float:
    if f is None or not math.isfinite(f) or d1 <= 0 or d2 <= 0:
        return float("nan")
    if f <= 0:
        return 1.0
    return betainc_reg(d2 / 2.0, d1 / 2.0, d2 / (d2 + d1 * f))


def chi2_sf(x: float, k: float) -> float:
    if x is None or not math.isfinite(x) or k <= 0:
        return float("nan")
    return gammainc_upper_reg(k / 2.0, x / 2.0)


def pearson_p(r: float, n: float) -> float:
    """Two-sided p of Pearson r with n pairs (t with n-2 df)."""
    if r is None or n is None or n < 3 or not math.isfinite(r):
        return float("nan")
    if abs(r) >= 1.0:
        return 0.0
    df = n - 2
    t = r * math.sqrt(df / (1 - r * r))
    return t_two_sided_p(t, df)


def t_ppf(q: float, df: float) -> float:
    """Quantile of Student's t by bisection on the tail function (q in (0.5, 1))."""
    if df <= 0:
        return float("nan")
    target = 2 * (1 - q)  # two-sided p at the quantile
    lo, hi = 0.0, 1.0
    while t_two_sided_p(hi, df) > target and hi < 1e8:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        if t_two_sided_p(mid, df) > target:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


def normal_two_sided_p(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))
