import itertools
import math

import numpy as np
from pyspark.sql import functions as F

from sentipanel.operators import causal as CA
from sentipanel.operators import linalg as LA
from sentipanel.operators import models as M
from sentipanel.operators import stats as S


def test_tails_known_values():
    assert abs(LA.t_two_sided_p(2.0, 10) - 0.07338803477074797) < 1e-9
    assert abs(LA.f_sf(3.0, 2, 20) - 1.3 ** -10) < 1e-12  # closed form for d1 = 2
    assert abs(LA.chi2_sf(3.84145882, 1) - 0.05) < 1e-7
    assert abs(LA.pearson_p(0.5, 12) - 0.0979) < 1e-3
    assert abs(LA.t_ppf(0.975, 10) - 2.2281388519649385) < 1e-8


def _frame(spark, n=400, seed=0):
    rng = np.random.default_rng(seed)
    x1, x2 = rng.normal(size=n), rng.normal(size=n)
    y = 0.5 + 2 * x1 - x2 + rng.normal(size=n)
    rows = [(("A" if i % 2 else "B"), i, float(a), float(b), float(c)) for i, (a, b, c) in enumerate(zip(x1, x2, y))]
    return spark.createDataFrame(rows, "symbol string, t long, x1 double, x2 double, y double"), x1, x2, y


def test_ols_matches_lstsq(spark):
    df, x1, x2, y = _frame(spark)
    out = {r["term"]: r for r in S.ols_by_group(df, "y", ["x1", "x2"]).collect()}
    X = np.column_stack([np.ones_like(x1), x1, x2])
    b, *_ = np.linalg.lstsq(X, y, rcond=None)
    resid = y - X @ b
    s2 = resid @ resid / (len(y) - 3)
    se = np.sqrt(np.diag(np.linalg.inv(X.T @ X)) * s2)
    for i, t in enumerate(["const", "x1", "x2"]):
        assert abs(out[t]["coef"] - b[i]) < 1e-9
        assert abs(out[t]["std_err"] - se[i]) < 1e-9
    assert abs(out["x1"]["r2"] - (1 - resid @ resid / ((y - y.mean()) @ (y - y.mean())))) < 1e-9


def test_ridge_matches_closed_form(spark):
    df, x1, x2, y = _frame(spark)
    coefs = {r["term"]: r["coef"] for r in M.ridge_fit(df, ["x1", "x2"], "y", alpha=3.0).collect()}
    X = np.column_stack([x1, x2])
    Xc, yc = X - X.mean(0), y - y.mean()
    b = np.linalg.solve(Xc.T @ Xc + 3.0 * np.eye(2), Xc.T @ yc)
    assert abs(coefs["x1"] - b[0]) < 1e-9 and abs(coefs["x2"] - b[1]) < 1e-9
    assert abs(coefs["intercept"] - (y.mean() - X.mean(0) @ b)) < 1e-9


def test_walk_forward_matches_refits(spark):
    rng = np.random.default_rng(1)
    rows = []
    import datetime as dt
    d0 = dt.date(2020, 1, 1)
    for d in range(60):
        for s in range(3):
            if (d + s) % 7 == 0:
                continue
            x = float(rng.normal())
            rows.append((f"S{s}", d0 + dt.timedelta(days=d), x, float(0.3 * x + rng.normal())))
    df = spark.createDataFrame(rows, "symbol string, dt date, x double, y double")
    out = M.walk_forward_ridge(df, ["x"], "y", "2020-01-20", "2020-02-29", offset=3, alpha=1.0).collect()
    dates = sorted({r[1] for r in rows})
    for r in out:
        d = r["dt"]
        if d < dt.date(2020, 1, 20):
            assert r["prediction"] is None
            continue
        cut = d - dt.timedelta(days=4)
        before = [x for x in dates if x < cut]
        if not before:
            assert r["prediction"] is None
            continue
        td = before[-1]
        tr = [(x, y) for (_, dd, x, y) in rows if dd < td]
        if not tr:
            assert r["prediction"] is None
            continue
        X = np.array([t[0] for t in tr])
        Y = np.array([t[1] for t in tr])
        xc, yc = X - X.mean(), Y - Y.mean()
        b = (xc @ yc) / (xc @ xc + 1.0)
        pred = Y.mean() - X.mean() * b + b * r["x"]
        assert abs(r["prediction"] - pred) < 1e-8


def test_granger_matches_lstsq(spark):
    rng = np.random.default_rng(2)
    n = 120
    x = rng.normal(size=n)
    y = np.zeros(n)
    for t in range(1, n):
        y[t] = 0.4 * y[t - 1] + 0.5 * x[t - 1] + rng.normal()
    df = spark.createDataFrame([("A", i, float(y[i]), float(x[i])) for i in range(n)], "symbol string, t long, y double, x double")
    out = {r["lag"]: r for r in S.granger_by_group(df, [("y", "x")], "symbol", "t", 2).collect()}
    for L in (1, 2):
        Y = y[L:]
        lags_y = np.column_stack([y[L - j:n - j] for j in range(1, L + 1)])
        lags_x = np.column_stack([x[L - j:n - j] for j in range(1, L + 1)])
        one = np.ones((len(Y), 1))
        def ssr(X):
            b, *_ = np.linalg.lstsq(X, Y, rcond=None)
            e = Y - X @ b
            return e @ e
        sr, su = ssr(np.hstack([one, lags_y])), ssr(np.hstack([one, lags_y, lags_x]))
        f = ((sr - su) / L) / (su / (len(Y) - 2 * L - 1))
        assert abs(out[L]["ssr_r"] - sr) < 1e-7 * sr and abs(out[L]["f_stat"] - f) < 1e-6 * f
        assert out[L]["n"] == len(Y)


def test_pearson_and_corr(spark):
    df, x1, x2, y = _frame(spark)
    r = S.pearson_test(df, "x1", "y").collect()[0]
    assert abs(r["r"] - np.corrcoef(x1, y)[0, 1]) < 1e-12
    assert r["p_value"] < 1e-10
    cm = {(a, b): v for a, b, v in S.corr_matrix(df, ["x1", "x2", "y"]).collect()}
    assert abs(cm[("x2", "y")] - np.corrcoef(x2, y)[0, 1]) < 1e-12


def test_backdoor_and_ci_tests(spark):
    df, x1, x2, y = _frame(spark)
    e = CA.backdoor_effect(df, "x1", "y", ["x2"]).collect()[0]
    assert abs(e["estimate"] - 2.0) < 0.2 and e["ci_low"] < e["estimate"] < e["ci_high"]
    tests = CA.ci_test_table(df, ["x1", "x2", "y"], 0.05, 1).collect()
    kept = {(r["x"], r["y"]) for r in tests if r["edge_kept"]}
    assert ("x1", "x2") not in kept and ("x1", "y") in kept


def test_refuters_deterministic(spark):
    df, *_ = _frame(spark)
    a = sorted(CA.refute_random_cause(df, "x1", "y", ["x2"], ["t"], replicates=5, seed=3).collect())
    b = sorted(CA.refute_random_cause(df, "x1", "y", ["x2"], ["t"], replicates=5, seed=3).collect())
    assert a == b and len(a) == 5
    s = CA.refute_subset(df, "x1", "y", ["x2"], ["t"], 0.5, replicates=4, seed=1).collect()
    assert all(150 < r["n"] < 250 for r in s)


def _fisher(rows, names, pair, cond, alpha=0.05):
    x = np.array([[r[names.index(c)] for c in [*pair, *cond]] for r in rows])
    p = np.linalg.inv(np.corrcoef(x.T))
    r = -p[0, 1] / math.sqrt(p[0, 0] * p[1, 1])
    return math.erfc(abs(math.atanh(r) * math.sqrt(len(x) - len(cond) - 3)) / math.sqrt(2)) > alpha


def _skeleton(rows, names):
    """Level-wise search by the rule, straight from the rows."""
    adjacent = {a: set(names) - {a} for a in names}
    level = 0
    while any(len(adjacent[a] - {b}) >= level for a in names for b in adjacent[a]):
        gone = []
        for a, b in itertools.combinations(names, 2):
            if b in adjacent[a]:
                sets = {s for side in (a, b) for s in itertools.combinations(sorted(adjacent[side] - {a, b}), level)}
                if any(_fisher(rows, names, (a, b), s) for s in sets):
                    gone.append((a, b))
        for a, b in gone:
            adjacent[a].discard(b)
            adjacent[b].discard(a)
        level += 1
    return {frozenset((a, b)) for a in names for b in adjacent[a]}


def test_skeleton_does_not_depend_on_column_order(spark):
    rng = np.random.default_rng(12)
    n = 500
    a, b = rng.normal(size=n), rng.normal(size=n)
    c = a + b + 0.5 * rng.normal(size=n)
    d = c + 0.7 * rng.normal(size=n)
    e = 0.3 * a - d + rng.normal(size=n)
    f = rng.normal(size=n)
    rows = np.column_stack([a, b, c, d, e, f])
    names = list("abcdef")
    df = spark.createDataFrame([tuple(map(float, r)) for r in rows], ", ".join(f"{c} double" for c in names))
    want = _skeleton(rows, names)
    for order in (names, names[::-1], ["d", "a", "f", "c", "b", "e"]):
        got = CA.ci_test_table(df, order, 0.05).collect()
        assert {frozenset((r["x"], r["y"])) for r in got if r["edge_kept"]} == want
        assert len({(r["x"], r["y"], r["cond"]) for r in got}) == len(got)
        for r in got[:40]:
            assert r["independent"] == _fisher(rows, names, (r["x"], r["y"]), [v for v in r["cond"].split(",") if v])


def test_granger_four_pairs_against_lstsq_and_a_table(spark):
    rng = np.random.default_rng(8)
    x = np.cumsum(rng.normal(size=(90, 3)), axis=0) * 0.1 + rng.normal(size=(90, 3)) + 1e4
    rows = [("A", i, *map(float, r)) for i, r in enumerate(x)] + [("B", i, float(i % 2), 1.0, float(i)) for i in range(40)] + [("C", i, 1.0 * i, 2.0, 3.0) for i in range(5)]
    rows.append(("A", 95, None, 1.0, 1.0))
    df = spark.createDataFrame(rows, "symbol string, t long, n double, s double, c double").repartition(4)
    pairs = [("n", "s"), ("n", "c"), ("s", "n"), ("c", "n")]
    got = {(r["symbol"], r["effect"], r["cause"], r["lag"]): r for r in S.granger_by_group(df, pairs, "symbol", "t", 4).collect()}
    assert {k[0] for k in got} == {"A", "B", "C"} and sum(k[0] == "A" for k in got) == 16
    for (s, y, c, lag), r in got.items():
        if s != "A":
            if "s" in (y, c):
                assert r["f_stat"] is None  # a constant channel
            continue
        v = {"n": x[:, 0], "s": x[:, 1], "c": x[:, 2]}
        stack = lambda names: np.column_stack([np.ones(90 - lag), *[v[m][lag - j:90 - j] - 1e4 for m in names for j in range(1, lag + 1)]])
        ssr = [np.linalg.lstsq(stack(m), v[y][lag:] - 1e4, rcond=None)[1][0] for m in ([y], [y, c])]
        assert [r["ssr_r"], r["ssr_u"]] == [pytest_approx(q) for q in ssr]
        f = (ssr[0] - ssr[1]) / lag / (ssr[1] / (90 - 3 * lag - 1))
        assert r["n"] == 90 - lag and r["f_stat"] == pytest_approx(f)
    # upper tails of F from published tables: 5 % points
    for f, d1, d2 in ((4.0012, 1, 60), (3.1504, 2, 60), (2.7581, 3, 60), (2.5252, 4, 60)):
        assert abs(LA.f_sf(f, d1, d2) - 0.05) < 2e-5


def pytest_approx(v):
    import pytest
    return pytest.approx(v, rel=1e-6)


def test_collinear_groups_keep_their_rows(spark):
    df = spark.createDataFrame([("A", float(i), float(i * i), 1.0) for i in range(9)], "symbol string, y double, x1 double, x2 double")
    out = S.ols_by_group(df, "y", ["x1", "x2"], "symbol").collect()
    assert {r["term"] for r in out} == {"const", "x1", "x2"} and all(r["n"] == 9 for r in out)
