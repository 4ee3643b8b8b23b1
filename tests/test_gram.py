"""Block Gram aggregates against numpy and pandas."""

import datetime as dt

import numpy as np
import pandas as pd
import pytest

from sentipanel.operators import gram as G
from sentipanel.operators import models as M
from sentipanel.operators import stats as S


def _rows(rng, n, k, gaps=0.2):
    x = rng.normal(size=(n, k)) @ rng.normal(size=(k, k)) + rng.normal(size=k) * 1e6
    x[:, 0] = 123.45  # constant
    x[:, 1] += 1e9
    x[rng.random((n, k)) < gaps] = np.nan
    return x


def _frame(spark, x, key=None):
    cols = [f"c{i}" for i in range(x.shape[1])]
    pdf = pd.DataFrame(x, columns=cols).astype(object).where(~np.isnan(x), None)
    pdf.insert(0, "symbol", key if key is not None else "A")
    return spark.createDataFrame(pdf.values.tolist(), "symbol string, " + ", ".join(f"{c} double" for c in cols)).repartition(5), cols


def test_states_merge_in_any_grouping():
    rng = np.random.default_rng(1)
    x = _rows(rng, 500, 6, 0.0)
    whole = G.Gram.of(x)
    parts = [G.Gram.of(p) for p in np.array_split(x, [0, 3, 4, 90, 90, 333])]
    total = parts[0]
    for p in parts[1:]:
        total = total.merge(p)
    assert total.n == 500 and total.cross[0, 0] == 0 and total.mean[0] == 123.45
    assert np.allclose(total.cross, whole.cross, rtol=1e-6, atol=1e-3) and np.allclose(total.cross / 500, np.cov((x - x[0]).T, bias=True), rtol=1e-6, atol=1e-5)
    back = G.Gram.unpack(total.pack(), 6)
    assert (back.cross == np.triu(total.cross) + np.triu(total.cross, 1).T).all() and (back.mean == total.mean).all()


@pytest.mark.parametrize("key", [None, "symbol"])
def test_corr_equals_pairwise_complete_pandas(spark, key):
    rng = np.random.default_rng(2)
    x = _rows(rng, 700, 5)
    x[:, 4] = np.where(np.arange(700) == 3, 1.0, np.nan)  # a single value
    names = rng.choice(["A", "B", "C"], 700, p=[0.8, 0.19, 0.01])
    df, cols = _frame(spark, x, names)
    got = {(r[key] if key else None, r["a"], r["b"]): r["r"] for r in S.corr_matrix(df, cols, key).collect()}
    groups = [(None, x)] if key is None else [(n, x[names == n]) for n in "ABC"]
    assert len(got) == 10 * len(groups)
    for name, own in groups:
        want = pd.DataFrame(own - np.nan_to_num(np.nanmean(own, axis=0)), columns=cols).corr(min_periods=2)
        for i, a in enumerate(cols):
            for b in cols[i + 1:]:
                r = got[name, a, b]
                if a == "c0" or "c4" in (a, b) or np.isnan(want.loc[a, b]):
                    assert r is None
                else:
                    assert r == pytest.approx(want.loc[a, b], abs=1e-6)


def test_229_columns_in_one_node(spark):
    df = spark.range(400).selectExpr(*[f"cast(pmod(hash(id, {k}), 1000) AS double) AS c{k}" for k in range(229)])
    cols = df.columns
    out = S.corr_matrix(df, cols)
    assert len(out._jdf.queryExecution().optimizedPlan().toString()) < 300_000 and "covar" not in out._jdf.queryExecution().optimizedPlan().toString()
    got = {(r["a"], r["b"]): r["r"] for r in out.collect()}
    x = np.array(df.collect())
    want = np.corrcoef(x.T)
    assert len(got) == 229 * 228 // 2
    assert max(abs(got[f"c{i}", f"c{j}"] - want[i, j]) for i in range(229) for j in range(i + 1, 229)) < 1e-9
    sets = {f"without:{c}": [d for d in cols[1:] if d != c] for c in cols[1:40]}
    assert M.ablation(df, cols[1:], "c0", sets).count() == 39


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_prefixes_by_day_with_a_hot_day(spark, partitions):
    rng = np.random.default_rng(4)
    d0 = dt.date(2020, 1, 1)
    days = [d0 + dt.timedelta(int(i)) for i in np.where(rng.random(600) < 0.4, 9, rng.integers(0, 25, 600))]
    x = rng.normal(size=(600, 3)) + 1e5
    df = spark.createDataFrame([(d, *map(float, r)) for d, r in zip(days, x)] + [(d0, None, 1.0, 1.0), (None, 1.0, 1.0, 1.0)], "dt date, a double, b double, c double")
    df = df.where("dt is not null")
    wanted = sorted(set(days))[::2]
    got = {r["dt"]: G.Gram.unpack(r["data"], 3) for r in G.prefix_grams(df, ["a", "b", "c"], "dt", wanted, partitions).collect()}
    assert sorted(got) == wanted
    for d, g in got.items():
        own = x[[v < d for v in days]]
        assert g.n == len(own)
        if len(own):
            assert np.allclose(g.mean, own.mean(axis=0)) and np.allclose(g.cross, np.cov(own.T, bias=True) * len(own), rtol=1e-6, atol=1e-6)


def test_walk_forward_with_many_columns(spark):
    rng = np.random.default_rng(6)
    n, k = 900, 60
    x = rng.normal(size=(n, k))
    y = x[:, :5].sum(axis=1) + rng.normal(size=n)
    days = [dt.date(2020, 1, 1) + dt.timedelta(int(i)) for i in np.sort(rng.integers(0, 60, n))]
    cols = [f"f{i}" for i in range(k)]
    df = spark.createDataFrame([(i, d, float(t), *map(float, r)) for i, (d, t, r) in enumerate(zip(days, y, x))], "i long, dt date, y double, " + ", ".join(f"{c} double" for c in cols))
    got = {r["i"]: r["prediction"] for r in M.walk_forward_ridge(df, cols, "y", "2020-02-01", "2020-02-20", offset=4).collect()}
    calendar = sorted(set(days))
    for d in calendar:
        before = [c for c in calendar if c < d - dt.timedelta(5)]
        at = [i for i in range(n) if days[i] == d]
        if not dt.date(2020, 2, 1) <= d <= dt.date(2020, 2, 20):
            assert all(got[i] is None for i in at)
            continue
        train = np.array([v < before[-1] for v in days])
        xm, ym = x[train].mean(axis=0), y[train].mean()
        b = np.linalg.solve((x[train] - xm).T @ (x[train] - xm) + np.eye(k), (x[train] - xm).T @ (y[train] - ym))
        assert [got[i] for i in at] == pytest.approx(list(ym + (x[at] - xm) @ b), rel=1e-8)


def test_empty_tables(spark):
    df = spark.createDataFrame([], "symbol string, dt date, y double, x double")
    assert S.corr_matrix(df, ["x", "y"], "symbol").count() == 0
    assert M.ridge_fit(df, ["x"], "y", key="symbol").count() == 0
    assert M.ridge_fit(df, ["x"], "y").count() == 0
    assert M.ablation(df, ["x"], "y", {"all": ["x"], "none": []}).count() == 0
    assert M.walk_forward_ridge(df, ["x"], "y", "2020-01-01", "2020-02-01").count() == 0
