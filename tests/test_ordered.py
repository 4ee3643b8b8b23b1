"""Carries, as-of joins, arg-max aggregations and exact quantiles against plain models."""

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentipanel.operators import aggs as A
from sentipanel.operators import ordered as O
from sentipanel.operators import panel as P


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("partitions", [1, 4, 30])
def test_forward_fill_of_every_column(spark, partitions):
    rng = random.Random(partitions)
    rows = [(i // 3, f"s{i % 3}", rng.choice([None, i * 1.0]), rng.choice([None, None, f"t{i}"])) for i in range(200)]
    rows[0] = (0, "s0", None, None)
    df = spark.createDataFrame(rng.sample(rows, len(rows)), "t int, s string, x double, y string").repartition(5)
    out = O.carry(df, ["t", "s"], ["x", "y"], partitions=partitions)
    assert out.columns == df.columns
    got = sorted(map(tuple, out.collect()))
    want, last = [], [None, None]
    for t, s, *v in sorted(rows, key=lambda r: r[:2]):
        last = [b if b is not None else a for a, b in zip(last, v)]
        want.append((t, s, *last))
    assert got == want


def _asof(left, right, keyed):
    out = []
    for k, t, v in left:
        best = [r for r in right if r[1] is not None and t is not None and r[1] <= t and (not keyed or (k is not None and r[0] == k))]
        top = max(best, key=lambda r: (r[1], r[2] is not None, r[2] or 0, r[3] is not None, r[3] or ""), default=None)
        out.append((k, t, v, *(top[2:] if top else (None, None))))
    return sorted(out, key=str)


@pytest.mark.parametrize("keyed", [False, True])
@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_asof_backward(spark, keyed, partitions):
    rng = random.Random(3)
    key = lambda: rng.choice(["hot"] * 8 + ["b", "c", None])
    left = [(key(), rng.choice([None, *range(60)]), i) for i in range(150)]
    right = [(key(), rng.choice([None, *range(5, 60)]), rng.choice([None, 1, 2]), rng.choice([None, "u", "v"])) for _ in range(40)]
    a = spark.createDataFrame(left, "k string, t int, v int")
    b = spark.createDataFrame(right, "k string, at int, x int, y string")
    out = P.asof_backward(a, b, "t", "at", ["x", "y"], "k" if keyed else None, partitions)
    assert sorted(map(tuple, out.collect()), key=str) == _asof(left, right, keyed)
    assert P.asof_backward(a, b.limit(0), "t", "at", ["x", "y"], "k" if keyed else None).where("x is not null").count() == 0
    assert P.asof_backward(a.limit(0), b, "t", "at", ["x", "y"]).count() == 0


def test_asof_dimension_keeps_every_left_row_once(spark):
    left = spark.createDataFrame([(i, dt.date(2020, 1, 1) + dt.timedelta(days=i * 9)) for i in range(40)] + [(99, None)], "i int, d date")
    dim = spark.createDataFrame([(dt.date(2020, 3, 1), 1.0), (dt.date(2020, 4, 1), None), (dt.date(2020, 6, 15), 3.0)], "m date, r double")
    got = {r["i"]: r["r"] for r in P.asof_dimension(left, dim, "d", "m", ["r"]).collect()}
    d = lambda i: dt.date(2020, 1, 1) + dt.timedelta(days=i * 9)
    assert got == {**{i: None if d(i) < dt.date(2020, 3, 1) else 1.0 if d(i) < dt.date(2020, 6, 15) else 3.0 for i in range(40)}, 99: None}


def _key(v):
    return (v is not None, v if v is not None else 0)


@pytest.mark.parametrize("first", ["n", "s", "d"])
def test_last_rows_and_values(spark, first):
    rng = random.Random(4)
    def row():
        return (rng.choice(["hot"] * 6 + ["a", "b", None]), rng.choice([None, *range(4)]), rng.choice([None, "", "é", "same prefix 1", "same prefix 2"]),
                rng.choice([None, dt.date(2020, 1, 1), dt.date(1960, 1, 1)]), rng.choice([None, 1.5, 2.5]))
    rows = [row() for _ in range(300)]
    rows += rows[:5]
    df = spark.createDataFrame(rows, "k string, n int, s string, d date, x double").repartition(6)
    names = df.columns
    order = [first, *[c for c in ("n", "s", "d", "x") if c != first]]
    rank = lambda r: tuple(_key(r[names.index(c)].encode() if isinstance(r[names.index(c)], str) else r[names.index(c)]) for c in order)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = P.dedup_keep_last(df, ["k"], [first])
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(str(max(g, key=rank)) for g in by.values())
    assert "SortAggregate" not in _plan(out) and "ObjectHashAggregate" not in _plan(out)

    got = A.last_non_null_per_key(df, "k", ["x", "s"], order)
    want = []
    for k, g in by.items():
        if k is not None:
            g = sorted(g, key=rank)
            want.append((k, *[next((r[names.index(c)] for r in reversed(g) if r[names.index(c)] is not None), None) for c in ("x", "s")]))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert "SortAggregate" not in _plan(got)
    assert P.dedup_keep_last(df.limit(0), ["k"], [first]).count() == 0


def test_exact_quantiles(spark):
    rng = np.random.default_rng(5)
    data = {"normal": rng.normal(size=2000), "ties": rng.integers(0, 4, 500).astype(float), "far": np.concatenate([rng.normal(size=300), [1e300, -1e300, 5e-324]]),
            "one": np.array([7.0]), "two": np.array([1.0, 2.0]), "wide": np.array([-1.7e308, 0.0, 1.7e308]), "lognormal": np.exp(rng.normal(size=800) * 20)}
    rows = [(k, float(x)) for k, v in data.items() for x in v] + [("normal", None), ("none", None), (None, 3.0)]
    df = spark.createDataFrame(rows, "symbol string, x double").repartition(4)
    got = {r["symbol"]: r for r in A.describe_by_symbol(df, "x").collect()}
    for k, v in data.items():
        for c, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)):
            assert got[k][c] == pytest.approx(float(np.quantile(v, q)), rel=1e-9, abs=1e-300), (k, c)
    assert got["none"]["p50"] is None and got["none"]["count"] == 0 and got[None]["p50"] == 3.0
    assert A.describe_by_symbol(df.limit(0), "x").count() == 0


def test_total_loss_leaves_nothing(spark):
    from sentipanel.operators import strategy as ST
    from sentipanel.operators import windows as W
    df = spark.createDataFrame([("s", "A", i, p, 1.0) for i, p in enumerate([10.0, 5.0, 0.0, 4.0, 8.0])], "strategy string, symbol string, dt int, close double, signal double")
    nav = [r["nav"] for r in W.nav_curve(df, "close", "signal").orderBy("dt").collect()]
    assert nav == [pytest.approx(5000), 0, 0, 0, 0]
    nav = [r["nav"] for r in ST.signal_weighted_nav(df, cost_rate=0.0).orderBy("dt").collect()]
    assert nav == [pytest.approx(10000), pytest.approx(5000), 0, 0, 0]
    days = df.withColumn("dt", F.date_add(F.lit("2020-01-01").cast("date"), F.col("dt")))
    assert ST.strategy_metrics(ST.signal_weighted_nav(days, cost_rate=0.0)).first()["total_return"] == 0
