import math
from fractions import Fraction

import numpy as np
import pytest

from sentipanel.operators import moments as M
from sentipanel.operators import windows as W


def _series():
    rng = np.random.default_rng(5)
    return {
        "offset": 1e6 + rng.uniform(-0.01, 0.01, 400),
        "tail": np.concatenate([rng.normal(size=100), np.full(300, 123.45)]),
        "gaps": np.where(rng.random(400) < 0.3, np.nan, rng.normal(size=400)),
    }


@pytest.mark.parametrize("n", [15, 16, 180, 365])
def test_rolling_matches_each_frame(spark, n):
    data = _series()
    rows = [(k, i, None if np.isnan(x) else float(x)) for k, v in data.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "symbol string, dt int, x double")
    out = df.select("symbol", "dt", W.rolling_mean("x", n, 0).alias("m"), W.rolling_std("x", n, 0).alias("s")).collect()
    for r in out:
        frame = data[r["symbol"]][max(0, r["dt"] - n + 1):r["dt"] + 1]
        frame = frame[~np.isnan(frame)]
        if len(frame):
            assert r["m"] == pytest.approx(frame.mean(), rel=1e-9, abs=1e-12)
        if len(frame) > 1:
            if frame.min() == frame.max():
                assert r["s"] == 0
            else:
                mid = frame - frame[0]  # shifted: the large offset is gone before squaring
                assert r["s"] == pytest.approx(mid.std(ddof=1), rel=1e-7)


def test_constant_series_has_no_momentum(spark):
    df = spark.createDataFrame([("A", i, 123.45) for i in range(200)], "symbol string, dt int, x double")
    assert {r[0] for r in df.select(W.momentum_feature("x", 30)).collect()} == {0.0}


def _frame_model(x, n, kind, least):
    """Each frame on its own, in exact arithmetic."""
    out = []
    for i in range(len(x)):
        f = [Fraction(v) for v in x[max(0, i - n + 1):i + 1] if v is not None]
        if kind == "sum":
            out.append(float(sum(f)) if len(f) >= least else None)
        elif len(f) < max(least, 1 if kind == "mean" else 2):
            out.append(None)
        else:
            m = sum(f) / len(f)
            out.append(float(m) if kind == "mean" else math.sqrt(sum((v - m) ** 2 for v in f) / (len(f) - 1)))
    return out


@pytest.mark.parametrize("n", [1, 2, 7, 30, 64, 500])
def test_linear_frames_equal_each_frame(spark, n):
    rng = np.random.default_rng(n)
    data = {"offset": 1e9 + rng.uniform(-0.01, 0.01, 200), "constant": np.full(200, 123.45), "jump": np.concatenate([np.full(90, 1e9), rng.normal(size=110)]),
            "tail": np.concatenate([rng.normal(size=60), np.full(140, 0.1)]), "short": rng.normal(size=2)}
    rows = [(k, i, None if rng.random() < 0.25 and k != "constant" else float(x), int(rng.integers(0, 9))) for k, v in data.items() for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "symbol string, dt int, x double, k int").repartition(3)
    got = M.rolling(df, {"m": M.Frame("mean", "x", n, 0), "m3": M.Frame("mean", "x", n, 3), "s": M.Frame("std", "x", n, 0), "sum": M.Frame("sum", "x", n, 0),
                         "k3": M.Frame("sum", "k", n, 1), "mom": M.Frame("momentum", "x", n)})
    assert dict(got.dtypes)["k3"] == "bigint"
    got = {(r["symbol"], r["dt"]): r for r in got.collect()}
    for s in data:
        own = sorted(r for r in rows if r[0] == s)
        x, k = [r[2] for r in own], [r[3] for r in own]
        close = lambda v: None if v is None else pytest.approx(v, rel=1e-7, abs=1e-9)
        for name, kind, col, least in (("m", "mean", x, 0), ("m3", "mean", x, 3), ("s", "std", x, 0), ("sum", "sum", x, 0), ("k3", "sum", k, 1)):
            for i, want in enumerate(_frame_model(col, n, kind, least)):
                assert got[s, i][name] == close(want), (s, i, name)
                if name == "s" and want == 0:
                    assert got[s, i][name] == 0
        parts = [_frame_model(x, n, "mean", 0), _frame_model(x, 3 * n, "mean", 0), _frame_model(x, 6 * n, "std", 0)]
        for i, (a, b, c) in enumerate(zip(*parts)):
            want = (a - b) / c if a is not None and c else 0.0
            # a mean near 1e9 is itself only good to 1e-7, a thousandth of a percent of the spread there
            assert got[s, i]["mom"] == pytest.approx(want, rel=1e-5, abs=1e-4 if s in ("offset", "jump") else 1e-9)


def test_linear_frames_on_empty_nan_and_wide_tables(spark):
    assert M.rolling(spark.createDataFrame([], "symbol string, dt int, x double"), {"m": M.Frame("mean", "x", 3)}).count() == 0
    df = spark.createDataFrame([("a", i, float("nan") if i == 3 else 1.0) for i in range(12)], "symbol string, dt int, x double")
    got = [r["m"] for r in M.rolling(df, {"m": M.Frame("mean", "x", 4, 0)}).orderBy("dt").collect()]
    assert [math.isnan(v) for v in got] == [3 <= i <= 6 for i in range(12)]
    wide = spark.range(40).selectExpr("'a' AS symbol", "cast(id AS int) AS dt", *[f"cast(id * {k} AS double) AS c{k}" for k in range(229)])
    out = M.rolling(wide, {f"m{k}": M.Frame("momentum", f"c{k}", 5) for k in range(229)})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Window" not in plan
    assert out.count() == 40
