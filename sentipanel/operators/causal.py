"""Causal estimates on the panel.

* ``ci_test_table``: constraint-based skeleton search, level by level and
  independent of column order: ONE block Gram gives the correlation matrix; the
  (pair, conditioning set) tests of a level are made and run in tasks.
* ``backdoor_effect``: linear-regression adjustment (moments + solve).
* refuters: replicate r of each row is generated by exploding a bounded
  sequence; random confounders / subsets come from a hash of (row key, r,
  seed), so reruns after executor loss give identical draws; estimates are
  grouped moments per replicate.
* ``double_ml``: cross-fitted forests (Spark ML) on hash folds, final
  L1-penalised residual-on-residual slope from sums.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage
from . import gram as G
from . import linalg as LA


CI_TESTS = "x string, y string, level int, cond string, partial_r double, z double, p_value double, independent boolean"


def _ci_tests(spark, corr: np.ndarray, n: float, names: list[str], sides: list[tuple[int, int, list[int]]], level: int, alpha: float) -> DataFrame:
    """The level's tests: a row per (pair, conditioning set), the sets of a pair made and tested in tasks.

    A pair's sets are split by their first member, so no task holds all sets of a pair.
    """
    parts = [(i, j, at, side) for i, j, side in sides for at in range(max(1, len(side) - level + 1))] if level else [(i, j, 0, []) for i, j, _ in sides]
    rows = spark.createDataFrame(parts, "i int, j int, at int, side array<int>")

    def run(it):
        for b in it:
            out = []
            for i, j, at, side in zip(*(b.column(c).to_pylist() for c in ("i", "j", "at", "side"))):
                rest = itertools.combinations(side[at + 1:], level - 1) if level else [()]
                for tail in rest:
                    cond = ((side[at],) if level else ()) + tail
                    idx = [i, j, *cond]
                    p = np.linalg.pinv(corr[np.ix_(idx, idx)], hermitian=True)
                    r = -p[0, 1] / math.sqrt(p[0, 0] * p[1, 1]) if p[0, 0] > 0 and p[1, 1] > 0 else 0.0
                    r = max(min(r, 1 - 1e-15), -1 + 1e-15)
                    z = math.atanh(r) * math.sqrt(max(n - level - 3, 0))
                    q = LA.normal_two_sided_p(z)
                    out.append((names[i], names[j], level, ",".join(names[c] for c in cond), r, z, q, q > alpha))
            cols = list(zip(*out)) or [[] for _ in range(8)]
            kinds = [pa.string(), pa.string(), pa.int32(), pa.string(), pa.float64(), pa.float64(), pa.float64(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["x", "y", "level", "cond", "partial_r", "z", "p_value", "independent"])
    return rows.repartition(max(1, min(len(parts), 64)), "i", "j", "at").mapInArrow(run, CI_TESTS)


def ci_test_table(df: DataFrame, cols: list[str], alpha: float = 0.05, max_level: int | None = None) -> DataFrame:
    """Rows (x, y, level, cond, partial_r, z, p_value, independent) for every
    test of a level-wise skeleton search, plus the final flag ``edge_kept`` per pair.

    The search does not depend on the order of the columns: a level tests every pair that is still adjacent against all sets of
    that size out of either side's own neighbours, as they were when the level began, and edges go between levels.  Levels rise
    until no pair has a neighbourhood that large (or to ``max_level``).  x and y, and the members of ``cond``, are in
    name order.  Only complete rows count; a column that does not vary correlates with nothing.
    """
    names = sorted(cols)
    k, spark = len(names), df.sparkSession
    g = G.collect_gram(df, names)  # k x k, whatever the number of rows
    sd = np.sqrt(np.diag(g.cross))
    both = np.outer(sd, sd)
    corr = np.where(both > 0, g.cross / np.where(both > 0, both, 1), 0.0)
    np.fill_diagonal(corr, 1.0)
    adjacent = {i: set(range(k)) - {i} for i in range(k)}
    found, level = [], 0
    while max_level is None or level <= max_level:
        sides = set()
        for i, j in itertools.combinations(range(k), 2):
            if j in adjacent[i]:
                own = [tuple(sorted(adjacent[a] - {i, j})) for a in (i, j)]
                sides |= {(i, j, s if level else ()) for s in own if len(s) >= level}
        if not sides:
            break
        tests = _ci_tests(spark, corr, g.n, names, [(i, j, list(s)) for i, j, s in sorted(sides)], level, alpha)
        tests = cut_lineage(tests.distinct())  # a set that both sides have is tested once
        found.append(tests)
        for r in tests.where("independent").select("x", "y").distinct().collect():  # pairs of columns
            i, j = names.index(r["x"]), names.index(r["y"])
            adjacent[i].discard(j)
            adjacent[j].discard(i)
        level += 1
    if not found:
        return spark.createDataFrame([], f"{CI_TESTS}, edge_kept boolean")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    kept = [f"{names[i]}\n{names[j]}" for i, j in itertools.combinations(range(k), 2) if j in adjacent[i]]
    return out.withColumn("edge_kept", F.concat_ws("\n", "x", "y").isin(kept))


def _effect_rows(mom: DataFrame, keys: list[str], k: int, treat_idx: int = 1, conf_level: float = 0.95) -> DataFrame:
    key_fields = [f for f in mom.schema.fields if f.name in keys]
    schema = T.StructType(key_fields + [T.StructField(n, T.DoubleType()) for n in
                                        ("estimate", "std_err", "ci_low", "ci_high", "p_value", "n")])

    def run(batches):
        for pdf in batches:
            out = []
            for _, row in pdf.iterrows():
                n, mean, C = LA.unpack(row, k)
                res = LA.ols_from_moments(n, mean, C, 0, list(range(1, k)))
                if res is None or res["se"] is None:
                    continue
                b, se = float(res["coef"][treat_idx]), float(res["se"][treat_idx])
                tq = LA.t_ppf(0.5 + conf_level / 2, res["df_resid"])
                p = LA.t_two_sided_p(b / se, res["df_resid"]) if se > 0 else float("nan")
                out.append({**{kk: row[kk] for kk in keys}, "estimate": b, "std_err": se, "ci_low": b - tq * se,
                            "ci_high": b + tq * se, "p_value": p, "n": float(n)})
            yield pd.DataFrame(out, columns=schema.fieldNames())

    return mom.mapInPandas(run, schema)


def backdoor_effect(df: DataFrame, treatment: str, outcome: str, confounders: list[str]) -> DataFrame:
    """Effect of treatment on outcome adjusted for confounders (linear regression):
    estimate, std error, 95% CI (t quantile), p-value, n."""
    cols = [outcome, treatment, *confounders]
    data = df.dropna(subset=cols)
    return _effect_rows(LA.moments(data, [], cols), [], len(cols))


def _u01(*cols) -> F.Column:
    """Deterministic uniform in (0, 1) from a hash of the given columns."""
    h = F.xxhash64(*cols)
    return (F.pmod(h, F.lit(2 ** 52)).cast("double") + 0.5) / float(2 ** 52)


def refute_random_cause(df: DataFrame, treatment: str, outcome: str, confounders: list[str], row_key: list[str],
                        replicates: int = 100, seed: int = 0) -> DataFrame:
    """Re-estimate with an extra independent N(0,1) confounder; one row per replicate."""
    cols = [outcome, treatment, *confounders]
    data = df.dropna(subset=cols).select(*row_key, *cols)
    rep = data.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    u1 = _u01(*[F.col(c) for c in row_key], F.col("replicate"), F.lit(seed), F.lit(1))
    u2 = _u01(*[F.col(c) for c in row_key], F.col("replicate"), F.lit(seed), F.lit(2))
    rep = rep.withColumn("__w", F.sqrt(-2 * F.log(u1)) * F.cos(2 * math.pi * u2))
    allc = [*cols, "__w"]
    return _effect_rows(LA.moments(rep, ["replicate"], allc), ["replicate"], len(allc))


def refute_subset(df: DataFrame, treatment: str, outcome: str, confounders: list[str], row_key: list[str],
                  fraction: float = 0.8, replicates: int = 100, seed: int = 0) -> DataFrame:
    """Re-estimate on random subsets (each row kept with probability ``fraction``)."""
    cols = [outcome, treatment, *confounders]
    data = df.dropna(subset=cols).select(*row_key, *cols)
    rep = data.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates))))
    rep = rep.filter(_u01(*[F.col(c) for c in row_key], F.col("replicate"), F.lit(seed), F.lit(3)) < fraction)
    return _effect_rows(LA.moments(rep, ["replicate"], cols), ["replicate"], len(cols))


def refutation_summary(original: DataFrame, replicas: DataFrame) -> DataFrame:
    """Original estimate vs the mean / std of the re-estimates."""
    r = replicas.agg(F.avg("estimate").alias("new_effect"), F.stddev_samp("estimate").alias("new_effect_std"),
                     F.count(F.lit(1)).alias("replicates"))
    return r.withColumn("estimated_effect", original.select("estimate").scalar())


def double_ml(df: DataFrame, treatment: str, outcome: str, covariates: list[str], row_key: list[str], cv: int = 3,
              n_trees: int = 100, depth: int = 5, lasso_alpha: float = 0.1, seed: int = 0) -> DataFrame:
    """Cross-fitted double ML: forests for E[y|X] and E[t|X] trained on the other
    folds, residuals on the held-out fold, final slope of y-residual on
    t-residual with an L1 penalty and no intercept:
    theta = soft(sum(rt*ry)/n, alpha) / (sum(rt^2)/n)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import RandomForestRegressor

    cols = [outcome, treatment, *covariates]
    data = df.dropna(subset=cols).select(*row_key, *cols)
    data = data.withColumn("__fold", F.pmod(F.xxhash64(*[F.col(c) for c in row_key], F.lit(seed)), F.lit(cv)))
    va = VectorAssembler(inputCols=covariates, outputCol="__x")
    data = va.transform(data)
    parts = []
    for k in range(cv):
        train, held = data.filter(F.col("__fold") != k), data.filter(F.col("__fold") == k)
        my = RandomForestRegressor(featuresCol="__x", labelCol=outcome, predictionCol="__py", numTrees=n_trees,
                                   maxDepth=depth, seed=seed).fit(train)
        mt = RandomForestRegressor(featuresCol="__x", labelCol=treatment, predictionCol="__pt", numTrees=n_trees,
                                   maxDepth=depth, seed=seed).fit(train)
        parts.append(mt.transform(my.transform(held)).select((F.col(outcome) - F.col("__py")).alias("ry"),
                                                             (F.col(treatment) - F.col("__pt")).alias("rt")))
    res = parts[0]
    for p in parts[1:]:
        res = res.unionByName(p)
    agg = res.agg((F.sum(F.col("rt") * F.col("ry")) / F.count(F.lit(1))).alias("xy"),
                  (F.sum(F.col("rt") * F.col("rt")) / F.count(F.lit(1))).alias("xx"), F.count(F.lit(1)).alias("n"))
    soft = F.signum("xy") * F.greatest(F.abs("xy") - F.lit(lasso_alpha), F.lit(0.0))
    return agg.select(F.try_divide(soft, F.col("xx")).alias("effect"), F.try_divide(F.col("xy"), F.col("xx")).alias("effect_ols"), "n")
