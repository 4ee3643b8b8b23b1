"""Ridge / walk-forward ridge / ablation / boosted trees.

Ridge is solved exactly from block Grams (intercept unpenalised, as a centred ridge): Spark folds the rows of each
group into one state whose size depends on the number of columns, and a (p x p) system is solved per state.
"""

from __future__ import annotations

import bisect
import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from . import gram as G


def _keys(key):
    return [] if key is None else ([key] if isinstance(key, str) else list(key))


def ridge_fit(df: DataFrame, features: list[str], target: str, alpha: float = 1.0, key=None) -> DataFrame:
    """Coefficients (keys, term, coef); term 'intercept' + one per feature.  Groups without a complete row have none."""
    keys = _keys(key)
    fits = G.solved(G.gram(df, [target, *features], keys), keys, len(features) + 1, alpha)
    terms = F.array(*[F.lit(t) for t in ["intercept", *features]])
    pairs = F.explode(F.arrays_zip(terms.alias("term"), F.col("b").alias("coef"))).alias("x")
    return fits.select(*keys, pairs).select(*keys, F.col("x.term").alias("term"), F.col("x.coef").alias("coef"))


def _linear(b: Column, features: list[str]) -> Column:
    pred = b[0]
    for i, f in enumerate(features, start=1):
        pred = pred + b[i] * F.col(f)
    return pred


def ridge_predict(df: DataFrame, coefs: DataFrame, features: list[str], key=None, out: str = "prediction") -> DataFrame:
    """prediction = intercept + sum(coef * feature).  The coefficients of a key become one array, joined; without a key it is
    one scalar subquery."""
    keys = _keys(key)
    wide = coefs.groupBy(*keys).agg(F.array(*[F.max(F.when(F.col("term") == t, F.col("coef"))) for t in ["intercept", *features]]).alias("__b"))
    j = df.join(wide, keys, "left") if keys else df.withColumn("__b", wide.scalar())
    return j.withColumn(out, _linear(F.col("__b"), features)).drop("__b")


def walk_forward_ridge(df: DataFrame, features: list[str], target: str, start, end, offset: int = 10,
                       alpha: float = 1.0, day: str = "dt", out: str = "prediction") -> DataFrame:
    """Expanding-window ridge refit for every prediction day.

    For a prediction day d in [start, end] (a date present in the data) the
    cutoff is d - (offset + 1) days; t_d = last data date strictly before the
    cutoff; training rows are those with dt < t_d.  Days without training rows
    keep NULL.

    Plan: the panel is checkpointed once; the prefix Grams before the t_d come from one pass
    over the rows in day order (:func:`gram.prefix_grams`); each is solved in its own row, and predictions are a join
    of per-day coefficient arrays.  Only the calendar of distinct days visits the driver.
    """
    cols = [target, *features]
    df = cut_lineage(df)
    dates = sorted(r[0] for r in df.dropna(subset=cols).select(F.col(day).cast("date").alias("d")).distinct().collect() if r[0] is not None)
    lo, hi = (datetime.date.fromisoformat(str(x)[:10]) for x in (start, end))
    last = {}
    for d in dates:
        at = bisect.bisect_left(dates, d - datetime.timedelta(days=offset + 1))
        if lo <= d <= hi and at > 0:
            last[d] = dates[at - 1]
    if not last:
        return df.withColumn(out, F.lit(None).cast("double"))
    fits = G.solved(G.prefix_grams(df, cols, day, sorted(set(last.values()))), [day], len(cols), alpha).withColumnRenamed(day, "__td")
    when = df.sparkSession.createDataFrame(sorted(last.items()), "__d date, __td date")
    fits = when.join(fits, "__td").select("__d", F.col("b").alias("__b"))
    return df.join(fits, F.col(day).cast("date") == F.col("__d"), "left").withColumn(out, _linear(F.col("__b"), features)).drop("__b", "__d")


def ablation_sets(features: list[str], kinds=("news", "submissions", "comments"), prefix: str = "ft_") -> dict[str, list[str]]:
    """The feature sets of the ablation study: whole kinds left out, every single feature left out, and every
    submissions feature left out with its comments twin."""
    of = {k: [f for f in features if f.startswith(prefix + k)] for k in kinds}
    news, subs, comm = (of[k] for k in kinds)
    sets = {"without-reddit": news, "without-reddit-submissions": comm + news, "without-reddit-comments": subs + news,
            "without-news": subs + comm, "all": news + subs + comm}
    sets |= {f"without:{f}": [x for x in features if x != f] for f in features}
    twin = lambda f: f.replace(kinds[1], kinds[2], 1)
    return sets | {f"without-both:{f}": [x for x in features if x not in (f, twin(f))] for f in subs}


def ablation(df: DataFrame, features: list[str], target: str, sets: dict[str, list[str]] | None = None, alpha: float = 1.0) -> DataFrame:
    """(feature_set, mse, contribution): contribution is (mse_reduced - mse_full) / (mse_mean - mse_full) per named feature set,
    in-sample ridge fits.  ONE Gram pass; every set is a row that solves its own part of it.  An empty set predicts the mean."""
    sets = ablation_sets(features) if sets is None else sets
    g = G.collect_gram(df, [target, *features])
    at = {f: i + 1 for i, f in enumerate(features)}
    if not g.n:
        return df.sparkSession.createDataFrame([], "feature_set string, mse double, contribution double")
    best, worst = g.ridge(0, list(at.values()), alpha)[1] / g.n, float(g.cross[0, 0]) / g.n
    errors = G.subset_errors(g, [(name, [at[f] for f in fs]) for name, fs in sets.items()], df.sparkSession, alpha)
    return errors.withColumn("contribution", F.try_divide(F.col("mse") - F.lit(best), F.lit(worst - best)))


def gbt_fit(train: DataFrame, features: list[str], target: str, max_iter: int = 300, step: float = 0.1,
            depth: int = 3, seed: int = 42, out: str = "prediction"):
    """Boosted-tree regressor (Spark ML: distributed histogram trees)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    va = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="skip")
    return GBTRegressor(featuresCol="__features", labelCol=target, maxIter=max_iter, stepSize=step, maxDepth=depth,
                        seed=seed, predictionCol=out).fit(va.transform(train.dropna(subset=[target, *features])))


def gbt_predict(model, df: DataFrame, features: list[str]) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler
    va = VectorAssembler(inputCols=features, outputCol="__features", handleInvalid="keep")
    return model.transform(va.transform(df)).drop("__features")


def gbt_fit_predict(train: DataFrame, test: DataFrame, features: list[str], target: str, max_iter: int = 300,
                    step: float = 0.1, depth: int = 3, seed: int = 42, out: str = "prediction") -> DataFrame:
    return gbt_predict(gbt_fit(train, features, target, max_iter, step, depth, seed, out), test, features)
