"""Hard negatives against brute force over all rows."""

import math
import random

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from sentipanel.llm import hard_negatives, registry

VECS = "vec_id long, embedding array<double>, label int"
COLS = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def model(rows, anchor=lambda i: i is not None and i % 100 == 0, scale=256):
    good = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            good.append((i, [math.floor(x * scale) for x in v], label))
    order = lambda j: (good[j][0] is None, good[j][0] or 0)
    out = []
    for a, (i, v, label) in enumerate(good):
        if not anchor(i):
            continue
        score = [sum(x * y for x, y in zip(v, w)) for _, w, _ in good]
        ranked = sorted(range(len(good)), key=lambda j: (-score[j], order(j)))
        for p in [j for j in ranked if j != a and good[j][2] == label][:5]:
            negs = [j for j in ranked if good[j][2] != label and 80 * score[p] <= 100 * score[j] <= 100 * score[p]][:5]
            out += [(i, good[p][0], r + 1, good[j][0], score[p], score[j]) for r, j in enumerate(negs)]
    return sorted(out, key=str)


def got(df):
    return sorted((tuple(r) for r in df.select(*COLS).collect()), key=str)


def clustered(rng, n, dims, spread):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(6)]
    return [(k, [rng.choice([1.0, 0.5, 2.0]) * x + rng.gauss(0, spread) for x in rng.choice(centres)], rng.randrange(3)) for k in range(n)]


@pytest.mark.parametrize("spread,index", [(0.05, {}), (0.5, {"shard_rows": 40, "leaf_rows": 4, "fan": 3}), (3.0, {"shard_rows": 64, "leaf_rows": 8, "max_cells": 3})])
def test_equals_brute_force(spark, spread, index):
    rng = random.Random(int(spread * 100))
    rows = clustered(rng, 1200, 6, spread)
    rows += [(2000 + k, rows[5][1], k % 3) for k in range(150)]  # a vector that many rows have
    df = spark.createDataFrame(rows, VECS)
    assert got(hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, **index)) == model(rows)


def test_nulls_repeats_and_odd_vectors(spark):
    rng = random.Random(7)
    rows = clustered(rng, 150, 3, 0.2)
    nan, inf = float("nan"), float("inf")
    rows += [(300, None, 1), (301, [1.0, None, 2.0], 1), (302, [nan, 1.0, 1.0], 1), (303, [inf, 0.0, 0.0], 1), (304, [1.0, 1.0, 1.0], None),
             (None, rows[3][1], 2), (None, rows[4][1], 1), (400, [], 1), (500, [1.0], 0), (501, [1.0, 1.0, 1.0, 1.0], 0), (502, [0.0, 0.0, 0.0], 2), rows[0], rows[0], rows[1]]
    rows += [(600, [4e6, -3e6, 5e6], 0), (601, [4e6, -3e6, 5e6 + 1 / 256], 0), (602, [4e6, -3e6, 5e6 - 1 / 256], 1)]  # beyond exact doubles
    assert got(hard_negatives.hard_negatives(spark.createDataFrame(rows, VECS), F.col("vec_id") % 100 == 0)) == model(rows)


def test_empty_table_and_clashing_columns(spark):
    assert got(hard_negatives.hard_negatives(spark.createDataFrame([], VECS), F.col("vec_id") % 100 == 0)) == []
    rows = clustered(random.Random(8), 130, 4, 0.3)
    df = spark.createDataFrame(rows, VECS).withColumns({c: F.lit("x") for c in ("id", "vec", "uid", "copies", "anchor", "rank", "q", "top", "cell")})
    assert got(hard_negatives.hard_negatives(df, F.col("vec_id") % 100 == 0)) == model(rows)


def test_covering_radii_and_bounds_hold():
    rng = np.random.default_rng(5)
    x = np.floor(rng.normal(size=(700, 5)) * 40)
    x[100:300] = x[7]
    m2 = (x * x).sum(axis=1).max()
    a = hard_negatives.augmented(x, m2)
    tree = hard_negatives.cover_tree(a, 16, 5)
    assert sorted(np.concatenate(tree["leaves"]).tolist()) == list(range(700))
    q = np.floor(rng.normal(size=(9, 5)) * 30)
    s = q @ x.T
    below = {}
    for level in range(len(tree["levels"]) - 1, -1, -1):
        centres, radii, parents, numbers = tree["levels"][level]
        own = {k: tree["leaves"][n] if n >= 0 else np.concatenate(below[k]) for k, n in enumerate(numbers)}
        least, most = hard_negatives.bounds(q, x[centres], radii, m2)
        for k, rows in own.items():
            assert hard_negatives._distance(a[rows], a[centres[k]]).max() <= radii[k] + 1e-9
            assert (s[:, rows] <= most[:, [k]]).all() and (s[:, rows] >= least[:, [k]]).all()
        below = {}
        for k, p in enumerate(parents):
            below.setdefault(p, []).append(own[k])


def test_query_equals_its_sql(spark):
    folder = "/root/testdata/sf0.01"
    db = duckdb.connect()
    db.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet'")
    want = sorted(db.execute(f"select {', '.join(COLS)} from ({registry.OP11_SQL})").fetchall(), key=str)
    assert want and got(registry.queries()["op11_hard_negatives"](spark, folder)) == want
