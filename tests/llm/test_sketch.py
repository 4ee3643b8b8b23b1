"""The n-gram join's index pairs only members whose sketches allow a link, and small tables take one slice."""

import random

import numpy as np
from pyspark.sql import functions as F

from sentipanel.llm import ngram_join

from test_passes import jaccard_labels


def test_sketches_differ_in_no_more_bits_than_their_sets_in_shingles(spark):
    rng = np.random.default_rng(4)
    rows, apart = [], []
    for k in range(60):
        a = rng.integers(0, 1 << 63, int(rng.integers(1, 3000)), dtype=np.uint64)
        b = np.concatenate([a[int(rng.integers(0, len(a))) // (k % 2 * 99 + 1):], rng.integers(0, 1 << 63, int(rng.integers(0, 20)), dtype=np.uint64)])
        rows.append((k, *[ngram_join.sketch(np.unique(s)).view(np.int64).tolist() for s in (a, b)]))
        apart.append(len(np.setxor1d(a, b)))
    df = spark.createDataFrame(rows, "k long, a array<long>, b array<long>")
    for width in (1, 2, 4, 8, 16):
        fold = lambda c: ngram_join._folded(F.col(c), F.lit(width)).alias(c)  # noqa: B023, E731
        got = df.select("k", fold("a"), fold("b")).select("k", F.size("a").alias("w"), ngram_join._apart("a", "b").alias("bits")).collect()
        assert all(r.w == width and r.bits <= apart[r.k] and (r.bits - apart[r.k]) % 2 == 0 for r in got)
        assert width < 16 or any(r.bits == apart[r.k] > 0 for r in got)


def test_members_that_drifted_apart_are_not_paired(spark, monkeypatch):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    sets = {i: set(base) - set(rng.sample(base, 40)) | {f"x{k}" for k in rng.sample(range(200), 40)} for i in range(150)}
    sets |= {i: set(base) - set(rng.sample(base, 3)) | {f"x{k}" for k in rng.sample(range(200), 3)} for i in range(150, 170)}
    for i in range(170, 190):  # linked with one of the first
        s = sorted(sets[i - 170])
        sets[i] = set(s) - set(rng.sample(s, 4)) | {f"x{k}" for k in rng.sample(range(200), 4)}
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in sets.items()], "doc_id long, text string")
    joined, slices = [], []
    kind = type(df)
    group, count = kind.groupBy, ngram_join._in_passes

    def watched(self, *cols):
        if "name_a" in [c for c in cols if isinstance(c, str)] and "hub" in self.columns and "token" in self.columns:  # what the index has joined
            joined.append(self.count())
        return group(self, *cols)
    monkeypatch.setattr(kind, "groupBy", watched)
    monkeypatch.setattr(ngram_join, "_in_passes", lambda step, key, n: slices.append(n) or count(step, key, n))
    got = {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, shingle_words=1, num=80, den=100).collect()}
    assert got == jaccard_labels(sets, 80, 100)
    assert joined and sum(joined) <= 1000
    assert set(slices) == {1}
