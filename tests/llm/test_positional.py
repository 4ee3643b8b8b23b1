"""Components stay exact where many members of a hub share a few differences."""

import random

from sentipanel.llm import ngram_join

from test_passes import jaccard_labels


def labels_of(spark, sets, **how):
    df = spark.createDataFrame([(i, " ".join(sorted(s))) for i, s in sets.items()], "doc_id long, text string")
    return {r.doc_id: r.component_id for r in ngram_join.jaccard_components(df, shingle_words=1, num=80, den=100, **how).collect()}


def test_members_that_share_a_few_differences_keep_exact_components(spark):
    rng = random.Random(3)
    base = [f"w{i}" for i in range(100)]
    sets = {}
    for i in range(150):  # far from the base and from each other, of words that all occur often
        s = set(base)
        s -= set(rng.sample(base, 40))
        sets[i] = s | {f"x{k}" for k in rng.sample(range(200), 40)}
    for i in range(150, 170):  # near the base
        sets[i] = set(base) - set(rng.sample(base, 3)) | {f"x{k}" for k in rng.sample(range(200), 3)}
    for i in range(170, 190):  # near one of the first
        s = sorted(sets[i - 170])
        sets[i] = set(s) - set(rng.sample(s, 4)) | {f"x{k}" for k in rng.sample(range(200), 4)}
    want = jaccard_labels(sets, 80, 100)
    assert len(set(want.values())) > 100
    assert labels_of(spark, sets) == want
