"""The n-gram join moves its tables a slice of the keys at a time."""

import random

import pytest

from sentipanel.llm import ngram_join


def jaccard_labels(sets, num, den):
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i
    for i in sets:
        for j in sets:
            both = len(sets[i] & sets[j])
            if i < j and both * den >= len(sets[i] | sets[j]) * num and sets[i]:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return {i: root(i) for i in sets}


@pytest.mark.parametrize("passes", [1, 3])
def test_passes_change_no_component(spark, passes):
    rng = random.Random(5)
    base = [[f"w{rng.randrange(400)}" for _ in range(60)] for _ in range(8)]
    rows = []
    for i in range(120):
        w = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(w)))
    rows += [(120, None), (121, "  "), (122, "one two")]
    df = spark.createDataFrame(rows + rows[:3], "doc_id long, text string")
    sets = {i: {tuple((t or "").split()[k:k + 5]) for k in range(len((t or "").split()) - 4)} or ({(t,)} if (t or "").split() else set()) for i, t in rows}
    want = jaccard_labels(sets, 80, 100)
    slices = []
    count = ngram_join._in_passes
    ngram_join._in_passes = lambda step, key, n: slices.append(n) or count(step, key, n)
    try:
        got = ngram_join.jaccard_components(df, shingle_words=5, num=80, den=100, broadcast_rows=20, passes=passes).collect()
    finally:
        ngram_join._in_passes = count
    assert len(got) == len(rows) + 3
    assert all(r.component_id == want[r.doc_id] and r.n_shingles == len(sets[r.doc_id]) for r in got)
    assert set(slices) == {passes} and len(slices) >= 4
