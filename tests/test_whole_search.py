"""Registered causal and model queries run the whole job: every test level, replicate, tree and round."""

import random

from sentipanel.catalog import causal_q, io_q, model_q
from sentipanel.operators import causal as CA


def test_ci_levels_go_on_while_neighbourhoods_are_large_enough(spark):
    rng = random.Random(9)
    rows = []
    for _ in range(4000):
        m = [rng.gauss(0, 1) for _ in range(3)]
        rows.append((*m, sum(m) + rng.gauss(0, 0.5), sum(m) + rng.gauss(0, 0.5)))
    cols = ["m1", "m2", "m3", "x", "y"]
    tests = CA.ci_test_table(spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)), cols, 0.001).collect()
    assert max(t.level for t in tests) == 3
    assert {t.edge_kept for t in tests if (t.x, t.y) == ("x", "y")} == {False}  # only all three of m part x and y


def test_registered_queries_run_the_whole_job(monkeypatch):
    seen = {}
    for module, name in ((CA, "refute_random_cause"), (CA, "refute_subset"), (CA, "double_ml"), (CA, "ci_test_table")):
        monkeypatch.setattr(module, name, lambda *a, n=name, **k: seen.update({n: (a, k)}))
    monkeypatch.setattr(causal_q, "_frame", lambda fx: None)
    for q in (causal_q.q_refute_random, causal_q.q_refute_subset, causal_q.q_dml, causal_q.q_ci):
        q(None)
    assert seen["refute_random_cause"][1]["replicates"] == seen["refute_subset"][1]["replicates"] == 100
    assert seen["double_ml"][1]["n_trees"] == 100 and len(seen["ci_test_table"][0]) == 3 and "max_level" not in seen["ci_test_table"][1]
    import inspect
    assert "max_iter=300" in inspect.getsource(io_q.q_gbt_fit) and "max_iter=300" in inspect.getsource(model_q.q_gbt)
