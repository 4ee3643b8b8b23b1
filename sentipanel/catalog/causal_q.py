"""Causal operators, rows-only checks (p-values, forests, random draws)."""

from __future__ import annotations

from ..operators import causal as CA
from . import common as C
from . import register

VARS = ["tgt_forward_returns_10", "ft_news_10", "ft_comments_10", "ft_submissions_10", "vol_ft_news_10"]


def _frame(fx):
    return C.dataset_cols(fx, *VARS)


@register("ci_test_table", None, note="Fisher-z tests on one moments pass; unit-tested vs numpy")
def q_ci(fx):
    return CA.ci_test_table(_frame(fx), VARS, 0.05)


@register("backdoor_effect", None, note="regression adjustment; unit-tested vs numpy lstsq")
def q_backdoor(fx):
    return CA.backdoor_effect(_frame(fx), "ft_news_10", "tgt_forward_returns_10", ["ft_comments_10", "vol_ft_news_10"])


@register("refute_random_cause", None, note="hash-seeded replicates")
def q_refute_random(fx):
    return CA.refute_random_cause(_frame(fx), "ft_news_10", "tgt_forward_returns_10", ["ft_comments_10", "vol_ft_news_10"],
                                  ["symbol", "dt"], replicates=100, seed=7)


@register("refute_subset", None, note="hash-seeded replicates")
def q_refute_subset(fx):
    return CA.refute_subset(_frame(fx), "ft_news_10", "tgt_forward_returns_10", ["ft_comments_10", "vol_ft_news_10"],
                            ["symbol", "dt"], 0.8, replicates=100, seed=7)


@register("double_ml", None, note="cross-fitted forests (Spark ML)")
def q_dml(fx):
    return CA.double_ml(_frame(fx), "ft_news_10", "tgt_forward_returns_10", ["ft_comments_10", "vol_ft_news_10"],
                        ["symbol", "dt"], cv=3, n_trees=100, depth=5)
