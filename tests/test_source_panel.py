"""The per-source panel takes its columns from the data."""

import datetime as dt

import pytest

from sentipanel.operators import scoring as SC
from sentipanel.plans import source_panel as SP

D = [dt.date(2020, 1, d) for d in range(1, 6)]


def _daily(spark, rows, source):
    return spark.createDataFrame(rows, f"symbol string, date date, {source} string, avg_sentiment double")


def test_three_kinds_and_top_sources(spark):
    subs = _daily(spark, [("A", D[0], "x", 1.0), ("B", D[4], "y.z", None)], "subreddit")
    comm = _daily(spark, [("A", D[1], "x", 2.0), ("A", D[1], "x", 5.0), ("A", D[1], None, 9.0)], "subreddit")
    news = _daily(spark, [("A", D[k], s, float(k)) for s, n in (("often", 3), ("seldom", 1), ("also", 3), ("never", 0)) for k in range(n)], "domain")
    out = SP.build_source_panel({"submissions": (subs, "subreddit"), "comments": (comm, "subreddit"), "news": (news, "domain")}, {"news": 2})
    assert out.columns == ["symbol", "dt", "ft_submissions_x", "ft_submissions_y.z", "ft_comments_x", "ft_news_also", "ft_news_often"]
    got = {(r["symbol"], r["dt"]): r for r in out.collect()}
    assert len(got) == 2 * 5
    assert got["A", D[0]]["ft_submissions_x"] == 1.0 and got["A", D[1]]["ft_comments_x"] == 5.0 and got["A", D[2]]["ft_news_often"] == 2.0
    assert sum(v is not None for r in got.values() for v in r[2:]) == 1 + 1 + 6
    assert SP.stacked(out.withColumnRenamed("ft_submissions_y.z", "ft_submissions_yz")).count() == 8


def test_documents_without_tokens_have_null_scores(spark):
    df = spark.createDataFrame([(1, ["good"] * 5 + ["bad"]), (2, []), (3, None), (4, ["x"] * 7)], "doc_id int, tokens array<string>")
    model = lambda: SC.WordListModel(["good"], ["bad"])
    other = lambda: SC.WordListModel(["x"], ["good"])
    scored = SC.score_documents(df, "doc_id", "tokens", {"a": model, "b": other}, size=4, stride=2, batch=2)
    rows = {(r["doc_id"], r["chunk"]): r for r in scored.collect()}
    assert set(rows) == {(1, 0), (1, 1), (1, 2), (2, None), (3, None), (4, 0), (4, 1), (4, 2), (4, 3)}
    assert rows[1, 2]["n_tokens"] == 2 and rows[1, 2]["a_pos"] == pytest.approx(0.5) and rows[4, 3]["b_pos"] == 1.0 and rows[2, None]["a_pos"] is None
    chunks = SC.chunk_tokens(df, "doc_id", "tokens", 4, 2)
    single = {(r["doc_id"], r["chunk"]): r for r in SC.score_chunks(chunks, model, model_key="test").collect()}
    assert {k: r["s_pos"] for k, r in single.items()} == {k: r["a_pos"] for k, r in rows.items()}
    agg = {r["doc_id"]: r for r in SC.aggregate_chunks(SC.score_chunks(chunks, model, model_key="test"), "doc_id").collect()}
    assert set(agg) == {1, 2, 3, 4} and agg[2]["roberta_pos"] is None and agg[3]["roberta_normalised_compound"] is None
    both = {r["doc_id"]: r for r in SC.ensemble_score(scored, "doc_id", ("a", "b")).collect()}
    assert set(both) == {1, 2, 3, 4} and both[2]["avg_compound"] is None
    assert scored._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
