"""Aggregations and the source panel (2.3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import slug_domain, ts_trading_day_roll
from ..operators import aggs as A
from ..operators import panel as P
from ..plans.fixtures import FIXTURE_SQL
from . import common as C
from . import register, cte

POST_ORDER = ["ts", "l_linenumber", "l_partkey", "l_extendedprice", "score", "pos", "neg", "subreddit", "symbol"]
POST_ORDER_SQL = ", ".join(POST_ORDER)


POST_COLS = ["date", "subreddit", "symbol", "score", "weighted"]


def _post_rows(fx):
    return fx.fx_post.withColumn("date", ts_trading_day_roll("ts", 5)).withColumn("weighted", F.col("compound") * F.col("score"))


def _posts_last(fx):
    return A.last_non_null_per_key(_post_rows(fx), "post_id", POST_COLS, POST_ORDER)


POSTS_LAST_SQL = cte("fx_post") + f""",
p AS (SELECT *, cast(ts + INTERVAL 5 HOUR AS date) AS date, compound * score AS weighted FROM fx_post),
posts AS (SELECT DISTINCT post_id,
   {", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY post_id ORDER BY {POST_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS {c}" for c in ["date", "subreddit", "symbol", "score", "weighted"])}
   FROM p WHERE post_id IS NOT NULL),
days AS (SELECT date, symbol, subreddit, sum(score) AS score_sum, sum(weighted) AS weighted_sum,
                sum(weighted) / nullif(sum(score), 0) AS avg_sentiment FROM posts GROUP BY 1, 2, 3)
"""


@register("last_per_key", POSTS_LAST_SQL + "SELECT * FROM posts", dbl="weighted")
def q_last_per_key(fx):
    return _posts_last(fx)


@register("trading_day_roll", cte("fx_post") + "SELECT post_id, l_linenumber, ts, cast(ts + INTERVAL 5 HOUR AS date) AS date FROM fx_post")
def q_trading_day_roll(fx):
    return fx.fx_post.select("post_id", "l_linenumber", "ts", ts_trading_day_roll("ts", 5).alias("date"))


@register("weighted_daily_sentiment", POSTS_LAST_SQL + "SELECT * FROM days", dbl="weighted_sum avg_sentiment")
def q_weighted(fx):
    return A.weighted_daily_sentiment(_posts_last(fx), "date", ["symbol", "subreddit"], "weighted", "score")


ART_SQL = cte("fx_article") + f""",
a AS (SELECT *, {C.ARTICLE_SCORE_SQL} AS score, lower(replace(replace(replace(replace(replace(replace(replace(replace(domain,
       ' ', '_'), ',', ''), '''', ''), '.com', ''), '+', ''), '-', '_'), '/', ''), '!', '')) AS sdomain FROM fx_article),
dedup AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY url ORDER BY doc_id DESC) = 1),
aday AS (SELECT dt AS date, 'S' || lpad(cast(doc_id % 7 AS string), 2, '0') AS symbol, sdomain AS domain, score FROM dedup)
"""


def _articles_dedup(fx):
    a = C.articles(fx).withColumn("sdomain", slug_domain("domain"))
    d = P.dedup_keep_last(a, ["url"], ["doc_id"])
    return d.select(F.col("dt").alias("date"),
                    F.concat(F.lit("S"), F.lpad((F.col("doc_id") % 7).cast("string"), 2, "0")).alias("symbol"),
                    F.col("sdomain").alias("domain"), "score")


@register("dedup_keep_last", ART_SQL + "SELECT doc_id, url, domain, score FROM dedup", dbl="score")
def q_dedup_keep_last(fx):
    return P.dedup_keep_last(C.articles(fx), ["url"], ["doc_id"]).select("doc_id", "url", "domain", "score")


@register("slug_domain", ART_SQL + "SELECT doc_id, sdomain FROM a")
def q_slug_domain(fx):
    return fx.fx_article.select("doc_id", slug_domain("domain").alias("sdomain"))


@register("slug_domain_edge", cte("fx_article") + """SELECT doc_id, lower(replace(replace(replace(replace(replace(replace(
  replace(replace(domain || ' Co.com+-/!''x', ' ', '_'), ',', ''), '''', ''), '.com', ''), '+', ''), '-', '_'), '/', ''),
  '!', '')) AS sdomain FROM fx_article""")
def q_slug_domain_edge(fx):
    return fx.fx_article.select("doc_id", slug_domain(F.concat(F.col("domain"), F.lit(" Co.com+-/!'x"))).alias("sdomain"))


@register("equal_daily_sentiment", ART_SQL + """SELECT date, symbol, domain, sum(score) AS weighted_sum, count(*) AS weight_sum,
  sum(score) / count(*) AS avg_sentiment FROM aday GROUP BY 1, 2, 3""", dbl="weighted_sum avg_sentiment")
def q_equal(fx):
    return A.equal_daily_sentiment(_articles_dedup(fx), "date", ["symbol", "domain"], "score")


@register("top_sources", ART_SQL + """SELECT domain, count(DISTINCT date) AS n_days FROM aday GROUP BY 1
  ORDER BY n_days DESC, domain LIMIT 5""")
def q_top_sources(fx):
    return A.top_sources(_articles_dedup(fx), "domain", "date", 5)


@register("value_counts_top", cte("fx_post") + """SELECT subreddit, count(*) AS n FROM fx_post GROUP BY 1 ORDER BY n DESC, subreddit LIMIT 3""")
def q_value_counts(fx):
    return A.value_counts_top(fx.fx_post, "subreddit", 3)


@register("sum_by_day", cte("fx_post") + """SELECT cast(ts AS date) AS date, sum(score) AS total FROM fx_post
  WHERE subreddit LIKE '%F%' GROUP BY 1""")
def q_sum_by_day(fx):
    from ..operators.filters import filter_mentions
    p = filter_mentions(fx.fx_post, "subreddit", ["F"]).withColumn("date", F.to_date("ts"))
    return A.sum_by_day(p, "date", "score")


@register("filter_mentions", ART_SQL + """SELECT doc_id FROM a WHERE contains(text, 'The') OR contains(text, 'Ein')""")
def q_filter_mentions(fx):
    from ..operators.filters import filter_mentions
    return filter_mentions(fx.fx_article, "text", ["The", "Ein"]).select("doc_id")


@register("mean_by_source", cte("fx_post") + """SELECT subreddit, avg(compound) AS compound, avg(score) AS score FROM fx_post
  GROUP BY 1""", dbl="compound score")
def q_mean_by_source(fx):
    return A.mean_by_source(fx.fx_post, "subreddit", ["compound", "score"])


_MF = ["ft_news_10", "ft_submissions_10", "ft_comments_10", "ft_abs_news_10"]
_MK = ["sp_tradeable_price", "sp_forward_returns_10"]


def market_frame(fx):
    ds = C.dataset_cols(fx, *_MF, *_MK)
    return A.market_features(ds, "dt", _MF, _MK)


MARKET_SQL = C.DATASET_CTES.rstrip() + f""",
mkt AS (SELECT dt, {", ".join(f"avg({c}) AS {c}" for c in _MF)},
  {", ".join(f"arg_max({c}, CASE WHEN {c} IS NOT NULL THEN symbol END) AS {c}" for c in _MK)} FROM ds GROUP BY dt)
"""


@register("market_features", MARKET_SQL + "SELECT * FROM mkt", dbl=" ".join(_MF + _MK))
def q_market_features(fx):
    return market_frame(fx)


@register("binned_target", C.DATASET_CTES + """SELECT round(ft_news_10, 2) AS bin, avg(tgt_forward_returns_10) AS mean_target,
  count(*) AS n FROM ds GROUP BY 1 HAVING count(*) > 500""", dbl="bin mean_target")
def q_binned_target(fx):
    return A.binned_target(C.dataset_cols(fx, "ft_news_10", "tgt_forward_returns_10"), "ft_news_10", "tgt_forward_returns_10", 2, 500)


@register("histogram", cte("fx_post") + """,
b AS (SELECT min(compound) AS lo, max(compound) AS hi FROM fx_post),
h AS (SELECT subreddit, CASE WHEN hi = lo THEN 0 ELSE least(cast(floor((compound - lo) / ((hi - lo) / 20)) AS INTEGER), 19) END AS bin,
             lo, hi FROM fx_post, b WHERE compound IS NOT NULL)
SELECT subreddit, bin, count(*) AS n, any_value(lo + bin * ((hi - lo) / 20)) AS bin_lo, any_value(lo + (bin + 1) * ((hi - lo) / 20)) AS bin_hi
FROM h GROUP BY 1, 2""", dbl="bin_lo bin_hi")
def q_histogram(fx):
    return A.histogram(fx.fx_post, "compound", 20, ["subreddit"])


@register("describe_by_symbol", cte("fx_event_day") + """SELECT symbol, count(x) AS count, avg(x) AS mean, stddev_samp(x) AS std,
  min(x) AS min, quantile_cont(x, 0.25) AS p25, quantile_cont(x, 0.5) AS p50, quantile_cont(x, 0.75) AS p75, max(x) AS max
FROM fx_event_day GROUP BY 1""", dbl="mean std min p25 p50 p75 max")
def q_describe(fx):
    return A.describe_by_symbol(fx.fx_event_day, "x")


_NP_COLS = ["symbol", "dt", "news_sentiment", "submissions_sentiment", "comments_sentiment", "open", "close", "high", "low",
            "sp500_open", "sp500_close"]
_NP_TYPES = {"symbol": "string", "dt": "date"}


@register("null_profile", C.PANEL_CTES + "\n" + " UNION ALL ".join(
    f"SELECT (SELECT count(*) FROM panel) AS n_rows, '{c}' AS column, count_if({c} IS NULL) AS n_null, "
    f"'{_NP_TYPES.get(c, 'double')}' AS dtype FROM panel" for c in _NP_COLS))
def q_null_profile(fx):
    return A.null_profile(C.panel(fx))


@register("conditional_stats", C.DATASET_CTES + """SELECT sum(tgt_forward_returns_10) AS sum_target,
  avg(tgt_forward_returns_10) AS mean_target, count(*) AS n FROM ds WHERE ft_news_10 > 0.5""", dbl="sum_target mean_target")
def q_conditional_stats(fx):
    return A.conditional_stats(C.dataset_cols(fx, "ft_news_10", "tgt_forward_returns_10"), "ft_news_10", "tgt_forward_returns_10", 0.5)


@register("position_share", C.DATASET_CTES + """SELECT symbol, dt, close / nullif(sum(close) OVER (PARTITION BY dt), 0) AS share
FROM ds""", dbl="share")
def q_position_share(fx):
    return A.position_share(C.dataset_cols(fx, "close"), "close").select("symbol", "dt", "share")


# ---------------------------------------------------------- source panel --

SUBS = ["AF", "NF", "NO", "RF", "AO", "RO"]


@register("pivot_sources", POSTS_LAST_SQL + "SELECT symbol, date AS dt, " + ", ".join(
    f"max(CASE WHEN subreddit = '{s}' THEN avg_sentiment END) AS ft_comments_{s}" for s in SUBS) +
    " FROM days GROUP BY 1, 2", dbl=" ".join(f"ft_comments_{s}" for s in SUBS))
def q_pivot_sources(fx):
    days = A.weighted_daily_sentiment(_posts_last(fx), "date", ["symbol", "subreddit"], "weighted", "score")
    days = days.withColumnRenamed("date", "dt")
    return P.pivot_sources(days, "subreddit", "avg_sentiment", "ft_comments_", SUBS)


# submissions: each order's first line; their comments: all lines
SUBMISSION = "l_linenumber = 1"
TOP = {"submissions": 50, "comments": 50, "news": 50}


def source_panel(fx):
    from ..plans.source_panel import build_source_panel
    daily = lambda p: A.weighted_daily_sentiment(p, "date", ["symbol", "subreddit"], "weighted", "score")
    subs = A.last_non_null_per_key(_post_rows(fx).where(SUBMISSION), "post_id", POST_COLS, POST_ORDER)
    news = A.equal_daily_sentiment(_articles_dedup(fx), "date", ["symbol", "domain"], "score")
    return build_source_panel({"submissions": (daily(subs), "subreddit"), "comments": (daily(_posts_last(fx)), "subreddit"), "news": (news, "domain")},
                              TOP, fx.fx_price, fx.fx_index)


def _top_sql(src: str, source: str, kind: str) -> str:
    return f"SELECT {source} FROM {src} WHERE {source} IS NOT NULL GROUP BY 1 ORDER BY count(DISTINCT date) DESC, {source} LIMIT {TOP[kind]}"


# every symbol-day's cells of all kinds in long form, the sources taken from the data
CELLS_SQL = POSTS_LAST_SQL.rstrip() + f""",
sposts AS (SELECT DISTINCT post_id,
   {", ".join(f"last_value({c} IGNORE NULLS) OVER (PARTITION BY post_id ORDER BY {POST_ORDER_SQL} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS {c}" for c in POST_COLS)}
   FROM p WHERE post_id IS NOT NULL AND {SUBMISSION}),
sdays AS (SELECT date, symbol, subreddit, sum(weighted) / nullif(sum(score), 0) AS avg_sentiment FROM sposts GROUP BY 1, 2, 3),
""" + ART_SQL.replace("WITH fx_article AS", "fx_article AS").rstrip() + f""",
ndays AS (SELECT date, symbol, domain, sum(score) / count(*) AS avg_sentiment FROM aday GROUP BY 1, 2, 3),
cells AS (
  SELECT symbol, date AS dt, 'submissions' AS kind, 'ft_submissions_' || subreddit AS c, avg_sentiment AS v FROM sdays WHERE subreddit IN ({_top_sql("sdays", "subreddit", "submissions")})
  UNION ALL SELECT symbol, date, 'comments', 'ft_comments_' || subreddit, avg_sentiment FROM days WHERE subreddit IN ({_top_sql("days", "subreddit", "comments")})
  UNION ALL SELECT symbol, date, 'news', 'ft_news_' || domain, avg_sentiment FROM ndays WHERE domain IN ({_top_sql("ndays", "domain", "news")})),
syms AS (SELECT symbol FROM sdays UNION SELECT symbol FROM days UNION SELECT symbol FROM ndays),
rng AS (SELECT min(d) AS lo, max(d) AS hi FROM (SELECT date AS d FROM sdays UNION ALL SELECT date FROM days UNION ALL SELECT date FROM ndays)),
spine AS (SELECT s.symbol, cast(g.d AS date) AS dt FROM syms s, rng, generate_series(rng.lo, rng.hi, INTERVAL 1 DAY) AS g(d)),
fx_price AS ({FIXTURE_SQL["fx_price"]}),
fx_index AS ({FIXTURE_SQL["fx_index"]})
"""


@register("join_source_panel", CELLS_SQL + "SELECT symbol, dt, c AS column, v AS value FROM cells WHERE v IS NOT NULL" + "".join(
    f" UNION ALL SELECT sp.symbol, sp.dt, '{c}', p.{c} FROM spine sp JOIN fx_price p ON p.symbol = sp.symbol AND p.dt = sp.dt WHERE p.{c} IS NOT NULL"
    for c in ("open", "close", "high", "low")) + "".join(
    f" UNION ALL SELECT sp.symbol, sp.dt, '{c}', i.{c} FROM spine sp JOIN fx_index i ON i.dt = sp.dt WHERE i.{c} IS NOT NULL" for c in ("sp500_open", "sp500_close")), dbl="value")
def q_join_source_panel(fx):
    """The wide panel's cells, stacked: its columns are found in the data, so their names are data too."""
    from ..plans.source_panel import stacked
    return stacked(source_panel(fx))


KINDS = ("submissions", "comments", "news")


@register("group_sources", CELLS_SQL + "SELECT sp.symbol, sp.dt, " + ", ".join(f"coalesce(sum(v) FILTER (kind = '{k}'), 0) AS ft_{k}" for k in KINDS) +
          " FROM spine sp LEFT JOIN cells c ON c.symbol = sp.symbol AND c.dt = sp.dt GROUP BY 1, 2", dbl=" ".join(f"ft_{k}" for k in KINDS))
def q_group_sources(fx):
    from ..plans.dataset import group_source_columns, select_features
    sp = source_panel(fx)
    return group_source_columns(sp.fillna(0.0, subset=select_features(sp.columns, "ft_"))).select("symbol", "dt", *[f"ft_{k}" for k in KINDS])


@register("row_mean_sources", CELLS_SQL + "SELECT sp.symbol, sp.dt, " + ", ".join(f"avg(v) FILTER (kind = '{k}') AS ft_{k}_mean" for k in KINDS) +
          " FROM spine sp LEFT JOIN cells c ON c.symbol = sp.symbol AND c.dt = sp.dt GROUP BY 1, 2", dbl=" ".join(f"ft_{k}_mean" for k in KINDS))
def q_row_mean(fx):
    sp = source_panel(fx)
    return sp.select("symbol", "dt", *[A.row_mean([c for c in sp.columns if c.startswith(f"ft_{k}_")]).alias(f"ft_{k}_mean") for k in KINDS])
