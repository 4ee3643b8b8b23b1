"""Sinks/readers as round trips (write what Spark derived from the tables into
the shared checkpoint folder, read it back), plus small helpers (SURVEY 2.1/2.2)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import scalars as SC
from ..operators import filters as FL
from ..operators import tagging as T
from ..plans.dataset import select_features
from ..plans.fixtures import FIXTURE_SQL
from ..session import ensure_checkpoint_dir
from ..sources import ingest as I
from . import common as C
from . import register, cte
from .text_q import ART_TAG, tag_sql


def _scratch(spark, name):
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/io-{name}-{uuid.uuid4().hex[:8]}"


_DAILY_SQL = cte("fx_post") + """SELECT symbol, cast(ts AS date) AS dt, avg(compound) AS compound, count(*) AS n
FROM fx_post GROUP BY 1, 2"""


def _daily(fx):
    return fx.fx_post.groupBy("symbol", F.to_date("ts").alias("dt")).agg(F.avg("compound").alias("compound"),
                                                                         F.count(F.lit(1)).alias("n"))


@register("write_by_symbol", _DAILY_SQL, dbl="compound")
def q_write_by_symbol(fx):
    path = _scratch(fx.spark, "bysym")
    I.write_by_symbol(_daily(fx), path, mode="overwrite")
    return I.read_by_symbol(fx.spark, path).select("symbol", "dt", "compound", "n")


@register("read_by_symbol", _DAILY_SQL, dbl="compound")
def q_read_by_symbol(fx):
    path = _scratch(fx.spark, "bysym-read")
    _daily(fx).write.partitionBy("symbol").parquet(path)
    return I.read_by_symbol(fx.spark, path).select("symbol", "dt", "compound", "n")


@register("write_incremental", _DAILY_SQL, dbl="compound")
def q_write_incremental(fx):
    path = _scratch(fx.spark, "incr")
    d = _daily(fx)
    I.write_incremental(d.filter(F.col("symbol") < "S10"), path)   # first run
    I.write_incremental(d, path)                                    # second run adds only new symbols
    return fx.spark.read.parquet(path).select("symbol", "dt", "compound", "n")


@register("write_dataset", C.PANEL_CTES + "\nSELECT * FROM panel",
          dbl="news_sentiment submissions_sentiment comments_sentiment open close high low sp500_open sp500_close")
def q_write_dataset(fx):
    path = _scratch(fx.spark, "dataset")
    I.write_dataset(C.panel(fx), path)
    return fx.spark.read.parquet(path)


@register("write_csv_export", cte("fx_price") + """SELECT symbol, cast(dt AS string) AS dt, cast(open AS string) AS open,
  cast(close AS string) AS close FROM fx_price""")
def q_write_csv(fx):
    path = _scratch(fx.spark, "csv")
    I.write_csv_export(fx.fx_price.select("symbol", F.col("dt").cast("string").alias("dt"), F.col("open").cast("string").alias("open"),
                                          F.col("close").cast("string").alias("close")), path)
    return fx.spark.read.option("header", True).csv(path)


_MACRO_NAMES = {"Interest Rates (Fed Funds Rate)": "rate", "Inflation (CPI)": "cpi", "GDP Growth Rate": "gdp",
                "M2 Money Supply": "m2", "Federal Expenditures": "spend", "Unemployment Rate": "unemp"}


@register("ingest_macro", cte("fx_macro") + """SELECT month AS Date, rate, rate / 1000 AS cpi, cast(volume AS double) AS gdp,
  rate * 2 AS m2, rate * 3 AS spend, cast(volume % 10 AS double) AS unemp FROM fx_macro""",
          dbl="rate cpi gdp m2 spend unemp", digits=4)
def q_ingest_macro(fx):
    path = _scratch(fx.spark, "macro")
    m = fx.fx_macro
    m.select(F.col("month").alias("Date"), F.col("rate").alias("Interest Rates (Fed Funds Rate)"),
             (F.col("rate") / 1000).alias("Inflation (CPI)"), F.col("volume").cast("double").alias("GDP Growth Rate"),
             (F.col("rate") * 2).alias("M2 Money Supply"), (F.col("rate") * 3).alias("Federal Expenditures"),
             (F.col("volume") % 10).cast("double").alias("Unemployment Rate")).write.option("header", True).csv(path)
    out = I.ingest_macro(fx.spark, path)
    return out.select("Date", *[F.col(f"`{k}`").alias(v) for k, v in _MACRO_NAMES.items()])


@register("finalize_segments", cte("fx_article", "fx_terms") + """, src AS (SELECT doc_id, domain || chr(10) || text AS text, '' AS start
  FROM fx_article)""" + tag_sql("src") + """SELECT DISTINCT s.text, s.ticker AS symbol, a.url, a.domain, a.dt
FROM segs s JOIN fx_article a ON a.doc_id = s.doc_id WHERE s.ticker <> ''""")
def q_finalize(fx):
    seg = T.tag_news(fx.fx_article, fx.fx_terms, doc="doc_id", title="domain", body="text", keep=("url", "domain", "dt"))
    return I.finalize_segments(seg.select("text", "symbol", "url", "domain", "dt"))


@register("tag_submissions", cte("fx_thread", "fx_terms") + """, src AS (SELECT id AS doc_id, role || chr(10) || text AS text,
  '' AS start FROM fx_thread WHERE turn = 0)""" + tag_sql("src") + """SELECT s.doc_id AS id, s.seg, s.text, s.ticker AS symbol,
  t.role AS flair, t.conv_id AS downs FROM segs s JOIN (SELECT conv_id * 100 AS id, role, conv_id FROM conversations WHERE turn = 0) t
  ON t.id = s.doc_id WHERE s.ticker <> ''""")
def q_tag_submissions(fx):
    posts = fx.fx_thread.filter("turn = 0").select("id", F.col("role").alias("title"), F.col("text").alias("body"),
                                                   F.col("role").alias("flair"), (F.col("id") / 100).cast("bigint").alias("downs"))
    return T.tag_submissions(posts, fx.fx_terms, doc="id", keep=("flair", "downs"))


@register("filter_symbols", cte("fx_price") + "SELECT symbol, dt, close FROM fx_price WHERE symbol IN ('S01', 'S07', 'S19')",
          dbl="close")
def q_filter_symbols(fx):
    return FL.filter_symbols(fx.fx_price.select("symbol", "dt", "close"), ["S01", "S07", "S19"])


@register("filter_nonzero", cte("fx_post") + "SELECT post_id, l_linenumber, l_partkey, compound FROM fx_post WHERE compound <> 0",
          dbl="compound")
def q_filter_nonzero(fx):
    return FL.filter_nonzero(fx.fx_post.select("post_id", "l_linenumber", "l_partkey", "compound"), "compound")


@register("drop_cols", cte("fx_price") + "SELECT symbol, dt, close FROM fx_price", dbl="close")
def q_drop_cols(fx):
    return FL.drop_cols(fx.fx_price, ["open", "high", "low", "volume"])


@register("numeric_only", cte("fx_post") + "SELECT * EXCLUDE (symbol, ts, subreddit) FROM fx_post", dbl="pos neu neg compound l_extendedprice")
def q_numeric_only(fx):
    return FL.numeric_only(fx.fx_post)


@register("fill_zero", C.PANEL_CTES + """
SELECT symbol, dt, coalesce(news_sentiment, 0) AS news, coalesce(open, 0) AS price FROM panel WHERE close IS NOT NULL""",
          dbl="news price")
def q_fill_zero(fx):
    p = C.panel(fx)
    p = FL.drop_null(p, ["close"])                               # drop_null
    p = FL.fill_zero(p, ["news_sentiment", "open"])              # fill_zero
    return p.select("symbol", "dt", F.col("news_sentiment").alias("news"), F.col("open").alias("price"))   # rename


@register("clip", cte("fx_post") + """SELECT post_id, l_linenumber, l_partkey,
  CASE WHEN compound IS NULL THEN NULL ELSE least(greatest(compound, -0.02), 0.05) END AS clipped FROM fx_post""", dbl="clipped")
def q_clip_only(fx):
    return fx.fx_post.select("post_id", "l_linenumber", "l_partkey", SC.clip("compound", -0.02, 0.05).alias("clipped"))


@register("compound_scores", cte("fx_post") + """SELECT post_id, l_linenumber, l_partkey, pos - neg AS compound,
  (pos - neg) / sqrt((pos - neg) ^ 2 + 20) AS normalised_compound FROM fx_post""", dbl="compound normalised_compound")
def q_compound(fx):
    c = SC.compound("pos", "neg")
    return fx.fx_post.select("post_id", "l_linenumber", "l_partkey", c.alias("compound"),
                             SC.normalised_compound(c, 20).alias("normalised_compound"))


@register("select_features", C.DATASET_CTES + "SELECT symbol, dt, ft_news_10, ft_submissions_10, ft_comments_10, "
          "ft_combined_10, ft_abs_news_10, ft_abs_submissions_10, ft_abs_comments_10, ft_combined_abs_10 FROM ds",
          dbl="ft_news_10 ft_submissions_10 ft_comments_10 ft_combined_10 ft_abs_news_10 ft_abs_submissions_10 "
              "ft_abs_comments_10 ft_combined_abs_10")
def q_select_features(fx):
    ds = C.dataset(fx, residualise=False)
    return ds.select("symbol", "dt", *select_features(ds.columns, "ft_", "_10"))


@register("sort_by", cte("fx_event_day") + "SELECT symbol, dt, x FROM fx_event_day ORDER BY x DESC, symbol, dt", dbl="x")
def q_sort_by(fx):
    return fx.fx_event_day.select("symbol", "dt", "x").orderBy(F.desc("x"), "symbol", "dt")


@register("gbt_fit", None, note="boosted trees (Spark ML); feature importances, rows-only")
def q_gbt_fit(fx):
    from ..operators import models as M
    feats = ["ft_news_10", "ft_comments_10"]
    ds = C.dataset_cols(fx, *feats, "tgt_forward_returns_10")
    model = M.gbt_fit(ds.filter(F.col("dt") < F.lit("1999-01-01").cast("date")), feats, "tgt_forward_returns_10", max_iter=300)
    imp = model.featureImportances.toArray().tolist()
    return fx.spark.createDataFrame(list(zip(feats, imp)), "feature string, importance double")


@register("read_ratings", cte("fx_article") + f""", r AS (SELECT l.doc_id, {C.ARTICLE_SCORE_SQL} AS m1,
  CASE WHEN l.doc_id % 9 = 0 THEN NULL ELSE l.toxic * 1.0 END AS m2, l.quality * 0.5 AS m3, -{C.ARTICLE_SCORE_SQL} AS m4,
  l.quality * 4 + 1.0 AS rating FROM labels l JOIN fx_article a ON a.doc_id = l.doc_id)
SELECT m2, m3, m4, m1 AS m5, rating FROM r WHERE m2 IS NOT NULL""", dbl="m2 m3 m4 m5 rating", digits=5)
def q_read_ratings(fx):
    path = _scratch(fx.spark, "ratings")
    a = C.articles(fx).select("doc_id", "score")
    lab = fx.table("labels")
    r = lab.join(a, ["doc_id"]).select(
        F.col("doc_id").cast("string").alias("Content"), F.col("score").alias("m1"),
        F.when(F.col("doc_id") % 9 == 0, F.lit(None)).otherwise(F.col("toxic") * 1.0).alias("m2"),
        (F.col("quality") * 0.5).alias("m3"), (-F.col("score")).alias("m4"), F.col("score").alias("m5"),
        (F.col("quality") * 4 + 1.0).alias("rating"))
    # sheet layout: text, one unused model column, then the last five columns are read
    r.select("Content", "m1", "m2", "m3", "m4", "m5", "rating").drop("m1").write.option("header", True).csv(path)
    return I.read_ratings(fx.spark, path, n_last=5)
