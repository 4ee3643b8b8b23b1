"""Ingest: raw JSONL / price strings derived from the driver
tables by Spark, parsed back by the ingest operators; the oracle computes the
expected clean rows straight from the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import ingest as I
from . import register

NEWS_LINES = """SELECT CASE WHEN doc_id % 50 = 7 THEN '{"title": "broken' ELSE to_json(named_struct(
  'title', lang, 'description', source, 'content', text, 'url', 'u' || cast(doc_id AS string),
  'publishedAt', CASE WHEN doc_id % 61 = 5 THEN 'not-a-date' ELSE
     date_format(timestamp_seconds(1451606400 + (doc_id % 400) * 86400 + doc_id % 86400), "yyyy-MM-dd'T'HH:mm:ss") ||
     CASE doc_id % 3 WHEN 0 THEN 'Z' WHEN 1 THEN '+02:00' ELSE '-05:30' END END,
  'source', named_struct('name', source))) END AS value FROM documents"""


@register("ingest_news", """SELECT lang AS title, source AS description, text AS body, 'u' || cast(doc_id AS string) AS url,
  source AS domain, (1451606400 + (doc_id % 400) * 86400 + doc_id % 86400) * 1000
    - CASE doc_id % 3 WHEN 0 THEN 0 WHEN 1 THEN 7200000 ELSE -19800000 END AS dt
FROM documents WHERE doc_id % 50 <> 7 AND doc_id % 61 <> 5""")
def q_ingest_news(fx):
    good, _ = I.ingest_news(fx.spark.sql(NEWS_LINES), on_error="reject")
    return good


@register("ingest_news_rejected", """SELECT 'u' || cast(doc_id AS string) AS url FROM documents
WHERE doc_id % 50 <> 7 AND doc_id % 61 = 5""")
def q_ingest_news_rej(fx):
    _, rej = I.ingest_news(fx.spark.sql(NEWS_LINES), on_error="reject")
    return rej.select("url")


SUB_LINES = """SELECT '{"created_utc": ' || CASE conv_id % 3 WHEN 0 THEN cast(1577836800 + conv_id * 3600 AS string)
    WHEN 1 THEN '"' || cast(1577836800 + conv_id * 3600 AS string) || '"'
    ELSE '"' || cast(1577836800 + conv_id * 3600 AS string) || '.0"' END || ', ' ||
  substring(to_json(named_struct('title', role, 'subreddit', 'r' || cast(conv_id % 4 AS string), 'domain', 'self',
    'score', CASE WHEN conv_id % 9 = 4 THEN NULL ELSE length(text) % 25 END, 'downs', turn, 'id', cast(conv_id AS string),
    'selftext', text, 'link_flair_text', CASE WHEN conv_id % 2 = 0 THEN 'dd' END)), 2) AS value
FROM conversations WHERE turn = 0"""


@register("ingest_submissions", """SELECT role AS title, 'r' || cast(conv_id % 4 AS string) AS subreddit, 'self' AS domain,
  cast(conv_id AS string) AS id, text AS body, CASE WHEN conv_id % 2 = 0 THEN 'dd' ELSE '' END AS flair,
  (1577836800 + conv_id * 3600) * 1000 AS dt, length(text) % 25 AS score, turn AS downs
FROM conversations WHERE turn = 0 AND conv_id % 9 <> 4 AND length(text) % 25 >= 10""")
def q_ingest_subs(fx):
    good, _ = I.ingest_submissions(fx.spark.sql(SUB_LINES), min_score=10)
    return good


COM_LINES = """SELECT to_json(named_struct('body', text, 'created_utc', cast(1577836800 + conv_id * 3600 + turn * 60 AS string),
  'score', length(text) % 30, 'id', cast(conv_id * 100 + turn AS string), 'link_id', 't3_' || cast(conv_id AS string),
  'permalink', '')) AS j, conv_id, turn FROM conversations WHERE turn > 0"""


def _comment_lines(spark):
    j = spark.sql(COM_LINES)
    parent = F.col("conv_id") * 100 + F.floor((F.col("turn") - 1) / 2)
    praw = F.when(F.col("turn") % 4 == 3, parent.cast("string")).otherwise(
        F.concat(F.lit('"t1_'), parent.cast("string"), F.lit('"')))
    # splice a parent_id that is a JSON number for some rows and a string for the rest
    return j.select(F.concat(F.expr("substring(j, 1, length(j) - 1)"), F.lit(', "parent_id": '), praw, F.lit("}")).alias("value"))


@register("ingest_comments", """SELECT text AS body, cast(conv_id * 100 + turn AS string) AS id, cast(conv_id AS string) AS post_id,
  CASE WHEN turn % 4 = 3 THEN '' ELSE cast(conv_id * 100 + cast(floor((turn - 1) / 2) AS bigint) AS string) END AS parent_id,
  (1577836800 + conv_id * 3600 + turn * 60) * 1000 AS dt, length(text) % 30 AS score
FROM conversations WHERE turn > 0 AND length(text) % 30 >= 10""")
def q_ingest_comments(fx):
    good, _ = I.ingest_comments(_comment_lines(fx.spark), min_score=10)
    return good


@register("parse_thread_ids", """SELECT cast(conv_id * 100 + turn AS string) AS id, cast(conv_id AS string) AS post_id,
  CASE WHEN turn % 4 = 3 THEN '' ELSE cast(conv_id * 100 + cast(floor((turn - 1) / 2) AS bigint) AS string) END AS parent_id,
  (1577836800 + conv_id * 3600 + turn * 60) * 1000 AS dt FROM conversations WHERE turn > 0""")
def q_parse_ids(fx):
    good, _ = I.ingest_comments(_comment_lines(fx.spark), min_score=-10**9)
    return good.select("id", "post_id", "parent_id", "dt")


@register("parse_created_utc", """SELECT conv_id, (1577836800 + conv_id * 3600) * 1000 AS dt FROM conversations WHERE turn = 0""")
def q_parse_created(fx):
    c = fx.table("conversations").filter("turn = 0")
    raw = F.when(F.col("conv_id") % 3 == 0, (F.lit(1577836800) + F.col("conv_id") * 3600).cast("string")).when(
        F.col("conv_id") % 3 == 1, F.concat(F.lit(" "), (F.lit(1577836800) + F.col("conv_id") * 3600).cast("string"))).otherwise(
        F.concat((F.lit(1577836800) + F.col("conv_id") * 3600).cast("string"), F.lit(".75")))
    return c.select("conv_id", I.parse_created_utc(raw).alias("dt"))


@register("dedup_raw_lines", """SELECT DISTINCT role || ':' || cast(conv_id % 7 AS string) || ':' || cast(length(text) % 5 AS string) AS value
FROM conversations""")
def q_dedup_lines(fx):
    c = fx.table("conversations").select(F.concat_ws(":", "role", (F.col("conv_id") % 7).cast("string"),
                                                     (F.length("text") % 5).cast("string")).alias("value"))
    return I.dedup_raw_lines(c)


PRICE_RAW = """SELECT symbol, date_format(dt, 'MM/dd/yyyy') AS date, '$' || format_number(open, 2) AS open,
  '$' || format_number(high, 2) AS high, '$' || format_number(low, 2) AS low,
  CASE WHEN symbol = 'S03' AND day(dt) % 7 = 0 THEN 'N/A' ELSE '$' || format_number(close, 2) END AS close,
  format_number(floor(low), 0) AS volume FROM fx_price"""


@register("ingest_prices", """WITH fx_price AS (""" + __import__("sentipanel.plans.fixtures", fromlist=["x"]).FIXTURE_SQL["fx_price"] + """)
SELECT dt AS date, open, high, low, CASE WHEN symbol = 'S03' AND day(dt) % 7 = 0 THEN NULL ELSE close END AS close,
  floor(low) AS volume, symbol FROM fx_price""", dbl="open high low close volume", digits=2)
def q_ingest_prices(fx):
    fx.fx_price.createOrReplaceTempView("fx_price")
    return I.ingest_prices(fx.spark.sql(PRICE_RAW))


@register("ingest_index_prices", """WITH fx_index AS (""" + __import__("sentipanel.plans.fixtures", fromlist=["x"]).FIXTURE_SQL["fx_index"] + """)
SELECT dt, sp500_open, sp500_open * 2 AS sp500_close FROM fx_index""", dbl="sp500_open sp500_close", digits=2)
def q_ingest_index(fx):
    fx.fx_index.createOrReplaceTempView("fx_index")
    raw = fx.spark.sql("""SELECT date_format(dt, 'dd/MM/yyyy') AS Date, format_number(sp500_open, 2) AS Open,
      format_number(sp500_open * 2, 2) AS Price FROM fx_index""")
    return I.ingest_index_prices(raw)
