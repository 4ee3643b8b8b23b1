"""Joins, set operations and scalar helpers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as SC
from ..operators import panel as P
from ..operators.filters import filter_nonzero, filter_symbols
from ..plans.dataset import filter_date_range
from . import common as C
from . import register, cte

MACRO_SQL = """SELECT month, CASE WHEN month(month) % 3 = 0 THEN NULL ELSE rate END AS rate, volume FROM fx_macro"""


@register("asof_macro", cte("fx_price", "fx_macro") + f""", m AS ({MACRO_SQL}),
mf AS (SELECT month, last_value(rate IGNORE NULLS) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS rate,
       last_value(volume IGNORE NULLS) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS volume FROM m)
SELECT p.symbol, p.dt, p.close, mf.rate, mf.volume FROM fx_price p ASOF LEFT JOIN mf ON p.dt >= mf.month""", dbl="close rate")
def q_asof(fx):
    fx.fx_macro.createOrReplaceTempView("fx_macro")
    macro = fx.spark.sql(MACRO_SQL)
    return P.asof_dimension(fx.fx_price.select("symbol", "dt", "close"), macro, "dt", "month", ["rate", "volume"])


@register("asof_macro_filled", cte("fx_price", "fx_macro") + f""", m AS ({MACRO_SQL}),
mf AS (SELECT month, last_value(rate IGNORE NULLS) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS rate,
       last_value(volume IGNORE NULLS) OVER (ORDER BY month ROWS UNBOUNDED PRECEDING) AS volume FROM m),
g AS (SELECT symbol, dt, CASE WHEN day(dt) % 3 = 0 THEN NULL ELSE close END AS close FROM fx_price),
j AS (SELECT g.*, mf.rate, mf.volume FROM g ASOF LEFT JOIN mf ON g.dt >= mf.month)
SELECT symbol, dt, {", ".join(f"last_value({c} IGNORE NULLS) OVER (ORDER BY dt, symbol ROWS UNBOUNDED PRECEDING) AS {c}" for c in ("close", "rate", "volume"))} FROM j""",
          dbl="close rate")
def q_asof_filled(fx):
    fx.fx_macro.createOrReplaceTempView("fx_macro")
    gaps = fx.fx_price.select("symbol", "dt", F.when(F.dayofmonth("dt") % 3 != 0, F.col("close")).alias("close"))
    return P.merge_macro(gaps, fx.spark.sql(MACRO_SQL), "dt", "month", ["dt", "symbol"], ["rate", "volume"])


_SPARSE = "SELECT dt, sp500_open, CASE WHEN day(dt) % 2 = 0 THEN sp500_close END AS sp500_close FROM fx_index WHERE day(dt) % 4 <> 1"


@register("asof_backward", cte("fx_price", "fx_index") + f""", s AS ({_SPARSE})
SELECT p.symbol, p.dt, p.close, s.sp500_open, s.sp500_close FROM fx_price p ASOF LEFT JOIN s ON p.dt >= s.dt""", dbl="close sp500_open sp500_close")
def q_asof_backward(fx):
    fx.fx_index.createOrReplaceTempView("fx_index")
    return P.asof_backward(fx.fx_price.select("symbol", "dt", "close"), fx.spark.sql(_SPARSE), "dt", "dt", ["sp500_open", "sp500_close"])


@register("asof_backward_by_key", cte("fx_post", "fx_price") + """, d AS (SELECT symbol, cast(ts AS date) AS dt, avg(compound) AS compound FROM fx_post
  WHERE subreddit = 'NF' GROUP BY 1, 2)
SELECT p.symbol, p.dt, p.close, d.compound FROM fx_price p ASOF LEFT JOIN d ON d.symbol = p.symbol AND p.dt >= d.dt""", dbl="close compound")
def q_asof_backward_key(fx):
    ch = C.channels(fx)["comments"].select("symbol", "dt", "compound")
    return P.asof_backward(fx.fx_price.select("symbol", "dt", "close"), ch, "dt", "dt", ["compound"], key="symbol")


@register("delayed_join", cte("fx_post", "fx_price") + """, d AS (SELECT symbol, cast(ts AS date) AS dt, avg(compound) AS compound
  FROM fx_post GROUP BY 1, 2)
SELECT p.symbol, p.dt, p.close, d.compound FROM fx_price p LEFT JOIN d ON d.symbol = p.symbol AND d.dt + 4 = p.dt""",
          dbl="compound close")
def q_delayed(fx):
    ch = C.channels(fx)["news"].select("symbol", "dt", "compound")
    # sentiment is seen 4 days later: the prices' side stays, the sentiment moves
    return P.delayed_join(fx.fx_price.select("symbol", "dt", "close"), ch, 4).select("symbol", "dt", "close", "compound")


@register("join_channels_full", C.PANEL_CTES + """
SELECT coalesce(n.symbol, s.symbol, c.symbol) AS symbol, coalesce(n.dt, s.dt, c.dt) AS dt,
  coalesce(n.s, 0) AS news, coalesce(s.s, 0) AS submissions, coalesce(c.s, 0) AS comments
FROM ch_news n FULL OUTER JOIN ch_subs s ON s.symbol = n.symbol AND s.dt = n.dt
FULL OUTER JOIN ch_comm c ON c.symbol = coalesce(n.symbol, s.symbol) AND c.dt = coalesce(n.dt, s.dt)""",
          dbl="news submissions comments")
def q_full(fx):
    ch = C.channels(fx)
    return P.join_channels_full({"news": ch["news"], "submissions": ch["submissions"], "comments": ch["comments"]},
                                value="compound")


@register("join_symbol_compare", cte("fx_price") + """SELECT dt, """ + ", ".join(
    f"max(CASE WHEN symbol = '{s}' THEN close END) AS {s}_close" for s in ["S01", "S02", "S03"]) +
    " FROM fx_price WHERE symbol IN ('S01', 'S02', 'S03') GROUP BY dt", dbl="S01_close S02_close S03_close")
def q_compare(fx):
    w = P.join_symbol_compare(fx.fx_price, ["S01", "S02", "S03"], ["close"])
    return w.select("dt", *[F.col(s).alias(f"{s}_close") for s in ["S01", "S02", "S03"]])


_THREAD = cte("fx_thread") + """, posts AS (SELECT id, role FROM fx_thread WHERE turn = 0),
comments AS (SELECT id, post_id, length(text) AS score, text FROM fx_thread WHERE turn > 0)
"""


@register("top_child_join", _THREAD + """, best AS (SELECT post_id, id AS top_id, score AS top_score FROM comments
  QUALIFY row_number() OVER (PARTITION BY post_id ORDER BY score DESC, id) = 1)
SELECT p.id, p.role, b.top_id, b.top_score FROM posts p LEFT JOIN best b ON b.post_id = p.id""")
def q_top_child(fx):
    t = fx.fx_thread
    posts = t.filter(F.col("turn") == 0).select("id", "role")
    comments = t.filter(F.col("turn") > 0).select(F.col("id").alias("cid"), "post_id", F.length("text").alias("score"))
    out = P.top_child_join(posts, comments.withColumnRenamed("cid", "id"), "id", "post_id", "score", ["id", "score"], "id")
    return out.select("id", "role", F.col("top_id"), F.col("top_score"))


@register("join_post_meta", _THREAD + """SELECT c.id, c.post_id, coalesce(cast(p.id AS string), '') AS found_post_id,
  p.role AS post_role FROM comments c LEFT JOIN posts p ON p.id = c.post_id""")
def q_post_meta(fx):
    t = fx.fx_thread
    posts = t.filter(F.col("turn") == 0).select(F.col("id").alias("post_id"), "role")
    comments = t.filter(F.col("turn") > 0).select("id", "post_id")
    return P.join_post_meta(comments, posts, "post_id", {"role": "post_role"}).select("id", "post_id", "found_post_id", "post_role")


@register("union_symbols", cte("fx_price", "fx_event_day") + """, s AS (SELECT symbol FROM fx_price UNION SELECT symbol FROM fx_event_day),
r AS (SELECT min(dt) AS lo, max(dt) AS hi FROM (SELECT dt FROM fx_price UNION ALL SELECT dt FROM fx_event_day))
SELECT s.symbol, r.lo, r.hi FROM s, r""")
def q_union_symbols(fx):
    syms, rng = P.union_symbols([fx.fx_price.select("symbol", "dt"), fx.fx_event_day.select("symbol", "dt")])
    return syms.withColumns({"lo": rng.select("lo").scalar(), "hi": rng.select("hi").scalar()})


@register("union_files", C.PANEL_CTES + """
SELECT symbol, dt, s AS news, NULL::DOUBLE AS subs FROM ch_news UNION ALL SELECT symbol, dt, NULL::DOUBLE, s FROM ch_subs""",
          dbl="news subs")
def q_union_files(fx):
    ch = C.channels(fx)
    return P.union_files([ch["news"].select("symbol", "dt", F.col("compound").alias("news")),
                          ch["submissions"].select("symbol", "dt", F.col("compound").alias("subs"))])


@register("exact_dedup", cte("fx_post") + "SELECT DISTINCT post_id, symbol, subreddit, score FROM fx_post")
def q_exact_dedup(fx):
    return P.exact_dedup(fx.fx_post.select("post_id", "symbol", "subreddit", "score"))


@register("symbol_dimension", cte("fx_price") + """, dim AS (SELECT 'S' || lpad(cast(n_nationkey AS string), 2, '0') AS symbol,
  n_name AS name FROM nation)
SELECT p.symbol, p.dt, d.name FROM fx_price p LEFT JOIN dim d ON d.symbol = p.symbol""")
def q_symbol_dim(fx):
    dim = fx.table("nation").select(
        F.concat(F.lit("S"), F.lpad(F.col("n_nationkey").cast("string"), 2, "0")).alias("symbol"), F.col("n_name").alias("name"))
    return P.symbol_dimension(fx.fx_price.select("symbol", "dt"), dim)


# ----------------------------------------------------------------- scalars --

@register("utc_ms_to_day", "SELECT event_id, epoch_us(ts) // 1000 AS ms, cast(make_timestamp((epoch_us(ts) // 1000) * 1000) AS date) AS day FROM events")
def q_utc_ms(fx):
    e = fx.table("events").select("event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"))
    return e.withColumn("day", SC.utc_ms_to_day("ms"))


@register("strip_timezone_day", """SELECT event_id, cast(timezone('UTC', cast(strftime(ts, '%Y-%m-%dT%H:%M:%S') || '-07:00' AS TIMESTAMPTZ)) AS date) AS day
FROM events""")
def q_strip_tz(fx):
    e = fx.table("events").select("event_id", F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("-07:00")).alias("s"))
    return e.select("event_id", SC.strip_timezone_day("s").alias("day"))


@register("shift_days", cte("fx_event_day") + "SELECT symbol, dt, dt + 4 AS dt_shifted FROM fx_event_day")
def q_shift(fx):
    return fx.fx_event_day.select("symbol", "dt", SC.shift_days("dt", 4).alias("dt_shifted"))


@register("slug_terms", "SELECT doc_id, regexp_replace(text, '[^\\p{L}\\p{N}]', '_', 'g') AS slug FROM documents")
def q_slug_terms(fx):
    return fx.table("documents").select("doc_id", SC.slug_terms("text").alias("slug"))


@register("clean_security_name", """SELECT s_suppkey, """ + "".join("replace(" for _ in SC.SECURITY_NAME_STEPS) +
          "n_name || ' Inc. (Class A), Company of the Group plc & ''s (The) ' || s_name" + "".join(
              f", '{a.replace(chr(39), chr(39) * 2)}', '{b}')" for a, b in SC.SECURITY_NAME_STEPS) +
          " AS name FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def q_clean_name(fx):
    s = fx.table("supplier").join(fx.table("nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    raw = F.concat(F.col("n_name"), F.lit(" Inc. (Class A), Company of the Group plc & 's (The) "), F.col("s_name"))
    return s.select("s_suppkey", SC.clean_security_name(raw).alias("name"))


@register("tokenize_words", "SELECT doc_id, array_to_string(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+'), ' ') AS tokens FROM documents")
def q_tokenize(fx):
    return fx.table("documents").select("doc_id", SC.tokenize_words("text").alias("tokens"))


@register("log_return", cte("fx_price") + "SELECT symbol, dt, ln(close / open) AS lr FROM fx_price", dbl="lr")
def q_log_return(fx):
    return fx.fx_price.select("symbol", "dt", SC.log_return("close", "open").alias("lr"))


@register("clip_threshold_signal", cte("fx_post") + """SELECT post_id, l_linenumber, l_partkey,
  CASE WHEN compound IS NULL THEN NULL ELSE least(greatest(compound, -0.03), 0.03) END AS clipped,
  CASE WHEN compound > 0.01 THEN 1.0 ELSE 0.0 END AS signal FROM fx_post""", dbl="clipped signal")
def q_clip(fx):
    return fx.fx_post.select("post_id", "l_linenumber", "l_partkey", SC.clip("compound", -0.03, 0.03).alias("clipped"),
                             SC.threshold_signal("compound", 0.01).alias("signal"))


@register("rescale_rating", cte("fx_post") + """SELECT post_id, l_linenumber, l_partkey, (compound + 1) * 2 + 1 AS rating,
  pos - neg AS comp, (pos - neg) / sqrt((pos - neg) ^ 2 + 20) AS norm20, (pos - neg) / sqrt((pos - neg) ^ 2 + 3) AS norm3
FROM fx_post""", dbl="rating comp norm20 norm3")
def q_rescale(fx):
    p = fx.fx_post
    return p.select("post_id", "l_linenumber", "l_partkey", SC.rescale_rating("compound").alias("rating"),
                    SC.compound("pos", "neg").alias("comp"),
                    SC.normalised_compound(SC.compound("pos", "neg"), 20).alias("norm20"),
                    SC.normalised_compound(SC.compound("pos", "neg"), 3).alias("norm3"))


@register("filter_date_range", C.PANEL_CTES + """
SELECT symbol, dt FROM panel WHERE dt >= DATE '1996-01-01' AND dt <= DATE '1996-12-31' AND symbol IN ('S01', 'S05')
  AND news_sentiment <> 0""")
def q_filter_range(fx):
    p = filter_date_range(C.panel(fx), "1996-01-01", "1996-12-31")
    return filter_nonzero(filter_symbols(p, ["S01", "S05"]), "news_sentiment").select("symbol", "dt")
