"""Tagging, dictionary and thread queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import tagging as T
from . import register, cte

START_SET = "(' ', chr(9), chr(10), '\"', '(')"
END_SET = "(' ', chr(9), chr(10), '\"', ')', ':', '?', '!', '.')"


def tag_sql(src: str, terms: str = "fx_terms") -> str:
    """CTE chain (brute force, per character) producing ``segs`` and ``mentions``
    from ``src(doc_id, text, start)``; independent of the Spark plan."""
    return f""",
d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(start, '') AS start, string_split(coalesce(text, ''), '') AS ch,
             length(coalesce(text, '')) AS len FROM {src}),
pos AS (SELECT doc_id, g.i FROM d, generate_series(1, d.len) AS g(i) WHERE g.i = 1 OR d.ch[g.i - 1] IN {START_SET}),
mentions AS (SELECT p.doc_id, p.i, length(t.term) AS n, t.ticker FROM pos p JOIN d ON d.doc_id = p.doc_id
      JOIN {terms} t ON d.ch[p.i] = substr(t.term, 1, 1)
      WHERE array_to_string(list_slice(d.ch, p.i, p.i + length(t.term) - 1), '') = t.term
        AND (p.i + length(t.term) - 1 = d.len OR d.ch[p.i + length(t.term)] IN {END_SET})),
mm AS (SELECT m.*, d.start, coalesce(lag(m.ticker) OVER (PARTITION BY m.doc_id ORDER BY m.i, m.n), nullif(d.start, ''), m.ticker) AS prev
       FROM mentions m JOIN d ON d.doc_id = m.doc_id),
firsts AS (SELECT doc_id, arg_min(ticker, i * 100000 + n) AS first_t FROM mentions GROUP BY 1),
b AS (SELECT doc_id, i, n, ticker FROM mm WHERE ticker <> prev
      UNION ALL
      SELECT d.doc_id, 1 AS i, 0 AS n, CASE WHEN d.start <> '' THEN d.start ELSE coalesce(f.first_t, '') END
      FROM d LEFT JOIN firsts f ON f.doc_id = d.doc_id),
bs AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, n) - 1 AS seg,
              lead(i) OVER (PARTITION BY doc_id ORDER BY i, n) AS next_i, count(*) OVER (PARTITION BY doc_id) AS nseg FROM b),
segs0 AS (SELECT bs.doc_id, bs.seg, bs.ticker, array_to_string(list_slice(d.ch, bs.i, coalesce(bs.next_i, d.len + 1) - 1), '') AS text,
                 bs.seg = bs.nseg - 1 AS is_last FROM bs JOIN d ON d.doc_id = bs.doc_id),
segs AS (SELECT doc_id, seg, ticker, text FROM segs0 WHERE NOT (is_last AND length(text) = 0)),
sizes AS (SELECT doc_id, ticker, sum(strlen(text)) AS size FROM segs WHERE ticker <> '' GROUP BY 1, 2 HAVING sum(strlen(text)) > 0),
dom AS (SELECT d.doc_id, coalesce(s.ticker, '') AS dominant FROM d LEFT JOIN
        (SELECT * FROM sizes QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY size DESC, ticker) = 1) s ON s.doc_id = d.doc_id)
"""


ART_TAG = cte("fx_article", "fx_terms") + ", src AS (SELECT doc_id, text, '' AS start FROM fx_article)" + tag_sql("src")


@register("dictionary_match_join", ART_TAG + "SELECT doc_id, i - 1 AS off, n, ticker FROM mentions")
def q_mentions(fx):
    m = T.find_mentions(fx.fx_article, fx.fx_terms, "doc_id", "text")
    return m.select(F.col("__doc").alias("doc_id"), F.col("off").cast("bigint").alias("off"),
                    F.col("n").cast("bigint").alias("n"), "ticker")


@register("tag_segments", ART_TAG + "SELECT * FROM segs")
def q_tag_segments(fx):
    return T.tag_segments(fx.fx_article, fx.fx_terms, "doc_id", "text")


@register("tag_segments_start", cte("fx_article", "fx_terms") + """, src AS (SELECT doc_id, text,
  CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'AAA' ELSE 'ZZZ' END AS start FROM fx_article)""" + tag_sql("src") +
          "SELECT * FROM segs")
def q_tag_segments_start(fx):
    a = fx.fx_article.withColumn("start", F.expr("CASE doc_id % 3 WHEN 0 THEN '' WHEN 1 THEN 'AAA' ELSE 'ZZZ' END"))
    return T.tag_segments(a, fx.fx_terms, "doc_id", "text", start="start")


@register("dominant_ticker", ART_TAG + "SELECT * FROM dom")
def q_dominant(fx):
    seg = T.tag_segments(fx.fx_article, fx.fx_terms, "doc_id", "text")
    docs = fx.fx_article.select("doc_id")
    dom = T.dominant_ticker(seg, "doc_id")
    return docs.join(dom, ["doc_id"], "left").select("doc_id", F.coalesce("dominant", F.lit("")).alias("dominant"))


@register("tag_news", cte("fx_article", "fx_terms") + """, src AS (SELECT doc_id, domain || chr(10) || text AS text, '' AS start
  FROM fx_article)""" + tag_sql("src") + """SELECT s.doc_id, s.seg, s.text, s.ticker AS symbol, a.url, a.domain, a.dt
FROM segs s JOIN fx_article a ON a.doc_id = s.doc_id WHERE s.ticker <> ''""")
def q_tag_news(fx):
    return T.tag_news(fx.fx_article, fx.fx_terms, doc="doc_id", title="domain", body="text", keep=("url", "domain", "dt"))


_DICT_SRC = """SELECT n_nationkey AS row_no, substr(n_name, 1, 3) AS symbol,
  n_name || '|' || lower(n_name) || '|' || r_name || '|' AS search_terms
FROM nation JOIN region ON n_regionkey = r_regionkey"""


@register("term_table", f"""WITH dict AS ({_DICT_SRC}),
x AS (SELECT row_no, symbol AS ticker, unnest(string_split(search_terms, '|')) AS term FROM dict)
SELECT term, arg_max(ticker, row_no) AS ticker FROM x WHERE length(term) > 0 GROUP BY term""")
def q_term_table(fx):
    return T.term_table(fx.spark.sql(_DICT_SRC))


_STOCK_SRC = """SELECT CASE WHEN s_suppkey % 5 = 0 THEN 'ALL' ELSE 'S' || cast(s_suppkey AS string) END AS symbol,
  CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE n_name END AS security,
  CASE WHEN s_suppkey % 3 = 0 THEN NULL ELSE lower(n_name) || '/ Supplier Co/' || s_name || '/ /glass' END AS search_terms
FROM supplier JOIN nation ON s_nationkey = n_nationkey"""


def _var_sql(x: str) -> str:
    return (f"CASE WHEN {x} IS NULL OR length({x}) = 0 THEN []::VARCHAR[] WHEN right({x}, 1) <> 's' THEN "
            f"[{x}, lower({x}), upper({x}), {x} || 's', lower({x}) || 's', upper({x}) || 'S'] "
            f"ELSE [{x}, lower({x}), upper({x})] END")


@register("expand_search_terms", f"""WITH st AS ({_STOCK_SRC}),
x AS (SELECT symbol, list_distinct(list_concat(
  CASE WHEN symbol IN ({", ".join(repr(s) for s in T.NEWS_IGNORE)}) THEN ['$' || symbol, '$' || symbol || 's']
       ELSE [symbol, symbol || 's', '$' || symbol, '$' || symbol || 's'] END,
  {_var_sql("security")},
  flatten(list_transform(string_split(coalesce(search_terms, ''), '/'), lambda t: {_var_sql("trim(t)")})))) AS terms FROM st)
SELECT DISTINCT symbol, unnest(terms) AS term FROM x""")
def q_expand(fx):
    return T.expand_search_terms(fx.spark.sql(_STOCK_SRC)).distinct()


# ---------------------------------------------------------------- threads --

from ..operators import threads as TH  # noqa: E402

_STARTS = ["", "AAA", "BBB", "CCC", "DDD", "EEE", "FFF", "GGG"]


def _thread_frames(fx):
    t = fx.fx_thread
    posts = t.filter(F.col("turn") == 0).select("id", F.concat(F.lit("\n"), F.col("text")).alias("text"), "role")
    comments = t.filter(F.col("turn") > 0).select("id", "parent_id", "post_id", F.col("turn").alias("dt"), "text")
    return posts, comments


THREAD_SQL = cte("fx_thread", "fx_terms").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
starts AS (SELECT * FROM (VALUES {", ".join(f"({i}, '{s}')" for i, s in enumerate(_STARTS))}) AS t(s_idx, s)),
posts AS (SELECT id, chr(10) || text AS text, role FROM fx_thread WHERE turn = 0),
comments AS (SELECT id, parent_id, post_id, turn AS dt, text FROM fx_thread WHERE turn > 0),
src AS (SELECT id * 10 + 9 AS doc_id, text, '' AS start FROM posts
        UNION ALL SELECT c.id * 10 + s.s_idx, c.text, s.s FROM comments c, starts s)""" + tag_sql("src") + """,
res AS (
  SELECT p.id, CAST(NULL AS BIGINT) AS parent_id, '' AS start_ticker, d.dominant, 0 AS lvl FROM posts p JOIN dom d ON d.doc_id = p.id * 10 + 9
  UNION ALL
  SELECT c.id, c.parent_id, r.dominant, d.dominant, r.lvl + 1 FROM res r JOIN comments c ON c.parent_id = r.id
    JOIN starts s ON s.s = r.dominant JOIN dom d ON d.doc_id = c.id * 10 + s.s_idx),
resolved AS (SELECT id, parent_id, start_ticker, dominant FROM res WHERE lvl > 0)
"""


@register("propagate_thread_ticker", THREAD_SQL + "SELECT * FROM resolved")
def q_propagate(fx):
    posts, comments = _thread_frames(fx)
    return TH.propagate_thread_ticker(posts, comments, fx.fx_terms)


@register("thread_match_rate", THREAD_SQL + """SELECT count_if(start_ticker <> '') AS matches, count(*) AS comments,
  count_if(start_ticker <> '') / count(*) AS rate FROM resolved""", dbl="rate")
def q_match_rate(fx):
    posts, comments = _thread_frames(fx)
    return TH.thread_match_rate(TH.propagate_thread_ticker(posts, comments, fx.fx_terms))


@register("tag_comments", THREAD_SQL + """SELECT r.id, sg.seg, sg.ticker, sg.text, r.parent_id, r.start_ticker,
  coalesce(cast(p.id AS string), '') AS found_post_id, p.role AS post_role
FROM resolved r JOIN starts s ON s.s = r.start_ticker JOIN segs sg ON sg.doc_id = r.id * 10 + s.s_idx
JOIN comments c ON c.id = r.id LEFT JOIN posts p ON p.id = c.post_id WHERE sg.ticker <> ''""")
def q_tag_comments(fx):
    posts, comments = _thread_frames(fx)
    return TH.tag_comments(posts, comments, fx.fx_terms, post_meta={"role": "post_role"})
