"""Scoring."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import rescale_rating
from ..operators import scoring as SC
from . import common as C
from . import register, cte

# Test-only stand-in models (deterministic word lists) and lexicon.
POS_A, NEG_A = ["good", "great", "the", "und", "et"], ["bad", "poor", "de", "la", "der"]
POS_B, NEG_B = ["and", "que", "le", "die"], ["of", "en", "el", "das"]
LEXICON = [("good", 2.0), ("great", 3.0), ("bad", -2.5), ("poor", -2.0), ("the", 0.5), ("de", -0.5), ("und", 1.0),
           ("la", -1.0)]


def model_a():
    return SC.WordListModel(POS_A, NEG_A)


def model_b():
    return SC.WordListModel(POS_B, NEG_B)


def _inlist(words):
    return ", ".join(f"'{w}'" for w in words)


TOK_SQL = """tok AS (SELECT doc_id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+') AS tokens FROM documents),
ch AS (SELECT doc_id, g.i // 256 AS chunk, list_slice(tokens, g.i + 1, g.i + 512) AS chunk_tokens
       FROM tok, generate_series(0, len(tokens) - 1, 256) AS g(i) WHERE len(tokens) > 0
       UNION ALL SELECT doc_id, NULL, NULL FROM tok WHERE coalesce(len(tokens), 0) = 0),
ch2 AS (SELECT *, coalesce(len(chunk_tokens), 0) AS n_tokens FROM ch)"""


def _score_sql(name, pos, neg):
    return f"""{name} AS (SELECT doc_id, chunk, n_tokens,
  len(list_filter(chunk_tokens, lambda x: x IN ({_inlist(neg)}))) / n_tokens AS s_neg,
  (n_tokens - len(list_filter(chunk_tokens, lambda x: x IN ({_inlist(pos)}))) - len(list_filter(chunk_tokens, lambda x: x IN ({_inlist(neg)})))) / n_tokens AS s_neu,
  len(list_filter(chunk_tokens, lambda x: x IN ({_inlist(pos)}))) / n_tokens AS s_pos FROM ch2)"""


def _softmax_sql(src, name):
    return f"""{name} AS (SELECT doc_id, chunk, n_tokens,
  exp(s_neg - greatest(s_neg, s_neu, s_pos)) / (exp(s_neg - greatest(s_neg, s_neu, s_pos)) + exp(s_neu - greatest(s_neg, s_neu, s_pos)) + exp(s_pos - greatest(s_neg, s_neu, s_pos))) AS s_neg,
  exp(s_neu - greatest(s_neg, s_neu, s_pos)) / (exp(s_neg - greatest(s_neg, s_neu, s_pos)) + exp(s_neu - greatest(s_neg, s_neu, s_pos)) + exp(s_pos - greatest(s_neg, s_neu, s_pos))) AS s_neu,
  exp(s_pos - greatest(s_neg, s_neu, s_pos)) / (exp(s_neg - greatest(s_neg, s_neu, s_pos)) + exp(s_neu - greatest(s_neg, s_neu, s_pos)) + exp(s_pos - greatest(s_neg, s_neu, s_pos))) AS s_pos
  FROM {src})"""


def _agg_sql(src, name, out, k=20):
    return f"""{name} AS (SELECT doc_id, sum(s_neg * n_tokens) / sum(n_tokens) AS {out}neg, sum(s_neu * n_tokens) / sum(n_tokens) AS {out}neu,
  sum(s_pos * n_tokens) / sum(n_tokens) AS {out}pos FROM {src} GROUP BY doc_id),
{name}c AS (SELECT *, {out}pos - {out}neg AS {out}compound,
  ({out}pos - {out}neg) / sqrt(({out}pos - {out}neg) ^ 2 + {k}) AS {out}normalised_compound FROM {name})"""


def _chunks(fx):
    d = fx.table("documents").select("doc_id", SC.tokens_col("text").alias("tokens"))
    return SC.chunk_tokens(d, "doc_id", "tokens", 512, 256)


@register("chunk_tokens", "WITH " + TOK_SQL + """
SELECT doc_id, chunk, n_tokens, array_to_string(chunk_tokens, ' ') AS text FROM ch2""")
def q_chunk(fx):
    return _chunks(fx).select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("n_tokens").cast("bigint").alias("n_tokens"),
                              F.array_join("chunk_tokens", " ").alias("text"))


@register("score_chunks", "WITH " + TOK_SQL + ",\n" + _score_sql("sa", POS_A, NEG_A) + "\nSELECT * FROM sa",
          dbl="s_neg s_neu s_pos")
def q_score_chunks(fx):
    s = SC.score_chunks(_chunks(fx), model_a, model_key="model_a")
    return s.select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), F.col("n_tokens").cast("bigint").alias("n_tokens"),
                    "s_neg", "s_neu", "s_pos")


@register("softmax3", "WITH " + TOK_SQL + ",\n" + _score_sql("sa", POS_A, NEG_A) + ",\n" + _softmax_sql("sa", "sm") +
          "\nSELECT doc_id, chunk, s_neg, s_neu, s_pos FROM sm", dbl="s_neg s_neu s_pos")
def q_softmax(fx):
    s = SC.score_chunks(_chunks(fx), model_a, model_key="model_a")
    return s.withColumns(SC.softmax3()).select("doc_id", F.col("chunk").cast("bigint").alias("chunk"), "s_neg", "s_neu", "s_pos")


@register("aggregate_chunks", "WITH " + TOK_SQL + ",\n" + _score_sql("sa", POS_A, NEG_A) + ",\n" +
          _agg_sql("sa", "ag", "roberta_") + "\nSELECT * FROM agc",
          dbl="roberta_neg roberta_neu roberta_pos roberta_compound roberta_normalised_compound")
def q_aggregate(fx):
    s = SC.score_chunks(_chunks(fx), model_a, model_key="model_a")
    return SC.aggregate_chunks(s, "doc_id", k=20.0)


@register("ensemble_score", "WITH " + TOK_SQL + ",\n" + _score_sql("sa", POS_A, NEG_A) + ",\n" + _score_sql("sb", POS_B, NEG_B) +
          ",\n" + _softmax_sql("sa", "ma") + ",\n" + _softmax_sql("sb", "mb") + ",\n" + _agg_sql("ma", "a1", "m1_") + ",\n" +
          _agg_sql("mb", "a2", "m2_") + """
SELECT a1c.doc_id, (m1_pos + m2_pos) / 2 AS ensemble_pos, (m1_neu + m2_neu) / 2 AS ensemble_neu, (m1_neg + m2_neg) / 2 AS ensemble_neg,
  m1_normalised_compound AS normalised_compound_1, m2_normalised_compound AS normalised_compound_2,
  (m1_normalised_compound * 3 + m2_normalised_compound * 2) / 5 AS avg_compound,
  (m1_pos + m2_pos - m1_neg - m2_neg) / sqrt((m1_pos + m2_pos - m1_neg - m2_neg) ^ 2 + 20) AS normalised_compound
FROM a1c JOIN a2c ON a1c.doc_id = a2c.doc_id""",
          dbl="ensemble_pos ensemble_neu ensemble_neg normalised_compound_1 normalised_compound_2 avg_compound normalised_compound")
def q_ensemble(fx):
    d = fx.table("documents").select("doc_id", SC.tokens_col("text").alias("tokens"))
    scored = SC.score_documents(d, "doc_id", "tokens", {"a": model_a, "b": model_b})
    return SC.ensemble_score(scored.withColumns(SC.softmax3("a_")).withColumns(SC.softmax3("b_")), "doc_id", ("a", "b"), k=20.0)


LEX_SQL = """lex AS (SELECT * FROM (VALUES """ + ", ".join(f"('{w}', {v}::DOUBLE)" for w, v in LEXICON) + """) AS t(word, valence)),
w AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]+')) AS word FROM documents),
j AS (SELECT w.doc_id, l.valence FROM w LEFT JOIN lex l ON l.word = w.word),
a AS (SELECT doc_id, coalesce(sum(CASE WHEN valence > 0 THEN valence + 1 END), 0) AS p,
  coalesce(sum(CASE WHEN valence < 0 THEN 1 - valence END), 0) AS n, count_if(valence IS NULL OR valence = 0) AS u,
  coalesce(sum(valence), 0) AS s FROM j GROUP BY 1),
lx AS (SELECT d.doc_id, coalesce(p / nullif(p + n + u, 0), 0) + 1e-6 AS lex_pos, coalesce(u / nullif(p + n + u, 0), 0) + 1e-6 AS lex_neu,
  coalesce(n / nullif(p + n + u, 0), 0) + 1e-6 AS lex_neg, coalesce(s / sqrt(s * s + 15), 0) + 1e-6 AS lex_compound
  FROM documents d LEFT JOIN a ON a.doc_id = d.doc_id)"""


def _lexicon(fx):
    return fx.spark.createDataFrame(LEXICON, "word string, valence double")


@register("lexicon_score", "WITH " + LEX_SQL + "\nSELECT * FROM lx", dbl="lex_pos lex_neu lex_neg lex_compound")
def q_lexicon(fx):
    return SC.lexicon_score(fx.table("documents"), "doc_id", "text", _lexicon(fx))


@register("score_trend", cte("fx_article") + f""", a AS (SELECT domain, dt, {C.ARTICLE_SCORE_SQL} AS score FROM fx_article)
SELECT domain, regr_slope(score, datediff('day', DATE '0001-01-01', dt) + 1) AS slope,
  regr_intercept(score, datediff('day', DATE '0001-01-01', dt) + 1) AS intercept, count(score) AS n FROM a GROUP BY domain""",
          dbl="slope intercept", digits=5)
def q_trend(fx):
    return SC.score_trend(C.articles(fx), "score", "dt", "domain")


@register("score_error", cte("fx_article") + ", " + LEX_SQL + f""",
r AS (SELECT l.quality * 4 + 1 AS rating, ({C.ARTICLE_SCORE_SQL} + 1) * 2 + 1 AS m_article, (lx.lex_compound + 1) * 2 + 1 AS m_lexicon
      FROM labels l JOIN fx_article a ON a.doc_id = l.doc_id JOIN lx ON lx.doc_id = l.doc_id),
u AS (SELECT rating, 'm_article' AS model, m_article AS pred FROM r UNION ALL SELECT rating, 'm_lexicon', m_lexicon FROM r)
SELECT model, avg(abs(pred - rating)) AS mae, sqrt(avg((pred - rating) ^ 2)) AS rmse, count(pred - rating) AS n FROM u GROUP BY model""",
          dbl="mae rmse")
def q_error(fx):
    lx = SC.lexicon_score(fx.table("documents"), "doc_id", "text", _lexicon(fx))
    a = C.articles(fx).select("doc_id", rescale_rating("score").alias("m_article"))
    lab = fx.table("labels").select("doc_id", (F.col("quality") * 4 + 1).alias("rating"))
    j = lab.join(a, ["doc_id"]).join(lx.select("doc_id", rescale_rating("lex_compound").alias("m_lexicon")), ["doc_id"])
    return SC.score_error(j, "rating", ["m_article", "m_lexicon"])
