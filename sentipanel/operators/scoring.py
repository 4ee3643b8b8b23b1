"""Sentiment scoring: chunking, pluggable model inference, aggregation.

* ``chunk_tokens``: overlapping windows (starts 0, stride, 2*stride, ... while
  start < n; each at most ``size`` tokens) as a higher-order array expression
  + posexplode -- no Python.
* ``score_chunks``: an Arrow iterator feeds batches of chunks to a model
  built ONCE per Python worker (factory result cached in the worker process),
  returning three class scores [neg, neu, pos] per chunk and no tokens.
* ``score_documents``: chunks cut inside the iterator and scored by several
  models in one pass.
* ``aggregate_chunks``: token-length-weighted means per document (a grouped
  aggregate), then compound scores.
"""

from __future__ import annotations

from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalars import normalised_compound, word_array
from .panel import bounded_broadcast

CLASSES = ("neg", "neu", "pos")


def tokens_col(text: str) -> Column:
    """Default tokenizer: lower-cased unicode word runs (model tokenizers plug in
    through ``score_chunks``)."""
    return word_array(text)


def chunk_tokens(df: DataFrame, doc: str, tokens: str, size: int = 512, stride: int = 256) -> DataFrame:
    """(doc, chunk, tokens, n_tokens): windows tokens[i : i+size] for i = 0, stride, ...  A document without tokens has one row, with
    null chunk and tokens and 0 tokens."""
    assert size > 0 and stride > 0
    n = F.size(tokens)
    starts = F.when(n > 0, F.sequence(F.lit(0), n - 1, F.lit(stride))).otherwise(F.array().cast("array<int>"))
    windows = F.transform(starts, lambda i: F.slice(F.col(tokens), i + 1, F.lit(size)))
    return (df.select(doc, F.posexplode_outer(windows).alias("chunk", "chunk_tokens"))
              .withColumn("n_tokens", F.when(F.col("chunk").isNull(), F.lit(0)).otherwise(F.size("chunk_tokens"))))


class WordListModel:
    """Deterministic stand-in model: [neg, neu, pos] = counts of words in two
    lists over the chunk length.  Any object with ``__call__(list[list[str]])
    -> ndarray (n, 3)`` plugs in the same way (e.g. an ONNX transformer)."""

    def __init__(self, pos_words, neg_words):
        self.pos = frozenset(pos_words)
        self.neg = frozenset(neg_words)

    def __call__(self, chunks) -> np.ndarray:
        out = np.zeros((len(chunks), 3))
        for r, toks in enumerate(chunks):
            toks = list(toks) if toks is not None else []
            n = len(toks)
            if n == 0:
                out[r] = np.nan
                continue
            p = sum(1 for t in toks if t in self.pos)
            q = sum(1 for t in toks if t in self.neg)
            out[r] = [q / n, (n - p - q) / n, p / n]
        return out


_MODEL_CACHE: dict = {}


def _model(key: str, factory: Callable[[], Callable]) -> Callable:
    """The worker's model of this key, built once."""
    if key not in _MODEL_CACHE:
        _MODEL_CACHE[key] = factory()
    return _MODEL_CACHE[key]


def _score_arrays(scores: np.ndarray) -> list[pa.Array]:
    return [pa.array(scores[:, j], mask=np.isnan(scores[:, j])) for j in range(len(CLASSES))]


def score_chunks(chunks: DataFrame, model_factory: Callable[[], Callable], tokens: str = "chunk_tokens",
                 prefix: str = "s_", model_key: str | None = None) -> DataFrame:
    """The chunks without their tokens and with {prefix}neg/neu/pos, the model run on Arrow batches.  Chunks without tokens have
    null scores."""
    key = model_key or repr(model_factory)
    kept = [f for f in chunks.schema.fields if f.name != tokens]
    names = [f.name for f in kept]
    schema = T.StructType([*kept, *[T.StructField(f"{prefix}{c}", T.DoubleType()) for c in CLASSES]])

    def run(batches):
        model = _model(key, model_factory)
        for b in batches:
            scores = np.asarray(model(b.column(tokens).to_pylist()), dtype=float).reshape(-1, len(CLASSES))
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in names], *_score_arrays(scores)], schema.fieldNames())

    return chunks.mapInArrow(run, schema)


def score_documents(df: DataFrame, doc: str, tokens: str, models: dict[str, Callable[[], Callable]], size: int = 512, stride: int = 256,
                    batch: int = 256) -> DataFrame:
    """(doc, chunk, n_tokens, {model}_neg, _neu, _pos): every chunk scored by every model in one pass.

    Chunks are cut inside the Arrow iterator and fed to all models, ``batch`` at a time; only ids and scores come back.  A
    document without tokens has one row with null chunk and scores.
    """
    assert size > 0 and stride > 0
    kind = df.schema[doc].dataType
    cols = [f"{m}_{c}" for m in models for c in CLASSES]
    schema = T.StructType([T.StructField(doc, kind), T.StructField("chunk", T.IntegerType()), T.StructField("n_tokens", T.IntegerType()),
                           *[T.StructField(c, T.DoubleType()) for c in cols]])

    def run(batches):
        ready = {m: _model(f"{m}:{f!r}", f) for m, f in models.items()}

        def scored(rows, ids):
            """rows: (place in the batch, chunk or none, its tokens)"""
            real = [t for _, _, t in rows if t]
            out = []
            for m in ready.values():
                s = np.full((len(rows), len(CLASSES)), np.nan)
                if real:
                    s[[i for i, r in enumerate(rows) if r[2]]] = np.asarray(m(real), dtype=float)
                out += _score_arrays(s)
            at = pa.array([r[0] for r in rows], pa.int64())
            return pa.RecordBatch.from_arrays([ids.take(at), pa.array([r[1] for r in rows], pa.int32()), pa.array([len(r[2]) for r in rows], pa.int32()), *out], schema.fieldNames())
        for b in batches:
            rows = []
            for i, t in enumerate(b.column(tokens)):
                words = t.as_py() or []
                rows += [(i, k, words[at:at + size]) for k, at in enumerate(range(0, len(words), stride))] or [(i, None, [])]
                while len(rows) >= batch:
                    yield scored(rows[:batch], b.column(doc))
                    rows = rows[batch:]
            if rows:
                yield scored(rows, b.column(doc))
    return df.select(doc, tokens).mapInArrow(run, schema)


def softmax3(prefix: str = "s_") -> dict[str, Column]:
    """Softmax over the three class columns (max-shifted)."""
    cs = [F.col(f"{prefix}{c}") for c in CLASSES]
    m = F.greatest(*cs)
    ex = [F.exp(c - m) for c in cs]
    tot = ex[0] + ex[1] + ex[2]
    return {f"{prefix}{c}": ex[i] / tot for i, c in enumerate(CLASSES)}


def aggregate_chunks(scored: DataFrame, doc: str, prefix: str = "s_", k: float = 20.0, out: str = "roberta_") -> DataFrame:
    """Token-length-weighted mean of chunk scores per document + compounds.
    Documents with no tokens get NULL scores (instead of a zero-weight error)."""
    w = F.col("n_tokens").cast("double")
    aggs = [F.try_divide(F.sum(F.col(f"{prefix}{c}") * w), F.sum(w)).alias(f"{out}{name}")
            for c, name in zip(CLASSES, ("neg", "neu", "pos"))]
    agg = scored.groupBy(doc).agg(*aggs)
    comp = F.col(f"{out}pos") - F.col(f"{out}neg")
    return agg.withColumn(f"{out}compound", comp).withColumn(f"{out}normalised_compound", normalised_compound(comp, k))


def ensemble_score(scored: DataFrame, doc: str, models: tuple[str, str], k: float = 20.0) -> DataFrame:
    """Two models' chunk scores ({model}_neg, _neu, _pos per chunk, n_tokens): per-model weighted means in one aggregate,
    each normalised compound, their 3:2 blend and the compound of the sums.  A document without tokens has nulls."""
    w = F.col("n_tokens").cast("double")
    mean = lambda m, c: F.try_divide(F.sum(F.col(f"{m}_{c}") * w), F.sum(w))
    j = scored.groupBy(doc).agg(*[mean(m, c).alias(f"m{i}_{c}") for i, m in enumerate(models, 1) for c in CLASSES])
    one = lambda i: normalised_compound(F.col(f"m{i}_pos") - F.col(f"m{i}_neg"), k)
    both = F.col("m1_pos") + F.col("m2_pos") - F.col("m1_neg") - F.col("m2_neg")
    return j.select(doc, *[((F.col(f"m1_{c}") + F.col(f"m2_{c}")) / 2).alias(f"ensemble_{c}") for c in ("pos", "neu", "neg")],
                    one(1).alias("normalised_compound_1"), one(2).alias("normalised_compound_2"),
                    ((one(1) * 3 + one(2) * 2) / 5).alias("avg_compound"), normalised_compound(both, k).alias("normalised_compound"))


def lexicon_score(df: DataFrame, doc: str, text: str, lexicon: DataFrame, alpha: float = 15.0,
                  eps: float = 1e-6) -> DataFrame:
    """Rule/lexicon scores (re-aimed valence model): words -> broadcast lexicon
    join -> per document pos/neu/neg shares and a normalised compound, each + eps.

    pos = sum(v+1 | v>0), neg = sum(1-v | v<0), neu = #words without valence;
    shares = each / (pos + neg + neu); compound = s / sqrt(s^2 + alpha), s = sum(v).
    """
    words = df.select(doc, F.explode(word_array(text)).alias("word"))
    lex = bounded_broadcast(lexicon.select("word", "valence"), max_rows=1_000_000)
    j = words.join(lex, ["word"], "left")
    v = F.col("valence")
    agg = j.groupBy(doc).agg(F.sum(F.when(v > 0, v + 1)).alias("__p"), F.sum(F.when(v < 0, 1 - v)).alias("__n"),
                             F.count_if(v.isNull() | (v == 0)).alias("__u"), F.sum(v).alias("__s"))
    p, n, u = F.coalesce("__p", F.lit(0.0)), F.coalesce("__n", F.lit(0.0)), F.col("__u").cast("double")
    tot = p + n + u
    s = F.coalesce("__s", F.lit(0.0))
    out = agg.select(doc, (F.coalesce(F.try_divide(p, tot), F.lit(0.0)) + eps).alias("lex_pos"),
                     (F.coalesce(F.try_divide(u, tot), F.lit(0.0)) + eps).alias("lex_neu"),
                     (F.coalesce(F.try_divide(n, tot), F.lit(0.0)) + eps).alias("lex_neg"),
                     (s / F.sqrt(s * s + F.lit(alpha)) + eps).alias("lex_compound"))
    # documents without any word still get a row
    docs = df.select(doc)
    return docs.join(out, [doc], "left").fillna({"lex_pos": eps, "lex_neu": eps, "lex_neg": eps, "lex_compound": eps})


def score_trend(df: DataFrame, score: str, day: str = "dt", key: str | None = None) -> DataFrame:
    """Least-squares line of score on the ordinal date (day 1 = 0001-01-01)."""
    x = (F.datediff(F.col(day), F.lit("0001-01-01").cast("date")) + 1).cast("double")
    g = df.groupBy(key) if key else df.groupBy()
    return g.agg(F.regr_slope(F.col(score), x).alias("slope"), F.regr_intercept(F.col(score), x).alias("intercept"),
                 F.count(F.col(score)).alias("n"))


def score_error(df: DataFrame, rating: str, models: list[str]) -> DataFrame:
    """MAE and RMSE of each model column against a human rating (long output)."""
    long = df.select(rating, F.explode(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).cast("double").alias("pred"))
                                                 for m in models])).alias("__m")).select(rating, "__m.model", "__m.pred")
    d = F.col("pred") - F.col(rating)
    return long.groupBy("model").agg(F.avg(F.abs(d)).alias("mae"), F.sqrt(F.avg(d * d)).alias("rmse"),
                                     F.count(d).alias("n"))
