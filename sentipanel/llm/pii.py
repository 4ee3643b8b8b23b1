"""Personal data: base patterns, and terms that disclose a protected entity.

Base spans are found by pattern.  Every base value is a protected entity.  Corpus co-occurrence then
estimates how strongly a term reveals an entity: with P(e|t) the share of a term's occurrences
that lie within ``window`` words of entity e, and IC(e) = -log2 P(e) the information of the entity,

    disclosure(t, e) = PMI(t; e) / IC(e) = 1 + log2 P(e|t) / IC(e)

is 1 for a term that only occurs beside e and 0 for one that is independent of it.  Terms at or above
``generalise`` are replaced by the entity's kind, terms at or above ``remove`` are deleted, wherever they
occur.  A term counts only with ``min_docs`` documents that show it beside the entity.

Everything is DataFrame functions.  Context rows are linear in the entities found; term counts are
pre-aggregated; no pairs of terms are built.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, broadcast_if_small, cut_lineage, drop_clashing, text_of

# Leftmost non-overlapping matches are those of the plain patterns in the comments.  A match can only begin where
# its run of characters begins or where the last match ended (\G), and possessive runs never backtrack, so
# long runs cost linear time.
PATTERNS = {
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    # [0-9]([\x20-]?[0-9])+ of 13 digits or more: a chain's ends do not depend on where it is entered
    "card": r"(?=[0-9](?:[\x20-]?+[0-9]){12})[0-9]++(?:[\x20-][0-9]++)*+",
    # \+[0-9][\x20().0-9-]+[0-9]
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}  # a character that every match holds
PART = r"0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])"
TERM = r"^[\p{L}\p{M}'’-]{3,}[.,;:!?]*$"
RESULTS = ["n_email", "n_ip", "n_card", "n_phone", "base_spans", "term_spans", "sanitised"]


def _luhn(digits: Column) -> Column:
    d = F.regexp_extract_all(F.reverse(digits), F.lit("([0-9])"), 1)
    double = lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise((c.cast("int") * 2) % 10 + (c.cast("int") >= 5).cast("int"))
    return F.aggregate(F.transform(d, double), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, hit: Column) -> Column:
    digits = F.regexp_replace(hit, r"[^0-9]", "")
    if kind == "ip":
        return hit.rlike(rf"^{PART}\.{PART}\.{PART}\.{PART}$")
    if kind == "card":
        return F.length(digits).between(13, 19) & _luhn(digits)
    if kind == "phone":
        return F.length(digits).between(9, 15)
    return F.lit(True)


def _located(text: Column, pattern: Column) -> tuple[Column, Column]:
    """Pieces between the matches, and (start, end, value) of each match; positions in code points."""
    pieces = F.split(text, pattern, -1)
    hits = F.regexp_extract_all(text, pattern, F.lit(0))
    return pieces, hits


SPAN = "array<struct<start:bigint,end:bigint,value:string>>"


def _spans(pieces: Column, hits: Column) -> Column:
    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(SPAN).alias("out"))

    def step(a, x):
        s = a["at"] + F.length(x["p"])
        e = s + F.length(x["h"])
        return F.struct(e.alias("at"), F.concat(a["out"], F.array(F.struct(s.alias("start"), e.alias("end"), x["h"].alias("value")))).alias("out"))
    zipped = F.zip_with(F.slice(pieces, 1, F.size(hits)), hits, lambda p, h: F.struct(p.alias("p"), h.alias("h")))
    return F.aggregate(zipped, start, step, lambda a: a["out"])


def base_spans(docs: DataFrame, text: str) -> DataFrame:
    """Adds one array of (start, end, value) per kind, ``__email`` and so on."""
    for kind, pattern in PATTERNS.items():
        pieces, hits = _located(F.col(text), F.lit(pattern))
        docs = docs.withColumns({"__p": F.when(F.col(text).contains(NEEDS[kind]), pieces), "__m": F.when(F.col(text).contains(NEEDS[kind]), hits)})
        found = F.when(F.size("__m") > 0, F.filter(_spans(F.col("__p"), F.col("__m")), lambda s: _valid(kind, s["value"])))
        docs = docs.withColumn(f"__{kind}", F.coalesce(found, F.array().cast(SPAN))).drop("__p", "__m")
    return docs


def _words(text: Column) -> Column:
    return F.split(F.lower(text), f"[{SPACE}]+")


def contexts(docs: DataFrame, text: str, window: int) -> DataFrame:
    """(entity, kind, doc, term) for every word within ``window`` words of a base span.

    The words come from the pieces of text before and after the span; a fragment that touches a span is no word.
    """
    parts = []
    for kind in PATTERNS:
        piece = lambda at, to: F.substring(F.concat(F.lit(" "), F.col(text), F.lit(" ")), at, to)
        d = docs.where(F.size(f"__{kind}") > 0).select("__id", text, F.explode(f"__{kind}").alias("s"))
        reach = window * 24  # characters enough for the window; the cut word at the far end is dropped with the fragment
        before = F.split(F.lower(piece(F.greatest(F.lit(1).cast("long"), F.col("s.start") + 2 - reach).cast("int"),
                                       F.least(F.lit(reach).cast("long"), F.col("s.start") + 1).cast("int"))), f"[{SPACE}]+")
        after = F.split(F.lower(piece((F.col("s.end") + 2).cast("int"), F.lit(reach))), f"[{SPACE}]+")
        inner = lambda a: F.slice(a, 2, F.greatest(F.size(a) - 2, F.lit(0)))
        near = F.concat(F.reverse(F.slice(F.reverse(inner(before)), 1, window)), F.slice(inner(after), 1, window))
        parts.append(d.select("__id", F.lit(kind).alias("kind"), F.col("s.value").alias("entity"),
                              F.explode(F.filter(near, lambda w: w.rlike(TERM))).alias("term")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def disclosing_terms(docs: DataFrame, text: str, window: int = 4, min_docs: int = 3, generalise: float = 0.95,
                     remove: float = 0.99, broadcast_rows: int = 200_000) -> DataFrame:
    """term, kind, disclosure, removed: the terms that reveal a protected entity in this corpus.

    ``docs`` holds ``__id``, the text and the arrays of :func:`base_spans`.
    """
    near = (contexts(docs, text, window).groupBy("kind", "entity", "term", "__id").agg(F.count(F.lit(1)).alias("n"))
            .groupBy("kind", "entity", "term").agg(F.sum("n").alias("n_te"), F.count(F.lit(1)).alias("docs")).where(F.col("docs") >= min_docs))
    near = cut_lineage(near)
    entities = None
    for kind in PATTERNS:
        e = docs.select(F.lit(kind).alias("kind"), F.explode(f"__{kind}.value").alias("entity"))
        entities = e if entities is None else entities.unionByName(e)
    n_entity = entities.groupBy("kind", "entity").agg(F.count(F.lit(1)).alias("n_e"))
    words = docs.select(F.explode(_words(F.col(text))).alias("term"))
    cands, small = broadcast_if_small(cut_lineage(near.select("term").distinct()), broadcast_rows)
    counts = (words.join(cands, "term").groupBy("term") if small else words.groupBy("term")).agg(F.count(F.lit(1)).alias("n_t"))
    total = docs.agg(F.sum(F.size(_words(F.col(text)))).alias("n")).first()["n"] or 1
    info = -F.log2(F.col("n_e") / F.lit(float(total)))
    p = F.least(F.lit(1.0), F.col("n_te") / F.col("n_t"))
    scored = (near.join(n_entity, ["kind", "entity"]).join(counts, "term")
                  .withColumn("disclosure", F.when(info > 0, 1 + F.log2(p) / info)).where(F.col("disclosure") >= generalise))
    best = scored.groupBy("term").agg(F.max(F.struct("disclosure", "kind")).alias("b"))
    return best.select("term", F.col("b.kind").alias("kind"), F.col("b.disclosure").alias("disclosure"), (F.col("b.disclosure") >= remove).alias("removed"))


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 4, min_docs: int = 3,
             generalise: float = 0.95, remove: float = 0.99, broadcast_rows: int = 200_000) -> DataFrame:
    """Personal data and disclosing terms of every document.

    Returns the input's columns without the text, plus ``n_email``, ``n_ip``, ``n_card``, ``n_phone``, ``base_spans`` and
    ``term_spans`` (arrays of kind, start, end, value; code points, end exclusive; base spans by kind as
    listed, then start) and ``sanitised``: base spans become ``[KIND]``, disclosing terms ``[KIND TERM]`` or nothing.
    Null text counts as empty and has no spans.  Repeated rows have equal results, null ids share
    one set of terms, an empty table gives an empty result, and input columns named like a result are replaced.
    """
    d = drop_clashing(docs, RESULTS)
    keep = [c for c in d.columns if c != text_col]
    d = base_spans(d.select(*keep, F.col(id_col).alias("__id"), text_of(text_col).alias("__t")), "__t")
    terms = cut_lineage(disclosing_terms(d, "__t", window, min_docs, generalise, remove, broadcast_rows))
    terms, _ = broadcast_if_small(terms, broadcast_rows)
    # which documents hold a disclosing term: distinct words against the table; only hits are grouped
    held = (d.select("__id", F.explode(F.array_distinct(_words(F.col("__t")))).alias("term")).join(terms, "term")
             .groupBy("__id").agg(F.sort_array(F.collect_set(F.struct("term", "kind", "removed"))).alias("__terms")))
    held, _ = broadcast_if_small(cut_lineage(held), 50_000)
    held = held.withColumnRenamed("__id", "__hid")
    d = d.join(held, d["__id"].eqNullSafe(held["__hid"]), "left").drop("__hid")

    alternatives = F.array_join(F.transform("__terms", lambda t: F.concat(F.lit("\\Q"), t["term"], F.lit("\\E"))), "|")
    pattern = F.concat(F.lit(f"(?iu)(?<![^{SPACE}])(?:"), alternatives, F.lit(f")(?![^{SPACE}])"))
    pieces, hits = _located(F.col("__t"), F.col("__re"))
    d = d.withColumn("__re", F.when(F.col("__terms").isNotNull(), pattern))
    d = d.withColumns({"__tp": F.when(F.col("__re").isNotNull(), pieces), "__tm": F.when(F.col("__re").isNotNull(), hits)})
    found = F.coalesce(F.when(F.size("__tm") > 0, _spans(F.col("__tp"), F.col("__tm"))), F.array().cast(SPAN))
    named = lambda kind, arr: F.transform(arr, lambda s: F.struct(F.lit(kind).alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value")))
    d = d.withColumns({"base_spans": F.concat(*[named(k, F.col(f"__{k}")) for k in PATTERNS]), "term_spans": named("term", found)})

    def replacement(s):
        t = F.get(F.filter("__terms", lambda t: t["term"] == F.lower(s["value"])), F.lit(0))
        term = F.when(t["removed"], "").otherwise(F.concat(F.lit("["), F.upper(F.coalesce(t["kind"], F.lit(""))), F.lit(" TERM]")))
        return F.when(s["kind"] == "term", term).otherwise(F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]")))
    cuts = F.array_sort(F.transform(F.concat("base_spans", "term_spans"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), replacement(s).alias("to"))))
    rest = lambda a, n: F.substring(F.col("__t"), (a + 1).cast("int"), n.cast("int"))
    clean = F.aggregate(cuts, F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out")),
                        lambda a, s: F.struct(F.greatest(a["at"], s["end"]).alias("at"),
                                              F.concat(a["out"], rest(a["at"], F.greatest(s["start"] - a["at"], F.lit(0))),
                                                       F.when(s["start"] >= a["at"], s["to"]).otherwise("")).alias("out")),
                        lambda a: F.concat(a["out"], rest(a["at"], F.length("__t"))))
    return d.select(*keep, *[F.size(f"__{k}").cast("long").alias(f"n_{k}") for k in PATTERNS], "base_spans", "term_spans", clean.alias("sanitised"))
