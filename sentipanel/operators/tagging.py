"""Dictionary tagging: cut texts into per-ticker segments.

Rule (what the reference computes):
* a mention may start at position 0 or right after one of  space tab newline " (
* it must end at the end of the text or before one of  space tab newline " ) : ? ! .
* case-sensitive; several terms may match at one start, they act in length order;
* an empty current ticker adopts the first mention's ticker (the text before it
  joins that ticker); a cut happens only when the ticker changes and emits the
  text so far, even when empty; the last piece is emitted only if non-empty.

Spark plan, row by row and without an exchange of texts:
1. a text is split after each start character into pieces (every mention starts a piece, every segment is a run of whole pieces), and
   one regex pass gives every piece's key, its prefix up to the first end character;
2. the term table, within a checked row bound, is a constant: an array of hash buckets of (length, term, ticker).  A key's bucket is
   one array access; its terms are verified against the piece and the pieces after it;
3. a match whose ticker differs from the match before it is a boundary; segments are joined slices of the pieces.
Everything is built-in array functions on the row itself, so ids may repeat, rows of any number may share an id, and a hot id
gathers nowhere.  A term table beyond the bound is joined instead (:func:`_tag_by_join`).
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .panel import bounded_broadcast

START_CHARS = " \t\n\"("
END_CHARS = " \t\n\"):?!."
_SPLIT_RE = r'(?<=[ \t\n"(])'
_KEY_RE = r'^[^ \t\n"):?!.]*'
_KEYS_RE = r'((?:^|(?<=[ \t\n"(]))[^ \t\n"():?!.]*\(?)'  # the same at every piece: "(" ends a piece and belongs to its key
INDEX_ROWS = 100_000  # terms that are kept as a constant of the plan
_END_CLASS = '[ \t\n"):?!.]'


# ----------------------------------------------------------- dictionary ----

def term_table(dictionary: DataFrame, symbol: str = "symbol", terms: str = "search_terms",
               row_no: str = "row_no", sep: str = "|") -> DataFrame:
    """(symbol, 'a|b|c') rows -> (term, ticker); a term shared by several rows
    goes to the LATER row (largest ``row_no``).  Empty terms are dropped."""
    exploded = dictionary.select(F.col(row_no), F.col(symbol).alias("ticker"),
                                 F.explode(F.split(F.col(terms), "\\" + sep if sep in "|.^$*+?()[]{}\\" else sep)).alias("term"))
    exploded = exploded.filter(F.length("term") > 0)
    return exploded.groupBy("term").agg(F.max_by("ticker", F.col(row_no)).alias("ticker"))


# Fixed values (must equal the reference): tickers that are ordinary words and
# only get their "$" forms.
NEWS_IGNORE = ["AFL", "A", "ARE", "ALL", "T", "BA", "C", "COP", "COO", "DAY", "DG", "D",
               "EL", "FAST", "F", "IT", "GM", "HAS", "HD", "ICE", "IP", "J", "K", "L", "MAS",
               "MS", "NI", "NSC", "ON", "PH", "PM", "PSA", "O", "ROK", "NOW", "SW", "USB", "V"]


def _variants(x):
    """x, lower, upper and, unless x ends in 's', their plurals (upper gets 'S')."""
    base = F.array(x, F.lower(x), F.upper(x))
    plural = F.array(F.concat(x, F.lit("s")), F.concat(F.lower(x), F.lit("s")), F.concat(F.upper(x), F.lit("S")))
    return F.when(x.isNull() | (F.length(x) == 0), F.array().cast("array<string>")).when(
        F.substring(x, -1, 1) != "s", F.concat(base, plural)).otherwise(base)


def expand_search_terms(stock_list: DataFrame, symbol="symbol", security="security", search_terms="search_terms",
                        ignore: list[str] = NEWS_IGNORE, sep: str = "/") -> DataFrame:
    """(symbol, security, 'a/b') -> distinct (symbol, term) search terms."""
    sym = F.col(symbol)
    sym_terms = F.when(sym.isin(ignore), F.array(F.concat(F.lit("$"), sym), F.concat(F.lit("$"), sym, F.lit("s")))) \
                 .otherwise(F.array(sym, F.concat(sym, F.lit("s")), F.concat(F.lit("$"), sym), F.concat(F.lit("$"), sym, F.lit("s"))))
    sym_terms = F.when(sym.isNull() | (F.length(sym) == 0), F.array().cast("array<string>")).otherwise(sym_terms)
    extra = F.transform(F.split(F.coalesce(F.col(search_terms), F.lit("")), sep), lambda t: F.trim(t))
    extra_terms = F.flatten(F.transform(extra, lambda t: _variants(t)))
    allt = F.array_distinct(F.concat(sym_terms, _variants(F.col(security)), extra_terms))
    return stock_list.select(F.col(symbol).alias("symbol"), F.explode(allt).alias("term")).filter(F.length("term") > 0)


# -------------------------------------------------------------- matching ----

def _max_start_chars(terms: DataFrame) -> int:
    # one tiny aggregate over the (bounded) term table
    v = terms.select(F.max(F.length(F.regexp_replace("term", r'[^ \t\n"(]', "")))).first()[0]
    return int(v or 0)


class TermIndex:
    """A bounded term table as hash buckets: ``bucket(key)`` is the array of its (n, term, ticker), shortest first."""

    def __init__(self, rows: list):
        size = 1 << max(4, (2 * len(rows)).bit_length())
        buckets = [[] for _ in range(size)]
        for r in sorted(rows, key=lambda r: (r["n"], r["ticker"], r["term"])):
            buckets[r["h"] % size].append({"n": r["n"], "term": r["term"], "ticker": r["ticker"]})
        self.size = size
        # folded to one literal when the plan is optimised
        self.buckets = F.from_json(F.lit(json.dumps(buckets)), "array<array<struct<n:int,term:string,ticker:string>>>")
        self.reach = max((sum(c in START_CHARS for c in r["term"]) for r in rows), default=0) + 2  # pieces that a term and the character after it can span

    @classmethod
    def of(cls, terms: DataFrame, max_rows: int = INDEX_ROWS) -> "TermIndex | None":
        """The index, or none if there are more terms than the bound."""
        rows = terms.select("term", "ticker", F.length("term").alias("n"), F.xxhash64(F.regexp_extract("term", _KEY_RE, 0)).alias("h")).where(
            "term is not null and ticker is not null").limit(max_rows + 1).collect()
        return cls(rows) if len(rows) <= max_rows else None

    def bucket(self, key: Column) -> Column:
        return F.element_at(self.buckets, (F.pmod(F.xxhash64(key), F.lit(self.size)) + 1).cast("int"))


def settled(df: DataFrame, **new: Column) -> DataFrame:
    """``df`` with new columns that are computed once a row.  An expression that later appears in a lambda might be moved into it and run for
    every element of an array; nothing moves below a generator, so the new row is a generated one."""
    row = F.struct(*[F.col(f"`{c}`") for c in df.columns if c not in new], *[c.alias(name) for name, c in new.items()])
    return df.select(F.explode(F.array(row)).alias("__row")).select("__row.*")


def with_matches(df: DataFrame, index: TermIndex, text: str) -> DataFrame:
    """``df`` with ``__pieces`` of the text and ``__m``, its matches (pos, n, ticker) by piece and length."""
    whole = F.coalesce(F.col(text), F.lit(""))
    df = settled(df, __pieces=F.split(whole, _SPLIT_RE), __keys=F.regexp_extract_all(whole, F.lit(_KEYS_RE)))
    hits = F.filter(F.transform("__keys", lambda k, i: F.when(F.size(index.bucket(k)) > 0, i)), lambda i: i.isNotNull())
    df = df.withColumn("__hits", hits)
    near = F.transform("__hits", lambda i: F.struct(i.alias("pos"), F.element_at(F.col("__keys"), i + 1).alias("key"),
                                                    F.array_join(F.slice("__pieces", i + 1, index.reach), "").alias("ctx")))
    df = df.withColumn("__hits", near)

    def verified(h):
        after = lambda c: F.substring(h["ctx"], c["n"] + 1, F.lit(1))
        fits = F.filter(index.bucket(h["key"]), lambda c: F.startswith(h["ctx"], c["term"]) & ((after(c) == "") | F.lit(END_CHARS).contains(after(c))))
        return F.transform(fits, lambda c: F.struct(h["pos"].alias("pos"), c["n"].alias("n"), c["ticker"].alias("ticker")))
    return settled(df.withColumn("__m", F.flatten(F.transform("__hits", verified))).drop("__keys", "__hits"))


def with_segments(df: DataFrame, index: TermIndex, text: str, start: Column | None = None) -> DataFrame:
    """``df`` with ``__m`` and ``__segs``, the text's segments (ticker, text) in order from the start ticker."""
    df = with_matches(df, index, text)
    m = F.col("__m")
    first = F.get(m, F.lit(0))["ticker"]
    init = F.coalesce(F.nullif(start, F.lit("")), first, F.lit("")) if start is not None else F.coalesce(first, F.lit(""))
    df = settled(df, __init=init)
    before = lambda j: F.when(j == 0, F.col("__init")).otherwise(F.get(m, j - 1)["ticker"])
    df = settled(df, __cuts=F.filter("__m", lambda x, j: x["ticker"] != before(j)))
    cut = F.col("__cuts")
    begin = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(cut, j - 1)["pos"])
    end = lambda j: F.coalesce(F.get(cut, j)["pos"], F.size("__pieces"))
    owners = F.concat(F.array("__init"), F.col("__cuts.ticker"))
    segs = F.transform(owners, lambda t, j: F.struct(t.alias("ticker"), F.array_join(F.slice("__pieces", begin(j) + 1, end(j) - begin(j)), "").alias("text")))
    df = settled(df, __segs=segs).drop("__init", "__cuts")
    empty = F.element_at("__segs", -1)["text"] == ""
    return df.withColumn("__segs", F.when(empty, F.slice("__segs", 1, F.size("__segs") - 1)).otherwise(F.col("__segs")))


def _pieces(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, pos, off, piece): pieces after start characters with code-point offsets."""
    p = docs.select(F.col(doc).alias("__doc"), F.posexplode(F.split(F.coalesce(F.col(text), F.lit("")), _SPLIT_RE)).alias("pos", "piece"))
    w = Window.partitionBy("__doc").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    return p.withColumn("off", F.coalesce(F.sum(F.length("piece")).over(w), F.lit(0)))


def find_mentions(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text", max_rows: int = INDEX_ROWS) -> DataFrame:
    """(doc, pos, off, n, ticker): every valid mention of every term; ``pos`` counts pieces, ``off`` characters."""
    index = TermIndex.of(terms, max_rows)
    if index is None:
        return _mentions_by_join(docs, terms, doc, text)
    df = with_matches(docs.select(F.col(doc).alias("__doc"), F.col(text).alias("__text")), index, "__text")
    # characters from one match to the next; their running sum is over matches, not over the text
    since = lambda j: F.when(j == 0, F.lit(0)).otherwise(F.get(F.col("__m"), j - 1)["pos"])
    gaps = F.transform("__m", lambda x, j: F.length(F.array_join(F.slice("__pieces", since(j) + 1, x["pos"] - since(j)), "")).cast("long"))
    df = settled(df.where(F.size("__m") > 0), __gaps=gaps)
    off = lambda j: F.aggregate(F.slice("__gaps", 1, j + 1), F.lit(0).cast("long"), lambda a, g: a + g)
    df = df.select("__doc", F.explode(F.transform("__m", lambda x, j: F.struct(x["pos"].alias("pos"), off(j).alias("off"), x["n"].alias("n"), x["ticker"].alias("ticker")))).alias("x"))
    return df.select("__doc", "x.*")


def _mentions_by_join(docs: DataFrame, terms: DataFrame, doc: str, text: str) -> DataFrame:
    """:func:`find_mentions` for a term table of any size."""
    k = _max_start_chars(terms) + 2
    pieces = _pieces(docs, doc, text)
    w = Window.partitionBy("__doc").orderBy("pos")
    ctx = F.concat(F.col("piece"), *[F.coalesce(F.lead("piece", j).over(w), F.lit("")) for j in range(1, k)])
    cand = pieces.withColumn("ctx", ctx).withColumn("key", F.regexp_extract("piece", _KEY_RE, 0))
    t = terms.select("term", "ticker").withColumn("key", F.regexp_extract("term", _KEY_RE, 0))
    t = bounded_broadcast(t, max_rows=2_000_000)
    m = cand.join(t, ["key"], "inner")
    n = F.length("term")
    nxt = F.substring(F.col("ctx"), n + 1, 1)
    ok = F.startswith(F.col("ctx"), F.col("term")) & ((nxt == "") | nxt.rlike("^" + _END_CLASS))
    return m.filter(ok).select("__doc", "pos", "off", n.alias("n"), "ticker")


def tag_segments(docs: DataFrame, terms: DataFrame, doc: str = "doc_id", text: str = "text",
                 start: str | None = None, max_rows: int = INDEX_ROWS) -> DataFrame:
    """Cut each text at every ticker change.

    Output: (doc, seg, ticker, text) with ``seg`` the 0-based segment order.
    ``start`` names a column holding the start ticker ('' or NULL = none).

    Ids may repeat: every row gets its own segments.  With at most ``max_rows`` terms nothing is exchanged.
    """
    index = TermIndex.of(terms, max_rows)
    if index is None:
        return _tag_by_join(docs, terms, doc, text, start)
    df = docs.select(F.col(doc).alias("__doc"), F.col(text).alias("__text"), (F.col(start) if start else F.lit("")).alias("__start"))
    df = with_segments(df, index, "__text", F.col("__start")).select("__doc", F.posexplode("__segs").alias("seg", "s"))
    return df.select(F.col("__doc").alias(doc), F.col("seg").cast("bigint").alias("seg"), "s.ticker", "s.text")


def _tag_by_join(docs: DataFrame, terms: DataFrame, doc: str, text: str, start: str | None) -> DataFrame:
    """:func:`tag_segments` for a term table of any size: one shuffle of whole rows by (id, digest, running number among
    equal rows) -> pieces -> LEFT join with the terms (keeps every piece) -> one window per row ordered by (piece, match
    length) marks boundaries and segment ids -> aggregate per (row, segment), which re-uses the partitioning.
    """
    k = _max_start_chars(terms) + 2
    st = F.coalesce(F.col(start), F.lit("")) if start else F.lit("")
    rows = docs.select(F.col(doc).alias("__doc"), st.alias("__start"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    rows = rows.withColumn("__h", F.md5(F.concat_ws("\n", "__start", "__text").cast("binary")))
    # equal rows are interchangeable, so any order numbers them alike on a re-run
    rows = rows.withColumn("__no", F.row_number().over(Window.partitionBy("__doc", "__h").orderBy("__start")))
    row = ["__doc", "__h", "__no"]
    # a NULL marker piece first: segment 0 always has a row (it may be empty)
    pieces = F.concat(F.array(F.lit(None).cast("string")), F.split("__text", _SPLIT_RE))
    p = rows.select(*row, "__start", F.posexplode(pieces).alias("pos", "piece"))
    w = Window.partitionBy(*row).orderBy("pos")
    ctx = F.concat(F.col("piece"), *[F.coalesce(F.lead("piece", j).over(w), F.lit("")) for j in range(1, k)])
    p = p.withColumn("ctx", ctx).withColumn("key", F.regexp_extract("piece", _KEY_RE, 0))
    t = terms.select("term", "ticker").withColumn("key", F.regexp_extract("term", _KEY_RE, 0))
    t = bounded_broadcast(t, max_rows=2_000_000)
    j = p.join(t, ["key"], "left")
    n = F.length("term")
    nxt = F.substring(F.col("ctx"), n + 1, 1)
    ok = F.col("term").isNotNull() & F.startswith(F.col("ctx"), F.col("term")) & ((nxt == "") | nxt.rlike("^" + _END_CLASS))
    j = j.select(*row, "__start", "pos", "piece",
                 F.when(ok, n).otherwise(F.lit(0)).alias("n"), F.when(ok, F.col("ticker")).alias("mt"))
    # one ordered pass per document over (piece, match length): unverified
    # candidates sort first within a piece (n = 0), the piece's last row
    # carries the piece text
    wd = Window.partitionBy(*row).orderBy("pos", "n")
    full = wd.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    prev = F.last("mt", ignorenulls=True).over(wd.rowsBetween(Window.unboundedPreceding, -1))
    j = j.withColumns({
        "__first": F.first("mt", ignorenulls=True).over(full),
        "__lastpos": F.coalesce(F.lead("pos").over(wd), F.lit(-1)) != F.col("pos"),
        "__bound": F.col("mt").isNotNull() & (F.col("mt") != F.coalesce(prev, F.nullif(F.col("__start"), F.lit("")), F.col("mt"))),
    })
    j = j.filter(F.col("mt").isNotNull() | F.col("__lastpos")).withColumn("txt", F.when(F.col("__lastpos"), F.col("piece")))
    j = j.withColumn("seg", F.sum(F.col("__bound").cast("int")).over(wd.rowsBetween(Window.unboundedPreceding, 0)))
    j = j.withColumn("__last", F.max("seg").over(full))
    init = F.when(F.col("__start") != "", F.col("__start")).otherwise(F.coalesce(F.col("__first"), F.lit("")))
    seg = (j.groupBy(*row, "seg")
             .agg(F.coalesce(F.max(F.when(F.col("__bound"), F.col("mt"))), F.first(init)).alias("ticker"),
                  F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("txt").isNotNull(), F.struct("pos", "txt")))),
                                           lambda x: x["txt"]), "").alias("text"),
                  F.max(F.col("seg") == F.col("__last")).alias("__is_last")))
    seg = seg.filter(~(F.col("__is_last") & (F.length("text") == 0))).drop("__is_last")
    return seg.select(F.col("__doc").alias(doc), F.col("seg").cast("bigint").alias("seg"), "ticker", "text")


def dominant_ticker(segments: DataFrame, doc: str = "doc_id") -> DataFrame:
    """Per document the ticker with the most UTF-8 bytes of (non-'') segment
    text; '' when none has any bytes; ties -> smallest ticker.  Two chained
    aggregates (the second re-uses the first's partitioning by document)."""
    sizes = segments.groupBy(doc, "ticker").agg(F.sum(F.octet_length("text")).alias("size"))
    valid = (F.col("ticker") != "") & (F.col("size") > 0)
    best = sizes.groupBy(doc).agg(F.min_by(F.when(valid, F.col("ticker")),
                                           F.when(valid, F.struct(-F.col("size"), F.col("ticker")))).alias("dominant"))
    return best.select(doc, F.coalesce(F.col("dominant"), F.lit("")).alias("dominant"))


def tag_news(news: DataFrame, terms: DataFrame, doc: str = "url", title: str = "title", body: str = "body",
             keep: tuple = ("domain", "dt")) -> DataFrame:
    """Tag title + newline + body from an empty start; drop '' segments.  ``doc`` and ``keep`` travel with
    each row, so repeated or empty urls neither mix texts nor multiply rows."""
    tt = F.concat_ws("\n", F.coalesce(F.col(title), F.lit("")), F.coalesce(F.col(body), F.lit("")))
    t = news.select(F.struct(doc, *keep).alias("__row"), tt.alias("__tt"))
    seg = tag_segments(t, terms, doc="__row", text="__tt").filter(F.col("ticker") != "")
    return seg.select(F.col(f"__row.{doc}").alias(doc), "seg", F.col("ticker").alias("symbol"), "text",
                      *[F.col(f"__row.{k}").alias(k) for k in keep])


def tag_submissions(posts: DataFrame, terms: DataFrame, doc: str = "id", title: str = "title", body: str = "body",
                    keep: tuple = ("domain", "flair", "subreddit", "score", "downs", "dt")) -> DataFrame:
    return tag_news(posts, terms, doc=doc, title=title, body=body, keep=keep)
