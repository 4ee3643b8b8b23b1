"""Comment threads: a comment starts with the dominant ticker of the post or
comment it answers (if that parent came earlier), and passes its own dominant
ticker on.

Plan:
1. every text is matched once, on its row, for an as yet unknown start ticker: the text before its first mention, the segments from there
   on, and the bytes per ticker.  These are checkpointed; nothing is matched again;
2. what a comment makes of a start ticker is a small function: its value at a few tickers, and elsewhere either the start ticker itself (below a
   bound, as ties go to the smaller ticker) or a fixed one.  Such functions can be composed, so
   pointers double: each round a comment takes over the function and the parent of the comment it points to, and a chain of
   n comments is done after log2(n) rounds, each one join and one checkpoint;
3. segments follow from the stored parts and the start ticker.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .tagging import INDEX_ROWS, TermIndex, settled, tag_segments, with_segments

RULE = "struct<pts:map<string,string>,steps:array<struct<low:string,value:string>>>"
RULE_ARROW = pa.struct([("pts", pa.map_(pa.string(), pa.string())), ("steps", pa.list_(pa.struct([("low", pa.string()), ("value", pa.string())])))])
BYTES = "map<string,bigint>"


def with_profile(df: DataFrame, terms: DataFrame, id_col: str = "id", text: str = "text", max_rows: int = INDEX_ROWS) -> DataFrame:
    """``df`` with ``__p``: t_first, lead (the text before the first mention), segs (ticker, text) from the first mention on, sizes (bytes
    per ticker from an empty start), lead_bytes and n_bytes."""
    index = TermIndex.of(terms, max_rows)
    whole = F.coalesce(F.col(text), F.lit(""))
    if index is None:
        # a term table beyond the bound: texts are matched by a join, once per different text
        texts = df.select(whole.alias("__whole")).distinct().withColumn("__h", F.sha2("__whole", 256))
        seg = tag_segments(texts.withColumn("__none", F.lit("\x00")), terms, "__h", "__whole", start="__none", max_rows=max_rows)
        seg = seg.groupBy("__h").agg(F.array_sort(F.collect_list(F.struct("seg", "ticker", "text"))).alias("s"))
        df = df.withColumn("__h", F.sha2(whole, 256)).join(seg, "__h", "left").drop("__h")
        cuts = F.coalesce(F.transform("s", lambda x: F.struct(x["ticker"].alias("ticker"), x["text"].alias("text"))), F.array())
        df = df.withColumn("__segs", cuts.cast("array<struct<ticker:string,text:string>>")).drop("s")
    else:
        # an impossible start ticker: the first mention is then always a cut
        df = with_segments(df, index, text, F.lit("\x00")).drop("__pieces", "__m")
    segs = F.col("__segs")
    lead = F.when((F.size(segs) > 0) & (F.get(segs, F.lit(0))["ticker"] == "\x00"), F.get(segs, F.lit(0))["text"]).otherwise(F.lit(""))
    df = settled(df, __lead=lead, __segs=F.filter(segs, lambda x: x["ticker"] != "\x00"))
    first = F.get(F.col("__segs"), F.lit(0))["ticker"]
    own = lambda t: F.aggregate(F.filter("__segs", lambda x: x["ticker"] == t), F.lit(0).cast("long"), lambda n, x: n + F.octet_length(x["text"]))
    sizes = F.transform(F.array_distinct("__segs.ticker"), lambda t: F.struct(t, own(t) + F.when(t == first, F.octet_length("__lead")).otherwise(F.lit(0))))
    profile = F.struct(first.alias("t_first"), F.col("__lead").alias("lead"), F.col("__segs").alias("segs"), F.map_from_entries(sizes).cast(BYTES).alias("sizes"),
                       F.octet_length("__lead").cast("long").alias("lead_bytes"), F.octet_length(whole).cast("long").alias("n_bytes"))
    return df.withColumn("__p", profile).drop("__lead", "__segs")


def comment_profiles(comments: DataFrame, terms: DataFrame, id_col: str = "id", text: str = "text") -> DataFrame:
    """(id, sizes map<ticker, bytes>, t_first, lead_bytes, n_bytes)."""
    df = with_profile(comments.select(id_col, F.col(text).alias("__text")), terms, id_col, "__text")
    return df.select(id_col, "__p.sizes", "__p.t_first", "__p.lead_bytes", "__p.n_bytes")


def _best(sizes: Column) -> Column:
    """The ticker with the most bytes, the smallest of equals; '' if none has any."""
    order = F.array_sort(F.filter(sizes, lambda e: e["v"] > 0), lambda a, b: F.when(a["v"] > b["v"], -1).when(a["v"] < b["v"], 1)
                         .when(a["k"] < b["k"], -1).when(a["k"] > b["k"], 1).otherwise(0))
    return F.coalesce(F.get(order, F.lit(0))["k"], F.lit(""))


def dominant_under_start(sizes, t_first, lead, n_bytes, start):
    """Dominant ticker of a profiled text when tagged from ``start``: its leading bytes belong to the start
    ticker, if there is one, else to the first mention's."""
    owner = F.when(start != "", start).otherwise(t_first)
    moved = F.transform(F.map_entries(sizes), lambda e: F.struct(
        e["key"].alias("k"), (e["value"] + F.when(e["key"] == owner, lead).otherwise(F.lit(0)) - F.when(e["key"] == t_first, lead).otherwise(F.lit(0))).alias("v")))
    new = F.when((start != "") & ~F.array_contains(F.map_keys(sizes), start), F.array(F.struct(start.alias("k"), lead.alias("v"))))
    found = F.concat(moved, F.coalesce(new, F.array().cast("array<struct<k:string,v:bigint>>")))
    return F.when(t_first.isNotNull(), _best(found)).when((start != "") & (n_bytes > 0), start).otherwise(F.lit(""))


# ------------------------------------------------- start -> dominant as functions --

def value_at(rule: dict, start: str) -> str:
    """A rule's ticker for a start ticker: its point, else the last step at or below the start, else the start itself."""
    if start in rule["pts"]:
        return rule["pts"][start]
    at = bisect_right([low for low, _ in rule["steps"]], start)
    return rule["steps"][at - 1][1] if at else start


def rule_of(sizes: dict[str, int], t_first: str | None, lead: int, n_bytes: int) -> dict:
    """The rule of a profiled text.  Start tickers that its text does not mention only compare with the others by their leading bytes."""
    if t_first is None:
        return {"pts": {}, "steps": [] if n_bytes else [("", "")]}
    best = lambda s: min(((-v, k) for k, v in s.items() if v > 0), default=(0, ""))
    bare = sizes | {t_first: sizes[t_first] - lead}
    pts = {k: best(bare | {k: bare[k] + lead})[1] for k in sizes} | {"": best(sizes)[1]}
    most, other = best(bare)
    if lead and (not most or lead > -most):
        steps = []
    elif lead and lead == -most:
        steps = [(other, other)]
    else:
        steps = [("", other)]
    return {"pts": pts, "steps": steps}


def composed(then: dict, first: dict) -> dict:
    """The rule that applies ``first``, then ``then``."""
    steps = first["steps"]
    lows = [low for low, _ in then["steps"]]
    below = then["steps"] if not steps else then["steps"][:bisect_left(lows, steps[0][0])]  # where ``first`` hands on the start itself
    out = []
    for low, value in [*below, *((low, value_at(then, value)) for low, value in steps)]:
        if not out or out[-1][1] != value:
            out.append((low, value))
    pts = {k: value_at(then, v) for k, v in first["pts"].items()}
    pts |= {k: v for k, v in then["pts"].items() if k not in pts and (not steps or k < steps[0][0])}
    whole = {"pts": {}, "steps": out}
    return {"pts": {k: v for k, v in pts.items() if value_at(whole, k) != v}, "steps": out}


def _read(rule: dict | None) -> dict | None:
    return rule and {"pts": dict(rule["pts"]), "steps": [(s["low"], s["value"]) for s in rule["steps"]]}


def _written(rules: list[dict | None]) -> pa.Array:
    return pa.array([r and {"pts": list(r["pts"].items()), "steps": [{"low": a, "value": b} for a, b in r["steps"]]} for r in rules], RULE_ARROW)


def _with_rules(df: DataFrame) -> DataFrame:
    """(id, ptr, rule) of rows (id, ptr, known, p): a known dominant is a rule of its own."""
    kind = df.schema["id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rules = []
            for known, *p in zip(*(b.column(c).to_pylist() for c in ("known", "sizes", "t_first", "lead_bytes", "n_bytes"))):
                rules.append({"pts": {}, "steps": [("", known)]} if known is not None else rule_of(dict(p[0]), *p[1:]))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("ptr"), _written(rules)], ["id", "ptr", "rule"])
    return df.mapInArrow(run, f"id {kind}, ptr {kind}, rule {RULE}")


def _compose(df: DataFrame) -> DataFrame:
    """(id, ptr, rule) of rows (id, rule, up_ptr, up_rule): the rule after the one of the row pointed to."""
    kind = df.schema["id"].dataType.simpleString()

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            rules = [composed(_read(r), _read(u)) for r, u in zip(b.column("rule").to_pylist(), b.column("up_rule").to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("up_ptr"), _written(rules)], ["id", "ptr", "rule"])
    return df.select("id", "up_ptr", "rule", "up_rule").mapInArrow(run, f"id {kind}, ptr {kind}, rule {RULE}")


def pointer_double(rules: DataFrame) -> tuple[DataFrame, int]:
    """((id, dominant), rounds) of rows (id, ptr, rule): a rule is applied to the dominant of the row pointed to; without a
    pointer the rule is a known dominant.  Pointers have no cycle and lead to rows."""
    rules = cut_lineage(rules)
    parts, open_, rounds = [rules.where("ptr is null")], rules.where("ptr is not null"), 0
    while not open_.isEmpty():
        rounds += 1
        ups = _all([*parts, open_]).select(F.col("id").alias("__up"), F.col("ptr").alias("up_ptr"), F.col("rule").alias("up_rule"))
        step = cut_lineage(_compose(open_.join(ups, F.col("ptr") == F.col("__up"))))
        parts.append(step.where("ptr is null"))
        open_ = step.where("ptr is not null")
    known = F.get(F.col("rule.steps"), F.lit(0))["value"]
    return _all(parts).select("id", F.coalesce(F.element_at("rule.pts", F.lit("")), known, F.lit("")).alias("dominant")), rounds


def _all(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _last_by_id(df: DataFrame, *cols: str) -> DataFrame:
    """One row per id: the last in the order of ``cols``."""
    return df.groupBy("id").agg(F.max(F.struct(*cols)).alias("__l")).select("id", *[F.col(f"__l.{c}").alias(c) for c in cols])


def _post_dominants(posts: DataFrame, terms: DataFrame, post_text: str) -> DataFrame:
    """(id, dominant) per post id, by its last text."""
    p = with_profile(_last_by_id(posts, post_text), terms, "id", post_text)
    entries = F.transform(F.map_entries("__p.sizes"), lambda e: F.struct(e["key"].alias("k"), e["value"].alias("v")))
    return p.select("id", _best(entries).alias("dominant"))


def _resolve(posts: DataFrame, comments: DataFrame, terms: DataFrame, post_text: str) -> DataFrame:
    """(id, parent_id, post's columns aside: __p, start_ticker, dominant), one row per comment id."""
    post_dom = cut_lineage(_post_dominants(posts, terms, post_text))
    last = _last_by_id(comments, "dt", "text", "parent_id")
    c = with_profile(last, terms).select("id", "parent_id", "dt", "__p")
    parents = last.select(F.col("id").alias("parent_id"), F.col("dt").alias("p_dt"))
    c = c.join(parents, ["parent_id"], "left")
    c = c.join(post_dom.select(F.col("id").alias("parent_id"), F.col("dominant").alias("__pd")), ["parent_id"], "left")
    earlier = F.col("p_dt").isNotNull() & (F.struct("p_dt", "parent_id") < F.struct("dt", "id"))
    c = c.withColumn("ptr", F.when(F.col("__pd").isNull() & earlier, F.col("parent_id")))
    c = cut_lineage(c.withColumn("known_start", F.when(F.col("ptr").isNull(), F.coalesce("__pd", F.lit("")))).drop("__pd", "p_dt", "dt"))
    p = F.col("__p")
    known = F.when(F.col("ptr").isNull(), dominant_under_start(p["sizes"], p["t_first"], p["lead_bytes"], p["n_bytes"], F.col("known_start")))
    rules = _with_rules(c.select("id", "ptr", known.alias("known"), "__p.sizes", "__p.t_first", "__p.lead_bytes", "__p.n_bytes"))
    dominant, _ = pointer_double(rules)
    dominant = cut_lineage(dominant)
    c = c.join(dominant.select(F.col("id").alias("ptr"), F.col("dominant").alias("__up")), "ptr", "left")
    return c.select("id", "parent_id", "__p", F.coalesce("known_start", "__up").alias("start_ticker")).join(dominant, "id")


def propagate_thread_ticker(posts: DataFrame, comments: DataFrame, terms: DataFrame, post_text: str = "text") -> DataFrame:
    """posts(id, text); comments(id, parent_id, dt, text) -> one row (id, parent_id, start_ticker, dominant)
    per comment row.  Order key: (dt, id), which rules out cycles.
    An id that repeats stands for its last row by (dt, text, parent_id); all its rows get that row's tickers."""
    got = _resolve(posts, comments, terms, post_text).select("id", "start_ticker", "dominant")
    return comments.select("id", "parent_id").join(got, ["id"], "left")


def segments_from(profile: Column, start: Column) -> Column:
    """The segments (ticker, text) of a profiled text tagged from ``start``."""
    segs, lead, first = profile["segs"], profile["lead"], profile["t_first"]
    one = lambda t, x: F.array(F.struct(t.alias("ticker"), x.alias("text")))
    joined = F.concat(one(first, F.concat(lead, F.get(segs, F.lit(0))["text"])), F.slice(segs, 2, F.greatest(F.size(segs) - 1, F.lit(0))))
    without = F.when(lead != "", one(start, lead)).otherwise(F.array().cast("array<struct<ticker:string,text:string>>"))
    return F.when(first.isNull(), without).when((start == "") | (start == first), joined).otherwise(F.concat(one(start, lead), segs))


def tag_comments(posts: DataFrame, comments: DataFrame, terms: DataFrame, post_meta: dict[str, str] | None = None,
                 post_text: str = "text") -> DataFrame:
    """Segments of every comment tagged from its inherited start ticker, with
    the found post's metadata (empty when the post is missing); '' tickers dropped.

    Texts of repeated ids are matched again only where a row is not the one that its id stands for."""
    got = cut_lineage(_resolve(posts, comments, terms, post_text))
    rows = comments.select("id", "parent_id", "post_id", "text")
    last = _last_by_id(comments, "dt", "text", "parent_id").select("id", F.struct("text").alias("__last"))
    same = F.col("__last").isNotNull() & F.col("text").eqNullSafe(F.col("__last.text"))
    rows = rows.join(last, "id", "left").withColumn("__same", same).drop("__last")
    same = rows.where("__same").join(got.select("id", "start_ticker", "__p"), "id")
    other = with_profile(rows.where("not __same"), terms).join(got.select("id", "start_ticker"), "id", "left")  # null ids start from nothing
    cols = ["id", "parent_id", "post_id", "start_ticker", "__p"]
    seg = same.select(*cols).unionByName(other.select(*cols))
    seg = seg.withColumn("__s", segments_from(F.col("__p"), F.coalesce("start_ticker", F.lit("")))).select(*cols[:-1], F.posexplode("__s").alias("seg", "s"))
    seg = seg.select("id", F.col("seg").cast("bigint").alias("seg"), "s.ticker", "s.text", "parent_id", "post_id", "start_ticker").where("ticker <> ''")
    meta = post_meta or {}
    p = _last_by_id(posts, *dict.fromkeys(meta)) if meta else posts.select("id").distinct()
    p = p.select(F.col("id").alias("__pid"), *[F.col(k).alias(v) for k, v in meta.items()])
    out = seg.join(p, F.col("post_id") == F.col("__pid"), "left")
    return out.withColumn("found_post_id", F.coalesce(F.col("__pid").cast("string"), F.lit(""))).drop("__pid", "post_id")


def thread_match_rate(resolved: DataFrame) -> DataFrame:
    return resolved.agg(F.count_if(F.col("start_ticker") != "").alias("matches"), F.count(F.lit(1)).alias("comments"),
                        F.try_divide(F.count_if(F.col("start_ticker") != ""), F.count(F.lit(1))).alias("rate"))
