"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled (seeded hash) order, cycled up to
``max_copies`` times.  The virtual finish time of a copy is the source's words up to its end
divided by the source's target.  All copies are ordered by finish time over equal-width ranges
of virtual time, and the mix takes them until the word budget is used up.

Running sums are in two levels: windows over hash buckets (or time ranges) of about
``bucket_rows`` rows, plus offsets from the buckets' sums, so a hot source is never one task.
Only (id, source, size) rows move; texts are joined back by :func:`apply_mix`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, broadcast_if_small, cut_lineage, text_of


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3) -> DataFrame:
    """Per source: rank, source_size, target.

    Sources in code point order, null last, get the weights in turn and share all words.  A target
    stops at ``max_copies`` times its source's size and the excess is reshared by weight, which is
    water filling: in the order of cap / weight the first sources are capped and the rest share
    what is left.  One row per source, so single-task windows are enough.
    """
    s = sizes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    s = s.withColumn("rank", F.row_number().over(by_name).cast("long"))
    s = s.withColumn("w", F.get(F.array(*[F.lit(int(w)) for w in weights]), ((F.col("rank") - 1) % len(weights)).cast("int")).cast("double"))
    s = s.withColumn("cap", (F.col("source_size") * max_copies).cast("double"))
    fill = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    rest = fill.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    s = s.withColumns({
        "left": F.sum(F.col("source_size").cast("double")).over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
        "wsum": F.sum("w").over(rest)})
    capped = F.col("cap") * F.col("wsum") <= F.col("left") * F.col("w")
    s = s.withColumn("level", F.when(~capped, F.col("left") / F.col("wsum")))
    level = F.first("level", ignorenulls=True).over(every)  # of the first source that isn't capped
    return s.select("source", "rank", "source_size",
                    F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.col("w") * level).alias("target"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), max_copies: int = 3, seed: int = 0,
             id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
             bucket_rows: int = 50_000) -> DataFrame:
    """How often the mix takes each document.

    Returns (doc_id, source, size, n, source_size, target, copies): one row per distinct
    (id, source, size); ``n`` input rows share it and are taken together, so repeated rows have a
    defined result.  Size is the number of words; null text has none and is never taken, null
    sources are one source and come last.  Documents are taken whole, up to ``max_copies`` times;
    a source ends within one document of its target.  Empty table: empty result.
    """
    sizes = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"),
                        F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long").alias("size"))
    sizes = cut_lineage(sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("n")))
    targets = cut_lineage(source_targets(sizes, weights, max_copies))
    buckets = max(128, sizes.count() // bucket_rows)

    # null sources join by rank: the sources are numbered with nulls last
    named, _ = broadcast_if_small(targets, 100_000)
    d = sizes.join(named, sizes["source"].eqNullSafe(targets["source"]), "left").drop(targets["source"])
    queue = d.where("size > 0 and target > 0").withColumn("key", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))))
    queue = queue.withColumns({"words": F.col("size") * F.col("n"),
                               "bucket": F.expr(f"conv(substring(key, 1, 8), 16, 10) * {buckets} div 4294967296").cast("long")})
    sums = queue.groupBy("rank", "bucket").agg(F.sum("words").alias("words"))
    offsets = sums.select("rank", "bucket", (F.sum("words").over(Window.partitionBy("rank").orderBy("bucket")) - F.col("words")).alias("offset"))
    in_bucket = Window.partitionBy("rank", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    queue = queue.withColumn("cum", F.sum("words").over(in_bucket)).join(offsets, ["rank", "bucket"])
    queue = cut_lineage(queue.select("doc_id", "source", "size", "n", "rank", "source_size", "target", "words",
                                     (F.col("cum") + F.col("offset")).alias("cum")))

    finish = lambda e: (F.lit(e) * F.col("source_size") + F.col("cum")) / F.col("target")
    # a source takes nothing that would start after its target is reached, even if another leaves budget over
    due = lambda e: (F.lit(e) * F.col("source_size") + F.col("cum") - F.col("words")) < F.col("target")
    served = (queue.select("rank", "words", F.explode(F.array(*[F.when(due(e), finish(e)) for e in range(max_copies)])).alias("finish"))
                   .where("finish is not null")
                   .withColumn("span", F.floor(F.col("finish") * buckets)))
    spans = served.groupBy("span").agg(F.sum("words").alias("words"))
    spans = spans.select("span", (F.sum("words").over(Window.orderBy("span")) - F.col("words")).alias("offset"))
    in_span = Window.partitionBy("span").orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, 0)
    budget = targets.agg(F.sum("source_size")).first()[0] or 0
    last = (served.withColumn("cum", F.sum("words").over(in_span)).join(spans, "span")
                  .where(F.col("cum") + F.col("offset") <= F.lit(budget))
                  .agg(F.max(F.struct("finish", "rank")).alias("last")).first()["last"])
    if last is None:
        copies = F.lit(0)
    else:
        before = lambda f: (f < F.lit(last["finish"])) | ((f == F.lit(last["finish"])) & (F.col("rank") <= last["rank"]))
        copies = sum(((due(e) & before(finish(e))).cast("int") for e in range(1, max_copies)), (due(0) & before(finish(0))).cast("int"))
    cols = ["doc_id", "source", "size", "n", "source_size", "target"]
    idle = d.where("not (size > 0 and target > 0)").select(*cols, F.lit(0).alias("copies"))
    return queue.select(*cols, copies.cast("int").alias("copies")).unionByName(idle)


def apply_mix(docs: DataFrame, plan: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              source_col: str = "source") -> DataFrame:
    """The mix itself: every input row as many times as the plan takes it, all columns kept."""
    taken = plan.where("copies > 0").select(F.col("doc_id").alias("__id"), F.col("source").alias("__src"),
                                            F.col("size").alias("__size"), F.col("copies").alias("__copies"))
    d = docs.withColumn("__words", F.regexp_count(text_of(text_col), F.lit(WORD)).cast("long"))
    on = d[id_col].eqNullSafe(taken["__id"]) & d[source_col].eqNullSafe(taken["__src"]) & (d["__words"] == taken["__size"])
    return (d.join(taken, on).withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__copies"))))
             .select(*docs.columns))
