"""Exact dedup by progressive refinement: length, then prefix hash, then full hash.

Three levels, each an aggregation of narrow rows:

1. byte lengths that occur twice or more;
2. for texts of such a length, (length, hash of the first characters) that occur twice or more;
3. for the texts left, SHA-256 of the whole text: equal hashes are equal texts.

The full text is hashed only where both earlier levels found a possible partner.  Texts never
travel: what is shuffled is (id, length, hash).  The lengths and prefixes found are broadcast if
their counted number is within ``level_rows``; beyond it the level is left out, which costs hashing
and changes no result, because the last level alone decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut_lineage, drop_clashing, skew_join, text_of

RESULTS = ["keep_id", "group_size", "kept"]


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 256,
                level_rows: int = 1_000_000) -> DataFrame:
    """Mark exact copies; of equal texts the row with the largest id stays.

    Returns the input's columns without the text, plus ``keep_id`` (id of the row that stays),
    ``group_size`` (rows with this text) and ``kept``.  Null text counts as empty, so nulls and
    empty texts form one group.  Rows that repeat both id and text are one document and share
    ``kept``; a null id is kept only if no row of its group has an id.  An empty table gives an
    empty result.  Input columns named like a result column are replaced.
    """
    d = drop_clashing(docs, RESULTS).withColumn("__t", text_of(text_col)).withColumn("__len", F.octet_length("__t"))
    narrow = [F.col("__len"), F.xxhash64(F.substring("__t", 1, prefix_chars)).alias("__pfx")]
    maybe = F.lit(True)

    lens = cut_lineage(d.groupBy("__len").count().where("count > 1").select("__len", F.lit(True).alias("__l1")))
    lens, small = broadcast_if_small(lens, level_rows)
    if small:
        d = d.join(lens, "__len", "left")
        maybe = F.col("__l1").isNotNull()
    pre = cut_lineage(d.where(maybe).select(*narrow).groupBy("__len", "__pfx").count().where("count > 1")
                       .select("__len", "__pfx", F.lit(True).alias("__l2")))
    pre, small = broadcast_if_small(pre, level_rows)
    if small:
        d = d.withColumn("__pfx", narrow[1]).join(pre, ["__len", "__pfx"], "left")
        maybe = maybe & F.col("__l2").isNotNull()

    # rows without a possible partner get a key of their own: no hot null key in the join
    d = d.withColumn("__sha", F.when(maybe, F.sha2("__t", 256))).withColumn(
        "__key", F.coalesce("__sha", F.concat(F.lit("#"), F.xxhash64(id_col, "__t").cast("string"))))
    groups = (d.where("__sha is not null").groupBy("__key")
               .agg(F.max(id_col).alias("keep_id"), F.count(F.lit(1)).alias("group_size")).where("group_size > 1"))
    keep = [c for c in docs.columns if c in d.columns and c != text_col]
    out = skew_join(d.select(*keep, "__key"), groups, ["__key"], "left")
    keep_id = F.when(F.col("group_size").isNull(), F.col(id_col)).otherwise(F.col("keep_id"))
    return out.select(*keep, keep_id.alias("keep_id"), F.coalesce("group_size", F.lit(1)).alias("group_size"),
                      F.col(id_col).eqNullSafe(keep_id).alias("kept"))
