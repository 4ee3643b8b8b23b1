"""Line dedup across documents, exact and within a small edit distance, in DataFrame functions only.

Segment-partition edit join: a line of length l is cut into ``edits + 1`` even segments.  A line within ``edits``
edits of it holds one of the segments unchanged, at a place shifted by a few characters.  (Lines of ``edits``
characters or fewer have no such segments: they are all within ``edits`` of each other, and a longer line within
``edits`` of one shares a character with it, so single characters are their keys.)  So every
line indexes its own segments and probes, for every length up to ``edits`` shorter, the substrings at the
shifts that the numbers of edits left and right of the segment allow.  Index and probe keys are (length,
segment, hash of the substring).  Keys that two lines share make candidates, which are checked by length, by
counts of letter groups (an edit changes them by at most two) and finally by edit distance over a diagonal
band held in the bits of a word, one step per character.

Candidates are not all paired.  Each key has a hub, and the other lines are checked against it; then only
lines of different classes that share a key are paired.  Classes are connected components.  Lines are named
by a 64-bit hash; texts are carried only for lines with candidates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut_lineage, drop_clashing, join_bounded, skew_join, text_of
from .components import components

RESULTS = ["n_lines", "n_removed", "removed"]
LETTERS = ["eE", "tTaA", "iInN", "oOsSrR", "hHlLdD", "cCuUmMfF", "pPgGwWyYbBvV", "0123456789"]  # groups of the count filter


def segment_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(name, key, own): a line's own segments and the substrings it probes.

    A line of length l is cut into ``edits + 1`` segments, the last ones a character longer; lengths up to ``edits`` are
    left to :func:`short_keys`.  Each (shorter, segment, shift) is one row of
    a literal table, so the key is one small expression.  Lines are read in UTF-32, four bytes a character, which makes a substring a slice.
    """
    n = edits + 1
    table = [F.struct(F.lit(shorter).alias("shorter"), F.lit(i).alias("i"), F.lit(shift).alias("shift"))
             for shorter in range(n) for i in range(n)
             for shift in range(max(-i, shorter - (edits - i)), min(i, shorter + edits - i) + 1)]
    wide = lines.select("name", F.encode("line", "UTF-32").alias("wide"))  # on its own, below the generator: once a line
    rows = wide.select("name", "wide", F.explode(F.array(*table)).alias("p"))
    target = F.shiftright(F.octet_length("wide"), 2) - F.col("p.shorter")
    rows = rows.withColumn("t", target).where(F.col("t") > edits)
    floor = F.floor(F.col("t") / n).cast("int")
    first_long = n - F.col("t") % n  # segments from here on take one character of the remainder
    start = floor * F.col("p.i") + F.greatest(F.lit(0), F.col("p.i") - first_long) + F.col("p.shift")
    size = floor + (F.col("p.i") >= first_long).cast("int")
    key = F.xxhash64("t", "p.i", F.substring("wide", F.shiftleft(start, 2) + 1, F.shiftleft(size, 2)))
    return rows.select("name", key.alias("key"), ((F.col("p.shorter") == 0) & (F.col("p.shift") == 0)).alias("own"))


def short_keys(lines: DataFrame, edits: int) -> DataFrame:
    """(name, key, own) for the pairs with a line of ``edits`` characters or fewer: its characters, and one key for all such lines."""
    own = F.length("line") <= edits
    chars = F.transform(F.array_distinct(F.split("line", "")), lambda c: F.xxhash64(F.lit(-1), c))
    keys = F.concat(chars, F.when(own, F.array(F.xxhash64(F.lit(-1)))).otherwise(F.array().cast("array<bigint>")))
    return lines.where(F.length("line") <= 2 * edits).select("name", F.explode(keys).alias("key"), own.alias("own"))


def edit_distances(pairs: DataFrame, a: str, b: str, edits: int) -> DataFrame:
    """Adds ``distance``, right up to ``edits`` and larger beyond: bit-parallel edit distance over the diagonal band.

    What two lines share at their ends does not count, so the distance runs over the characters between, column by column.  Bit k of a
    word stands for the cell edits - k above the main diagonal.  ``vp`` and ``vn`` mark where the distance rises or falls from the
    cell above, ``same`` the cells whose characters agree, ``d0`` those that continue a diagonal at no cost; the score follows the
    diagonal that ends at the last cell.  Arrays are columns of their own, as a lambda would compute them anew at each step;
    for the same reason a filter on the distance belongs behind a checkpoint, or it is pushed below them.
    """
    w = 2 * edits + 1
    mask = (1 << w) - 1
    keep = pairs.columns

    def agreed(x: str, y: str) -> Column:  # characters before the first difference
        at = F.array_position(F.zip_with(x, y, lambda p, q: p.eqNullSafe(q)), False)
        return F.when(at == 0, F.least(F.size(x), F.size(y))).otherwise(at - 1).cast("int")
    d = pairs.where(F.abs(F.length(a) - F.length(b)) <= edits).withColumns({"__a": F.split(a, ""), "__b": F.split(b, "")})
    d = d.withColumn("__pre", agreed("__a", "__b"))
    d = d.withColumns({"__ra": F.reverse("__a"), "__rb": F.reverse("__b"), "__most": F.least(F.size("__a"), F.size("__b")) - F.col("__pre")})
    d = d.withColumn("__suf", F.least(agreed("__ra", "__rb"), F.col("__most"))).drop("__ra", "__rb")
    for c in ("__a", "__b"):
        d = d.withColumn(c, F.slice(c, F.col("__pre") + 1, F.size(c) - F.col("__pre") - F.col("__suf")))
    d = d.withColumn("__gap", F.size("__a") - F.size("__b"))

    def same(char, j):
        bits = [F.when(F.get("__a", j + (k - edits)) == char, 1 << k).otherwise(0) for k in range(w)]
        return sum(bits[1:], bits[0])
    d = d.withColumn("__same", F.transform("__b", same))
    start = sum(1 << k for k in range(edits + 1, w)) << w | sum(1 << k for k in range(1, edits + 1))
    d = d.withColumn("__cost", F.get(F.array(*[F.lit(1 << k) for k in range(w)]), F.col("__gap") + edits))

    def column(acc, x):
        # the accumulator holds the score above vp above vn; the band moves down one row with every column
        vp = F.shiftright(acc, w + 1).bitwiseAND(F.lit(mask >> 1)).bitwiseOR(F.lit(1 << (w - 1)))
        vn = F.shiftright(acc, 1).bitwiseAND(F.lit(mask >> 1))
        d0 = (x.bitwiseAND(vp) + vp).bitwiseXOR(vp).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(F.lit(mask))
        hp = F.shiftleft(vn.bitwiseOR(d0.bitwiseOR(vp).bitwiseXOR(F.lit(mask))), 1).bitwiseOR(F.lit(1))
        hn = F.shiftleft(vp.bitwiseAND(d0), 1)
        next_vp = hn.bitwiseOR(d0.bitwiseOR(hp).bitwiseAND(F.lit(mask)).bitwiseXOR(F.lit(mask))).bitwiseAND(F.lit(mask))
        next_vn = hp.bitwiseAND(d0)
        paid = F.when(d0.bitwiseAND(F.col("__cost")) == 0, 1).otherwise(0)
        return F.shiftleft(F.shiftright(acc, 2 * w) + paid, 2 * w) + F.shiftleft(next_vp, w) + next_vn
    score = F.aggregate("__same", F.lit(start) + F.shiftleft(F.abs("__gap"), 2 * w), column, lambda x: F.shiftright(x, 2 * w))
    empty = (F.size("__a") == 0) | (F.size("__b") == 0)
    return d.select(*keep, F.when(empty, F.abs("__gap")).otherwise(score).alias("distance"))


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc, __id, pos, line, name) of the lines that are compared."""
    return (docs.select("__doc", "__id", F.posexplode(F.split("__t", "\n")).alias("pos", "line"))
                .where((F.length("line") >= min_chars) & (F.ltrim("line", F.lit(" \t\v\f\r")) != "")).withColumn("name", F.xxhash64("line")))


def near_lines(lines: DataFrame, edits: int, near_chars: int, broadcast_rows: int) -> DataFrame:
    """(node, label): classes of different lines linked by up to ``edits`` edits."""
    long = lines.where(F.length("line") >= near_chars)
    keyed = segment_keys(long, edits)
    if near_chars <= 2 * edits:
        keyed = keyed.unionByName(short_keys(long, edits))
    live = (keyed.groupBy("key").agg(F.min("name").alias("lo"), F.max("name").alias("hi"), F.max("own").alias("own"))
                 .where("lo < hi and own").select("key"))
    live, _ = broadcast_if_small(cut_lineage(live), broadcast_rows)
    members = cut_lineage(keyed.join(live, "key").groupBy("key", "name").agg(F.max("own").alias("own")))
    names, _ = broadcast_if_small(cut_lineage(members.select("name").distinct()), broadcast_rows)
    counts = [(F.length("line") - F.length(F.translate("line", g, ""))).cast("smallint").alias(f"g{i}") for i, g in enumerate(LETTERS)]
    texts = cut_lineage(long.select("name", "line").join(names, "name").dropDuplicates(["name"])
                            .select("name", "line", F.length("line").alias("len"), *counts))

    stats = ["len", *[f"g{i}" for i in range(len(LETTERS))]]

    def close(a: str, b: str) -> Column:
        gap = sum((F.abs(F.col(f"{a}.g{i}") - F.col(f"{b}.g{i}")) for i in range(1, len(LETTERS))), F.abs(F.col(f"{a}.g0") - F.col(f"{b}.g0")))
        return (F.abs(F.col(f"{a}.len") - F.col(f"{b}.len")) <= edits) & (gap <= 2 * edits)

    def verify(pairs: DataFrame) -> DataFrame:
        one = lambda c: texts.select(F.col("name").alias(c), F.col("line").alias(f"l{c}"))
        both = skew_join(skew_join(pairs, one("b"), ["b"]), one("a"), ["a"])
        return cut_lineage(edit_distances(both, "la", "lb", edits).select("a", "b", "distance")).where(F.col("distance") <= edits).select("a", "b")

    m = members.join(texts.select("name", F.struct(*stats).alias("s")), "name")
    hubs = members.where("own").groupBy("key").agg(F.min("name").alias("hub")).join(
        texts.select(F.col("name").alias("hub"), F.struct(*stats).alias("hs")), "hub").select("key", "hub", "hs")
    tried = cut_lineage(skew_join(m, hubs, ["key"]).where((F.col("name") != F.col("hub")) & close("s", "hs"))
                        .select(F.col("hub").alias("a"), F.col("name").alias("b")).distinct())
    links = verify(tried)
    label = components(links)

    m = m.join(label.withColumnRenamed("node", "name"), "name", "left").withColumn("label", F.coalesce("label", "name"))
    x, y = (m.select("key", *[F.col(c).alias(f"{c}_{t}") for c in ("name", "own", "label", "s")]) for t in "xy")
    rest = (x.join(y, "key").where((F.col("name_x") < F.col("name_y")) & (F.col("label_x") != F.col("label_y"))
                                   & (F.col("own_x") | F.col("own_y")) & close("s_x", "s_y"))
             .select(F.col("name_x").alias("a"), F.col("name_y").alias("b")).distinct())
    done = tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
    return components(links.unionByName(verify(rest.join(done, ["a", "b"], "left_anti"))))


def _once(lines: DataFrame, names: DataFrame, broadcast_rows: int) -> DataFrame:
    """(name, line) of different lines: those that repeat only at one of their places (rows that repeat id and text count as one place)."""
    again = names.where("n > 1").select("name", "place")
    return join_bounded(lines, again, ["name"], "left", broadcast_rows).where("place is null or place = own").select("name", "line")


def line_dedup(docs: DataFrame, edits: int = 2, min_chars: int = 20, near_chars: int = 40, id_col: str = "doc_id",
               text_col: str = "text", broadcast_rows: int = 1_000_000) -> DataFrame:
    """Remove lines that repeat an earlier line, exactly or within ``edits`` edits.

    Lines are split at ``\\n``.  Lines of ``min_chars`` characters or more that hold a word are compared exactly, those of
    ``near_chars`` or more also within ``edits`` edits; 1 and 1 compare every line that holds a word.  Of each class the first line stays in the document with
    the smallest id; all other lines of the class go.  Other lines always stay.

    Returns the input's columns with the text shortened, plus ``n_lines``, ``n_removed`` and ``removed`` (array of
    (pos, keep_doc), by position from 0).  Null text stays null and has one empty line.  Rows that repeat id
    and text share their result, so the first of such copies does not empty the others; null ids come after all
    others.  An empty table gives an empty result; input columns named like a result are replaced.
    """
    d = drop_clashing(docs, RESULTS)
    keep = d.columns
    d = d.withColumns({"__id": F.col(id_col), "__t": text_of(text_col)}).withColumn("__doc", F.xxhash64("__id", "__t"))
    texts = _lines(d, min_chars).withColumn("own", F.xxhash64("__doc", "pos"))
    lines = cut_lineage(texts.select("__doc", "__id", "pos", "name"))
    names = cut_lineage(lines.groupBy("name").agg(F.min("__id").alias("first"), F.count(F.lit(1)).alias("n"), F.min(F.xxhash64("__doc", "pos")).alias("place")))
    near = near_lines(_once(texts, names, broadcast_rows), edits, near_chars, broadcast_rows)
    exact = cut_lineage(names.join(near, F.col("name") == F.col("node"), "left").where("n > 1 or node is not null")
                             .select("name", F.coalesce("label", "name").alias("label"), "first"))
    first = exact.groupBy("label").agg(F.min("first").alias("keep_doc"))
    classes = exact.select("name", "label").join(first, "label")

    at = skew_join(lines, classes, ["name"])
    mine = F.col("__id").eqNullSafe(F.col("keep_doc"))
    per = at.groupBy("__doc", "label", mine.alias("mine"), "keep_doc").agg(F.array_sort(F.collect_set("pos")).alias("at"))
    gone = F.when(F.col("mine"), F.slice("at", 2, F.greatest(F.size("at") - 1, F.lit(0)))).otherwise(F.col("at"))
    gone = F.transform(gone, lambda p: F.struct(p.alias("pos"), F.col("keep_doc").alias("keep_doc")))
    removed = (per.select("__doc", gone.alias("gone")).where(F.size("gone") > 0)
                  .groupBy("__doc").agg(F.array_sort(F.flatten(F.collect_list("gone"))).alias("removed")))
    removed, _ = broadcast_if_small(cut_lineage(removed), broadcast_rows // 4)
    d = d.join(removed, "__doc", "left")
    # a generated row: the lines are split once, not anew for every line that a lambda takes
    split = F.split("__t", "\n")
    row = F.struct(F.when(F.col("removed").isNotNull(), split).alias("lines"), F.size(split).alias("n"))
    d = d.select(*keep, "removed", F.explode(F.array(row)).alias("__parts"))
    stay = F.array_except(F.sequence(F.lit(0), F.col("__parts.n") - 1), F.col("removed.pos"))
    short = F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join(F.transform(stay, lambda i: F.get(F.col("__parts.lines"), i)), "\n"))
    none = F.array().cast(removed.schema["removed"].dataType)
    return d.select(*[short.alias(c) if c == text_col else F.col(c) for c in keep], F.col("__parts.n").cast("long").alias("n_lines"),
                    F.coalesce(F.size("removed"), F.lit(0)).cast("long").alias("n_removed"), F.coalesce("removed", none).alias("removed"))
