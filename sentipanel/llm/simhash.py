"""SimHash near-duplicates by deletion-variant signatures.

A fingerprint of 64 bits is cut into so few segments that of any two within ``max_bits`` bits one segment differs
by at most one bit (two segments of 32 bits for 3).  Each segment is indexed once per bit with that bit taken out: 64 narrow rows a
fingerprint.  Two fingerprints whose segment differs in bit b, or not at all, then have an equal variant, so an equality join finds
every pair, and the count of differing bits decides.

Equal fingerprints are one node.  The members of a variant are not paired off.  Each variant names a hub; members within reach of it
are linked to it, a linear number of pairs, and get the label of their component.  What is left are links between members of different labels.  Variants that
have such members are paired when they are small.  Larger ones are cut again: what was not fixed yet (32 bits, then 16) is split in the same way, so
that a group has agreed in 46 and then in 53 bits, and at most 2,048 different fingerprints can be in it.  The pairing join's own
condition is the exact distance, between different labels; it returns links, not candidates, and those connect the labels.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut_lineage, skew_join
from .components import components

BITS = 64
SEED = 42
BLOCK = 1 << 16  # hashes whose bits are counted at once


def fingerprint(text: bytes | None, size: int = 3) -> int:
    """SimHash of a whole UTF-8 text: A-Z lower-cased, words split at ASCII white space, shingles with repeats."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    n = len(words) - size + 1
    if n <= 1:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    digest = xxhash.xxh64_intdigest
    spans = zip(starts[:n].tolist(), ends[size - 1:].tolist())
    h = np.fromiter((digest(joined[a:b], SEED) for a, b in spans), dtype="<u8", count=n)
    count = np.zeros(BITS, dtype=np.int64)
    for i in range(0, n, BLOCK):
        count += np.unpackbits(h[i:i + BLOCK].view(np.uint8), bitorder="little").reshape(-1, BITS).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * count > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << BITS) if x >> (BITS - 1) else x


def fingerprints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(__id, fp) of every row."""
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).cast("string").cast("binary").alias("__t"))

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            fp = [_signed(fingerprint(t.as_py(), size)) for t in b.column("__t")]
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(fp, pa.int64())], ["__id", "fp"])
    return rows.mapInArrow(run, f"__id {rows.schema['__id'].dataType.simpleString()}, fp long")


def _cut(bits: list[int], pieces: int) -> list[list[int]]:
    return [bits[len(bits) * k // pieces:len(bits) * (k + 1) // pieces] for k in range(pieces)]


def variants(max_bits: int) -> list[list[list[tuple[int, int, int, bool, int]]]]:
    """Levels, in each by path [(bit, segment mask, kept mask, first of its segment, next path)]: how a group of that path is cut.

    Bits of the level's segments are fixed but for one; the next level cuts the other bits.  It ends when a segment has fewer than 8 bits.
    """
    pieces = max(2, max_bits // 2 + 1)
    levels, open_paths = [], [list(range(BITS))]
    while min(map(len, open_paths)) >= 8 * pieces:
        level, below = [], []
        for bits in open_paths:
            cuts = []
            for piece in _cut(bits, pieces):
                mask = sum(1 << b for b in piece)
                cuts += [(b, _signed(mask), _signed(mask & ~(1 << b)), b == piece[0], len(below)) for b in piece]
                below.append([b for b in bits if b not in piece])
            level.append(cuts)
        levels.append(level)
        open_paths = below
    return levels


def _index(groups: DataFrame, level) -> DataFrame:
    """Variants (g, seg, first, path) of rows (g, path, fp), other columns kept: equal g for those that agree in a segment of their group but for one bit."""
    names = ["bit", "seg", "keep", "first", "path"]
    kinds = ["int", "long", "long", "boolean", "int"]
    cut = F.array(*[F.array(*[F.struct(*[F.lit(x).cast(k).alias(c) for x, k, c in zip(v, kinds, names)]) for v in cuts]) for cuts in level])
    kept = [c for c in groups.columns if c not in ("g", "path", "seg", "first", "n")]
    rows = groups.select("g", *kept, F.explode(F.element_at(cut, F.col("path") + 1)).alias("v"))
    # a collision of this hash only brings a candidate more
    return rows.select(F.xxhash64("g", "v.bit", F.col("fp").bitwiseAND(F.col("v.keep"))).alias("g"), *kept, "v.seg", "v.first", "v.path")


def _apart(a, b):
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _pairs(members: DataFrame, max_bits: int) -> DataFrame:
    """Links (a, b) between the components of a group's members, by label."""
    one = members.select("g", F.col("fp").alias("x"), F.col("label").alias("a"), "seg", "first")
    other = members.select("g", F.col("fp").alias("y"), F.col("label").alias("b"))
    # equal segments have all their variants equal: the first one counts
    once = F.col("first") | (F.col("x").bitwiseXOR(F.col("y")).bitwiseAND(F.col("seg")) != 0)
    return one.join(other, "g").where((F.col("a") < F.col("b")) & (_apart("x", "y") <= max_bits) & once).select("a", "b").distinct()


def _with_groups(index: DataFrame, groups: DataFrame, broadcast_rows: int) -> DataFrame:
    groups, few = broadcast_if_small(cut_lineage(groups), broadcast_rows)
    return cut_lineage(index.join(groups, "g") if few else skew_join(index, groups, ["g"]))


def classes(nodes: DataFrame, max_bits: int = 3, small: int = 64, broadcast_rows: int = 500_000, task_edges: int = 50_000) -> DataFrame:
    """(fp, label) of the fingerprints (fp): equal labels for those that links of at most ``max_bits`` bits connect."""
    levels = variants(max_bits)
    index = _index(nodes.select(F.lit(0).cast("long").alias("g"), F.lit(0).alias("path"), "fp"), levels[0])
    live = index.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("hub")).where("n > 1")
    members = _with_groups(index, live, broadcast_rows)
    stars = members.where((F.col("fp") != F.col("hub")) & (_apart("fp", "hub") <= max_bits)).select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    label = components(stars.distinct(), task_edges).withColumnRenamed("node", "fp")
    label = cut_lineage(nodes.select("fp").join(label, "fp", "left").withColumn("label", F.coalesce("label", "fp")))

    members = cut_lineage(skew_join(members.drop("hub", "n"), label, ["fp"]))
    links = None
    for depth, level in enumerate(levels):
        mixed = members.groupBy("g").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("g", "n")
        members = _with_groups(members, mixed, broadcast_rows)
        last = depth + 1 == len(levels)
        found = cut_lineage(_pairs(members if last else members.where(F.col("n") <= small), max_bits))
        links = found if links is None else links.union(found)
        large = members.where(F.col("n") > small)
        if last or not large.limit(1).count():
            break
        members = cut_lineage(_index(large, levels[depth + 1]))
    root = components(links, task_edges).select(F.col("node").alias("label"), F.col("label").alias("root"))
    return skew_join(label, root, ["label"], "left").select("fp", F.coalesce("root", "label").alias("label"))


def simhash_components(docs: DataFrame, max_bits: int = 3, shingle_words: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint and component of every document under links of at most ``max_bits`` differing bits.

    A fingerprint bit is 1 if it is set in over half of the XXH64 hashes (seed 42) of the whole text's shingles, repeats included.
    Fewer words than a shingle are one shingle; null and empty texts and texts of white space have fingerprint zero, linked like any other.
    Returns the id column, ``fingerprint`` (16 lowercase hex digits) and ``component_id`` (smallest id reachable, itself included); one
    row per input row, repeated rows and ids included.  Null ids are passed over in component ids.  An empty table gives an empty result;
    other input columns are dropped.
    """
    rows = cut_lineage(fingerprints(docs, id_col, text_col, shingle_words))
    nodes = cut_lineage(rows.groupBy("fp").agg(F.min("__id").alias("rep")))
    comp = cut_lineage(classes(nodes, max_bits).join(nodes, "fp"))
    comp = skew_join(comp, comp.groupBy("label").agg(F.min("rep").alias("component_id")), ["label"]).select("fp", "component_id")
    out = skew_join(rows, cut_lineage(comp), ["fp"])
    return out.select(F.col("__id").alias(id_col), F.lower(F.lpad(F.hex("fp"), BITS // 4, "0")).alias("fingerprint"), "component_id")
