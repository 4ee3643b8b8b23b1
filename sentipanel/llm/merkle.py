"""Merkle dataset manifest: a SHA-256 tree per source and one over the sources, with proofs that resume hash states.

A parent is the hash of its children's hex digests, one after the other.  While it is built it keeps a copy
of the hash state before each child slot.  To fold a changed leaf, the state of its slot is
copied, takes the replacement and the siblings to its right, and gives the parent; siblings to the left are never
hashed again.

The trees are built in tiers.  Leaves of a tree (a source) are numbered in order, without a window over the tree: range
partitions number their own rows and add the rows of the partitions before them.  ``arity ** tier_levels`` (729)
consecutive nodes form a chunk, which one task builds up to a single node; those nodes are the next tier's leaves, until every tree
is a single node.  So a task holds one chunk, however large a source is, and a tier
shuffles one narrow row per node.  Then the tiers are walked from the top: each node learns the siblings on its
way to the root, level by level, and a chunk of leaves folds all of its rows on that one way.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut_lineage, skew_join

FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]
WAY = "array<struct<left:string,right:string>>"
WAY_ARROW = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))


def encoded(value: Column) -> Column:
    """``-`` for null, else byte count, colon, value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_hash(fields: list[Column]) -> Column:
    return F.sha2(F.concat(*[encoded(c) for c in fields]), 256)


def levels_above(n: int, arity: int) -> int:
    """Levels between n leaves and their root."""
    levels = 0
    while n > 1:
        n = -(-n // arity)
        levels += 1
    return levels


class Chunk:
    """Consecutive nodes of one tree, built ``levels`` levels up; states[l][i] is the parent's state before node i of level l."""

    def __init__(self, digests: list[bytes], levels: int, arity: int):
        self.arity, self.rows, self.states = arity, [digests], []
        for _ in range(levels):
            below, states, above = self.rows[-1], [], []
            for i in range(0, len(below), arity):
                h = hashlib.sha256()
                for d in below[i:i + arity]:
                    states.append(h.copy())
                    h.update(d)
                above.append(h.hexdigest().encode())
            self.states.append(states)
            self.rows.append(above)

    def siblings(self, i: int) -> list[tuple[bytes, bytes]]:
        """(left, right) digests of node i's siblings, level by level."""
        way = []
        for row in self.rows[:-1]:
            first = i - i % self.arity
            way.append((b"".join(row[first:i]), b"".join(row[i + 1:first + self.arity])))
            i //= self.arity
        return way

    def fold(self, i: int, digest: bytes, way: list[tuple[bytes, bytes]]) -> bytes:
        for states, (_, right) in zip(self.states, way):
            digest = resume(states[i], digest, right)
            i //= self.arity
        return digest


def resume(state, digest: bytes, right: bytes) -> bytes:
    h = state.copy()
    h.update(digest)
    h.update(right)
    return h.hexdigest().encode()


def _number(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """Rows with ``__pos``, their place in their tree by ``order``, and ``__n``, the tree's rows.

    No group is a tree: each range partition counts its own rows, a row per (partition, tree) is summed up.
    """
    # plain columns: a range partitioner samples its input, which so is computed once
    parts = max(8, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = cut_lineage(df).repartitionByRange(parts, tree, *order).sortWithinPartitions(tree, *order)
    fields = rows.schema.simpleString()[len("struct<"):-1]

    def count(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, at = TaskContext.get().partitionId(), (), 0
        for b in it:
            own = []
            for t in b.column(tree).to_pylist():
                at = at + 1 if (t,) == last else 0
                last = (t,)
                own.append(at)
            cols = [*b.columns, pa.array([part] * len(own), pa.int32()), pa.array(own, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, [*b.schema.names, "__part", "__own"])
    rows = cut_lineage(rows.mapInArrow(count, f"{fields},__part:int,__own:bigint"))
    per = rows.groupBy(tree, "__part").agg(F.count(F.lit(1)).alias("__rows"))
    # (tree, partition) rows: a tree has one for each partition it reaches into, so these sums are small
    spans = per.groupBy(tree).agg(F.array_sort(F.collect_list(F.struct("__part", "__rows"))).alias("s"))
    before = lambda k: F.aggregate(F.slice("s", 1, k), F.lit(0).cast("long"), lambda a, x: a + x["__rows"])
    spans = spans.select(tree, before(F.size("s")).alias("__n"), F.explode(F.transform("s", lambda x, k: F.struct(x["__part"].alias("part"), before(k).alias("before")))).alias("x"))
    spans = spans.select(F.col(tree).alias("__tree"), "__n", F.col("x.part").alias("__in"), F.col("x.before").alias("__before"))
    spans, _ = broadcast_if_small(cut_lineage(spans), 100_000)
    out = rows.join(spans, (F.col("__part") == F.col("__in")) & F.col(tree).eqNullSafe(F.col("__tree")))
    return out.withColumn("__pos", F.col("__own") + F.col("__before")).drop("__part", "__own", "__tree", "__in", "__before")


def _as_bytes(values: list[str]) -> list[bytes]:
    return [v.encode() for v in values]


def _way_out(ways: list[list[tuple[bytes, bytes]]]) -> pa.Array:
    return pa.array([[{"left": a.decode(), "right": b.decode()} for a, b in w] for w in ways], WAY_ARROW)


def _tops(nodes: DataFrame, tier: int, arity: int, tier_levels: int) -> DataFrame:
    """One row (tree, chunk, n, digest) per chunk of nodes (tree, pos, n, digest); n are the tree's leaves."""
    def build(table: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table["n"][0].as_py()
        c = Chunk(_as_bytes(table["digest"].to_pylist()), min(tier_levels, levels_above(n, arity) - tier * tier_levels), arity)
        return table.slice(0, 1).select(["tree", "chunk", "n"]).append_column("digest", pa.array([c.rows[-1][0].decode()]))
    kind = nodes.schema["tree"].dataType.simpleString()
    chunks = nodes.withColumn("chunk", F.floor(F.col("pos") / arity ** tier_levels).cast("long"))
    return chunks.groupBy("tree", "chunk").applyInArrow(build, f"tree {kind}, chunk long, n long, digest string")


def _ways(nodes: DataFrame, above: DataFrame | None, tier: int, arity: int, tier_levels: int) -> DataFrame:
    """(tree, pos, way): the siblings of every node on its way to the root; ``above`` holds the ways of the chunks' tops."""
    def walk(table: pa.Table, rest: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        n = table["n"][0].as_py()
        c = Chunk(_as_bytes(table["digest"].to_pylist()), min(tier_levels, levels_above(n, arity) - tier * tier_levels), arity)
        upper = [(x["left"].encode(), x["right"].encode()) for x in rest["way"][0].as_py()] if rest.num_rows else []
        ways = [c.siblings(i) + upper for i in range(table.num_rows)]
        return pa.table({"tree": table["tree"], "pos": table["pos"], "way": _way_out(ways)})
    kind = nodes.schema["tree"].dataType.simpleString()
    chunks = nodes.withColumn("chunk", F.floor(F.col("pos") / arity ** tier_levels).cast("long"))
    if above is None:
        above = chunks.select("tree", F.col("chunk").alias("pos"), F.array().cast(WAY).alias("way")).limit(0)
    return chunks.groupBy("tree", "chunk").cogroup(above.withColumnRenamed("pos", "chunk").groupBy("tree", "chunk")).applyInArrow(
        walk, f"tree {kind}, pos long, way {WAY}")


def forest(leaves: DataFrame, arity: int = 3, tier_levels: int = 6) -> tuple[DataFrame, DataFrame]:
    """Roots and chunk ways of the trees of ``leaves`` (tree, pos, n, digest).

    Returns (tree, n, root) per tree and (tree, chunk, way) per chunk of leaves, the siblings above the chunk.
    """
    tiers = []  # tiers[k]: the nodes that tier k builds upon; tiers[0] are the leaves
    nodes, size = leaves, None
    while size is None or size > 0:
        tiers.append(nodes)
        tops = cut_lineage(_tops(nodes, len(tiers) - 1, arity, tier_levels))
        nodes = tops.select("tree", F.col("chunk").alias("pos"), "n", "digest")
        size = nodes.where("pos > 0").limit(1).count()
    roots = nodes.select("tree", "n", F.col("digest").alias("root"))
    way = None
    for tier in range(len(tiers) - 1, 0, -1):
        way = cut_lineage(_ways(tiers[tier], way, tier, arity, tier_levels))
    if way is None:
        way = nodes.select("tree", "pos", F.array().cast(WAY).alias("way"))
    return roots, way.select("tree", F.col("pos").alias("chunk"), "way")


def manifest(docs: DataFrame, tampered: dict[str, Column] | None = None, fields: list[str] = FIELDS, id_col: str = "doc_id",
             source_col: str = "source", arity: int = 3, tier_levels: int = 6) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root that its tampered leaf folds to.

    ``tampered`` gives replacement columns by field; rows whose leaf it leaves alone are folded from their own leaf.  A leaf
    hashes ``fields``, each ``-`` if null, else byte count, colon, value; missing fields count as null and other columns play no part.
    Per source leaves go by id, then leaf (nulls first), so rows that repeat an id, or are equal, are leaves each; null is a source of its own and
    comes first, and the others go by their UTF-8 bytes.  A lone leaf is its source's subroot, and a lone subroot is the root.  An
    empty table gives an empty result.

    Returns id, ``leaf``, ``subroot``, ``root``, ``proof_sha256`` (hash of all siblings' digests, level by level, left to right),
    ``folded_root`` and ``verified`` (the folded root is the root).
    """
    col = lambda c: F.col(c) if c in docs.columns else F.lit(None).cast("string")
    kept = {c: col(c) for c in fields}
    changed = kept | (tampered or {})
    rows = docs.select(col(id_col).alias("id"), col(source_col).alias("tree"), leaf_hash(list(kept.values())).alias("leaf"),
                       leaf_hash(list(changed.values())).alias("other"))
    rows = rows.withColumn("other", F.when(F.col("other") != F.col("leaf"), F.col("other")))
    rows = cut_lineage(_number(rows, "tree", ["id", "leaf", "other"]).withColumnsRenamed({"__pos": "pos", "__n": "n"}))
    subroots, way = forest(rows.select("tree", "pos", "n", F.col("leaf").alias("digest")), arity, tier_levels)

    tops = subroots.select(F.lit(0).alias("tree"), F.coalesce(F.concat(F.lit("1"), F.col("tree").cast("string")), F.lit("0")).alias("name"), F.col("root").alias("digest"))
    tops = cut_lineage(_number(tops, "tree", ["name"]).withColumnsRenamed({"__pos": "pos", "__n": "n"}))
    nodes = tops.select("tree", "pos", "n", "digest")
    whole, over = forest(nodes, arity, tier_levels)
    chunk = F.floor(F.col("pos") / arity ** tier_levels).cast("long")
    # the way of each subroot: its siblings in its chunk, then those above the chunk
    over = cut_lineage(_ways(nodes, over.select("tree", F.col("chunk").alias("pos"), "way"), 0, arity, tier_levels)).join(
        tops.select("pos", "name", F.col("digest").alias("subroot")), "pos")
    way = way.withColumn("name", F.coalesce(F.concat(F.lit("1"), F.col("tree").cast("string")), F.lit("0")))
    over = over.select("name", F.col("way").alias("over"), "subroot")
    way = cut_lineage(skew_join(way, over, ["name"]).select("tree", "chunk", F.concat("way", "over").alias("way"), "subroot"))
    top = whole.select("root").first()  # one row, or none of an empty table
    return _folded(rows.withColumn("chunk", chunk), way, top["root"] if top else "", id_col, arity, tier_levels)


def _folded(rows: DataFrame, way: DataFrame, root: str, id_col: str, arity: int, tier_levels: int) -> DataFrame:
    """Every row's proof and folded root; a group is one chunk and the one way above it."""
    kind = rows.schema["id"].dataType.simpleString()

    def fold(table: pa.Table, above: pa.Table) -> pa.Table:
        table = table.sort_by("pos")
        leaves = _as_bytes(table["leaf"].to_pylist())
        c = Chunk(leaves, min(tier_levels, levels_above(table["n"][0].as_py(), arity)), arity)
        steps = []  # the states before this chunk's slot on every level above it
        for x in above["way"][0].as_py():
            steps.append((hashlib.sha256(x["left"].encode()), x["right"].encode()))
        rest = b"".join((x["left"] + x["right"]).encode() for x in above["way"][0].as_py())
        proofs, folded = [], []
        for i, other in enumerate(table["other"].to_pylist()):
            own = c.siblings(i)
            h = hashlib.sha256(b"".join(a + b for a, b in own))
            h.update(rest)
            proofs.append(h.hexdigest())
            d = c.fold(i, leaves[i] if other is None else other.encode(), own)
            for state, right in steps:
                d = resume(state, d, right)
            folded.append(d.decode())
        n = table.num_rows
        return pa.table({"id": table["id"], "leaf": table["leaf"], "subroot": pa.array([above["subroot"][0].as_py()] * n, pa.string()),
                         "root": pa.array([root] * n, pa.string()), "proof_sha256": pa.array(proofs, pa.string()),
                         "folded_root": pa.array(folded, pa.string()), "verified": pa.array([f == root for f in folded], pa.bool_())})
    out = rows.groupBy("tree", "chunk").cogroup(way.groupBy("tree", "chunk")).applyInArrow(
        fold, f"id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.withColumnRenamed("id", id_col)


def without_newlines(id_col: str = "doc_id", text_col: str = "text") -> dict[str, Column]:
    """Tampering that deletes line feeds where 2 divides the unsigned crc32 of the decimal id; other rows, and null ids, stay."""
    hit = F.crc32(F.col(id_col).cast("string").cast("binary")) % 2 == 0
    return {text_col: F.when(F.coalesce(hit, F.lit(False)), F.replace(F.col(text_col), F.lit("\n"), F.lit(""))).otherwise(F.col(text_col))}
