"""Hard-negative mining by maximum inner product search in cover trees.

A vector x is augmented by sqrt(M^2 - |x|^2), with M the largest norm, so all candidates lie on one sphere and an inner product with an
anchor q is (|q|^2 + M^2 - dist^2) / 2.  A node of the tree has a centre and a covering radius, so its inner products lie between
those at the nearest and the farthest point that its ball can hold.

The tree's top level are cells around pivots.  The pivots come from a bounded sample (``sample_rows``, the rows with the least hash); every
row is then put in the cell of its nearest pivot, and a cell's radius covers all of its rows.  A cell with many rows, or many equal ones, is dealt by hash
to shards of ``shard_rows`` rows.  One task builds a shard's levels: centres are a net of separated points whose first is the parent's own
centre, every point goes to its nearest centre, and the covering radii are measured, level by level.

A search takes anchors with windows of scores.  An anchor first goes to its nearest cell, whose k-th best score bounds what other
cells must reach; those that can't, or lie wholly outside its windows, are not visited.  Within a shard the levels are
descended in the same way, and the leaves left are scored exactly, best bound first, in batches that double, while a
leaf's bound still reaches the k-th best score.  Anchors travel in blocks to the shards they visit.  Bounds have a slack for rounding and ties, and scores
are whole numbers, so results are exact.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut_lineage, skew_join

LEAST, MOST = -np.iinfo(np.int64).max, np.iinfo(np.int64).max  # their negatives exist
SLACK = 1e-9  # of |q| M + M^2
HITS = "q long, top long, score long, uid long, id long, copies long"


def padded(col: pa.Array, dims: int) -> np.ndarray:
    """Lists of doubles as rows; shorter ones end in zeros."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    ends = np.asarray(col.offsets, dtype=np.int64)
    flat = np.asarray(col.values, dtype=np.float64)
    if (np.diff(ends) == dims).all():
        return flat[ends[0]:ends[-1]].reshape(-1, dims)
    out = np.zeros((len(col), dims))
    for i in range(len(col)):
        row = flat[ends[i]:ends[i + 1]]
        out[i, :len(row)] = row
    return out


def augmented(x: np.ndarray, m2: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(m2 - (x * x).sum(axis=1), 0))])


def _distance(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = x - c
    return np.sqrt((d * d).sum(axis=1))


def net(x: np.ndarray, most: int) -> np.ndarray:
    """Centres among the rows of x: the first row, then rows in order that are farther from all centres than the scale, which halves when none is."""
    centres, d = [0], _distance(x, x[0])
    scale = d.max() / 2
    while len(centres) < most and d.max() > 0:
        far = np.flatnonzero(d > scale)
        if not len(far):
            scale /= 2
            continue
        centres.append(int(far[0]))
        d = np.minimum(d, _distance(x, x[far[0]]))
    return np.array(centres)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(index of the nearest centre, distance from it) of every row; equal distances go to the first."""
    best, at = np.full(len(x), np.inf), np.zeros(len(x), dtype=np.int64)
    for k, c in enumerate(centres):
        d = _distance(x, c)
        at[d < best] = k
        best = np.minimum(best, d)
    return at, best


def cover_tree(x: np.ndarray, leaf_rows: int, fan: int) -> dict:
    """Levels of nodes over the rows of x.

    levels[l] holds the nodes' centre rows, radii, parents (in the level above) and leaf numbers (-1 inside); leaves are the row numbers of
    each leaf, in ascending order.
    """
    levels, leaves = [], []
    nodes = [(np.arange(len(x)), -1)]
    while nodes:
        centres, radii, parents, numbers, below = [], [], [], [], []
        for rows, parent in nodes:
            d = _distance(x[rows], x[rows[0]])
            centres.append(rows[0])
            radii.append(d.max())
            parents.append(parent)
            if len(rows) <= leaf_rows or radii[-1] == 0:
                numbers.append(len(leaves))
                leaves.append(np.sort(rows))
                continue
            numbers.append(-1)
            own = x[rows]
            at, _ = nearest(own, own[c := net(own, fan)])
            for k, first in enumerate(c):
                part = np.flatnonzero(at == k)
                below.append((np.concatenate([rows[[first]], rows[part[part != first]]]), len(centres) - 1))
        levels.append(tuple(map(np.array, (centres, radii, parents, numbers))))
        nodes = below
    return {"levels": levels, "leaves": leaves}


def bounds(q: np.ndarray, centres: np.ndarray, radii: np.ndarray, m2: float) -> tuple[np.ndarray, np.ndarray]:
    """(least, most) inner products of anchors (rows) with points in the balls (columns)."""
    both = (q * q).sum(axis=1)[:, None] + m2
    dist = np.sqrt(np.maximum(both - 2 * (q @ centres.T), 0))
    near, far = np.maximum(dist - radii, 0), dist + radii
    slack = SLACK * (both + m2) + 1e-6
    return (both - far * far) / 2 - slack, (both - near * near) / 2 + slack


def scores(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole-number inner products, exact at every size; beyond 64 bits the nearest end."""
    size = max(np.abs(q).max(initial=0), 1) * max(np.abs(x).max(initial=0), 1) * max(1, q.shape[1])
    if size < 2.0 ** 52:
        return np.rint(q @ x.T).astype(np.int64)
    whole = np.vectorize(int, otypes=[object])
    return np.clip(whole(q).dot(whole(x).T), LEAST + 1, MOST).astype(np.int64)


class Found:
    """The k best (score, then id) of every anchor and window; rows of the shard, -1 for none."""

    def __init__(self, n: int, windows: int, k: int):
        self.score = np.full((n, windows, k), LEAST)
        self.row = np.full((n, windows, k), -1, dtype=np.int64)

    def add(self, which: np.ndarray, w: int, score: np.ndarray, rows: np.ndarray) -> None:
        """score[i, j] of row rows[j] for anchor which[i]; LEAST is no hit.  Rows are numbered in order of their ids."""
        k = self.score.shape[2]
        if score.shape[1] > 4 * k:
            part = np.argsort(-score, axis=1, kind="stable")[:, :k]
            score, rows = np.take_along_axis(score, part, 1), rows[part]
        else:
            rows = np.broadcast_to(rows, score.shape)
        s = np.concatenate([self.score[which, w], score], axis=1)
        r = np.concatenate([self.row[which, w], np.where(score > LEAST, rows, -1)], axis=1)
        best = np.lexsort((r, -s), axis=1)[:, :k]
        self.score[which, w] = np.take_along_axis(s, best, 1)
        self.row[which, w] = np.take_along_axis(r, best, 1)


def descend(shard: dict, q: dict, k: int, same: bool, m2: float) -> Found:
    """The best rows of a shard for a block of anchors: q has vec, label, uid and by window the least and most score and the k-th best so far."""
    x, vec = shard["vec"], q["vec"]
    n, windows = q["low"].shape
    found = Found(n, windows, k)

    def open_nodes(least, most):
        """Nodes whose scores can lie in a window and reach its k-th best."""
        floor = np.maximum(q["low"], np.maximum(q["kth"], found.score[:, :, k - 1]))
        return ((most[:, :, None] >= floor[:, None, :]) & (least[:, :, None] <= q["high"][:, None, :])).any(axis=2)
    alive = np.ones((n, 1), dtype=bool)
    leaf_of, leaf_most, leaf_least = [], [], []
    for centres, radii, parents, numbers in shard["tree"]["levels"]:
        up = alive[:, np.maximum(parents, 0)]
        visit = np.flatnonzero(up.any(axis=0))
        alive = np.zeros((n, len(centres)), dtype=bool)
        if not len(visit):
            break
        least, most = bounds(vec, x[centres[visit]], radii[visit], m2)
        alive[:, visit] = up[:, visit] & open_nodes(least, most)
        for j, v in enumerate(visit):
            if numbers[v] >= 0 and alive[:, v].any():
                leaf_of.append(numbers[v])
                leaf_most.append(np.where(alive[:, v], most[:, j], -np.inf))
                leaf_least.append(least[:, j])
    if not leaf_of:
        return found
    most, least = np.column_stack(leaf_most), np.column_stack(leaf_least)
    order = np.argsort(-most, axis=1, kind="stable")
    at, step = 0, 1
    while at < len(leaf_of):
        wanted = np.zeros(most.shape, dtype=bool)
        np.put_along_axis(wanted, order[:, at:at + step], True, axis=1)
        wanted &= open_nodes(least, most)
        for j in np.flatnonzero(wanted.any(axis=0)):
            which = np.flatnonzero(wanted[:, j])
            rows = shard["tree"]["leaves"][leaf_of[j]]
            s = scores(vec[which], x[rows])
            fits = (shard["label"][rows] == q["label"][which, None]) == same
            self_ = (shard["uid"][rows] == q["uid"][which, None]) & (shard["copies"][rows] == 1)
            s = np.where(fits & ~self_, s, LEAST)
            for w in range(windows):
                inside = (s >= q["low"][which, w, None]) & (s <= q["high"][which, w, None])
                hit = inside.any(axis=1)
                if hit.any():
                    found.add(which[hit], w, np.where(inside, s, LEAST)[hit], rows)
        at, step = at + step, step * 2
    return found


class Index:
    """Cover trees over the rows (uid, id, label, vec, copies) of a materialised table; id and label are whole numbers."""

    def __init__(self, rows: DataFrame, shard_rows: int = 4096, leaf_rows: int = 64, fan: int = 16, sample_rows: int = 4096, max_cells: int = 256):
        self.rows = rows
        size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("vec")).alias("dims"),
                        F.max(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x)).alias("m2")).first()
        self.n, self.dims, self.m2 = size["n"], max(1, size["dims"] or 1), (size["m2"] or 0.0) * (1 + 1e-12)
        sample_rows = max(64, min(sample_rows, (1 << 22) // self.dims))
        cells = min(max_cells, -(-self.n // shard_rows))
        if not self.n:
            return
        sample = rows.select("vec", F.xxhash64("id", "label").alias("h"), "uid").orderBy("h", "uid").limit(sample_rows).select("vec").toArrow()
        x = augmented(padded(sample["vec"], self.dims), self.m2)
        pivots = x[net(x, cells)]
        dims, m2 = self.dims, self.m2

        def assign(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in it:
                at, _ = nearest(augmented(padded(b.column("vec"), dims), m2), pivots)
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(at, pa.int32())], [*b.schema.names, "cell"])
        rows = cut_lineage(rows.mapInArrow(assign, "uid long, id long, label long, vec array<double>, copies long, cell int"))
        counts = {r["cell"]: r["count"] for r in rows.groupBy("cell").count().collect()}  # at most max_cells rows
        shards = {c: -(-n // shard_rows) for c, n in sorted(counts.items())}
        first = {c: sum(list(shards.values())[:k]) for k, c in enumerate(shards)}
        of = lambda d: F.element_at(F.create_map(*[F.lit(v) for c in d for v in (c, d[c])]), F.col("cell"))
        rows = rows.withColumn("shard", (of(first) + F.pmod(F.xxhash64("uid"), of(shards))).cast("int"))

        def build(table: pa.Table) -> pa.Table:
            null = np.asarray(table["id"].is_null())
            ids = np.asarray(table["id"].fill_null(0), dtype=np.int64)
            order = np.lexsort((np.asarray(table["uid"]), ids, null))
            take = lambda c: np.asarray(table[c], dtype=np.int64)[order]
            vec = padded(table["vec"], dims)[order]
            aug = augmented(vec, m2)
            tree = cover_tree(aug, leaf_rows, fan)
            shard = {"vec": vec, "id": ids[order], "null": null[order], "uid": take("uid"), "label": take("label"), "copies": take("copies"), "tree": tree}
            cell = table["cell"][0].as_py()
            radius = float(_distance(aug, pivots[cell]).max())
            return pa.table({"shard": table["shard"].slice(0, 1), "cell": pa.array([cell], pa.int32()), "radius": [radius], "data": [pickle.dumps(shard, protocol=5)]})
        self.shards = cut_lineage(rows.groupBy("shard").applyInArrow(build, "shard int, cell int, radius double, data binary"))
        radius = {r["cell"]: r["r"] for r in self.shards.groupBy("cell").agg(F.max("radius").alias("r")).collect()}  # at most max_cells rows
        # only the cells' centres, radii and shard numbers leave the cluster
        self.cells = [(pivots[c][:-1], radius[c], first[c], shards[c]) for c in shards]

    def search(self, queries: DataFrame, k: int, same: bool, low: int = 0, den: int = 100, block_rows: int = 4096) -> DataFrame:
        """The k best rows of every anchor and window, each row with its copies, as (q, top, score, uid, id, copies).

        ``queries`` is a materialised table (q, label, vec, tops): q is the anchor's uid; tops are the windows' highest scores, and a window's least is low / den of
        it; null tops mean one window without ends.  Rows are of the anchor's label if ``same``, else of another; the anchor's own row
        comes with one copy less.  Ties go to the smaller id, null last.
        """
        blocks = max(1, -(-queries.count() // block_rows))
        queries = queries.withColumn("block", F.pmod(F.xxhash64("q"), F.lit(blocks)).cast("int"))
        first = cut_lineage(self._visit(queries.withColumn("kth", F.lit(None).cast("map<long,long>")), True, blocks, k, same, low, den))
        # what has k hits in the nearest cell needs nothing below the least of them
        kth = first.groupBy("q", "top").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("kth")).where(F.col("n") >= k)
        kth = kth.groupBy("q").agg(F.map_from_entries(F.collect_list(F.struct(F.coalesce("top", F.lit(MOST)).alias("top"), "kth"))).alias("kth"))
        rest = self._visit(queries.join(kth, "q", "left"), False, blocks, k, same, low, den)
        hits = first.unionByName(rest)
        place = Window.partitionBy("q", "top").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid")
        return hits.withColumn("__r", F.row_number().over(place)).where(F.col("__r") <= k).drop("__r")

    def _visit(self, queries: DataFrame, nearest_cell: bool, blocks: int, k: int, same: bool, low: int, den: int) -> DataFrame:
        dims, m2, cells = self.dims, self.m2, self.cells
        centres, radii = np.array([c[0] for c in cells]), np.array([c[1] for c in cells])

        def windows(b) -> dict:
            tops, kths = b["tops"].to_pylist(), [dict(x or []) for x in b["kth"].to_pylist()]
            wide = max((len(t) for t in tops if t is not None), default=1) or 1
            low_, high, kth = np.full((len(tops), wide), MOST), np.full((len(tops), wide), LEAST), np.full((len(tops), wide), LEAST)
            for i, (t, d) in enumerate(zip(tops, kths)):
                if t is None:
                    low_[i, 0], high[i, 0], kth[i, 0] = LEAST + 1, MOST, d.get(MOST, LEAST)
                    continue
                for w, top in enumerate(t):
                    low_[i, w], high[i, w], kth[i, w] = max(LEAST + 1, -(-top * low // den)), top, d.get(top, LEAST)
            return {"tops": tops, "low": low_, "high": high, "kth": kth, "vec": padded(b["vec"], dims)}

        def choose(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """A row per (anchor, shard to visit)."""
            for b in it:
                if not b.num_rows:
                    continue
                t = pa.Table.from_batches([b])
                q = windows(t)
                least, most = bounds(q["vec"], centres, radii, m2)
                near = np.zeros(most.shape, dtype=bool)
                near[np.arange(len(most)), np.argmax(q["vec"] @ centres.T, axis=1)] = True
                if nearest_cell:
                    go = near
                else:
                    floor = np.maximum(q["low"], q["kth"])
                    go = ~near & ((most[:, :, None] >= floor[:, None, :]) & (least[:, :, None] <= q["high"][:, None, :])).any(axis=2)
                rows, at = np.nonzero(go)
                for i in range(0, len(rows), 2048):
                    each = [(r, s) for r, c in zip(rows[i:i + 2048], at[i:i + 2048]) for s in range(cells[c][2], cells[c][2] + cells[c][3])]
                    out = t.take(pa.array([r for r, _ in each], pa.int64())).append_column("shard", pa.array([s for _, s in each], pa.int32()))
                    yield from out.to_batches()

        def look(shard: pa.Table, anchors: pa.Table) -> pa.Table:
            if not shard.num_rows or not anchors.num_rows:
                return pa.table({c: pa.array([], pa.int64()) for c in ("q", "top", "score", "uid", "id", "copies")})
            s = pickle.loads(shard["data"][0].as_py())
            q = windows(anchors)
            q["uid"], q["label"] = np.asarray(anchors["q"], dtype=np.int64), np.asarray(anchors["label"], dtype=np.int64)
            found = descend(s, q, k, same, m2)
            i, w, j = np.nonzero(found.row >= 0)
            rows = found.row[i, w, j]
            top = pa.array([q["tops"][a][b] if q["tops"][a] is not None else None for a, b in zip(i.tolist(), w.tolist())], pa.int64())
            copies = s["copies"][rows] - (s["uid"][rows] == q["uid"][i])
            return pa.table({"q": q["uid"][i], "top": top, "score": found.score[i, w, j], "uid": s["uid"][rows],
                             "id": pa.array(s["id"][rows], pa.int64(), mask=s["null"][rows]), "copies": copies})
        fields = "q long, label long, vec array<double>, tops array<long>, block int, kth map<bigint,bigint>"
        sent = queries.select("q", "label", "vec", "tops", "block", "kth").mapInArrow(choose, f"{fields}, shard int")
        trees = self.shards.select("shard", "data", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"))
        return trees.groupBy("shard", "block").cogroup(sent.groupBy("shard", "block")).applyInArrow(look, HITS)


def whole_vectors(vec: Column, scale: float) -> Column:
    """floor(scale * x) of every component as doubles; null if a component is null or not finite, or becomes so."""
    y = F.transform(vec, lambda x: x.cast("double") * F.lit(float(scale)))
    fine = F.forall(y, lambda v: F.coalesce(F.abs(v) < F.lit(float("inf")), F.lit(False)))
    whole = F.transform(y, lambda v: F.when(F.abs(v) < 2.0 ** 53, F.floor(v).cast("double")).otherwise(v))
    return F.when(F.coalesce(fine, F.lit(False)), whole)


def hard_negatives(df: DataFrame, anchor: Column, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", positives: int = 5,
                   negatives: int = 5, low: int = 80, den: int = 100, scale: float = 256.0, **index) -> DataFrame:
    """For every anchor its first positives, and for each of those the first negatives whose score is between low / den of the positive's and all of it.

    Scores are inner products of floor(scale * x); higher ones come first, ties by smaller id, null ids last.  Positives are other rows of the
    anchor's label, negatives are rows of other labels.  Returns anchor_id, positive_id, rank, negative_id, positive_score, negative_score; an anchor
    and positive without negatives have no row.

    Ids and labels are whole numbers.  Rows with a null label, a null vector, or a component that is null, not finite or beyond the double range when
    scaled take no part.  Rows that repeat id, label and vector count each: as anchors, positives and negatives.  Of vectors of different lengths the
    shorter counts as ending in zeros, an empty one as zeros.  Scores beyond 64 bits count as the nearest end.  An empty table gives an empty
    result.  Other input columns are dropped.
    """
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), whole_vectors(F.col(vec_col), scale).alias("vec"),
                     F.coalesce(anchor, F.lit(False)).alias("anchor")).where("label is not null and vec is not null")
    rows = rows.groupBy("id", "label", "vec").agg(F.max("anchor").alias("anchor"), F.count(F.lit(1)).alias("copies"))
    rows = cut_lineage(rows.withColumn("uid", F.monotonically_increasing_id()))
    tree = Index(rows.select("uid", "id", "label", "vec", "copies"), **index)
    names = {"anchor_id": "long", "positive_id": "long", "rank": "int", "negative_id": "long", "positive_score": "long", "negative_score": "long"}
    if not tree.n:
        return rows.select(*[F.lit(None).cast(t).alias(c) for c, t in names.items()])
    anchors = cut_lineage(rows.where("anchor").select(F.col("uid").alias("q"), "label", "vec", "id", "copies"))

    def first(hits: DataFrame, k: int) -> DataFrame:
        """Every hit as often as its row occurs, the first k with their place."""
        hits = hits.withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k)))))
        place = Window.partitionBy("q", "top").orderBy(F.desc("score"), F.asc_nulls_last("id"), "uid", "__c")
        return hits.withColumn("rank", F.row_number().over(place)).where(F.col("rank") <= k).select("q", "top", "score", "id", "rank")
    found = first(tree.search(anchors.withColumn("tops", F.lit(None).cast("array<long>")), positives, True), positives)
    pos = cut_lineage(found.select("q", F.col("score").alias("top"), F.col("id").alias("positive_id")))
    tops = pos.groupBy("q").agg(F.array_sort(F.collect_set("top")).alias("tops"))
    found = first(tree.search(cut_lineage(anchors.join(tops, "q")), negatives, False, low, den), negatives)
    out = skew_join(pos, found, ["q", "top"]).join(anchors.select("q", F.col("id").alias("anchor_id"), "copies"), "q")
    out = out.withColumn("__c", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return out.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"),
                      F.col("top").alias("positive_score"), F.col("score").alias("negative_score"))
