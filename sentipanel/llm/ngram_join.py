"""N-gram Jaccard self-join by universe partitions.

Documents are sets of word shingles.  Two sets with Jaccard similarity of at least ``num / den`` differ in at
most H = (den - num) / (den + num) * (|X| + |Y|) shingles.  Within a size band, shingles are hashed into
segments.  With H + 1 segments one segment must agree exactly (its subset is the signature); with half as
many, one must agree up to one deletion, and the signatures are the subset and all its one-deletion
neighbours.  Each band takes the cheaper of the two: exact subsets are cheap to index, deletion
neighbourhoods cost a row per shingle and collide far less, so a band changes over when the rows its measured
collisions bring into verification outweigh its shingles (``merge_ratio``).

A set near the top of a band also indexes itself in the next band, for partners there.  Empty
segments say little.  A set differs from any partner in a number of shingles that its own size bounds, so as many segments
as lie beyond that bound agree; if all of them could be empty, the set indexes itself once more under another seed.  Two
sets that agree in empty segments only both do so, and the argument holds for any seed.

Candidates share a signature.  A set with too many shingles that no other candidate has can have no link and goes, before any
sets are joined.  Candidates are not paired off.  Each signature names a hub, its set with the most live
signatures; hub and members are verified exactly, which joins true groups of copies in a linear number of
pairs.  What is left are links between two members of different components.  With D the symmetric difference from the
hub, |X ^ Y| = |D(X)| + |D(Y)| - 2 |D(X) & D(Y)|, so two such members that share nothing in D would both be linked with the
hub, and be in one component.  They are therefore found by an index on the rarest shingles of D (prefix
filter).  In a group of copies that drifted apart most members share some of that, so the index also holds every set's
sketch, a parity bit for each of its buckets of shingles: two sketches differ in no more bits than their sets in shingles, and
the index joins only pairs whose sketches allow a link.  Only pairs whose common keys, and what may follow the last of them,
suffice get their differences (positional filter), and the condition of that join is the exact similarity: it returns links,
not candidates.  Component ids are exact.

What moves every signature, shingle or token set goes in ``passes``: by slices of its keys, one after the other, whose shuffle files
are released before the next, so that disk holds a slice of it.  Small tables need fewer slices, and small tables of links fewer tasks.

Equal sets are one node, named by a 64-bit hash of its shingles (64-bit hashes as well): a false link
needs two different sets with equal names, about 3 expected among 10^10 sets.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut_lineage, drop_clashing, join_bounded, release, skew_join, text_of
from .components import components

BAND_BITS = 0xFFF  # of a signature, for the number of its size band
LEVELS = 6  # seeds tried in place of empty segments
SKETCH = 16  # words of a sketch, a power of two; groups of smaller sets fold it
PASSES, PASS_SHINGLES = 4, 12_000_000  # slices of the keys at most, and shingles to a slice
TASK_EDGES = 100_000  # links to a task of the components' rounds
U = np.uint64
MULT = [U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9), U(0xD6E8FEB86659FD93), U(0xFF51AFD7ED558CCD)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
        return x ^ (x >> U(31))


class WordHash(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= 400_000:
            self.clear()
        v = self[word] = xxhash.xxh3_64_intdigest(word)
        return v


def shingles(text: str, size: int, words: WordHash) -> np.ndarray:
    """Sorted distinct shingle hashes of a whole text; A-Z are lower-cased, words are split at ASCII spaces."""
    w = text.encode("utf-8", "surrogatepass").lower().split()
    if not w:
        return np.empty(0, dtype=np.uint64)
    if len(w) < size:
        w, n = [b"\0".join([b"short", *w])], 1
        return mix(np.array([words[w[0]]], dtype=np.uint64))
    h = np.fromiter(map(words.__getitem__, w), dtype=np.uint64, count=len(w))
    n = len(w) - size + 1
    with np.errstate(over="ignore"):
        x = np.zeros(n, dtype=np.uint64)
        for k in range(size):
            x = mix(x * MULT[0] + h[k:k + n])
    return np.unique(x)


def sketch(s: np.ndarray) -> np.ndarray:
    """Parity bits of the shingles' buckets.  A shingle that only one of two sets has flips one bit, so they differ in as many bits at most."""
    odd = np.bincount((s & U(64 * SKETCH - 1)).astype(np.int64), minlength=64 * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def _folded(words: Column, width: Column) -> Column:
    """A sketch of fewer buckets, of ``width`` words (a power of two): word i takes all words that leave i."""
    zero = F.lit(0).cast("long")
    return F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.aggregate(
        F.filter(words, lambda _, k: F.pmod(k, width) == i), zero, lambda x, y: x.bitwiseXOR(y)))


def _apart(a: str, b: str) -> Column:
    """In how many bits two sketches of one width differ: no more than their sets in shingles."""
    bits = [F.coalesce(F.bit_count(F.get(a, F.lit(k)).bitwiseXOR(F.get(b, F.lit(k)))), F.lit(0)) for k in range(SKETCH)]
    return reduce(lambda x, y: x + y, bits)


def set_name(s: np.ndarray) -> int:
    return int(np.uint64(xxhash.xxh3_64_intdigest(s.tobytes())).astype(np.int64))


class Partition:
    """Size bands and their segments for a similarity of num / den."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den
        ratio = (den / num) ** 4
        self.low = [1]
        while self.low[-1] < 1 << 31:
            self.low.append(max(self.low[-1] + 1, int(self.low[-1] * ratio)))
            if len(self.low) > BAND_BITS:
                raise ValueError("similarity too near 1 for size bands")

    def bands(self, n: int) -> list[int]:
        b = bisect_right(self.low, n) - 1
        return [b, b + 1] if n * self.den >= self.num * self.low[b + 1] else [b]

    def differences(self, band: int, n: int | None = None) -> int:
        """Most differences of two similar sets of a band, or of a set of n shingles and any partner there."""
        top = self.low[band + 1] - 1
        return (2 * top if n is None else n + min(top, n * self.den // self.num)) * (self.den - self.num) // (self.den + self.num)

    def signatures(self, s: np.ndarray, merged: frozenset[int], only: frozenset[int] | None = None):
        """(keys, full) per band; full is false for one-deletion neighbours.  The low bits of a key are its band."""
        one = lambda keys, band: (keys & ~U(BAND_BITS)) | U(band)
        for band in self.bands(len(s)):
            if only is not None and band not in only:
                continue
            h, mine = self.differences(band), self.differences(band, len(s))
            near = band in merged and h > 0
            m = h // 2 + 1 if near else h + 1
            spare = m - 1 - (mine // 2 if near else mine)  # segments that agree with any partner, beyond one
            for level in range(LEVELS):
                with np.errstate(over="ignore"):
                    salt = mix(np.array([band * 64 + level * 2 + near + 1], dtype=np.uint64) * MULT[1])[0]
                    v = mix(s ^ salt)
                    seg = ((v >> U(32)) * U(m)) >> U(32)
                    seg = seg.astype(np.int64)
                    part = mix(v * MULT[2])
                    sums = np.zeros(m, dtype=np.uint64)
                    np.add.at(sums, seg, part)
                    tag = mix(np.arange(m, dtype=np.uint64) * MULT[3] + salt)
                    count = np.bincount(seg, minlength=m)
                    last = level == LEVELS - 1
                    use = np.ones(m, dtype=bool) if last else count > 0
                    keys = mix(sums + tag)[use]
                    yield one(keys, band), True
                    if near:
                        # what is left after taking one shingle out; a lone shingle leaves the empty set, which only
                        # full empty segments could match, and those are indexed under the next seed
                        alone = (count[seg] == 1) & (not last)
                        yield one(mix(sums[seg] - part + tag[seg])[~alone], band), False
                        thin = int((count <= 1).sum()) > spare
                    else:
                        thin = int((count == 0).sum()) > spare
                if not thin or last:
                    break


def _narrow(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("__id"), text_of(text_col).alias("__t"))


def _sets(d: DataFrame, size: int, p: Partition) -> DataFrame:
    """Every row's set: __id, n, name and its exact-subset signatures.  Name is null for empty sets."""
    schema = f"__id {d.schema['__id'].dataType.simpleString()}, n long, name long, keys array<long>"

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in it:
            n, names, keys = [], [], []
            for t in b.column("__t"):
                s = shingles(t.as_py(), size, words)
                n.append(len(s))
                names.append(set_name(s) if len(s) else None)
                keys.append(np.concatenate([k for k, _ in p.signatures(s, frozenset())]) if len(s) else np.empty(0, np.uint64))
            yield pa.RecordBatch.from_arrays([b.column("__id"), pa.array(n, pa.int64()), pa.array(names, pa.int64()), _listed(keys)], ["__id", "n", "name", "keys"])
    return d.mapInArrow(run, schema)


def _listed(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.concatenate([np.empty(0, np.uint64), *arrays]).view(np.int64)))


def _in_passes(step: Callable[[Column], DataFrame], key: Column, passes: int) -> DataFrame:
    """All rows of ``step``, which gets a condition on hashed keys and returns its rows for them; a slice of the keys at a time."""
    parts = []
    for k in range(passes):
        parts.append(cut_lineage(step(F.pmod(F.shiftrightunsigned(key, 40), F.lit(passes)) == k)))
        release(parts[0].sparkSession)
    return reduce(DataFrame.unionByName, parts)


def _one_each(sets: DataFrame, reps: DataFrame, broadcast_rows: int, mine: Column) -> DataFrame:
    """(name, key) once per name, of the keys that are ``mine``: only the rows of names that occur again are shuffled."""
    again = reps.where("copies > 1").select("name")
    keys = lambda how: join_bounded(sets.select("name", "keys"), again, ["name"], how, broadcast_rows).select("name", F.explode("keys").alias("key")).where(mine)
    return keys("left_anti").unionByName(keys("left_semi").distinct())


def _signatures(d: DataFrame, size: int, p: Partition, merged: frozenset[int], only: frozenset[int] | None = None) -> DataFrame:
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        parts: list[tuple] = []
        held = 0

        def out():
            keys = np.concatenate([x[0] for x in parts]).view(np.int64)
            lens = [len(x[0]) for x in parts]
            rep = lambda i, t: np.repeat(np.array([x[i] for x in parts], dtype=t), lens)
            cols = [pa.array(keys), pa.array(rep(2, np.int64)), pa.array(rep(1, np.int8).astype(bool))]
            parts.clear()
            return pa.RecordBatch.from_arrays(cols, ["key", "name", "full"])
        for b in it:
            for t in b.column("__t"):
                s = shingles(t.as_py(), size, words)
                if not len(s):
                    continue
                name = set_name(s)
                for keys, full in p.signatures(s, merged, only):
                    parts.append((keys, full, name))
                    held += len(keys)
                if held >= 100_000:
                    yield out()
                    held = 0
        if parts:
            yield out()
    return d.mapInArrow(run, "key long, name long, full boolean")


def _members(sig: DataFrame, live: DataFrame, broadcast_rows: int) -> DataFrame:
    """The sets (key, name) of the live signatures."""
    live, _ = broadcast_if_small(cut_lineage(live.select("key")), broadcast_rows)
    return sig.select("key", "name").join(live, "key")


def _joined(pairs: DataFrame, tokens: DataFrame, broadcast_rows: int = 1_000_000) -> DataFrame:
    """Pairs (a, b) of a materialised table with their shingles ta, tb.

    Within the bound the narrow pairs travel to the token sets; then only the sets that are some pair's a move.
    """
    one = lambda c: tokens.select(F.col("name").alias(c), F.col("tokens").alias(f"t{c}"))
    narrow, small = broadcast_if_small(pairs, broadcast_rows)
    rows = one("b").join(narrow, "b") if small else skew_join(pairs, one("b"), ["b"])
    hubs, _ = broadcast_if_small(cut_lineage(pairs.select("a").distinct()), broadcast_rows)
    return skew_join(rows, one("a").join(hubs, "a", "left_semi"), ["a"])


def _verify(pairs: DataFrame, tokens: DataFrame, p: Partition, passes: int = 1) -> DataFrame:
    """The pairs (a, b) of a materialised table whose sets reach the similarity."""
    return _in_passes(lambda mine: _similar(pairs.where(mine), tokens, p), F.xxhash64("a"), passes)


def _similar(pairs: DataFrame, tokens: DataFrame, p: Partition) -> DataFrame:
    both = _joined(pairs, tokens).select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("o"), (F.size("ta") + F.size("tb")).alias("s"))
    return both.where(F.col("o") * p.den >= (F.col("s") - F.col("o")) * p.num).select("a", "b")


def _able(names: DataFrame, tokens: DataFrame, p: Partition, passes: int = 1) -> DataFrame:
    """The names, of a materialised table (name, n), whose sets can have a link among these sets.

    A set whose shingles of its own, among all the sets, are too many reaches the similarity with none of them.
    """
    each = tokens.select("name", F.explode("tokens").alias("token"))
    one = lambda mine: each.where(mine).groupBy("token").agg(F.min("name").alias("name"), F.max("name").alias("hi")).where("name = hi")
    own = _in_passes(lambda mine: one(mine).groupBy("name").agg(F.count(F.lit(1)).alias("own")), F.col("token"), passes)
    own = own.groupBy("name").agg(F.sum("own").alias("own"))
    able = names.join(own, "name", "left").where((F.col("n") - F.coalesce("own", F.lit(0))) * p.den >= F.col("n") * p.num)
    return cut_lineage(able.select("name"))


def _partnered(spokes: DataFrame, tokens: DataFrame, p: Partition, passes: int = 1) -> DataFrame:
    """The spokes that can have a link in another component."""
    names = cut_lineage(spokes.select("name", "n").distinct())
    able = _able(names, join_bounded(tokens, names.select("name"), ["name"]), p, passes)
    release(spokes.sparkSession)
    spokes = cut_lineage(join_bounded(spokes, able, ["name"]))
    mixed = spokes.groupBy("hub").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("hub")
    return cut_lineage(join_bounded(spokes, cut_lineage(mixed), ["hub"]))


def _between_members(spokes: DataFrame, tokens: DataFrame, p: Partition, passes: int = 1) -> DataFrame:
    """Links (a, b) between members of a hub that are in different components.

    ``spokes`` holds (hub, name, n, label).  Of D(name) only the rarest shingles are indexed, as many as leave out fewer than any
    partner must share; a shingle that one member of the hub has is no key.  Keys join only pairs whose sketches allow a link.
    """
    num, den = p.num, p.den

    def indexed(mine: Column) -> DataFrame:
        d = _joined(spokes.where(mine).withColumnsRenamed({"hub": "a", "name": "b"}), tokens).withColumnsRenamed({"a": "hub", "b": "name"})
        d = cut_lineage(d.select("hub", "name", "n", "label", F.concat(F.array_except("ta", "tb"), F.array_except("tb", "ta")).alias("d")))
        release(d.sparkSession)
        each = d.select("hub", "name", F.explode("d").alias("token"))
        often = each.groupBy("hub", "token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
        # of every difference what other members have too, rarest first; only that can be in an intersection
        shared = skew_join(each, often, ["hub", "token"]).groupBy("hub", "name").agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("s"))
        # two buckets a shingle tell most sets apart that differ in a quarter more than a link allows
        width = F.least(F.lit(SKETCH), F.pow(F.lit(2), F.ceil(F.log2(F.greatest(F.max("n") / 32, F.lit(1))))).cast("int"))
        least = d.groupBy("hub").agg(F.min(F.size("d")).alias("least"), width.alias("width"))
        size, reach = F.size("d"), F.floor(F.col("n") * (den - num) / num)
        need = F.greatest(F.lit(1), size - reach, F.ceil((size + F.col("least") - reach) / 2))  # shingles that any partner shares
        alone = size - F.size("s")  # shingles of no other member come first in the order
        keys = F.greatest(size - need + 1 - alone, F.lit(0)).cast("int")
        x = d.select("hub", "name", "n", "label", "d").join(shared, ["hub", "name"]).join(least, "hub")
        return x.select("hub", "name", "n", "label", size.cast("int").alias("size"), F.col("s.token").alias("d"), keys.alias("keys"), "width").where("keys > 0")

    x = _in_passes(indexed, F.xxhash64("hub"), passes)
    sketches = tokens.select("name", "sketch")
    # the index is narrow: a row per indexed shingle without the differences, which travel once per pair
    key = skew_join(x, sketches, ["name"]).withColumn("sketch", _folded(F.col("sketch"), F.col("width")))
    key = key.select("hub", "name", "n", "label", "size", "sketch", F.size("d").alias("len"), F.posexplode(F.slice("d", F.lit(1), F.col("keys"))).alias("pos", "token"))
    key = key.withColumn("after", F.col("len") - F.col("pos") - 1)
    one = lambda t: key.select("hub", "token", *[F.col(c).alias(f"{c}_{t}") for c in ("name", "n", "label", "size", "after", "sketch")])
    bound = F.abs(F.col("size_a") - F.col("size_b")) * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)
    able = _apart("sketch_a", "sketch_b") * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)
    pairs = one("a").join(one("b"), ["hub", "token"]).where((F.col("name_a") < F.col("name_b")) & (F.col("label_a") != F.col("label_b")) & bound & able)
    # both lists are in one order: what two differences share is what they share in the index and, beyond their last common key, the rest of the shorter at most
    pairs = pairs.groupBy("hub", "name_a", "name_b").agg(
        F.max(F.col("n_a") + F.col("n_b")).alias("n"), F.max(F.col("size_a") + F.col("size_b")).alias("size"),
        F.count(F.lit(1)).alias("both"), F.min(F.least("after_a", "after_b")).alias("after"))
    near = lambda both: (F.col("size") - 2 * both) * (den + num) <= F.col("n") * (den - num)
    pairs = pairs.where(near(F.col("both") + F.col("after")))
    # any hub of a pair tells its exact similarity
    pairs = cut_lineage(pairs.groupBy("name_a", "name_b").agg(F.min(F.struct("hub", "n", "size")).alias("h")).select("h.*", "name_a", "name_b"))
    release(x.sparkSession)

    def linked(mine: Column) -> DataFrame:
        part = pairs.where(mine)
        side = lambda t: x.select("hub", F.col("name").alias(f"name_{t}"), F.col("d").alias(f"d_{t}"))
        both = skew_join(skew_join(part, side("a").where(mine), ["hub", "name_a"]), side("b"), ["hub", "name_b"])
        return both.where(near(F.size(F.array_intersect("d_a", "d_b")))).select(F.col("name_a").alias("a"), F.col("name_b").alias("b"))

    return _in_passes(linked, F.xxhash64("name_a"), passes)


def jaccard_components(docs: DataFrame, shingle_words: int = 3, num: int = 9, den: int = 10, id_col: str = "doc_id",
                       text_col: str = "text", merge_ratio: float = 4.0, broadcast_rows: int = 1_000_000, passes: int | None = None) -> DataFrame:
    """Component of every document under links of Jaccard similarity num / den or more.

    Returns the id column, ``n_shingles`` and ``component_id`` (smallest id reachable, itself included); one row per
    input row.  Fewer words than a shingle are one shingle; null and empty texts and texts of white space have no
    shingles and no links.  Repeated rows link with each other; null ids are passed over in component ids.
    An empty table gives an empty result; other input columns are dropped.  More ``passes`` need less disk and change no result;
    none gives one to every 12 million shingles of different sets, 4 at most.
    """
    p = Partition(num, den)
    d = _narrow(docs, id_col, text_col)
    keyed = cut_lineage(_sets(d, shingle_words, p).withColumn("name", F.coalesce("name", F.xxhash64(F.lit("empty"), "__id"))))
    sets = cut_lineage(keyed.drop("keys"))
    per_id = sets.groupBy("name", "__id").agg(F.max("n").alias("n"), F.count(F.lit(1)).alias("rows"))
    reps = cut_lineage(per_id.groupBy("name").agg(F.min("__id").alias("rep"), F.max("n").alias("n"), F.sum("rows").alias("copies"), F.max("rows").alias("rows")))
    del per_id
    if passes is None:
        passes = max(1, min(PASSES, -(-(reps.agg(F.sum("n")).first()[0] or 0) // PASS_SHINGLES)))

    def live_members(mine: Column) -> DataFrame:
        sig = _one_each(keyed, reps, broadcast_rows, mine)
        # every set is there once, so a signature that occurs twice is live
        return _members(sig, sig.groupBy("key").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1"), broadcast_rows)

    members = _in_passes(live_members, F.col("key"), passes)
    del keyed, live_members
    release(d.sparkSession)

    band = F.col("key").bitwiseAND(F.lit(BAND_BITS))
    load = members.groupBy("key").count().groupBy(band.alias("band")).agg(F.sum(F.col("count") - 1).alias("rows"))
    load = {r["band"]: r["rows"] for r in load.collect()}  # one row per size band, at most some seventy
    if load:
        # the sets that index themselves in a band: its own, and those near the top of the one below
        spans = {b: (min(p.low[b], -(-p.num * p.low[b] // p.den)) if b else p.low[b], p.low[b + 1] - 1) for b in load}
        mass = reps.agg(*[F.sum(F.when(F.col("n").between(lo, hi), F.col("n"))).alias(f"b{b}") for b, (lo, hi) in spans.items()]).first()
        hot = frozenset(b for b in load if load[b] > merge_ratio * (mass[f"b{b}"] or 0))
        if hot:
            near = _signatures(d, shingle_words, p, hot, hot)
            # one of the sets must be there in full
            live = near.groupBy("key").agg(F.min("name").alias("lo"), F.max("name").alias("hi"), F.max("full").alias("any_full")).where("lo < hi and any_full")
            members = cut_lineage(members.where(~band.isin(sorted(hot))).unionByName(cut_lineage(_members(near, live, broadcast_rows).distinct())))
            del near, live
            release(d.sparkSession)

    names = cut_lineage(members.groupBy("name").agg(F.count(F.lit(1)).alias("live")).join(reps, "name"))
    ids, _ = broadcast_if_small(names.select(F.col("rep").alias("__id"), "name"), broadcast_rows)
    tokens = _token_sets(d.join(ids, "__id"), shingle_words)
    if names.where("rows > 1").limit(1).count():  # a kept id has equal texts in several rows
        tokens = tokens.dropDuplicates(["name"])
    tokens = cut_lineage(tokens)
    able = _able(names, tokens, p, passes)
    names = cut_lineage(join_bounded(names, able, ["name"], max_rows=broadcast_rows))
    tokens = cut_lineage(join_bounded(tokens, able, ["name"], max_rows=broadcast_rows))
    release(d.sparkSession)

    m = join_bounded(members, names.select("name", "n", "live"), ["name"], max_rows=broadcast_rows)
    hubs = m.groupBy("key").agg(F.max(F.struct("live", "name", "n")).alias("h")).select("key", F.col("h.name").alias("hub"), F.col("h.n").alias("hub_n"))
    m = cut_lineage(skew_join(m, hubs, ["key"]).where("name <> hub").select("key", "name", "n", "hub", "hub_n"))
    fits = F.least("n", "hub_n") * den >= F.greatest("n", "hub_n") * num
    links = cut_lineage(_verify(cut_lineage(m.where(fits).select(F.col("hub").alias("a"), F.col("name").alias("b")).distinct()), tokens, p, passes))
    release(d.sparkSession)
    label = components(links, TASK_EDGES)

    m = join_bounded(m, label.withColumnRenamed("node", "name"), ["name"], "left", broadcast_rows).withColumn("label", F.coalesce("label", "name"))
    mixed = m.groupBy("key").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo < hi").select("key")
    spokes = join_bounded(m, cut_lineage(mixed), ["key"], max_rows=broadcast_rows).select("hub", "name", "n", "label").distinct()
    spokes = _partnered(cut_lineage(spokes), tokens, p, passes)
    release(d.sparkSession)
    more = cut_lineage(_between_members(spokes, tokens, p, passes))
    del spokes, tokens, members, m
    release(d.sparkSession)
    label = components(links.unionByName(more), TASK_EDGES)

    comp = label.join(reps.select(F.col("name").alias("node"), "rep"), "node")
    comp = skew_join(comp, comp.groupBy("label").agg(F.min("rep").alias("component_id")), ["label"])
    named = reps.join(comp.select(F.col("node").alias("name"), "component_id"), "name", "left").select(
        "name", F.coalesce("component_id", "rep").alias("component_id"))
    return skew_join(sets, named, ["name"]).select(F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), "component_id")


def _token_sets(d: DataFrame, size: int) -> DataFrame:
    """(name, tokens, sketch) of the rows (__t, name) whose text has the set of that name."""
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = WordHash()
        for b in it:
            names, sets = [], []
            for t, name in zip(b.column("__t"), b.column("name").to_pylist()):
                s = shingles(t.as_py(), size, words)
                if len(s) and set_name(s) == name:
                    names.append(name)
                    sets.append(s)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), _listed(sets), _listed([sketch(s) for s in sets])], ["name", "tokens", "sketch"])
    return d.mapInArrow(run, "name long, tokens array<long>, sketch array<long>")


def keep_one(docs: DataFrame, id_col: str = "doc_id", **how) -> DataFrame:
    """Of each component the document with the smallest id; all columns kept.

    Rows that repeat the kept id stay together.  Rows with a null id stay.
    """
    comp = jaccard_components(docs, id_col=id_col, **how).where(F.col(id_col) != F.col("component_id")).select(F.col(id_col).alias("__gone")).distinct()
    kept = drop_clashing(docs, ["__gone"])
    gone, _ = broadcast_if_small(cut_lineage(comp), 1_000_000)
    return kept.join(gone, kept[id_col] == gone["__gone"], "left_anti")
