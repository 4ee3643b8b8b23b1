"""SimHash fingerprints and components against a plain model."""

import random

import pytest
import xxhash
from pyspark.sql import functions as F

from sentipanel.llm import registry, simhash

from test_operators import union_find

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def plain(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    s = [" ".join(w[i:i + 3]) for i in range(max(1, len(w) - 2))]
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps, max_bits):
    fps = sorted(set(fps))
    return [(a, b) for i, a in enumerate(fps) for b in fps[:i] if bin(a ^ b).count("1") <= max_bits]


def model(rows, max_bits=3):
    fp = [(i, plain(t)) for i, t, *_ in rows]
    label = union_find(linked([f for _, f in fp], max_bits), sorted({f for _, f in fp}))
    least = {}
    for i, f in fp:
        if i is not None:
            least[label[f]] = min(i, least.get(label[f], i))
    return sorted(((i, f"{f:016x}", least.get(label[f])) for i, f in fp), key=str)


def got(df):
    return sorted((tuple(r) for r in df.select("doc_id", "fingerprint", "component_id").collect()), key=str)


def texts(rng, n):
    words = ["alpha", "Beta", "γάμμα", "delta,", "É", "x" * 300, "zz", "7", "😀", "mu"] + [f"w{k}" for k in range(200)]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 4, 40, 400]))] for _ in range(12)]

    def one():
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 2)):
            w[rng.randrange(len(w))] = rng.choice(words)
        return rng.choice([" ", "\n", "\t ", "\v"]).join(w)
    return [one() for _ in range(n)] + ["", None, " \n", "a", "A", "a b", "é é é é", "b\xa0c d e"]


def test_components(spark):
    rng = random.Random(11)
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(texts(rng, 150))]
    rows += [rows[0], rows[3], (None, rows[5][1], "en", "s", 1), (None, "nobody else says this", None, None, None)]
    assert got(simhash.simhash_components(spark.createDataFrame(rows, DOCS))) == model(rows)


def test_long_text_is_counted_whole():
    rng = random.Random(2)
    text = " ".join(f"v{rng.randrange(5000)}" for _ in range(150_000))
    assert simhash.fingerprint(text.encode()) == plain(text)


@pytest.mark.parametrize("max_bits", [2, 3])
def test_links_in_dense_clouds(spark, max_bits):
    """Fingerprints that all lie within a few bits of each other: the variants are cut again, no link between components is lost."""
    rng = random.Random(max_bits)
    fps = {0, (1 << 64) - 1, 1 << 63}
    for low, bits in ((0, 64), (0, 12), (40, 24), (20, 30)):
        centre = rng.getrandbits(64)
        fps |= {centre ^ sum({1 << rng.randrange(low, low + bits) for _ in range(rng.randint(0, 7))}) for _ in range(150)}
    nodes = spark.createDataFrame([(simhash._signed(f),) for f in fps], "fp long").checkpoint()
    label = {r["fp"]: r["label"] for r in simhash.classes(nodes, max_bits, small=4).collect()}
    together = lambda of: {frozenset(f for f in fps if of(f) == x) for x in {of(f) for f in fps}}
    want = union_find(linked(fps, max_bits), sorted(fps))
    assert together(lambda f: label[simhash._signed(f)]) == together(lambda f: want[f])


def test_empty_table_and_clashing_columns(spark):
    assert simhash.simhash_components(spark.createDataFrame([], DOCS)).count() == 0
    rows = [(k, t, "en", "s", 1) for k, t in enumerate(["a b c d", "a b c d", None, "q"])]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("fp", "g", "__id", "__t", "fingerprint", "component_id", "label")})
    assert got(simhash.simhash_components(df)) == model(rows)


def test_query_on_a_whole_table(spark, tmp_path):
    rng = random.Random(12)
    rows = [(k * 3, t, "en", "s", 1) for k, t in enumerate(texts(rng, 400))]
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    assert got(registry.queries()["op12_simhash"](spark, f"file://{tmp_path}")) == model(rows)
