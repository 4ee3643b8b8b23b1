"""The Merkle manifest against a plain model of the trees."""

import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sentipanel.llm import merkle, registry

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(i, source, lang, n, text):
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return sha(*[enc(v) for v in (i, source, lang, n, text)])


def tree(digests):
    """(root, siblings of every leaf level by level)."""
    rows = [digests]
    while len(rows[-1]) > 1:
        rows.append([sha(*rows[-1][i:i + 3]) for i in range(0, len(rows[-1]), 3)])
    ways = []
    for i in range(len(digests)):
        way = []
        for row in rows[:-1]:
            first = i - i % 3
            way.append((row[first:i], row[i + 1:first + 3]))
            i //= 3
        ways.append(way)
    return rows[-1][0], ways


def model(rows):
    by = defaultdict(list)
    for i, text, lang, source, n in rows:
        own = leaf(i, source, lang, n, text)
        hit = i is not None and text is not None and zlib.crc32(str(i).encode()) % 2 == 0
        by[source].append((i is not None, i or 0, own, leaf(i, source, lang, n, text.replace("\n", "")) if hit else own, i))
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([x[2] for x in sorted(by[s])]) for s in order}
    root, over = tree([trees[s][0] for s in order]) if order else (None, [])
    out = []
    for k, s in enumerate(order):
        for (_, _, own, other, i), way in zip(sorted(by[s]), trees[s][1]):
            way = way + over[k]
            d = other
            for left, right in way:
                d = sha(*left, d, *right)
            out.append((i, own, trees[s][0], root, sha(*[x for left, right in way for x in left + right]), d, d == root))
    return out


COLS = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def same(df, rows):
    key = lambda r: tuple((x is not None, x if x is not None else 0) for x in r)
    got = sorted((tuple(r) for r in df.select(*COLS).collect()), key=key)
    assert got == sorted(model(rows), key=key)


def rows_of(rng, n, sources):
    texts = ["a\nb", "", None, "plain", "é😀\n", "\n", "x" * 5000 + "\n"]
    return [(k * 7 % 1009 if rng.random() < 0.97 else None, rng.choice(texts), rng.choice(["en", None]), rng.choice(sources), rng.choice([None, 3])) for k in range(n)]


@pytest.mark.parametrize("tier_levels", [1, 2, 6])
def test_trees_of_every_height(spark, tier_levels):
    rng = random.Random(3)
    rows = rows_of(rng, 300, [None, "", "b", "é", "Z"]) + [(5, "one\n", "en", f"only{k}", 1) for k in range(11)]
    rows += [rows[0], rows[0], rows[1]]  # repeated rows are leaves each
    same(merkle.manifest(spark.createDataFrame(rows, DOCS), merkle.without_newlines(), tier_levels=tier_levels), rows)


def test_lone_leaf_and_empty_table(spark):
    rows = [(4, "x\ny", None, None, None)]
    got = merkle.manifest(spark.createDataFrame(rows, DOCS), merkle.without_newlines())
    same(got, rows)
    r = got.first()
    assert r["leaf"] == r["subroot"] == r["root"] and r["proof_sha256"] == sha()
    assert merkle.manifest(spark.createDataFrame([], DOCS), merkle.without_newlines()).count() == 0


def test_clashing_columns(spark):
    rng = random.Random(4)
    rows = rows_of(rng, 40, ["a", "b"])
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("leaf", "tree", "pos", "id", "n", "other", "chunk", "__pos", "root", "way", "name")})
    same(merkle.manifest(df, merkle.without_newlines()), rows)


def test_query_on_a_whole_table(spark, tmp_path):
    rows = rows_of(random.Random(5), 2000, ["hot"] * 9 + ["cold"])
    spark.createDataFrame(rows, DOCS).write.parquet(f"file://{tmp_path}/documents.parquet")
    same(registry.queries()["op13_merkle"](spark, f"file://{tmp_path}"), rows)
