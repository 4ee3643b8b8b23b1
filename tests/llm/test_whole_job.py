"""Tests that the registered queries and the pipeline do the whole job: no line, word or document is left out by a bound."""

import math
import random
import re
import unicodedata
from collections import Counter

import pytest

import corpus_pipeline
from sentipanel.llm import quality, registry

from test_operators import levenshtein, union_find

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def write(spark, tmp_path, rows, table="documents", schema=DOCS):
    spark.createDataFrame(rows, schema).write.parquet(f"file://{tmp_path}/{table}.parquet")
    return f"file://{tmp_path}"


@pytest.fixture(scope="module")
def short_docs():
    rng = random.Random(17)
    line = lambda: "".join(rng.choice("abcdefghéß😀") for _ in range(rng.choice([1, 1, 2, 3, 4, 5, 6, 7, 9, 12, 19, 20, 25, 39, 40, 60])))
    seen = [line() for _ in range(150)]

    def varied():
        s = list(rng.choice(seen))
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(s) + 1)
            s[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "k"])
        return "".join(s)
    return [(i, "\n".join(rng.choice([line, varied])() for _ in range(rng.randint(1, 6))), "en", "s", 1) for i in range(80)] + [(90, " \n\t\n", "en", "s", 4), (91, None, "en", "s", 0)]


def lines_gone(rows):
    """doc: [(pos, keep_doc)] by a plain model over every line that holds a word."""
    at = {}
    for i, t in sorted((r[0], r[1] or "") for r in rows):
        for p, x in enumerate(t.split("\n")):
            if x.strip(" \t\v\f\r"):
                at.setdefault(x, []).append((i, p))
    names = sorted(at)
    label = union_find([(a, b) for n, a in enumerate(names) for b in names[:n] if abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= 2], names)
    groups, gone = {}, {}
    for x, places in at.items():
        groups.setdefault(label[x], []).extend(places)
    for places in groups.values():
        first = min(places)
        for i, p in places:
            if (i, p) != first:
                gone.setdefault(i, []).append((p, first[0]))
    return {i: sorted(x) for i, x in gone.items()}


def test_line_dedup_query_compares_every_line(spark, tmp_path, short_docs):
    gone = lines_gone(short_docs)
    out = {r.doc_id: r for r in registry.queries()["op7_line_dedup"](spark, write(spark, tmp_path, short_docs)).collect()}
    assert len(out) == len(short_docs)
    for i, r in out.items():
        assert r.removed == ",".join(f"{p}:{k}" for p, k in gone.get(i, [])) and r.n_removed == len(gone.get(i, []))


def test_line_dedup_stage_compares_every_line(spark, tmp_path, short_docs):
    gone = lines_gone(short_docs)
    docs = spark.createDataFrame(short_docs, DOCS)
    for r in corpus_pipeline.line_dedup_stage(spark, docs, "").collect():
        text = dict((x[0], x[1]) for x in short_docs)[r.doc_id]
        left = {p for p, _ in gone.get(r.doc_id, [])}
        assert r.text == (text if not left else "\n".join(x for p, x in enumerate(text.split("\n")) if p not in left))


def test_line_dedup_stage_keeps_documents_of_short_lines(spark):
    shared = "this passage is shared by all the documents of the table"
    rows = [(1, shared, "en", "s", len(shared)), (2, f"{shared}\nbread knife\nold piano\ntwelve swans", "en", "s", 90), (3, f"{shared}\n \n", "en", "s", 60),
            (4, f"{shared}\nold piano", "en", "s", 70), (5, " \n", "en", "s", 2)]
    out = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.line_dedup_stage(spark, spark.createDataFrame(rows, DOCS), "").collect()}
    left = "bread knife\nold piano\ntwelve swans"
    assert out == {1: (shared, len(shared)), 2: (left, len(left)), 5: (" \n", 2)}


def js(p, q):
    p, q = [x / sum(p) for x in p], [x / sum(q) for x in q]
    half = lambda a: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(a, p if a is q else q) if x)
    return max(0.0, (half(p) + half(q)) / 2) ** 0.5


@pytest.mark.parametrize("flush", [None, 64])
def test_quality_query_distances(spark, tmp_path, monkeypatch, flush):
    """Distances and verdict of every row, with frequent words of many scripts and lengths."""
    if flush:
        monkeypatch.setattr(quality, "BROADCAST_BYTES", flush)  # the shuffled join of wide references
    rng = random.Random(23)
    common = {"en": ["the", "of", "internationalisation", "and"], "es": ["ciónción", "cióngañ", "de", "información"],
              "ru": ["который", "человек", "и", "государственный"], "zh": ["机器学习", "我们的", "是", "中华人民共和国"], "few": ["a", "b"]}
    rows = []
    for lang, top in common.items():
        rare = ["".join(rng.choice(top) for _ in range(2)) + str(k) for k in range(200)] + [w.upper() for w in top] + ["x" * 3000]
        for k in range(5 if lang == "few" else 25):
            size = rng.choice([5, 40, 60, 200])
            rows.append((len(rows), " ".join(rng.choice(top if rng.random() < (0.1 if k % 6 == 0 else 0.6) else rare) for _ in range(size)), lang, "s", 1))
    rows += [(1000, None, "en", "s", 0), (1001, "", None, "s", 0), (1002, "der " * 60, "ru", "s", 1)]

    def cls(ch):
        cat = unicodedata.category(ch)
        return (4 if ch in " \t\n\v\f\r" else 6 if ch in "#*$%&|<>" else 7 if ord(ch) > 65535 else
                {"Ll": 0, "Lu": 1, "Nd": 3}.get(cat, 2 if cat[0] in "LM" else 5 if cat[0] == "P" else 7))
    classes = lambda t: [sum(cls(ch) == k for ch in t) for k in range(8)]
    lower = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t.lower())
    refs = {}
    for _, t, lang, *_ in rows:
        if t:
            n, c, w = refs.setdefault(lang or "", ([0], Counter(), Counter()))
            n[0] += 1
            c.update({k: v * 10**6 // len(t) for k, v in enumerate(classes(t))})
            w.update({x: v * 10**6 // len(lower(t)) for x, v in Counter(lower(t)).items()})
    out = {r.doc_id: r for r in registry.queries()["op10_quality_rules"](spark, write(spark, tmp_path, rows)).collect()}
    assert len(out) == len(rows) and any(r.kept for r in out.values())
    for i, t, lang, *_ in rows:
        t, r = t or "", out[i]
        n, c, w = refs.get(lang or "", ([0], {}, Counter()))
        by_class = js(classes(t), [c[k] for k in range(8)]) if n[0] >= 20 and len(t) >= 200 else None
        by_word = None
        if n[0] >= 20 and len(t.split()) >= 50:
            top = sorted(w.items(), key=lambda x: (-x[1], x[0]))[:64]
            found = Counter(lower(t))
            own = [found[x] for x, _ in top]
            by_word = js([*own, sum(found.values()) - sum(own)], [*(v for _, v in top), max(0, n[0] * 10**6 - sum(v for _, v in top))])
        assert (r.class_distance, r.word_distance) == (pytest.approx(by_class, abs=1e-9) if by_class is not None else None, pytest.approx(by_word, abs=1e-9) if by_word is not None else None), (i, lang)
        assert r.kept == (not r.base_failed and not (by_class or 0) > 0.25 and not (by_word or 0) > 0.5)


def test_html_query_takes_text_from_slots(spark, tmp_path):
    """Unmarked template text in an article goes on hosts of every size; the text of copied pages stays."""
    page = "<html><body><nav>Menu</nav><article><h1>Head {0}</h1><p>Own text {0}.</p>{1}</article></body></html>"
    block = "<p>Read our other stories.</p><p>All rights reserved.</p>"
    rows, want = [], {}
    for host, n, share in (("small", 4, 1.0), ("mid", 12, 0.6), ("large", 30, 0.6), ("rare", 12, 0.4)):
        for k in range(n):
            has = k < share * n
            rows.append((len(rows), f"http://{host}.example/{k}", page.format(f"{host}{k}", block if has else "")))
            want[rows[-1][0]] = f"Head {host}{k} Own text {host}{k}." + (" Read our other stories. All rights reserved." if has and share < 0.5 else "")
    for k in range(5):
        rows.append((1000 + k, f"http://copies.example/{k}", page.format("copy", block)))
        want[1000 + k] = "Head copy Own text copy. Read our other stories. All rights reserved."
    folder = write(spark, tmp_path, rows, "pages", "page_id long, url string, html string")
    out = registry.queries()["op3_html_extract"](spark, folder).collect()
    assert {r.page_id: r.text for r in out} == want and len(out) == len(rows)
