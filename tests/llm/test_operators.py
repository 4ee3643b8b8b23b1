"""Small-table tests of the training-data operators against plain models: nulls, empty texts, ties, repeated rows, clashing columns, empty tables."""

import hashlib
import random
import re

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from sentipanel.llm import chat, exact_dedup, html_extract, line_dedup, mixing, ngram_join, pii, quality, spm, warc

MODEL = public_tokenizers.path("piece_bpe_32k.model")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(7)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(60):
        lines = [" ".join(rng.choice(words) for _ in range(rng.randint(8, 16))) for _ in range(4)]
        rows.append((i, "\n".join(lines), "en", f"s{i % 3}", 1))
    rows += [(100 + i, rows[i][1], "en", "s0", 1) for i in range(10)]                       # exact copies
    rows += [(200 + i, rows[i][1].replace("a", "b", 1), "en", None, 1) for i in range(10)]  # near copies
    rows += [(300, None, None, None, None), (301, "", "en", "s1", 0), (302, " \n\t", "en", "s1", 3), (303, "one two", None, "s2", 7)]
    rows += [rows[5], rows[5], (400, "x" * 50_000, "en", "s2", 1), (401, "word " * 5000, "en", "s2", 1)]
    return spark.createDataFrame(rows, DOCS)


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def union_find(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_exact_dedup(docs):
    got = rows_of(exact_dedup.exact_dedup(docs.select("doc_id", "text", F.lit(1).alias("kept"))))
    by = {}
    for r in docs.collect():
        by.setdefault(r.text or "", []).append(r.doc_id)
    want = sorted(((i, max(ids), len(ids), i == max(ids)) for ids in by.values() for i in ids), key=str)
    assert got == want


def test_exact_dedup_without_levels_is_equal(docs):
    assert rows_of(exact_dedup.exact_dedup(docs, level_rows=0)) == rows_of(exact_dedup.exact_dedup(docs))


def base_spans(t):
    digits = lambda m: re.sub("[^0-9]", "", m)

    def luhn(d):
        return sum(int(c) if i % 2 == 0 else sum(divmod(int(c) * 2, 10)) for i, c in enumerate(reversed(d))) % 10 == 0
    found = [("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
             ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
             ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 13 <= len(digits(m)) <= 19 and luhn(digits(m))),
             ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(digits(m)) <= 15)]
    return [(k, m.start(), m.end()) for k, p, ok in found for m in re.finditer(p, t) if ok(m[0])]


def test_pii_base_spans(spark):
    rng = random.Random(3)
    alphabet = list("01239.@+-( )a%é😀") + ["4111 1111 1111 1111", "10.0.0.255", "a.b@c-d.org", "+1 (555) 123-4567", "\n"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40))) for _ in range(1500)]
    texts += [None, "", "a" * 100_000, "1" * 50_000, "a@b.c%d@e.f a.b.@c.d.e", "1.2.3.4.5.6.7.8", "1.2.3.256 0255.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in pii.sanitise(df).collect():
        assert [(s.kind, s.start, s.end) for s in r.base_spans] == base_spans(texts[r.doc_id] or ""), texts[r.doc_id]
    assert pii.sanitise(df.limit(0)).count() == 0


def test_pii_disclosing_terms(spark):
    rng = random.Random(5)
    fill = lambda: " ".join(rng.choice(["alpha", "beta", "gamma", "delta", "omega"]) for _ in range(30))
    rows = [(i, f"{fill()} ask Zanzibar at secret@corp.example today {fill()}") for i in range(8)] + [(i, fill()) for i in range(8, 60)]
    out = {r.doc_id: r for r in pii.sanitise(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert {s.value.lower() for i in range(8) for s in out[i].term_spans} >= {"zanzibar"}
    assert all(not out[i].term_spans for i in range(8, 60))
    assert "secret@" not in out[0].sanitised and "Zanzibar" not in out[0].sanitised and "[EMAIL]" in out[0].sanitised


def test_mixing(docs):
    plan = mixing.plan_mix(docs).collect()
    sizes, target, taken, most = {}, {}, {}, {}
    for r in plan:
        assert 0 <= r.copies <= 3
        sizes[r.source] = r.source_size
        target[r.source] = r.target
        taken[r.source] = taken.get(r.source, 0) + r.copies * r.size * r.n
        most[r.source] = max(most.get(r.source, 0), r.size * r.n)
    assert sum(taken.values()) <= sum(sizes.values()) and abs(sum(target.values()) - sum(sizes.values())) < 1e-6
    for s in sizes:
        assert target[s] <= 3 * sizes[s] + 1e-6 and abs(taken[s] - target[s]) <= most[s]
    assert sorted(map(str, plan)) == sorted(map(str, mixing.plan_mix(docs.repartition(7)).collect()))
    assert mixing.apply_mix(docs, mixing.plan_mix(docs)).count() == sum(r.copies * r.n for r in plan)
    assert mixing.plan_mix(docs.limit(0)).count() == 0


def test_html(spark):
    page = ('<html><head><title>t</title><script>var a="</p>";</script></head><body><header>Site</header><nav><a href=x>Menu</a></nav>'
            '<div class="cookie-notice">We use cookies</div><aside>side</aside><{0}><h1>Head &amp; line {1}</h1><p><b>First{1}.<br><p>Second &lt;{1}&gt;'
            '</p><form>Name <input></form></{0}><div id="comments"><p>Nice comment {1}</p></div><footer>&copy; Host</footer></body></html>')
    rows = [(i, "http://a.example/x", page.format("article" if i % 2 else 'div class="content"', i).replace('/div class="content"', "/div")) for i in range(12)]
    rows += [(50, None, None), (51, "http://b.example", ""), (52, "x", "plain <b>te</b>xt &am &amp"), (1, "http://a.example/x", rows[1][2])]
    out = {r.page_id: r for r in html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n_chars", F.lit(0))).collect()}
    for i in range(12):
        assert out[i].text == f"Head & line {i} First{i}. Second <{i}>"
    assert out[50].text == out[51].text == "" and out[52].text == "plain text &am &" and out[52].n_chars == 16


def test_warc_round_trip(spark, tmp_path):
    big = "<p>é" * 400
    rows = [(i, f"http://a/{i}", f"<html>{i}{'x' * 50 * i}</html>") for i in range(300)]
    rows += [(400, "u", big), (401, "u", big), (402, None, big), (402, None, big), (403, "u", None), (404, "u", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/warc"
    manifest = warc.write_archives(df, folder)
    got = sorted((r.page_id, r.record_type, r.payload_digest, r.payload_bytes, r.refers_to, r.payload if r.payload is None else bytes(r.payload)) for r in warc.read_archives(manifest, folder).collect())
    want = []
    for i, _, h in rows:
        p = (h or "").encode()
        revisit = i in (400, 401)
        want.append((i, "revisit" if revisit else "response", hashlib.sha1(p).hexdigest(), len(p), 402 if revisit else None, None if revisit else p))
    assert got == sorted(want)
    assert max(r.dictionary_bytes for r in manifest.collect()) > 0
    assert warc.read_archives(warc.write_archives(df.limit(0), folder), folder).count() == 0


def test_spm_equals_library(spark, docs):
    lib = spm.model(MODEL).lib
    rng = random.Random(1)
    texts = ["".join(rng.choice(" ab▁é\n\t☃x0.😀<s>") for _ in range(rng.randint(0, 80))) for _ in range(500)] + [None, "", "a" * 3000, "▁▁ ▁"]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(list(enumerate(texts, 1000)), "doc_id long, text string"))
    text = {r.doc_id: r.text or "" for r in df.collect()}
    out = spm.encode_decode(df, MODEL, check_texts=-1).collect()
    assert len(out) == df.count()
    for r in out:
        ids = lib.encode(text[r.doc_id])
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.decoded_sha256 == hashlib.sha256(lib.decode(ids).encode()).hexdigest()
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()


def shingle_set(text, k):
    w = text.encode().lower().split()
    return {tuple(w)} if w and len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


@pytest.mark.parametrize("k,num,den,ratio", [(3, 90, 100, 4.0), (5, 80, 100, 4.0), (1, 60, 100, 0.0)])
def test_jaccard_components(spark, docs, k, num, den, ratio):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(120)]
    rows = [(1000 + i, " ".join(rng.choice(base) + "z" if rng.random() < p else w for w in base)) for i, p in enumerate([0.01, 0.02, 0.03, 0.05] * 30)]
    df = docs.select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    sets = {r.doc_id: shingle_set(r.text or "", k) for r in df.collect()}
    ids = sorted(sets)
    links = [(a, b) for i, a in enumerate(ids) for b in ids[:i] if sets[a] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])]
    label = union_find(links, ids)
    got = ngram_join.jaccard_components(df, shingle_words=k, num=num, den=den, merge_ratio=ratio).collect()
    assert len(got) == df.count()
    for r in got:
        assert (r.n_shingles, r.component_id) == (len(sets[r.doc_id]), label[r.doc_id])


def levenshtein(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_line_dedup(spark, docs):
    rng = random.Random(2)
    seed = "the quick brown fox jumps over the lazy dog and runs away"
    rows = []
    for i in range(60):
        s = list(seed if i % 2 else seed[::-1])
        for _ in range(rng.randint(0, 4)):
            s[rng.randrange(len(s))] = rng.choice("xyzé")
        rows.append((1000 + i, "".join(s) + f"\nshort\n{'unique' * 5} {i * 7919}"))
    df = docs.where("doc_id <> 400").select("doc_id", "text").union(spark.createDataFrame(rows, "doc_id long, text string"))
    data = sorted({(r.doc_id, r.text or "") for r in df.collect()})
    at = {}
    for i, t in data:
        for p, x in enumerate(t.split("\n")):
            if len(x) >= 20 and x.strip(" \t\v\f\r"):
                at.setdefault(x, []).append((i, p))
    long = sorted(x for x in at if 40 <= len(x) < 300)
    links = [(a, b) for n, a in enumerate(long) for b in long[:n] if abs(len(a) - len(b)) <= 2 and levenshtein(a, b) <= 2]
    label = union_find(links, at)
    groups = {}
    for x, places in at.items():
        groups.setdefault(label[x], []).extend(places)
    gone = {}
    for places in groups.values():
        first = min(places)
        for i, p in places:
            if (i, p) != first:
                gone.setdefault(i, []).append((p, first[0]))
    out = line_dedup.line_dedup(df.withColumn("removed", F.lit("clash"))).collect()
    assert len(out) == df.count()
    texts = dict(data)
    for r in out:
        assert [tuple(x) for x in r.removed] == sorted(gone.get(r.doc_id, []))
        stay = [x for p, x in enumerate(texts[r.doc_id].split("\n")) if p not in {q for q, _ in gone.get(r.doc_id, [])}]
        assert (r.text or "") == "\n".join(stay)


def test_quality(spark, docs):
    out = {r.doc_id: r for r in quality.quality_rules(docs).collect()}
    for r in docs.collect():
        t = r.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        many = {g for g in grams if grams.count(g) > 1} if len(grams) < 1000 else set(grams)
        cover = {i + j for i, g in enumerate(grams) if g in many for j in range(5)}
        lines = [x for x in t.split("\n") if x.strip(" \t\v\f\r")]
        q = out[r.doc_id]
        assert (q.n_words, q.word_chars, q.n_dup_lines, q.n_repeat_words) == (len(w), sum(map(len, w)), len(lines) - len(set(lines)), len(cover))
        assert q.base_failed == (len(w) < 10 or 100 * len(cover) > 20 * len(w)) and not (q.kept and q.base_failed)
    assert out[0].kept and not out[300].kept
    assert quality.quality_rules(docs.limit(0)).count() == 0


def test_chat_links(spark):
    call = lambda *c: '{"content":null,"tool_calls":[' + ",".join(f'{{"id":"{i}","name":"{n}","arguments":{a}}}' for i, n, a in c) + "]}"
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", call(("b", "f", '{"x":{"$result":"a"}}'), ("a", "f", '{"x":2.0,"a":1}'))),
            (1, 2, "tool", '{"tool_call_id":"a","content":"ok"}'), (1, 3, "tool", '{"tool_call_id":"q","content":1}'),
            (1, 4, "assistant", call(("a", "f", '{"x":1}'), ("c", "f", '{"x":{"$result":"d"}}'), ("d", "f", '{"x":{"$result":"c"}}'), ("e", "g", "{}"), ("h", "f", '{"x":"s"}'))),
            (2, 0, None, None), (None, 0, "user", "x")]
    out = {(r.conv_id, r.turn, r.part): r for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"),
                                                                     {"f": {"type": "object", "required": ["x"], "properties": {"x": {"type": "integer"}}}}).collect()}
    assert (out[1, 1, 1].level, out[1, 1, 2].level) == (1, 0)
    assert (out[1, 1, 2].status, out[1, 1, 2].linked_turn, out[1, 1, 2].json) == ("ok", 2, '{"arguments":{"a":1,"x":2},"id":"a","name":"f"}')
    assert out[1, 1, 1].status == "no result" and out[1, 3, 0].status == "orphan result" and out[1, 4, 1].status == "duplicate id"
    assert out[1, 4, 2].status == out[1, 4, 3].status == "cycle" and out[1, 4, 4].status == "unknown tool" and out[1, 4, 5].status == "$.x: not integer"
    assert out[2, 0, 0].json == '{"content":"","role":""}' and len(out) == 14


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert exact_dedup.exact_dedup(none).count() == ngram_join.jaccard_components(none).count() == line_dedup.line_dedup(none).count() == 0
    assert spm.encode_decode(none, MODEL).count() == 0
    assert html_extract.extract(none.selectExpr("doc_id page_id", "text url", "text html")).count() == 0
    assert chat.format_chats(none.selectExpr("doc_id conv_id", "doc_id turn", "lang role", "text")).count() == 0


def test_pipeline(spark, docs, tmp_path):
    import corpus_pipeline
    docs.write.parquet(f"file://{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, f"file://{tmp_path}")
    kept = {r.doc_id for r in out.select("doc_id").collect()}
    assert kept <= set(range(60)) | set(range(200, 210)) | {400, 401} and len(kept) >= 40
    text = {r.doc_id: r.text for r in docs.collect()}
    assert not kept & {300, 301, 302, 303, 401} and all(text[i] for i in kept)
