import random

from pyspark.sql import functions as F

from sentipanel.operators import tagging as T
from tests.model_tagging import tag_text

TERMS = {"AOS": "AOS", "A. O. Smith": "AOS", "MMM": "MMM", "3M": "MMM", "of": "X1", "of the": "Y2", "the": "Z3",
         "Estée Lauder": "EL", "la": "L1", "de la": "D2"}
WORDS = ["AOS", "A. O. Smith", "MMM", "3M", "of", "the", "of the", "Estée", "Lauder", "Estée Lauder", "la", "de",
         "(", ")", "\"", ",", ".", ":", "?", "!", "\n", "\t", " ", "  ", "x", "theory", "AOSs", "'s", ";", "-", "é"]


def _texts(seed=1, n=300):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        k = rnd.randint(0, 25)
        out.append("".join(rnd.choice(WORDS) + (" " if rnd.random() < 0.5 else "") for _ in range(k)))
    out[0] = ""
    out[1] = "A. O. Smith (NYSE:AOS) and 3M (MMM), AOS: MMM!"
    return out


def _run(spark, texts, starts):
    docs = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(zip(texts, starts))], "doc_id long, text string, start string")
    terms = spark.createDataFrame(list(TERMS.items()), "term string, ticker string")
    seg = T.tag_segments(docs, terms, "doc_id", "text", start="start").collect()
    got = {}
    for r in seg:
        got.setdefault(r["doc_id"], []).append((r["seg"], r["ticker"], r["text"]))
    return {k: [(t, x) for _, t, x in sorted(v)] for k, v in got.items()}


def test_tag_segments_matches_literal_model(spark):
    texts = _texts()
    rnd = random.Random(7)
    starts = [rnd.choice(["", "", "AOS", "MMM", "ZZ"]) for _ in texts]
    got = _run(spark, texts, starts)
    for i, (t, s) in enumerate(zip(texts, starts)):
        exp = tag_text(t, s, TERMS)
        assert got.get(i, []) == exp, (i, t, s)
        # segments concatenate back to the text
        assert "".join(x for _, x in got.get(i, [])) == t


def test_reference_example_text(spark):
    text = ("A. O. Smith Corporation (NYSE:AOS) makes water heaters.\n"
            "3M (MMM) reported results. MMM, AOS and 3M.")
    got = _run(spark, [text], [""])[0]
    assert got == tag_text(text, "", TERMS)
    assert [t for t, _ in got] == ["AOS", "MMM", "AOS", "MMM"]


def test_dominant_ticker_bytes_and_ties(spark):
    seg = spark.createDataFrame([(1, 0, "A", "ab"), (1, 1, "B", "éé"), (2, 0, "B", "xx"), (2, 1, "A", "yy"), (3, 0, "", "zzz"),
                                 (4, 0, "C", "")], "doc_id long, seg long, ticker string, text string")
    d = {r["doc_id"]: r["dominant"] for r in T.dominant_ticker(seg, "doc_id").collect()}
    assert d == {1: "B", 2: "A", 3: "", 4: ""}


def test_term_table_later_row_wins(spark):
    d = spark.createDataFrame([(1, "GOOGL", "Alphabet|Google"), (2, "GOOG", "Alphabet|Google|"), (3, "X", "x")],
                              "row_no long, symbol string, search_terms string")
    t = {r["term"]: r["ticker"] for r in T.term_table(d).collect()}
    assert t == {"Alphabet": "GOOG", "Google": "GOOG", "x": "X"}


def test_expand_search_terms(spark):
    d = spark.createDataFrame([("A", "Agilent", "Agilent Technologies/ /Keysight"), ("ZZ", "Glass", None)],
                              "symbol string, security string, search_terms string")
    got = {}
    for r in T.expand_search_terms(d).collect():
        got.setdefault(r["symbol"], set()).add(r["term"])
    assert got["A"] >= {"$A", "$As", "Agilent", "agilent", "AGILENT", "Agilents", "agilents", "AGILENTS", "Keysight"}
    assert "A" not in got["A"] and "As" not in got["A"]
    assert got["ZZ"] == {"ZZ", "ZZs", "$ZZ", "$ZZs", "Glass", "glass", "GLASS"}


def test_repeated_and_empty_urls_stay_apart(spark):
    rows = [("u1", "Acme", "one two", 1), ("u1", "BBB", "three four", 2), ("", "AAA", "x", 3), ("", "BBB", "y", 4),
            ("", "BBB", "y", 4), (None, "AAA", None, 5)]
    news = spark.createDataFrame(rows, "url string, title string, body string, dt int")
    terms = spark.createDataFrame(list(TERMS.items()), "term string, ticker string")
    got = sorted(((r["url"] or "-", r["symbol"], r["text"], r["dt"]) for r in T.tag_news(news, terms, keep=("dt",)).collect()))
    exp = sorted((u or "-", t, x, d) for u, title, body, d in rows for t, x in tag_text(f"{title}\n{body or ''}", "", TERMS) if t)
    assert got == exp


def test_a_term_table_beyond_the_bound_is_joined(spark):
    texts = _texts(5, 120)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    terms = spark.createDataFrame(list(TERMS.items()), "term string, ticker string")
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(T.tag_segments(docs, terms)) == rows(T.tag_segments(docs, terms, max_rows=0))
    assert rows(T.find_mentions(docs, terms)) == rows(T.find_mentions(docs, terms, max_rows=0))


def test_no_text_is_exchanged(spark):
    docs = spark.createDataFrame(list(enumerate(_texts(6, 20))), "doc_id long, text string")
    terms = spark.createDataFrame(list(TERMS.items()), "term string, ticker string")
    for df in (T.tag_segments(docs, terms), T.find_mentions(docs, terms)):
        assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()


def test_null_texts_and_empty_tables(spark):
    terms = spark.createDataFrame(list(TERMS.items()), "term string, ticker string")
    docs = spark.createDataFrame([(1, None), (2, "AOS"), (2, "MMM")], "doc_id long, text string")
    assert sorted(map(tuple, T.tag_segments(docs, terms).collect())) == [(2, 0, "AOS", "AOS"), (2, 0, "MMM", "MMM")]
    assert T.tag_segments(docs.limit(0), terms).count() == 0
    assert [r["ticker"] for r in T.tag_segments(docs, terms.limit(0)).collect()] == ["", ""]
