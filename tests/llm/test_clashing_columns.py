"""Input columns named like internal ones, and hosts beyond the broadcast bound."""

from pyspark.sql import functions as F

from sentipanel.llm import html_extract, line_dedup

PAGE = "<html><head><title>t</title></head><body><nav>Home News</nav><article><h1>Title {k}</h1><p>Body {k} of the article, some words.</p></article><footer>About us</footer></body></html>"
EXTRA = ("host", "page", "template", "token", "class", "__x", "doc", "line", "name", "pos", "lines", "n")


def pages(spark):
    rows = [(k, f"https://h{k % 3}.example/{k}", PAGE.format(k=k)) for k in range(18)] + [(99, None, None)]
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_html_extract(spark):
    want = sorted(map(tuple, html_extract.extract(pages(spark)).collect()))
    more = pages(spark).withColumns({c: F.lit("mine") for c in EXTRA})
    got = html_extract.extract(more)
    assert {r["host"] for r in got.collect()} == {r["page"] for r in got.collect()} == {"mine"}
    assert sorted(map(tuple, got.select("page_id", "url", "text", "n_chars").collect())) == want
    assert sorted(map(tuple, html_extract.extract(pages(spark), broadcast_hosts=0).collect())) == want


def test_line_dedup(spark):
    docs = spark.createDataFrame([(1, "one line\nother line"), (2, "one line\nthird"), (3, None)], "doc_id long, text string")
    plain = line_dedup.line_dedup(docs, min_chars=1, near_chars=1)
    got = line_dedup.line_dedup(docs.withColumns({c: F.lit("mine") for c in EXTRA}), min_chars=1, near_chars=1)
    assert {r["doc"] for r in got.collect()} == {"mine"}
    assert sorted(map(str, got.select(*plain.columns).collect())) == sorted(map(str, plain.collect()))
