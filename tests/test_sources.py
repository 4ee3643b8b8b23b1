import json
import os

import pytest
from pyspark.sql import functions as F

from sentipanel.sources import ingest as I


def _lines(spark, rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_news_skips_bad_json_and_rejects_bad_dates(spark):
    good = json.dumps({"title": "t", "description": "d", "content": "c", "url": "u1",
                       "publishedAt": "2020-01-01T00:00:00Z", "source": {"name": "Reuters"}})
    bad_date = json.dumps({"title": "t", "url": "u2", "publishedAt": "yesterday"})
    news, rej = I.ingest_news(_lines(spark, [good, "{not json", bad_date, good]))
    rows = news.collect()
    assert len(rows) == 2 and rows[0]["dt"] == 1577836800000 and rows[0]["domain"] == "Reuters"
    assert [r["url"] for r in rej.collect()] == ["u2"]


def test_submissions_fail_on_bad_json(spark):
    ok = json.dumps({"title": "x", "created_utc": 1577836800, "score": 12, "id": "a"})
    subs, _ = I.ingest_submissions(_lines(spark, [ok, "{broken"]))
    with pytest.raises(Exception):
        subs.collect()


def test_submission_fields_and_threshold(spark):
    rows = ['{"title": "a", "created_utc": "1577836800.0", "score": 10, "id": "p1"}',
            '{"title": "b", "created_utc": 1577836801, "score": 9, "id": "p2"}',
            '{"title": "c", "created_utc": 1577836802.9, "id": "p3"}']
    subs, _ = I.ingest_submissions(_lines(spark, rows))
    got = [(r["id"], r["dt"], r["score"]) for r in subs.collect()]
    assert got == [("p1", 1577836800000, 10)]


def test_comment_ids(spark):
    rows = ['{"body": "x", "created_utc": 1, "score": 11, "id": "c1", "link_id": "t3_abc", "parent_id": "t1_def"}',
            '{"body": "y", "created_utc": 2, "score": 11, "id": "c2", "link_id": "t3_abc", "parent_id": 12345}',
            '{"body": "z", "created_utc": 3, "score": 11, "id": "c3", "link_id": "xt3_q", "parent_id": "nounderscore"}']
    c, _ = I.ingest_comments(_lines(spark, rows))
    got = {r["id"]: (r["post_id"], r["parent_id"]) for r in c.collect()}
    assert got == {"c1": ("abc", "def"), "c2": ("abc", ""), "c3": ("xq", "")}


def test_dedup_raw_lines(spark):
    assert I.dedup_raw_lines(_lines(spark, ["a", "b", "a"])).count() == 2


def test_prices_and_index(spark):
    raw = spark.createDataFrame([("01/31/2020", "$1,234.50", "$1", "$1", "N/A", "1,000", "X")],
                                "date string, open string, high string, low string, close string, volume string, symbol string")
    r = I.ingest_prices(raw).collect()[0]
    assert str(r["date"]) == "2020-01-31" and r["open"] == 1234.5 and r["close"] is None and r["volume"] == 1000.0
    idx = spark.createDataFrame([("31/01/2020", "3,000.5", "3,010.25")], "Date string, Open string, Price string")
    r = I.ingest_index_prices(idx).collect()[0]
    assert str(r["dt"]) == "2020-01-31" and r["sp500_close"] == 3010.25


def test_writers_and_readers(spark, tmpdir_path):
    df = spark.createDataFrame([("A", 1), ("B", 2), ("A", 3)], "symbol string, v long")
    p = os.path.join(tmpdir_path, "by_symbol")
    I.write_by_symbol(df, p)
    back = I.read_by_symbol(spark, p)
    assert sorted((r["symbol"], r["v"]) for r in back.collect()) == [("A", 1), ("A", 3), ("B", 2)]
    more = spark.createDataFrame([("A", 9), ("C", 4)], "symbol string, v long")
    written = I.write_incremental(more, p)
    assert [r["symbol"] for r in written.collect()] == ["C"]
    assert I.read_by_symbol(spark, p).count() == 4
    csvp = os.path.join(tmpdir_path, "csv")
    I.write_csv_export(df, csvp)
    assert spark.read.option("header", True).csv(csvp).columns == ["symbol", "v"]
    stem = os.path.join(tmpdir_path, "stem")
    os.makedirs(stem)
    df.filter("symbol = 'A'").toPandas().to_parquet(os.path.join(stem, "AAPL.parquet"))
    assert {r["symbol"] for r in I.read_by_symbol(spark, stem, layout="stem").collect()} == {"AAPL"}


def test_macro_ratings_sample_news(spark, tmpdir_path):
    m = os.path.join(tmpdir_path, "macro.csv")
    with open(m, "w") as f:
        f.write("Date,Interest Rates (Fed Funds Rate),Inflation (CPI),GDP Growth Rate,M2 Money Supply,Federal Expenditures,Unemployment Rate\n")
        f.write("2005-06-01,3.0,194.5,1.2,6000,2500,5.0\n")
    r = I.ingest_macro(spark, m).collect()[0]
    assert str(r["Date"]) == "2005-06-01" and r["Unemployment Rate"] == 5.0
    rp = os.path.join(tmpdir_path, "ratings.csv")
    with open(rp, "w") as f:
        f.write("Content,a,b,c,d,rating\nx,0.1,0.2,0.3,0.4,3\ny,,0.2,0.3,0.4,4\n")
    rows = I.read_ratings(spark, rp).collect()
    assert len(rows) == 1 and rows[0]["rating"] == 3.0
    d = os.path.join(tmpdir_path, "news")
    os.makedirs(d)
    with open(os.path.join(d, "sample_reuters_2020.csv"), "w") as f:
        f.write("Title,Content\nt,c\n")
    assert I.read_sample_news(spark, d).collect()[0]["source"] == "reuters"


def test_stream_ingest(spark, tmpdir_path):
    from sentipanel.streaming.ingest_stream import stream_ingest
    raw = os.path.join(tmpdir_path, "raw")
    os.makedirs(raw)
    with open(os.path.join(raw, "part1.jsonl"), "w") as f:
        f.write(json.dumps({"title": "t", "publishedAt": "2020-01-01T00:00:00Z", "url": "u", "source": {"name": "s"}}) + "\n")
        f.write("{bad\n")
    out = os.path.join(tmpdir_path, "out")
    q = stream_ingest(spark, "news", raw, out, checkpoint=os.path.join(tmpdir_path, "ck"))
    q.awaitTermination(120)
    assert spark.read.parquet(out).count() == 1


def test_reject_returns_broken_lines_and_bad_times(spark):
    ok = json.dumps({"title": "t", "created_utc": 5, "score": 50, "id": "a", "body": "b"})
    bad_time = json.dumps({"title": "t", "created_utc": "x", "score": 50, "id": "z", "body": "b"})
    for ingest in (I.ingest_submissions, I.ingest_comments):
        good, rejected = ingest(_lines(spark, [ok, "{broken", bad_time]), on_error="reject")
        assert [r["id"] for r in good.collect()] == ["a"]
        rej = rejected.collect()
        assert sorted(r["_corrupt_record"] or r["id"] for r in rej) == ["z", "{broken"]
