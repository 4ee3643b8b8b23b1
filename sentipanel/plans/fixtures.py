"""Fixture views over the driver tables (see FIXTURES.md).

The same SQL text runs in Spark and in DuckDB, so Spark queries build their
inputs from it and the DuckDB oracle reuses it as a CTE prefix.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

BASE_TABLES = ("region nation customer supplier part orders lineitem events documents "
               "embeddings pages benchmark labels conversations").split()

FIXTURE_SQL = {
    "fx_price": """
SELECT 'S' || lpad(cast(o_custkey % 20 AS string), 2, '0') AS symbol, cast(o_orderdate AS date) AS dt,
  min_by(o_totalprice, o_orderkey) AS open, max_by(o_totalprice, o_orderkey) AS close,
  max(o_totalprice) AS high, min(o_totalprice) AS low
FROM orders GROUP BY 1, 2""",
    "fx_index": """
SELECT cast(o_orderdate AS date) AS dt, min_by(o_totalprice, o_orderkey) AS sp500_open, avg(o_totalprice) AS sp500_close
FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY 1""",
    "fx_post": """
SELECT l_orderkey AS post_id, 'S' || lpad(cast(l_suppkey % 20 AS string), 2, '0') AS symbol,
  l_shipdate + l_linenumber * INTERVAL '3' HOUR AS ts, l_returnflag || l_linestatus AS subreddit,
  cast(l_quantity AS bigint) AS score, l_discount AS pos, 1 - l_discount - l_tax AS neu, l_tax AS neg,
  l_discount - l_tax AS compound, l_partkey, l_linenumber, l_extendedprice
FROM lineitem""",
    "fx_article": """
SELECT doc_id, 'u' || cast(doc_id % 800 AS string) AS url, source AS domain, lang, text,
  DATE '2016-01-01' + cast(doc_id % 400 AS int) AS dt FROM documents""",
    "fx_thread": """
SELECT conv_id * 100 + turn AS id,
  CASE WHEN turn > 0 THEN conv_id * 100 + cast(floor((turn - 1) / 2) AS bigint) END AS parent_id,
  conv_id * 100 AS post_id, turn, role, text FROM conversations""",
    "fx_event_day": """
SELECT event_type || cast(user_id % 40 AS string) AS symbol, cast(ts AS date) AS dt, avg(value) AS x, count(*) AS n
FROM events GROUP BY 1, 2""",
    "fx_macro": """
SELECT cast(date_trunc('month', o_orderdate) AS date) AS month, avg(o_totalprice) AS rate, count(*) AS volume
FROM orders GROUP BY 1""",
    "fx_terms": """
SELECT * FROM (VALUES ('the','AAA'),('The','AAA'),('of the','BBB'),('and','EEE'),('der','CCC'),('de la','DDD'),('la','FFF'),('que','GGG')) AS t(term, ticker)""",
}


def cte_prefix(*names: str) -> str:
    """``WITH fx_a AS (...), fx_b AS (...)`` for the DuckDB oracle."""
    parts = [f"{n} AS ({FIXTURE_SQL[n].strip()})" for n in names]
    return "WITH " + ",\n".join(parts) + "\n"


class Fixtures:
    """Lazily registered base tables + fixture frames for one sf directory."""

    _registered: dict = {}

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir.rstrip("/")
        tag = (id(spark), spark.sparkContext.applicationId, self.sf_dir)
        if Fixtures._registered.get(id(spark)) != tag or not spark.catalog.tableExists(BASE_TABLES[-1]):
            for t in BASE_TABLES:
                spark.read.parquet(f"{self.sf_dir}/{t}.parquet").createOrReplaceTempView(t)
            Fixtures._registered[id(spark)] = tag

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def __getattr__(self, name: str) -> DataFrame:
        if name in FIXTURE_SQL:
            return self.spark.sql(FIXTURE_SQL[name])
        raise AttributeError(name)
