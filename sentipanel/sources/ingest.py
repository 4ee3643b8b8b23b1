"""Sources and sinks: raw JSONL -> typed rows, CSV/Parquet writers, readers.

Every transform takes a DataFrame of raw lines (column ``value``: what
``spark.read.text`` or ``spark.readStream.text`` yields), so the same code
serves batch files and streams.  JSON is parsed with ``from_json`` against a
fixed schema (no inference); the raw text of a malformed line lands in
``_corrupt_record``.

zstd-compressed text is not a Hadoop codec in this Spark build: re-compress
raw dumps to gzip/bzip2 (splittable) before reading.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

S, L, D = T.StringType(), T.LongType(), T.DoubleType()

RAW_NEWS = T.StructType([T.StructField(n, S) for n in ("title", "description", "content", "url", "publishedAt")] +
                        [T.StructField("source", T.StructType([T.StructField("name", S)]))])
RAW_SUBMISSION = T.StructType([T.StructField("title", S), T.StructField("created_utc", S), T.StructField("subreddit", S),
                               T.StructField("domain", S), T.StructField("score", L), T.StructField("downs", L),
                               T.StructField("id", S), T.StructField("selftext", S), T.StructField("link_flair_text", S)])
RAW_COMMENT = T.StructType([T.StructField("body", S), T.StructField("created_utc", S), T.StructField("score", L),
                            T.StructField("id", S), T.StructField("link_id", S), T.StructField("parent_id", S),
                            T.StructField("permalink", S)])
CORRUPT = "_corrupt_record"


def _parse(lines: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    full = T.StructType(schema.fields + [T.StructField(CORRUPT, S)])
    parsed = F.from_json(F.col(value), full, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    return lines.select(parsed.alias("__j")).select("__j.*")


def _on_error(df: DataFrame, bad: Column, on_error: str, what: str):
    """'fail' -> raise at execution; 'reject' -> (good, rejected); 'skip' -> good."""
    if on_error == "fail":
        # a filter (not a projected column, which column pruning would drop)
        return df.filter(F.when(bad, F.raise_error(F.lit(f"invalid {what}"))).otherwise(F.lit(True))), None
    good, rejected = df.filter(~bad), df.filter(bad)
    return good, (rejected if on_error == "reject" else None)


def _both(first: DataFrame | None, second: DataFrame | None) -> DataFrame | None:
    """Rejected rows of both checks; malformed lines keep their raw text in ``_corrupt_record``."""
    if first is None or second is None:
        return first if second is None else second
    return first.unionByName(second, allowMissingColumns=True)


def parse_created_utc(c: Column | str) -> Column:
    """JSON number or quoted number, integer or float, epoch seconds -> epoch ms
    (fraction cut off).  NULL when not a number."""
    c = F.col(c) if isinstance(c, str) else c
    return F.substring_index(F.trim(c), ".", 1).try_cast("bigint") * F.lit(1000)


def post_id_from_link(link: Column | str) -> Column:
    """link_id with the first 't3_' removed."""
    link = F.col(link) if isinstance(link, str) else link
    pos = F.instr(link, "t3_")
    return F.when(pos > 0, F.concat(F.substring(link, F.lit(1), pos - 1), F.substr(link, pos + 3))).otherwise(link)


def parent_from_raw(parent: Column | str) -> Column:
    """'t1_abc' -> 'abc' (text between the first and second '_'); numbers or
    strings without '_' -> ''."""
    parent = F.col(parent) if isinstance(parent, str) else parent
    return F.coalesce(F.try_element_at(F.split(parent, "_"), F.lit(2)), F.lit(""))


def ingest_news(lines: DataFrame, on_error: str = "reject", value: str = "value"):
    """raw news JSONL -> (news, rejected).  Malformed JSON lines are skipped;
    an unparsable ``publishedAt`` fails the job ('fail') or is rejected."""
    p = _parse(lines, RAW_NEWS, value).filter(F.col(CORRUPT).isNull())
    ts = F.try_to_timestamp(F.col("publishedAt"))
    rows = p.select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("description", F.lit("")).alias("description"),
                    F.coalesce("content", F.lit("")).alias("body"), F.coalesce("url", F.lit("")).alias("url"),
                    F.coalesce(F.col("source.name"), F.lit("")).alias("domain"),
                    F.unix_millis(ts).alias("dt"), F.col("publishedAt"))
    good, rej = _on_error(rows, F.col("dt").isNull(), on_error, "publishedAt")
    return good.drop("publishedAt"), rej


def ingest_submissions(lines: DataFrame, min_score: int = 10, on_error: str = "fail", value: str = "value"):
    """raw submissions -> submission rows with score >= min_score.  Malformed
    JSON fails the job by default (as does a bad created_utc)."""
    p = _parse(lines, RAW_SUBMISSION, value)
    p, rej1 = _on_error(p, F.col(CORRUPT).isNotNull(), on_error, "JSON line")
    rows = p.select(F.coalesce("title", F.lit("")).alias("title"), F.coalesce("subreddit", F.lit("")).alias("subreddit"),
                    F.coalesce("domain", F.lit("")).alias("domain"), F.coalesce("id", F.lit("")).alias("id"),
                    F.coalesce("selftext", F.lit("")).alias("body"), F.coalesce("link_flair_text", F.lit("")).alias("flair"),
                    parse_created_utc("created_utc").alias("dt"), F.coalesce("score", F.lit(0)).alias("score"),
                    F.coalesce("downs", F.lit(0)).alias("downs"))
    rows, rej2 = _on_error(rows, F.col("dt").isNull(), on_error, "created_utc")
    return rows.filter(F.col("score") >= min_score), _both(rej1, rej2)


def ingest_comments(lines: DataFrame, min_score: int = 10, on_error: str = "fail", value: str = "value"):
    p = _parse(lines, RAW_COMMENT, value)
    p, rej1 = _on_error(p, F.col(CORRUPT).isNotNull(), on_error, "JSON line")
    rows = p.select(F.coalesce("body", F.lit("")).alias("body"), F.coalesce("id", F.lit("")).alias("id"),
                    post_id_from_link(F.coalesce("link_id", F.lit(""))).alias("post_id"),
                    parent_from_raw("parent_id").alias("parent_id"),
                    parse_created_utc("created_utc").alias("dt"), F.coalesce("score", F.lit(0)).alias("score"))
    rows, rej2 = _on_error(rows, F.col("dt").isNull(), on_error, "created_utc")
    return rows.filter(F.col("score") >= min_score), _both(rej1, rej2)


def dedup_raw_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Exact duplicate raw lines dropped (hash aggregate; one copy kept)."""
    return lines.dropDuplicates([value])


# ------------------------------------------------------------- sinks ----

def write_csv_export(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Clean rows as CSV with a header that matches the row columns."""
    df.write.mode(mode).option("header", True).csv(path)


def write_by_symbol(df: DataFrame, path: str, key: str = "symbol", mode: str = "append", fmt: str = "parquet") -> None:
    """One directory per ticker.  Rows are gathered by ticker first (few files
    per ticker); the rebalance hint lets AQE split a hot ticker over tasks."""
    df.hint("rebalance", key).write.mode(mode).partitionBy(key).format(fmt).save(path)


def finalize_segments(df: DataFrame) -> DataFrame:
    """Typed segment rows with exact duplicates removed (before ``write_by_symbol``)."""
    return df.dropDuplicates()


def read_by_symbol(spark, path: str, key: str = "symbol", layout: str = "partitioned", fmt: str = "parquet") -> DataFrame:
    """Union of all per-symbol outputs with the symbol column restored:
    'partitioned' = key=VALUE directories (partition discovery, pruning);
    'stem' = one file per symbol named VALUE.parquet."""
    if layout == "partitioned":
        return spark.read.format(fmt).load(path)
    df = spark.read.format(fmt).load(path)
    return df.withColumn(key, F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(\.[^.]*)?$", 1))


def write_incremental(df: DataFrame, path: str, key: str = "symbol", fmt: str = "parquet") -> DataFrame:
    """Append only the keys that have no output yet (left-anti join against
    the existing partitions); returns what was written."""
    spark = df.sparkSession
    try:
        existing = spark.read.format(fmt).load(path).select(key).distinct()
        todo = df.join(existing, [key], "left_anti")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        todo = df  # nothing written yet
    todo.hint("rebalance", key).write.mode("append").partitionBy(key).format(fmt).save(path)
    return todo


def write_dataset(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    w = df.write.mode(mode)
    (w.option("header", True).csv(path) if fmt == "csv" else w.format(fmt).save(path))


# ----------------------------------------------------------- market data --

def _money(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, r"\$", ""), ",", "").try_cast("double")


def ingest_prices(raw: DataFrame, symbol: str | None = None) -> DataFrame:
    """date MM/DD/YYYY; open/high/low/close/volume strings with '$' and ','
    (unparsable -> NULL); optional symbol tag."""
    out = raw.select(F.try_to_date(F.col("date"), "MM/dd/yyyy").alias("date"),
                     *[_money(F.col(c)).alias(c) for c in ("open", "high", "low", "close", "volume")],
                     *([F.col("symbol")] if "symbol" in raw.columns and symbol is None else []))
    return out.withColumn("symbol", F.lit(symbol)) if symbol is not None else out


def ingest_index_prices(raw: DataFrame) -> DataFrame:
    """Day-first dates, comma thousands -> (dt, sp500_open, sp500_close)."""
    return raw.select(F.try_to_date(F.col("Date"), "dd/MM/yyyy").alias("dt"),
                      _money(F.col("Open")).alias("sp500_open"), _money(F.col("Price")).alias("sp500_close"))


MACRO_SCHEMA = ("Date date, `Interest Rates (Fed Funds Rate)` double, `Inflation (CPI)` double, `GDP Growth Rate` double, "
                "`M2 Money Supply` double, `Federal Expenditures` double, `Unemployment Rate` double")


def ingest_macro(spark, path: str) -> DataFrame:
    return spark.read.option("header", True).schema(MACRO_SCHEMA).csv(path)


def read_sample_news(spark, path: str) -> DataFrame:
    """Union of CSVs; ``source`` = second '_' part of the file name."""
    df = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return df.withColumn("source", F.try_element_at(F.split(F.col("_metadata.file_name"), "_"), F.lit(2)))


def read_ratings(spark, path: str, n_last: int = 5) -> DataFrame:
    """Rating sheet exported to CSV: rows with any NULL dropped, last ``n_last`` columns."""
    df = spark.read.option("header", True).option("inferSchema", False).csv(path).dropna()
    cols = df.columns[-n_last:]
    return df.select(*[F.col(f"`{c}`").try_cast("double").alias(c) for c in cols])
