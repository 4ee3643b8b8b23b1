"""Structured Streaming entry points.

The reference has no stateful streaming operator; its only stream is a JSONL
dump read to the end.  The ingest transforms are pure DataFrame -> DataFrame
functions of raw lines, so they run unchanged on ``readStream.text`` and the
clean rows are appended to Parquet with exactly-once file sink semantics
(checkpointed in the shared checkpoint folder).
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..session import ensure_checkpoint_dir
from ..sources import ingest as I


def stream_ingest(spark: SparkSession, kind: str, raw_dir: str, out_dir: str, min_score: int = 10,
                  checkpoint: str | None = None, trigger_once: bool = True):
    """Start a streaming ingest of raw JSONL files (news|submissions|comments).

    Malformed or unparsable rows are skipped in streams (a streaming query
    cannot return a second frame); batch ingest offers 'fail'/'reject'.
    """
    lines = spark.readStream.text(raw_dir)
    if kind == "news":
        rows, _ = I.ingest_news(lines, on_error="skip")
    elif kind == "submissions":
        rows, _ = I.ingest_submissions(lines, min_score, on_error="skip")
    elif kind == "comments":
        rows, _ = I.ingest_comments(lines, min_score, on_error="skip")
    else:
        raise ValueError(kind)
    ck = checkpoint or f"{ensure_checkpoint_dir(spark).rstrip('/')}/stream-{kind}"
    w = rows.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", ck).outputMode("append")
    w = w.trigger(availableNow=True) if trigger_once else w.trigger(processingTime="30 seconds")
    return w.start()
