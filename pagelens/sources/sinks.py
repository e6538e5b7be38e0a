"""A3-A5: sinks.

Writes are plain DataFrame writers into folders partitioned by a low
cardinality column; every job overwrites its own output folder, so a
retried job or batch leaves the same files behind.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_content(processed: DataFrame, path: str) -> None:
    """A3: ``process`` output (page_id, content, format, ...) as parquet by
    format, and the bare contents beside it: JSON documents as JSON lines
    (their own text, so numbers stay numbers), markdown and HTML as text
    with a record separator after each page."""
    base = path.rstrip("/")
    processed.write.mode("overwrite").partitionBy("format").parquet(f"{base}/content")
    processed.filter(F.col("format") == "json").select(F.col("content").alias("value")).write.mode("overwrite").text(f"{base}/json")
    for fmt in ("markdown", "html"):
        (processed.filter(F.col("format") == fmt).select(F.col("content").alias("value"))
         .write.mode("overwrite").option("lineSep", "\u001e\n").text(f"{base}/{fmt}"))


def write_envelopes(envelopes: DataFrame, path: str) -> None:
    """A4: one JSON envelope per page (``report.extract_envelope``)."""
    envelopes.select("envelope").write.mode("overwrite").text(path)


def write_probe_report(summary: DataFrame, raw: DataFrame, path: str, ts: str, probe: str) -> None:
    """A5: the summary without ``_``-prefixed columns, stamped and
    partitioned by probe and timestamp; raw html and full JSON go to a
    separate parquet folder with the same stamp."""
    base = path.rstrip("/")
    keep = [c for c in summary.columns if not c.startswith("_")]
    (summary.select(*keep).withColumn("probe", F.lit(probe)).withColumn("ts", F.lit(ts))
     .write.mode("overwrite").partitionBy("probe", "ts").json(f"{base}/summary"))
    (raw.withColumn("probe", F.lit(probe)).withColumn("ts", F.lit(ts))
     .write.mode("overwrite").partitionBy("probe", "ts").parquet(f"{base}/raw"))
