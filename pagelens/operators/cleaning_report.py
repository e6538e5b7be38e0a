"""Bytes saved by the pre-clean, per host.

Plan: scan (page_id, url, html) -> codegen'd regex chain -> partial
aggregate per host on the map side -> one small shuffle of per-host partial
sums. A hot host costs nothing extra because only partial sums move.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagelens.functions.cleaning import pre_clean
from pagelens.functions.text import url_host
from pagelens.session import ensure_parallel


def cleaning_report(pages: DataFrame, images: bool = False) -> DataFrame:
    pages = ensure_parallel(pages.select("page_id", "url", "html"))
    cleaned = pages.select(
        url_host("url").alias("host"),
        F.octet_length("html").cast("long").alias("raw_bytes"),
        F.octet_length(pre_clean("html", images)).cast("long").alias("clean_bytes"),
    )
    return cleaned.groupBy("host").agg(
        F.count(F.lit(1)).alias("pages"),
        F.sum("raw_bytes").alias("raw_bytes"),
        F.sum("clean_bytes").alias("clean_bytes"),
        (F.sum("raw_bytes") - F.sum("clean_bytes")).alias("saved_bytes"),
    )
