"""A1/A2: page sources.

A page row is ``(page_id long, url string, html string[, status int,
final_url string])``. Fetching is outside Spark (the browser service);
these readers take its output table, or pre-fetched HTML files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAGE_SCHEMA = T.StructType([
    T.StructField("page_id", T.LongType()),
    T.StructField("url", T.StringType()),
    T.StructField("html", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("final_url", T.StringType()),
])

# The fetch stage's reply object {html, status, url}.
SCRAPE_REPLY_SCHEMA = T.StructType([
    T.StructField("html", T.StringType()),
    T.StructField("status", T.IntegerType()),
    T.StructField("url", T.StringType()),
])


def with_page_defaults(df: DataFrame) -> DataFrame:
    """Fill optional columns: status 200, final_url = url."""
    cols = df.columns
    if "status" not in cols:
        df = df.withColumn("status", F.lit(200))
    if "final_url" not in cols:
        df = df.withColumn("final_url", F.col("url"))
    return df


def read_pages(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A1: the fetch stage's output table (parquet or JSON lines)."""
    if fmt == "parquet":
        df = spark.read.parquet(path)
    elif fmt == "json":
        df = spark.read.schema(PAGE_SCHEMA).json(path)
    else:
        raise ValueError(f"unsupported page format: {fmt}")
    return with_page_defaults(df)


def read_scrape_replies(spark: SparkSession, path: str) -> DataFrame:
    """A1: JSON lines of ``{html, status, url}`` replies; ``url`` is the final
    URL after redirects. Ids come from the URL and the content, so they are
    stable across re-reads and two scrapes of one URL are two pages; equal
    replies are one page (``with_page_ids``)."""
    df = spark.read.schema(SCRAPE_REPLY_SCHEMA).json(path)
    return with_page_ids(df.select(
        "url", "html",
        F.coalesce("status", F.lit(0)).alias("status"),
        F.col("url").alias("final_url")))


def with_page_ids(df: DataFrame) -> DataFrame:
    """Give rows (url, html, ...) a ``page_id``: the first 63 bits of the
    SHA-256 of url and html. Rows that agree in both are one page and are
    merged by the full digest; different pages whose 63 bits agree would make
    a wrong page, so ``check_page_ids`` reports them."""
    digest = F.sha2(F.concat_ws("\u0000", F.coalesce("url", F.lit("")), F.coalesce("html", F.lit(""))), 256)
    short = F.conv(F.substring("_digest", 1, 16), 16, 10).cast("decimal(20,0)")
    out = df.withColumn("_digest", digest).dropDuplicates(["_digest"])
    return out.select((short % F.lit(str(2 ** 63)).cast("decimal(20,0)")).cast("long").alias("page_id"), *df.columns)


def check_page_ids(pages: DataFrame) -> DataFrame:
    """(page_id, n) of ids that more than one row has; empty for a table that
    may go into the node table."""
    return pages.groupBy("page_id").agg(F.count("*").alias("n")).where("n > 1")


# What the bytes 0x80 to 0x9F mean in windows-1252 (the five
# that it leaves open stay control characters).
WINDOWS_1252 = "\u20ac\u0081\u201a\u0192\u201e\u2026\u2020\u2021\u02c6\u2030\u0160\u2039\u0152\u008d\u017d\u008f\u0090\u2018\u2019\u201c\u201d\u2022\u2013\u2014\u02dc\u2122\u0161\u203a\u0153\u009d\u017e\u0178"
WESTERN = ("windows-1252", "cp1252", "iso-8859-1", "latin1", "us-ascii", "ascii")
META_BYTES = 4096      # a meta tag counts within so many bytes


def _charset_label(text) -> F.Column:
    return F.lower(F.regexp_extract(text, r"(?i)charset\s*=\s*[\x22']?\s*([A-Za-z0-9_:.-]+)", 1))


def charset_of(content, header=None) -> F.Column:
    """The charset of html bytes: utf-8, utf-16le, utf-16be or windows-1252, by
    byte order mark, then the charset of a Content-Type ``header``, then a meta
    tag near the start, else UTF-8 where the bytes are valid and windows-1252
    where not. A label that names none of these counts as not given; one of
    UTF-16 in a meta tag means UTF-8, since it could be read."""
    content = F.col(content) if isinstance(content, str) else content
    head = F.decode(F.substring(content, 1, META_BYTES), "ISO-8859-1")
    known = lambda label, wide: (F.when(label.isin("utf-8", "utf8"), "utf-8").when(label.isin(*WESTERN), "windows-1252")
                                 .when(label.isin("utf-16", "utf-16le"), wide or "utf-16le").when(label == "utf-16be", wide or "utf-16be"))
    mark = F.hex(F.substring(content, 1, 3))
    by_mark = F.when(mark.startswith("EFBBBF"), "utf-8").when(mark.startswith("FFFE"), "utf-16le").when(mark.startswith("FEFF"), "utf-16be")
    by_header = known(_charset_label(header), None) if header is not None else F.lit(None).cast("string")
    meta = F.regexp_extract(head, r"(?i)<meta\s[^>]*charset\s*=[^>]*>", 0)
    valid = F.is_valid_utf8(content.cast("string"))
    return F.coalesce(by_mark, by_header, known(_charset_label(meta), "utf-8"), F.when(valid, "utf-8").otherwise("windows-1252"))


def decode_html(content, charset) -> F.Column:
    """Bytes to text on the JVM. The mark is dropped; bytes that are no UTF-8
    become replacement characters, half a UTF-16 unit at the end is dropped."""
    content, charset = (F.col(c) if isinstance(c, str) else c for c in (content, charset))
    high = "".join(chr(c) for c in range(0x80, 0xA0))
    even = F.substring(content, F.lit(1), (F.octet_length(content) - F.octet_length(content) % 2).cast("int"))
    text = (F.when(charset == "utf-16le", F.decode(even, "UTF-16LE")).when(charset == "utf-16be", F.decode(even, "UTF-16BE"))
            .when(charset == "windows-1252", F.translate(F.decode(content, "ISO-8859-1"), high, WINDOWS_1252))
            .otherwise(F.make_valid_utf8(content.cast("string"))))
    return F.regexp_replace(text, "^\ufeff", "")


def read_html_files(spark: SparkSession, path: str, header: str | None = None) -> DataFrame:
    """A2: pre-fetched HTML files as bytes, one page per file, decoded by
    ``charset_of``; ``header`` is the Content-Type they were served with."""
    files = spark.read.format("binaryFile").load(path)
    html = decode_html("content", charset_of("content", F.lit(header) if header else None))
    df = files.select(html.alias("html"), F.col("path").alias("url"))
    return with_page_ids(df.select("url", "html", F.lit(200).alias("status"), F.col("url").alias("final_url")))


def split_missing_html(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A2: html is required; rows without it are rejected with the message
    the service returns."""
    bad = F.col("html").isNull() | (F.col("html") == "")
    ok = df.filter(~bad)
    rejected = df.filter(bad).withColumn("error", F.lit("Missing 'html' field"))
    return ok, rejected
