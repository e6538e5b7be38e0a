import os
import tempfile

from pyspark.sql import functions as F

from pagelens.operators import profiles as PR
from pagelens.plans import fixtures as FX
from pagelens.streaming import jobs as SJ


def test_stream_extract_equals_batch(spark):
    root = tempfile.mkdtemp(prefix="pagelens-stream-")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    pages = FX.search_pages(docs).withColumn("status", F.lit(200)).withColumn("final_url", F.col("url"))
    pages.repartition(3).write.parquet(os.path.join(root, "in"))
    q = SJ.stream_extract(SJ.read_page_stream(spark, os.path.join(root, "in"), max_files=1), "google_web",
                          os.path.join(root, "out"), os.path.join(root, "ckpt"))
    q.awaitTermination(300)
    got = spark.read.parquet(os.path.join(root, "out", "results")).drop("batch_id", "fields")
    want, _ = PR.extract(pages, "google_web", materialize=False)
    cols = ["page_id", "rank", "url", "title", "content", "thumbnail"]
    assert sorted(map(tuple, got.select(*cols).collect())) == sorted(map(tuple, want.select(*cols).collect()))


def test_stream_windows_and_dedupe(spark):
    root = tempfile.mkdtemp(prefix="pagelens-stream-")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    ev.repartition(2).write.parquet(os.path.join(root, "ev"))
    stream = spark.readStream.schema(ev.schema).parquet(os.path.join(root, "ev"))
    rates = SJ.outcome_rates(stream, "tumbling", "10 minutes", by="event_type", delay="1 hour")
    q = (rates.writeStream.outputMode("append").format("memory").queryName("rates_t")
         .option("checkpointLocation", os.path.join(root, "c1")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    batch = SJ.outcome_rates(ev, "tumbling", "10 minutes", by="event_type", delay=None)
    got = spark.table("rates_t")
    # append mode emits windows closed by the watermark; all of them match the batch counts
    assert got.count() > 0
    assert got.exceptAll(batch).count() == 0
    users = stream.withColumn("url", F.concat(F.lit("u"), F.col("user_id")))
    d = SJ.stream_dedupe(users, "url", "ts", "1 hour")
    q = (d.writeStream.format("memory").queryName("dedupe_t")
         .option("checkpointLocation", os.path.join(root, "c2")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("dedupe_t")
    assert got.count() == got.select("url").distinct().count()
    assert got.select("url").distinct().count() == ev.select("user_id").distinct().count()


def test_stream_history(spark):
    root = tempfile.mkdtemp(prefix="pagelens-stream-")
    ev = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    h = ev.select(F.col("event_id").alias("id"), F.concat(F.lit("https://e.org/"), "user_id").alias("url"),
                  F.lit("render").alias("mode"), "ts")
    h.repartition(3).write.parquet(os.path.join(root, "h"))
    s = spark.readStream.schema(h.schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(root, "h"))
    q = SJ.stream_history(s, os.path.join(root, "table"), os.path.join(root, "ckpt"), keep=20)
    q.awaitTermination(300)
    from pagelens.operators.report import upsert_history
    got = SJ.read_history(spark, os.path.join(root, "table"), h.schema)
    want = upsert_history(h, 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # a second run of the same query goes on from its state: older entries change nothing, newer ones do
    more = spark.createDataFrame([(10 ** 6, "https://e.org/0", "render", "2020-01-01 00:00:00"), (10 ** 6 + 1, "https://e.org/1", "render", "2035-01-01 00:00:00.000001"),
                                  (10 ** 6 + 2, "https://e.org/new", "render", "2034-01-01 00:00:00")], "id long, url string, mode string, t string")
    more = more.select("id", "url", "mode", F.col("t").cast(h.schema["ts"].dataType).alias("ts"))
    more.coalesce(1).write.mode("append").parquet(os.path.join(root, "h"))
    SJ.stream_history(s, os.path.join(root, "table"), os.path.join(root, "ckpt"), keep=20).awaitTermination(300)
    got = SJ.read_history(spark, os.path.join(root, "table"), h.schema)
    want = upsert_history(h.unionByName(more), 20)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
    # two versions stay, however many batches came
    assert sum(x.startswith("v=") for x in os.listdir(os.path.join(root, "table"))) == 2


def test_keys_expire(spark):
    root = tempfile.mkdtemp(prefix="pagelens-stream-")
    rows = [(1, "a", "2024-01-01 00:00:00"), (2, "b", "2024-01-01 06:00:00")], [(3, "b", "2024-01-01 20:00:00")], [(4, "c", "2024-01-03 00:00:00")], [(5, "c", "2024-01-03 00:00:01")]
    make = lambda part: spark.createDataFrame(part, "id long, url string, t string").select("id", "url", F.lit("render").alias("mode"), F.col("t").cast("timestamp").alias("ts"))
    for part in rows:
        make(part).coalesce(1).write.mode("append").parquet(os.path.join(root, "h"))
    s = spark.readStream.schema(make(rows[0]).schema).option("maxFilesPerTrigger", 1).parquet(os.path.join(root, "h"))
    SJ.stream_history(s, os.path.join(root, "table"), os.path.join(root, "ckpt"), expire="12 HOURS").awaitTermination(300)
    got = SJ.read_history(spark, os.path.join(root, "table"), make(rows[0]).schema)
    assert [(r["id"], r["url"]) for r in got.collect()] == [(5, "c")]


def test_late_rows_go_to_the_side_table(spark):
    arrived = spark.createDataFrame([(1, "x"), (1, "y"), (2, "z"), (None, "n")], "k int, v string")
    assert [r["v"] for r in SJ.dropped_rows(arrived, arrived.filter("k = 1"), "k").orderBy("v").collect()] == ["n", "z"]
