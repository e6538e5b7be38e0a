"""L1-L4: the same jobs on Structured Streaming.

* L1 ``stream_extract``: page files arrive in a folder; each micro-batch
  runs the profile plan (ordered per-page aggregates stay inside a batch)
  and writes its results under ``batch_id=<n>`` with overwrite, so a
  replayed batch after a failure rewrites the same files (exactly-once
  output with the checkpoint).
* L2 ``stream_history``: latest row per (url, mode) in keyed state
  (``transformWithState``: a list of entries per key, timers that
  expire it); only keys that change reach the table of the newest ``keep``.
* L3 ``stream_dedupe``: cross-batch URL dedupe with late data via
  ``withWatermark`` + ``dropDuplicatesWithinWatermark``; ``dropped_rows`` lists
  what arrived and never came out.
* L4 ``outcome_rates``: counts in tumbling / sliding / session windows with
  a watermark; rows later than the watermark are dropped in append mode.
"""

from __future__ import annotations

import contextlib

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from pagelens.operators import profiles as PR
from pagelens.operators import report as RP
from pagelens.operators.requests import split_captcha
from pagelens.session import scratch
from pagelens.sources.pages import PAGE_SCHEMA


def read_page_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(PAGE_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path)


def stream_extract(pages_stream: DataFrame, profile: str, sink: str, checkpoint: str,
                   options: dict | None = None, available_now: bool = True):
    """L1. Returns the started query."""
    prof = PR.get_profile(profile)

    def run(batch: DataFrame, batch_id: int):
        if "final_url" not in batch.columns:
            batch = batch.withColumn("final_url", F.col("url"))
        batch = batch.withColumn("final_url", F.coalesce("final_url", "url"))
        ok, blocked = split_captcha(batch, prof.captcha_patterns)
        base = f"{sink.rstrip('/')}"
        with scratch(batch.sparkSession):     # the batch's node table goes with it
            res, sugg = PR.extract(ok, profile, options)
            res.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
                .parquet(f"{base}/results/batch_id={batch_id}")
            sugg.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite") \
                .parquet(f"{base}/suggestions/batch_id={batch_id}")
            RP.page_status(batch, res, sugg, blocked).write.mode("overwrite") \
                .parquet(f"{base}/status/batch_id={batch_id}")

    w = pages_stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
    return w.start()


# entries as state keeps them: order, and the row as JSON to the microsecond
ENTRY = "ts long, id string, row string"
CHANGE = "url string, mode string, ts long, id string, row string, expired boolean"
EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class LatestEntries(StatefulProcessor):
    """Per (url, mode): a list of the newest ``versions`` entries, newest
    first. Hands on the newest when it changes. With ``expire_ms`` an event-time
    timer that long after the newest entry clears the key and says so."""

    def __init__(self, versions: int, expire_ms: int | None, numbers: bool):
        self.versions, self.expire_ms, self.numbers = versions, expire_ms, numbers

    def init(self, handle) -> None:
        self.handle = handle
        self.entries = handle.getListState("entries", ENTRY)

    def _order(self, entry):
        # as in SQL: no time and no id come before all others
        ts, own = entry[0], entry[1]
        return ts is not None, ts or 0, own is not None, (int(own) if self.numbers else own) if own is not None else ""

    def _change(self, key, entry, expired):
        return Row(url=key[0], mode=key[1], ts=entry[0], id=entry[1], row=entry[2], expired=expired)

    def handleInputRows(self, key, rows, timerValues):
        # each call of the state is a message to the JVM: one to read, one to write
        held = list(self.entries.get())
        found = set(held)
        found.update((r["at"], r["entry_id"], r["entry"]) for r in rows)
        newest = sorted(found, key=self._order, reverse=True)[:self.versions]
        if newest == held:
            return
        self.entries.put(newest)
        if self.expire_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if newest[0][0] is not None:
                self.handle.registerTimer(newest[0][0] // 1000 + self.expire_ms)
        if not held or newest[0] != held[0]:
            yield self._change(key, newest[0], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = list(self.entries.get())
        self.entries.clear()
        if held:
            yield self._change(key, held[0], True)

    def close(self) -> None:
        pass


@contextlib.contextmanager
def _rocksdb(spark: SparkSession):
    """Keyed state needs this store; a query keeps the setting it starts with."""
    name = "spark.sql.streaming.stateStore.providerClass"
    old = spark.conf.get(name, None)
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def latest_changes(entries: DataFrame, versions: int = 1, expire: str | None = None) -> DataFrame:
    """L2: the stream of changes of the newest entry per (url, mode)
    (``CHANGE``). An entry older than the key's newest changes nothing, however
    late it comes. ``expire`` (an interval of event time, which is then also
    the watermark's delay) forgets keys without a newer entry."""
    from pagelens.session import ship_package
    ship_package(entries.sparkSession)
    whole = entries.schema["id"].dataType.typeName() in ("byte", "short", "integer", "long")
    expire_ms = None
    if expire:
        entries = _as_event_time(entries, "ts").withWatermark("ts", expire)
        expire_ms = int(entries.sparkSession.sql(f"SELECT unix_millis(timestamp_millis(0) + INTERVAL {expire}) AS ms").first()["ms"])
    rows = entries.select("url", "mode", *(["ts"] if expire else []), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"),
                          F.col("id").cast("string").alias("entry_id"), F.to_json(F.struct(*entries.columns), EXACT).alias("entry"))
    return rows.groupBy("url", "mode").transformWithState(
        LatestEntries(versions, expire_ms, whole), CHANGE, "Update", "EventTime" if expire else "None")


def stream_history(entries_stream: DataFrame, table_path: str, checkpoint: str, keep: int = 20,
                   available_now: bool = True, expire: str | None = None):
    """L2: ``entries(id, url, mode, ts, ...)``; the history table at
    ``table_path`` holds the newest ``keep`` rows. State holds every key, so a
    batch brings only keys that changed; they are merged with the small table.
    A batch writes a version folder and removes those before its predecessor,
    so that two remain; readers use ``read_history``."""
    spark, schema = entries_stream.sparkSession, entries_stream.schema

    def run(batch: DataFrame, batch_id: int):
        # a replayed batch starts from the version before its own
        cur = read_history(spark, table_path, schema, before=batch_id)
        # the state's step runs once for a batch: only with expire are its changes read twice
        batch = batch.persist() if expire else batch
        new = batch.filter("NOT expired").select(F.from_json("row", schema, EXACT).alias("r")).select("r.*")
        merged = RP.upsert_history(cur.unionByName(new), keep)
        if expire:
            gone = batch.filter("expired").select("url", "mode", F.col("ts").alias("_at"))
            same = (merged["url"].eqNullSafe(gone["url"]) & merged["mode"].eqNullSafe(gone["mode"])
                    & (F.unix_micros(merged["ts"].cast("timestamp")) == gone["_at"]))
            merged = merged.join(gone, same, "left_anti")
        merged.write.mode("overwrite").parquet(f"{table_path.rstrip('/')}/v={batch_id}")
        if expire:
            batch.unpersist()
        _forget_versions(spark, table_path, batch_id - 1)

    with _rocksdb(spark):
        w = latest_changes(entries_stream, expire=expire).writeStream.outputMode("update").foreachBatch(run).option("checkpointLocation", checkpoint)
        w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="10 seconds")
        return w.start()


def _forget_versions(spark: SparkSession, table_path: str, first: int) -> None:
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(table_path.rstrip("/"))
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for st in fs.listStatus(top):
        name = st.getPath().getName()
        if name.startswith("v=") and int(name[2:]) < first:
            fs.delete(st.getPath(), True)


def read_history(spark: SparkSession, table_path: str, schema, before: int | None = None) -> DataFrame:
    """The newest complete version: the highest ``v=`` folder with the
    writer's success mark. Only a missing folder means that there is none yet;
    any other failure is raised."""
    base = table_path.rstrip("/")
    jvm = spark.sparkContext._jvm
    top = jvm.org.apache.hadoop.fs.Path(base)
    fs = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    versions = []
    if fs.exists(top):
        for st in fs.listStatus(top):
            name = st.getPath().getName()
            if name.startswith("v=") and fs.exists(jvm.org.apache.hadoop.fs.Path(f"{base}/{name}/_SUCCESS")):
                versions.append(int(name[2:]))
    versions = [v for v in versions if before is None or v < before]
    if not versions:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{base}/v={max(versions)}")


def stream_dedupe(df: DataFrame, key: str = "url", event_time: str = "ts",
                  delay: str = "10 minutes") -> DataFrame:
    """L3: first sighting of each key; duplicates within the watermark delay
    are dropped across batches, state older than the watermark is purged."""
    return _as_event_time(df, event_time).withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def dropped_rows(arrived: DataFrame, emitted: DataFrame, key) -> DataFrame:
    """L3, the side table: rows that arrived and whose key never came out of a
    stream, because they came after the watermark had passed them."""
    keys = [key] if isinstance(key, str) else list(key)
    return arrived.join(emitted.select(*keys).distinct(), keys, "left_anti")


def _as_event_time(df: DataFrame, event_time: str) -> DataFrame:
    """Watermarks need TIMESTAMP; a TIMESTAMP_NTZ column is read as UTC."""
    if dict(df.dtypes).get(event_time) == "timestamp_ntz":
        df = df.withColumn(event_time, F.col(event_time).cast("timestamp"))
    return df


def outcome_rates(df: DataFrame, kind: str = "tumbling", size: str = "10 minutes",
                  slide: str | None = None, by: str = "outcome", event_time: str = "ts",
                  delay: str | None = "10 minutes") -> DataFrame:
    """L4: counts per window and outcome. ``kind``: tumbling, sliding or
    session (``size`` is the gap). With ``delay`` a watermark bounds state."""
    if delay:
        df = _as_event_time(df, event_time).withWatermark(event_time, delay)
    if kind == "tumbling":
        w = F.window(event_time, size)
    elif kind == "sliding":
        w = F.window(event_time, size, slide or size)
    elif kind == "session":
        w = F.session_window(event_time, size)
    else:
        raise ValueError(kind)
    g = df.groupBy(w.alias("w"), F.col(by))
    return g.agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), F.col("w.end").alias("window_end"), by, "n")


def sessions(df: DataFrame, by: str, gap: str, event_time: str = "ts", slice_unit: str = "hour") -> DataFrame:
    """L4, batch form for sessions that may be very large: sessions within
    (key, time slice) first, so that a key's events are spread over its
    slices, then the slices' sessions of a key are joined where they touch.
    What meets in one task is a key's sessions, whose number is bounded by
    time, not by events. Same result as ``outcome_rates(kind='session')``."""
    part = df.groupBy(F.col(by), F.date_trunc(slice_unit, F.col(event_time)).alias("_slice"), F.session_window(event_time, gap).alias("w")).agg(
        F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
    order = Window.partitionBy(by).orderBy("start", "end")
    so_far = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = F.when(so_far.isNull() | (F.col("start") >= so_far), 1).otherwise(0)
    numbered = part.withColumn("_new", opens).withColumn("_no", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(by, "_no").agg(F.min("start").alias("window_start"), F.max("end").alias("window_end"), F.sum("n").alias("n")).select(
        "window_start", "window_end", by, "n")
