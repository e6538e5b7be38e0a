"""Session helpers: a tuned SparkSession, table loading and lineage cuts."""

from __future__ import annotations

import contextlib
import os
import tempfile
import warnings

from pyspark.sql import DataFrame, SparkSession


def get_spark(master: str | None = None, app: str = "pagelens",
              shuffle_partitions: int | None = None) -> SparkSession:
    """Session used by tests and bench. On a cluster the submitter's
    settings win: builder options only fill what is not set already."""
    master = master or os.environ.get("PAGELENS_MASTER", "local[8]")
    b = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        # session windows: merge sessions inside each partition before the
        # shuffle, so one very active key does not arrive as raw events
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        # joins on (page_id, x) may use a page_id bucketing/partitioning
        .config("spark.sql.requireAllClusterKeysForCoPartition", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("PAGELENS_DRIVER_MEMORY", "16g"))
    )
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    if os.environ.get("PAGELENS_EVENT_LOG_DIR"):   # stage timings for profiling
        b = b.config("spark.eventLog.enabled", "true").config(
            "spark.eventLog.dir", os.environ["PAGELENS_EVENT_LOG_DIR"])
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    checkpoint_dir(spark)
    return spark


_SHIPPED: set = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``pagelens`` importable in Python workers: zip the package once
    per SparkContext and ``addPyFile`` it (what ``--py-files`` does on
    submit). Spark distributes the archive to every executor; workers that
    can already import the package are unaffected."""
    import zipfile
    sc = spark.sparkContext
    key = sc.applicationId
    if key in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="pagelens-pyfiles-"), "pagelens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(key)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for lineage cuts, read from the session
    (``spark.checkpoint.dir``). Only a local master may go without: it gets a
    scratch folder. On a cluster every executor would write to a disk of its
    own, so an unset folder is an error there."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    conf = spark.conf.get("spark.checkpoint.dir", None)
    if not conf:
        master = sc.master or ""
        if master != "local" and not master.startswith("local["):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        conf = tempfile.mkdtemp(prefix="pagelens-ckpt-")
    sc.setCheckpointDir(conf)
    return sc.getCheckpointDir() or conf


# Tables written under the checkpoint folder and not removed yet:
# (path, catalog table or None), by application.
_TABLES: dict[str, list] = {}


def _remember(spark: SparkSession, path: str, table: str | None = None) -> None:
    import atexit
    key = spark.sparkContext.applicationId
    if key not in _TABLES:
        _TABLES[key] = []
        atexit.register(_forget, spark, key)
    _TABLES[key].append((path, table))


def _forget(spark: SparkSession, key: str) -> None:
    # at the end of the program; a stopped session leaves nothing to do, and
    # the JVM may have gone first
    with contextlib.suppress(Exception):
        if spark.sparkContext._jsc is not None:
            drop_tables(spark)


def drop_tables(spark: SparkSession, keep: int = 0) -> int:
    """Remove the intermediate tables of this application, but for the
    ``keep`` oldest; returns how many. Results that were not consumed yet
    cannot be read afterwards."""
    held = _TABLES.get(spark.sparkContext.applicationId, [])
    gone = held[keep:]
    del held[keep:]
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path, table in gone:
        if table:
            spark.sql(f"DROP TABLE IF EXISTS {table}")
        top = jvm.org.apache.hadoop.fs.Path(path)
        top.getFileSystem(conf).delete(top, True)
    return len(gone)


@contextlib.contextmanager
def scratch(spark: SparkSession):
    """``with scratch(spark): df.write...`` removes the intermediate tables
    made inside when it ends."""
    held = len(_TABLES.get(spark.sparkContext.applicationId, []))
    try:
        yield
    finally:
        drop_tables(spark, held)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new folder under the shared checkpoint folder, removed like a table."""
    import uuid
    path = f"{checkpoint_dir(spark).rstrip('/')}/scratch/{name}-{uuid.uuid4().hex}"
    _remember(spark, path)
    return path


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Materialise ``df`` (now, not lazily) as parquet under the shared
    checkpoint folder and read it back: a lineage cut that survives executor
    loss and, unlike an RDD checkpoint, keeps column pruning and filter
    pushdown for every reader. Removed by ``scratch``, ``drop_tables`` or the
    end of the program."""
    import uuid
    root = checkpoint_dir(df.sparkSession).rstrip("/")
    path = f"{root}/tables/{name}-{uuid.uuid4().hex}"
    df.write.mode("overwrite").parquet(path)
    _remember(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def node_buckets(spark: SparkSession) -> int:
    """Bucket count of page-keyed tables: ``spark.pagelens.buckets`` when
    set (size it so a bucket holds a few hundred MB of nodes), else two per
    core."""
    conf = spark.conf.get("spark.pagelens.buckets", None)
    return int(conf) if conf else max(8, 2 * spark.sparkContext.defaultParallelism)


def write_bucketed(df: DataFrame, name: str, key: str = "page_id", buckets: int | None = None,
                   sort_by=None, row_group_bytes: int | None = None) -> DataFrame:
    """Write ``df`` as a table bucketed (and sorted) by ``key`` under the
    shared checkpoint folder and read it back. Every later join, aggregate
    and window keyed by ``key`` (plus more columns) is then planned without
    a shuffle: the scan reports hash partitioning on ``key`` and
    ``spark.sql.requireAllClusterKeysForCoPartition=false`` lets joins on
    ``(key, x)`` use it. The caller hash-partitions the input by ``key``
    into ``buckets`` partitions first, so each task writes one file."""
    import uuid
    spark = df.sparkSession
    buckets = buckets or node_buckets(spark)
    if spark.conf.get("spark.sql.requireAllClusterKeysForCoPartition") != "false":
        warnings.warn("set spark.sql.requireAllClusterKeysForCoPartition=false, or joins on (page_id, x) shuffle", stacklevel=2)
    root = checkpoint_dir(spark).rstrip("/")
    table = f"pagelens_{name}_{uuid.uuid4().hex[:12]}"
    w = df.write.format("parquet").option("path", f"{root}/tables/{table}")
    if row_group_bytes:
        w = w.option("parquet.block.size", str(row_group_bytes))
    sort_cols = list(sort_by) if sort_by else [key]
    w.bucketBy(buckets, key).sortBy(*sort_cols).saveAsTable(table)
    _remember(spark, f"{root}/tables/{table}", table)
    return spark.table(table)


def ensure_parallel(df: DataFrame, key: str = "page_id", per_core: int = 2) -> DataFrame:
    """Spread a narrow input before per-row Python work. Only when it has
    fewer partitions than the cluster has cores (small inputs, a single
    file); a large input already has many splits and is left alone, so no
    extra shuffle of the raw data happens at scale. Nor is one added after a
    shuffle of the input's own, whose partitions are only known once it has
    run: to ask for them would run it twice."""
    want = df.sparkSession.sparkContext.defaultParallelism
    if df._jdf.queryExecution().executedPlan().nodeName() == "AdaptiveSparkPlan" or df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want * per_core, key)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
