"""Session construction and cluster-safe checkpoint handling."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

# Settings the operators are written for.  AQE re-plans joins at runtime
# (broadcast only after the actual size is known), coalesces small shuffle
# partitions and splits skewed join partitions.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(master: str = "local[*]", shuffle_partitions: int = 8,
                  app_name: str = "churnlens", extra: dict | None = None) -> SparkSession:
    builder = SparkSession.builder.master(master).appName(app_name)
    conf = dict(DEFAULT_CONF)
    conf["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    conf.update(extra or {})
    for k, v in conf.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once per application, so that
    Python tasks import it whatever folder the driver was started in.  (The
    executors need numpy, pyarrow and what the operators used import.)"""
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: use spark.addArtifacts
        return
    if sc.applicationId in _SHIPPED:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="churnlens-py-"), "churnlens.zip")
    with zipfile.ZipFile(path, "w") as z:
        for folder, _, files in os.walk(here):
            for f in sorted(files):
                if f.endswith(".py"):
                    full = os.path.join(folder, f)
                    z.write(full, os.path.join("churnlens", os.path.relpath(full, here)))
    sc.addPyFile(path)
    _SHIPPED.add(sc.applicationId)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Make sure ``Dataset.checkpoint`` has a reliable directory.

    The cluster names a shared folder in ``spark.checkpoint.dir``; that is
    always used when present.  Only a local-mode session (tests, bench) with
    no setting gets a private scratch folder.  On a cluster without the
    setting we refuse rather than write to a machine-local path.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - Spark Connect: the server owns the setting
        return spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        try:
            configured = spark.conf.get("spark.checkpoint.dir")
        except Exception:  # noqa: BLE001 - unset key
            configured = None
    if configured:
        sc.setCheckpointDir(configured)
        return sc.getCheckpointDir()
    if sc.master.startswith("local"):
        base = os.environ.get("TMPDIR", "/tmp")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="churnlens-ckpt-", dir=base))
        return sc.getCheckpointDir()
    raise RuntimeError(
        "spark.checkpoint.dir is not set; point it at a shared folder "
        "(e.g. an object-store or HDFS path) before running ranking operators")


def materialize(df):
    """Write ``df`` once to the shared checkpoint folder and return a frame
    over that copy (lineage cut).  Used by operators that must read their
    input more than once (ranking passes, snapshot + per-person rows), so
    the upstream plan runs once and a lost executor re-reads the copy
    instead of re-running the upstream."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def write_stage(df, partition_by=None):
    """Persist a stage output as a Parquet table in the shared checkpoint
    folder and return a frame over it.

    Unlike ``checkpoint()`` (serialized rows), later readers get column
    pruning, predicate pushdown, partition pruning on ``partition_by`` and
    real size statistics for AQE.  The lineage is cut at the table."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise RuntimeError("no shared checkpoint folder to write the stage to")
    path = f"{base.rstrip('/')}/stages/{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    # the declared schema skips footer inference and keeps partition types
    out = spark.read.schema(df.schema).parquet(path).select(*df.columns)
    out._churnlens_stage_path = path  # for release(); plain attribute
    return out


def write_bucketed(df, key: str, buckets: int | None = None):
    """Like :func:`write_stage`, but hashed into ``buckets`` (default: the
    shuffle partitions) by ``key`` and sorted by it: a later grouping, window
    or join by ``key`` reads the buckets in place, without an exchange.

    All rows of a key are one bucket, so reduce hot keys before.  The table
    is external; its name and path are attributes for the caller to drop."""
    import uuid

    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark)
    if not base:
        raise RuntimeError("no shared checkpoint folder to write the stage to")
    n = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    name = f"churnlens_{uuid.uuid4().hex}"
    path = f"{base.rstrip('/')}/stages/{name}"
    # the exchange uses the buckets' own hash: one file a bucket
    df.repartition(n, key).write.format("parquet").option("path", path) \
        .bucketBy(n, key).sortBy(key).saveAsTable(name)
    out = spark.table(name).select(*df.columns)
    out._churnlens_stage_path, out._churnlens_stage_table = path, name
    return out


def delete_path(spark, path: str) -> bool:
    """Recursively delete ``path`` on whatever file system it lives on
    (HDFS, object store, local) through Hadoop's FileSystem API."""
    jvm = spark.sparkContext._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    fs = hpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return bool(fs.delete(hpath, True))
