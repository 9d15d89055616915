"""Session helpers: a tuned local session for tests/bench, table loading and
lineage cuts that survive executor loss."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


#: Folders written by stage(), by application.
_STAGED: dict[str, list[str]] = {}


def build_session(master: str = "local[8]", shuffle_partitions: int = 8,
                  app_name: str = "logsight", time_zone: str = "UTC") -> SparkSession:
    """Session for tests and the benchmark. On a cluster, the deployment's own
    settings win (``getOrCreate`` returns the existing session)."""
    builder = (
        SparkSession.builder.master(master).appName(app_name)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.session.timeZone", time_zone)
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder the cluster names in
    ``spark.checkpoint.dir``; only when it is unset (tests, local runs) pick a
    fresh scratch folder."""
    sc = spark.sparkContext
    current = sc.getCheckpointDir()
    if current:
        return current
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured:
        if not sc.master.startswith("local"):
            # a driver-local folder is invisible to executors on a cluster
            raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
        configured = tempfile.mkdtemp(prefix="logsight-ckpt-")
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


#: Rows of one task of row-expensive work.
TASK_ROWS = 50_000


def spread(df: DataFrame) -> DataFrame:
    """Row-expensive work (regex parsing) on a table: its rows are dealt
    round-robin to tasks of about ``TASK_ROWS`` rows, at least one a core, unless
    it scans as that many splits. Splits are cut by bytes, so those of a narrow
    table hold millions of rows, and all rows of a row group fall to one of them.
    The count is read from the footers of the table's files."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    wanted = max(cores, -(-df.count() // TASK_ROWS))
    if df.rdd.getNumPartitions() < wanted:
        return df.repartition(wanted)
    return df


def stage(df: DataFrame, name: str, schema: StructType | None = None, partition_by: str | None = None) -> DataFrame:
    """Write ``df`` as parquet under the shared checkpoint folder and read it
    back (as ``schema``, if given; by the integer column ``partition_by``, if given, in folders): later passes scan the columnar copy (pruned, filter-pushed) instead
    of recomputing the upstream plan, and a lost executor only costs a
    re-read. Used where one expensive plan feeds several jobs."""
    spark = df.sparkSession
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/logsight-stage/{name}-{uuid.uuid4().hex}"
    writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
    if partition_by and schema is None:
        schema = df.schema  # an empty table has no folders to tell the column by
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return (spark.read.schema(schema) if schema else spark.read).parquet(path)


def drop_stages(spark: SparkSession) -> int:
    """Delete what :func:`stage` has written in this application, once the
    results that read it are written. Returns the number of folders."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = hadoop.Path(p)
        path.getFileSystem(conf).delete(path, True)
    return len(paths)
