"""Session helpers: local sessions for tests / bench, checkpoint folder."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8,
                  app: str = "contentmark") -> SparkSession:
    """A local session configured like the cluster one (AQE, Arrow, UTC)."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the shared checkpoint folder named by the cluster.

    ``spark.checkpoint.dir`` is read from the session; only when it is unset
    (local tests) a private folder is created and registered.
    """
    sc = spark.sparkContext
    d = sc.getCheckpointDir()
    if d:
        return d
    d = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get(
        "spark.checkpoint.dir", None)
    if not d:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="contentmark-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_room: ContextVar[str | None] = ContextVar("contentmark_room", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[str]:
    """Gives the tables and folders the library writes inside the block a lifetime:
    they are removed at its end, after an error too.  Whatever reads them must
    have run by then (collected, or written to a place of its own).  Blocks
    nest; outside of any, tables stay until the checkpoint folder is cleared."""
    room = os.path.join(ensure_checkpoint_dir(spark), "contentmark-rooms", uuid.uuid4().hex)
    token = _room.set(room)
    try:
        yield room
    finally:
        _room.reset(token)
        path = spark._jvm.org.apache.hadoop.fs.Path(room)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def new_path(spark: SparkSession, kind: str, name: str) -> str:
    """A fresh path in the current room, or under the shared checkpoint folder."""
    base = _room.get() or ensure_checkpoint_dir(spark)
    return os.path.join(base, kind, f"{name}-{uuid.uuid4().hex}")


def materialize(df: DataFrame, name: str = "table", partition_by: str | None = None) -> DataFrame:
    """Cut lineage by writing ``df`` as a Parquet table into the shared
    checkpoint folder and reading it back.

    Used where one expensive table (shredded pages, blocks, fitted models)
    feeds several branches or scalar subqueries of a plan: it is computed
    once (one job - ``Dataset.checkpoint`` would run the plan twice), and a
    lost executor re-reads the table instead of re-parsing HTML.  ``scratch``
    gives such tables a lifetime.
    ``partition_by`` lets readers of one slice prune the others (the token
    table is written by ``kind``: node readers skip text rows and so on)."""
    spark = df.sparkSession
    path = new_path(spark, "contentmark-tables", name)
    w = df.write.mode("overwrite")
    if partition_by:
        w = w.partitionBy(partition_by)
    w.parquet(path)
    return spark.read.parquet(path)


def spread(df: DataFrame, key: str | None = None, factor: int = 2) -> DataFrame:
    """Parallelism guard for CPU-heavy row work: a scan with fewer splits
    than ``factor`` x the cluster's task slots (small files, a single row
    group) is spread first; large inputs keep their scan partitioning and
    pay no shuffle."""
    want = df.sparkSession.sparkContext.defaultParallelism * factor
    if df.rdd.getNumPartitions() >= want:
        return df
    return df.repartition(want, key) if key else df.repartition(want)


def table_path(sf_dir: str, name: str) -> str:
    return os.path.join(sf_dir, f"{name}.parquet")
