"""Session helpers for tests, the bench and scratch storage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

# Fixed values
#: Rows of a narrow table (about 100 bytes a row) that are still sent to every task.
BROADCAST_ROWS = 1_000_000


def local_session(cpus: int | str = "*", partitions: int = 8, app: str = "airfill") -> SparkSession:
    """A local session for tests and the bench. Production code never calls this:
    operators take the caller's session and leave its configuration alone."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor sees: what the cluster names in ``spark.checkpoint.dir``.

    The setting is only read, never changed. Where it is unset, a session with a local
    master (tests, the bench) gets a temporary folder for its lifetime; on a cluster that
    would be one machine's disk, so there the missing setting is an error."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not d:
        held = context._jsc.sc().getCheckpointDir()
        d = held.get() if held.isDefined() else None
    if not d:
        if not re.match(r"local(\[|$)", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="airfill-shared-")
        context.setCheckpointDir(d)
    return d


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path under the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


def checkpoint(df):
    """Reliable, eager checkpoint into the shared checkpoint folder (cuts lineage; a
    lost executor recomputes from the written files, not from the start)."""
    context = df.sparkSession.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def written(df, name: str, by: Sequence[str] = ()):
    """``df`` written as Parquet under the shared folder (in a folder per value of ``by``) and read
    back: cuts the lineage, keeps the columns prunable, survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def sent_if_small(df, rows: int | None = None):
    """``df`` with a broadcast hint where it has at most ``BROADCAST_ROWS`` rows (``rows``: their number, if known),
    else as it is. For tables that are cheap to count (written ones) and meet rows by the million: Spark's own
    limit is in bytes, and beyond it all of these rows are shuffled and sorted to meet them."""
    return F.broadcast(df) if (df.count() if rows is None else rows) <= BROADCAST_ROWS else df
